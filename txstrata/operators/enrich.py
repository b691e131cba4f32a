"""Enrichment of distinct IPs by longest matching network, and address classes."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.addresses import CLASSES, classes_of, key_of, range_of

#: Rows of a range table up to which it is sent to all tasks; larger ones are joined by address blocks.
BROADCAST_RANGES = 200_000


def distinct_ips(observations: DataFrame) -> DataFrame:
    """Every endpoint once."""
    return observations.select(F.explode(F.array("src_ip", "dst_ip")).alias("ip")).distinct()


def range_table(spark: SparkSession, networks: Iterable[tuple[str, str | None, int | None, str | None]]) -> DataFrame:
    """Ranges (first, last, bits, country_code, asn, holder, network) from (network, country, number, holder)."""
    rows = [(*range_of(n), c, a, h, n) for n, c, a, h in networks]
    return spark.createDataFrame(rows, "first string, last string, bits int, country_code string, asn long, holder string, network string")


@F.pandas_udf(T.StringType())
def _key(ip: pd.Series) -> pd.Series:
    return ip.map(lambda x: None if x is None else key_of(x))


#: Dotted IPv4 text in its canonical form.
_PART = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_IPV4 = rf"^({_PART}\.){{3}}{_PART}$"


def with_keys(ips: DataFrame) -> DataFrame:
    """(ip, key): IPv4 texts by expressions, only others by Python."""
    part = F.split("ip", "\\.")
    number = sum((part[i].cast("long") * (1 << (8 * (3 - i))) for i in range(4)), F.lit(0).cast("long"))
    four = ips.filter(F.col("ip").rlike(_IPV4)).select("ip", F.concat(F.lit("4"), F.lpad(F.lower(F.hex(number)), 32, "0")).alias("key"))
    return four.unionByName(ips.filter(~F.coalesce(F.col("ip").rlike(_IPV4), F.lit(False))).select("ip", _key("ip").alias("key")))


def enrich(ips: DataFrame, ranges: DataFrame) -> DataFrame:
    """One row per IP: country, number, holder and network of its longest match; misses are null and marked.

    Networks nest, so an address matches at most one of each prefix length.
    Each length that occurs is joined by equality on the network's own key,
    which needs no range comparison and works at any size; a table of at most
    BROADCAST_RANGES rows is sent to the tasks.
    """
    lengths = sorted({(r["first"][0], r["bits"]) for r in ranges.select("first", "bits").distinct().collect()})
    small = ranges.limit(BROADCAST_RANGES + 1).count() <= BROADCAST_RANGES
    keyed = with_keys(ips.select("ip"))
    starts = F.array(*[F.struct(F.lit(b).alias("bits"), _network_start(F.col("key"), v, b).alias("first")) for v, b in lengths]) if lengths else F.array().cast("array<struct<bits:int,first:string>>")
    tries = keyed.select("ip", F.explode(F.filter(starts, lambda s: s["first"].isNotNull())).alias("s")).select("ip", F.col("s.first").alias("first"), F.col("s.bits").alias("bits"))
    side = F.broadcast(ranges) if small else ranges
    best = tries.join(side, ["first", "bits"]).groupBy("ip").agg(F.max_by(F.struct("country_code", "asn", "holder", "network"), "bits").alias("m"))
    out = keyed.join(best, "ip", "left")
    return out.select("ip", "m.country_code", "m.asn", "m.holder", "m.network", F.col("m.country_code").isNotNull().alias("country_found"), F.col("m.asn").isNotNull().alias("asn_found"))


def _network_start(key, family: str, bits: int):
    """The first address of the key's network of a prefix length; null for the other family."""
    total = 32 if family == "4" else 128
    digits, rest = divmod(total - bits, 4)
    body = F.substring(key, 1, 33 - digits - (1 if rest else 0))
    if rest:
        digit = F.conv(F.substring(key, 33 - digits, 1), 16, 10).cast("int")
        body = F.concat(body, F.lower(F.hex(digit.bitwiseAND(F.lit(~((1 << rest) - 1) & 15)))))
    return F.when(key.startswith(family), F.concat(body, F.lit("0" * digits)))


def address_classes(ips: DataFrame, address: str = "ip") -> DataFrame:
    """IP, version and the six class flags of distinct IPs; null where the text is no address.

    ``address`` names the column that is classified, where IPs go by other names.
    """

    def run(batches):
        for pdf in batches:
            rows = [(ip, *classes_of(a)) for ip, a in zip(pdf["ip"], pdf["a"], strict=True)]
            yield pd.DataFrame(rows, columns=["ip", "ip_version", *CLASSES], dtype=object)

    return ips.select("ip", F.col(address).alias("a")).mapInPandas(run, "ip string, ip_version int, " + ", ".join(f"{c} boolean" for c in CLASSES))


def lookup_counts(enrichment: DataFrame) -> DataFrame:
    """One row: how many addresses were looked up and how many of them each kind of range knew."""
    found = lambda c: F.count_if(c)
    return enrichment.agg(
        F.count("*").alias("lookups"), found("country_found").alias("country_hits"), found(~F.col("country_found")).alias("country_misses"),
        found("asn_found").alias("asn_hits"), found(~F.col("asn_found")).alias("asn_misses"), found(F.col("country_found") & F.col("asn_found")).alias("both"),
    )


def value_checks(enrichment: DataFrame, ranges: DataFrame) -> DataFrame:
    """(code, breaches): stored rows that looking their address up again doesn't give."""
    from .integrity import bag_difference, tagged

    columns = ("ip", "country_code", "asn", "holder", "network", "country_found", "asn_found")
    return tagged("ENRICHMENT_VALUE_MISMATCH", bag_difference(enrichment.select(*columns), enrich(enrichment.select("ip"), ranges).select(*columns)))
