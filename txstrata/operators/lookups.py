"""The named analytical queries over canonical tables; each returns a frame and collects nothing."""

from __future__ import annotations

import re
from datetime import datetime
from ipaddress import ip_address

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Tables = dict[str, DataFrame]

BUCKETS = ("hour", "day")


def checked_limit(limit: int) -> int:
    """A limit between 1 and 1000."""
    if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= 1000:
        raise ValueError("limit must be an integer between 1 and 1000")
    return limit


def checked_txid(txid: str) -> str:
    """64 hexadecimal digits, in lower case."""
    found = txid.strip().lower() if isinstance(txid, str) else ""
    if not re.fullmatch(r"[0-9a-f]{64}", found):
        raise ValueError("txid must contain exactly 64 hexadecimal characters")
    return found


def checked_address(address: str) -> str:
    found = address.strip() if isinstance(address, str) else ""
    if not found:
        raise ValueError("address must not be empty")
    return found


def checked_ip(ip: str) -> str:
    """The canonical form of an IPv4 or IPv6 address."""
    return str(ip_address(ip.strip()))


def exact_sum(column: str | Column) -> Column:
    """A sum that does not overflow 64 bits."""
    return F.sum((F.col(column) if isinstance(column, str) else column).cast("decimal(38,0)")).cast("decimal(38,0)")


def transaction_summary(t: Tables) -> DataFrame:
    """One row per transaction: counts and exact totals of both sides, and its observations.

    Each side is aggregated before it is joined, so no side multiplies another.
    """
    zero = F.lit(0).cast("decimal(38,0)")

    def side(name: str) -> DataFrame:
        return t[f"transaction_{name}s"].groupBy("txid").agg(F.count("*").alias(f"{name}_count"), exact_sum("amount_sats").alias(f"total_{name}_sats"))

    seen = t["network_observations"].groupBy("txid").agg(F.count("*").alias("observation_count"), F.min("observed_at").alias("first_observed_at"), F.max("observed_at").alias("last_observed_at"))
    joined = t["transactions"].join(side("input"), "txid", "left").join(side("output"), "txid", "left").join(seen, "txid", "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return joined.select(
        "txid", "fee_sats", "script_type", count("input_count"), count("output_count"), F.coalesce("total_input_sats", zero).alias("total_input_sats"),
        F.coalesce("total_output_sats", zero).alias("total_output_sats"), count("observation_count"), "first_observed_at", "last_observed_at",
    )


def transaction_detail(t: Tables, txid: str) -> dict[str, DataFrame]:
    """The five parts of one transaction, in order; each filter reaches its scan."""
    of = F.col("txid") == txid
    return {
        "transaction": t["transactions"].filter(of),
        "inputs": t["transaction_inputs"].filter(of).orderBy("input_index"),
        "outputs": t["transaction_outputs"].filter(of).orderBy("output_index"),
        "observations": t["network_observations"].filter(of).orderBy("observed_at", "observation_id"),
        "provenance": t["transaction_sources"].filter(of).join(t["source_records"], "source_record_id").orderBy("record_index"),
    }


def transaction_rows(t: Tables, txid: str) -> DataFrame:
    """The parts of one transaction as rows (part, position, key, amount)."""
    part = transaction_detail(t, txid)

    def rows(name: str, position, key, amount=None) -> DataFrame:
        frame = part[name]
        return frame.select(F.lit(name).alias("part"), position.cast("long").alias("position"), key.alias("key"), (F.lit(None) if amount is None else amount).cast("long").alias("amount"))

    stated = rows("transaction", F.lit(0), F.col("script_type"), F.col("fee_sats"))
    sides = rows("inputs", F.col("input_index"), F.col("address"), F.col("amount_sats")).union(rows("outputs", F.col("output_index"), F.col("address"), F.col("amount_sats")))
    return stated.union(sides).union(rows("observations", F.unix_micros(F.col("observed_at").cast("timestamp")), F.col("observation_id"))).union(rows("provenance", F.col("record_index"), F.col("source_record_id")))


def address_activity(t: Tables, address: str) -> DataFrame:
    """One row: transactions, roles, exact totals and the time range of an address; zeros if unknown."""
    own = {s: t[f"transaction_{s}s"].filter(F.col("address") == address).select("txid", "amount_sats") for s in ("input", "output")}
    txids = own["input"].select("txid").union(own["output"].select("txid")).distinct()
    one = [own[s].agg(F.count("*").alias(f"{s}_count"), F.coalesce(exact_sum("amount_sats"), F.lit(0).cast("decimal(38,0)")).alias(f"total_{s}_sats")) for s in own]
    seen = t["network_observations"].join(txids, "txid", "left_semi").agg(F.min("observed_at").alias("first_observed_at"), F.max("observed_at").alias("last_observed_at"))
    return txids.agg(F.count("*").alias("transaction_count")).crossJoin(one[0]).crossJoin(one[1]).crossJoin(seen).select(F.lit(address).alias("address"), "*")


def high_value_transactions(t: Tables, limit: int = 20) -> DataFrame:
    return transaction_summary(t).select("txid", "total_output_sats", "fee_sats", "input_count", "output_count").orderBy(F.desc("total_output_sats"), "txid").limit(checked_limit(limit))


def fee_ratio(total: str = "total_input_sats") -> Column:
    """The fee over the inputs, null without inputs."""
    return F.when(F.coalesce(total, F.lit(0)) != 0, F.col("fee_sats").cast("double") / F.col(total).cast("double"))


def high_fee_transactions(t: Tables, limit: int = 20) -> DataFrame:
    return transaction_summary(t).select("txid", "fee_sats", "total_input_sats", fee_ratio().alias("fee_to_input_ratio")).orderBy(F.desc("fee_sats"), "txid").limit(checked_limit(limit))


def transaction_summaries(t: Tables, limit: int = 100) -> DataFrame:
    return transaction_summary(t).orderBy("txid").limit(checked_limit(limit))


def endpoints(observations: DataFrame) -> DataFrame:
    """Two rows per observation, one for each endpoint, with its role and port."""
    side = lambda r: observations.select(F.col(f"{r}_ip").alias("ip"), F.lit(r).alias("role"), F.col(f"{r}_port").alias("port"), "observation_id", "txid", "observed_at", "reported_asn", "reported_geo_country")
    return side("src").unionByName(side("dst"))


def ip_activity(t: Tables, ip: str) -> DataFrame:
    """One row: observations by role, transactions, ports, system numbers, countries and range of an IP."""
    rows = endpoints(t["network_observations"]).filter(F.col("ip") == ip)
    return rows.agg(
        F.count_distinct("observation_id").alias("observation_count"), F.count_distinct("txid").alias("transaction_count"), F.count_if(F.col("role") == "src").alias("source_count"),
        F.count_if(F.col("role") == "dst").alias("destination_count"), F.sort_array(F.collect_set("port")).alias("ports"), F.sort_array(F.collect_set("reported_asn")).alias("asns"),
        F.sort_array(F.collect_set("reported_geo_country")).alias("countries"), F.min("observed_at").alias("first_observed_at"), F.max("observed_at").alias("last_observed_at"),
    ).select(F.lit(ip).alias("ip"), "*")


def asn_activity(t: Tables, asn: int) -> DataFrame:
    rows = t["network_observations"].filter(F.col("reported_asn") == asn)
    ips = rows.select(F.explode(F.array("src_ip", "dst_ip")).alias("ip")).agg(F.count_distinct("ip").alias("ip_count"))
    own = rows.agg(F.count("*").alias("observation_count"), F.count_distinct("txid").alias("transaction_count"), F.min("observed_at").alias("first_observed_at"), F.max("observed_at").alias("last_observed_at"))
    return own.crossJoin(ips).select(F.lit(asn).cast("long").alias("asn"), "*")


def temporal_activity(t: Tables, bucket: str, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Observations, transactions and sources in each bucket with any, within [start, end)."""
    if bucket not in BUCKETS:
        raise ValueError(f"bucket must be one of {BUCKETS}")
    rows = t["network_observations"]
    if start is not None:
        rows = rows.filter(F.col("observed_at") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        rows = rows.filter(F.col("observed_at") < F.lit(end).cast("timestamp_ntz"))
    at = F.date_trunc(bucket, F.col("observed_at").cast("timestamp")).cast("timestamp_ntz")
    return rows.groupBy(at.alias("bucket_start")).agg(F.count("*").alias("observation_count"), F.count_distinct("txid").alias("transaction_count"), F.count_distinct("src_ip").alias("source_ip_count"))


def summary_scan(t: Tables) -> DataFrame:
    return transaction_summary(t).agg(F.count("*").alias("n"), exact_sum("total_output_sats").alias("output_sats"), F.sum("observation_count").alias("observations"))


def layout_queries(observations: DataFrame, txid: str, start: datetime, end: datetime) -> DataFrame:
    """(query, rows, transactions): a whole scan, one transaction, and a range of time, as layouts of a table are compared by."""
    at = F.col("observed_at")
    within = (at >= F.lit(start).cast("timestamp_ntz")) & (at < F.lit(end).cast("timestamp_ntz"))
    parts = (("full_scan", observations), ("selective_txid", observations.filter(F.col("txid") == txid)), ("time_range", observations.filter(within)))
    counted = [f.agg(F.count("*").alias("rows"), F.count_distinct("txid").alias("transactions")).select(F.lit(name).alias("query"), "rows", "transactions") for name, f in parts]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])
