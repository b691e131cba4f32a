"""Integrity checks: each is a relational query that counts rows in breach of a rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Tables = dict[str, DataFrame]

#: Child table, key, parent table, parent key, for each code.
ORPHANS = {
    "ORPHAN_TRANSACTION_INPUT": ("transaction_inputs", "txid", "transactions", "txid"),
    "ORPHAN_TRANSACTION_OUTPUT": ("transaction_outputs", "txid", "transactions", "txid"),
    "ORPHAN_NETWORK_OBSERVATION_TXID": ("network_observations", "txid", "transactions", "txid"),
    "ORPHAN_NETWORK_OBSERVATION_SOURCE": ("network_observations", "source_record_id", "source_records", "source_record_id"),
    "ORPHAN_TRANSACTION_SOURCE_TXID": ("transaction_sources", "txid", "transactions", "txid"),
    "ORPHAN_TRANSACTION_SOURCE_RECORD": ("transaction_sources", "source_record_id", "source_records", "source_record_id"),
    "ORPHAN_REJECTED_SOURCE_RECORD": ("rejected_records", "source_record_id", "source_records", "source_record_id"),
}
KEYS = {
    "DUPLICATE_TRANSACTION": ("transactions", ("txid",)),
    "DUPLICATE_TRANSACTION_INPUT": ("transaction_inputs", ("txid", "input_index")),
    "DUPLICATE_TRANSACTION_OUTPUT": ("transaction_outputs", ("txid", "output_index")),
    "DUPLICATE_NETWORK_OBSERVATION": ("network_observations", ("observation_id",)),
    "DUPLICATE_TRANSACTION_SOURCE": ("transaction_sources", ("txid", "source_record_id")),
    "DUPLICATE_SOURCE_RECORD": ("source_records", ("source_record_id",)),
}
NOT_NEGATIVE = {
    "NEGATIVE_INPUT_AMOUNT": ("transaction_inputs", "amount_sats"),
    "NEGATIVE_OUTPUT_AMOUNT": ("transaction_outputs", "amount_sats"),
    "NEGATIVE_TRANSACTION_FEE": ("transactions", "fee_sats"),
    "NEGATIVE_INPUT_INDEX": ("transaction_inputs", "input_index"),
    "NEGATIVE_OUTPUT_INDEX": ("transaction_outputs", "output_index"),
}


def tagged(code: str, frame: DataFrame, count=None) -> DataFrame:
    """One row (code, breaches)."""
    return frame.agg(F.coalesce(F.count("*") if count is None else count, F.lit(0)).cast("long").alias("breaches")).select(F.lit(code).alias("code"), "breaches")


def together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows of ``child`` without a parent."""
    return child.join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def excess(frame: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Keys that occur more than once, and how many rows too many each has."""
    return frame.groupBy(*keys).agg((F.count("*") - 1).alias("excess")).filter("excess > 0")


def orphan_checks(t: Tables) -> DataFrame:
    return together([tagged(code, orphans(t[c], k, t[p], pk)) for code, (c, k, p, pk) in ORPHANS.items()])


def duplicate_checks(t: Tables) -> DataFrame:
    return together([tagged(code, excess(t[n], keys), F.sum("excess")) for code, (n, keys) in KEYS.items()])


def negative_checks(t: Tables) -> DataFrame:
    return together([tagged(code, t[n].filter(F.col(c) < 0)) for code, (n, c) in NOT_NEGATIVE.items()])


def canonical_checks(t: Tables) -> DataFrame:
    """All rules over the seven canonical tables."""
    return together([orphan_checks(t), duplicate_checks(t), negative_checks(t)])


def row_count_mismatches(t: Tables, expected: dict[str, int]) -> DataFrame:
    """MANIFEST_ROW_COUNT_MISMATCH for every table whose rows differ from the manifest's."""
    counted = together([t[n].agg(F.count("*").alias("found")).select(F.lit(n).alias("table"), F.lit(k).cast("long").alias("stated"), "found") for n, k in expected.items()])
    return counted.filter("found <> stated").select(F.lit("MANIFEST_ROW_COUNT_MISMATCH").alias("code"), "table", "stated", "found")


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in one set only, with their side."""
    return a.subtract(b).withColumn("side", F.lit("left")).union(b.subtract(a).withColumn("side", F.lit("right")))


def bag_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one bag has more often, with their side."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).union(b.exceptAll(a).withColumn("side", F.lit("right")))


#: Which columns of a feature table are counts, ratios or times.
RATIOS = ("ip_reuse_ratio", "source_destination_country_match_rate", "source_destination_asn_match_rate")


def feature_checks(name: str, frame: DataFrame, key: str, known: DataFrame, cutoff=None) -> DataFrame:
    """Unique and known keys, no negative or infinite values, ratios within 0 and 1, nothing after the cutoff."""
    kinds = dict(frame.dtypes)
    numbers = [c for c, k in kinds.items() if k in ("bigint", "int", "double")]
    doubles = [c for c in numbers if kinds[c] == "double"]
    some = lambda tests: reduce(lambda a, b: a | b, tests, F.lit(False))
    parts = [
        tagged(f"DUPLICATE_{name}_FEATURE", frame, F.count(key) - F.count_distinct(key)),
        tagged(f"UNKNOWN_{name}_FEATURE", orphans(frame, key, known, key)),
        tagged(f"NEGATIVE_{name}_VALUE", frame.filter(some([F.col(c) < 0 for c in numbers if "entropy" not in c]))),
        tagged(f"NONFINITE_{name}_VALUE", frame.filter(some([F.isnan(c) | (F.abs(c) == float("inf")) for c in doubles]))),
        tagged(f"{name}_RATIO_OUT_OF_RANGE", frame.filter(some([~F.col(c).between(0, 1) for c in RATIOS if c in kinds]))),
    ]
    if cutoff is not None:
        parts.append(tagged(f"{name}_AFTER_CUTOFF", frame.filter(some([F.col(c) > F.lit(cutoff).cast("timestamp_ntz") for c in kinds if c.endswith("_observed_at")]))))
    return together(parts)


def enrichment_checks(enrichment: DataFrame, observed: DataFrame) -> DataFrame:
    """Rules over enriched IPs: one row each, the observed set, and consistent values and marks."""
    return together(
        [
            tagged("DUPLICATE_ENRICHMENT_IP", excess(enrichment, ("ip",)), F.sum("excess")),
            tagged("CANONICAL_IP_SET_MISMATCH", set_difference(enrichment.select("ip"), observed.select("ip"))),
            tagged("INVALID_COUNTRY_VALUE", enrichment.filter(~F.col("country_code").rlike("^[A-Z]{2}$"))),
            tagged("INVALID_ASN_VALUE", enrichment.filter(~F.col("asn").between(0, 4294967295))),
            tagged("COUNTRY_FOUND_INCONSISTENT", enrichment.filter(F.col("country_found") != F.col("country_code").isNotNull())),
            tagged("ASN_FOUND_INCONSISTENT", enrichment.filter(F.col("asn_found") != F.col("asn").isNotNull())),
        ]
    )


def sample(rows: DataFrame, key: str, n: int = 100) -> DataFrame:
    """The first ``n`` rows by key, the same in every run."""
    return rows.orderBy(key).limit(n)


def correlation_checks(correlation: DataFrame, addresses: DataFrame) -> DataFrame:
    """Whether the correlation table has the addresses of the address table."""
    return tagged("CORRELATION_ADDRESS_SET_MISMATCH", set_difference(correlation.select("address"), addresses.select("address")))
