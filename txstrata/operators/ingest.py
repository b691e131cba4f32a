"""Canonical tables from validated records: provenance, quarantine, first definition of a transaction, explosion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Tables = dict[str, DataFrame]


def canonical_tables(records: DataFrame) -> Tables:
    """The seven tables.

    A transaction is what its first valid record says.  A later record that
    says something else is rejected and shows no observation; one that says the
    same adds its observation.
    """
    source = F.sha2(F.concat(F.lit("source-record:"), "source_file_sha256", F.lit(":"), F.col("record_index")), 256)
    rows = records.withColumn("source_record_id", source)
    stated = F.struct("fee_sats", "script_type", "inputs", "outputs")
    first = W.partitionBy("txid").orderBy("record_index", "source_record_id")
    valid = rows.filter("error_code IS NULL").withColumn("stated", stated).withColumn("is_first", F.row_number().over(first) == 1).withColumn("agreed", F.first("stated").over(first).eqNullSafe(F.col("stated")))
    accepted, clash = valid.filter("agreed"), valid.filter("NOT agreed")
    definitions = accepted.filter("is_first")

    def side(name: str) -> DataFrame:
        exploded = definitions.select("txid", F.posexplode(f"{name}s").alias("p", "e"))
        return exploded.select("txid", F.col("p").cast("long").alias(f"{name}_index"), "e.address", "e.amount_sats")

    refused = ("source_record_id", "source_file", "record_index")
    conflict = clash.select(*refused, F.lit("TXID_CONTENT_CONFLICT").alias("error_code"), F.concat(F.lit("txid "), "txid", F.lit(" conflicts with an earlier accepted definition")).alias("error_message"), F.lit("txid").alias("field_name"))
    broken = rows.filter("error_code IS NOT NULL").select(*refused, "error_code", "error_message", "field_name")
    return {
        "transactions": definitions.select("txid", "fee_sats", "script_type"),
        "transaction_inputs": side("input"),
        "transaction_outputs": side("output"),
        "network_observations": accepted.select(
            F.sha2(F.concat(F.lit("network-observation:"), "source_record_id"), 256).alias("observation_id"), "txid", "observed_at", "src_ip", "dst_ip", "src_port", "dst_port", "reported_geo_country", "reported_asn", "source_record_id"
        ),
        "transaction_sources": accepted.select("txid", "source_record_id"),
        "source_records": rows.select("source_record_id", "source_file", "source_format", "source_file_sha256", "record_index"),
        "rejected_records": broken.unionByName(conflict),
    }
