"""The driver's tables in the canonical shape, as frames and as the same relations in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Tables = dict[str, DataFrame]


def canonical(spark: SparkSession, sf_dir: str) -> Tables:
    """The seven canonical tables and the address ranges, derived from orders, lineitem and events."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    orders, items, events = read("orders"), read("lineitem"), read("events")
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    txid = F.concat(F.lit("T"), F.col("l_orderkey"))
    place = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")

    def side(rows: DataFrame, index: str, address, amount) -> DataFrame:
        return rows.select(txid.alias("txid"), (F.row_number().over(place) - 1).cast("long").alias(index), F.concat(F.lit("A"), address).alias("address"), amount.alias("amount_sats"))

    k = F.get_json_object("props", "$.k").cast("long")
    home = lambda n: F.concat(F.lit("10.0."), F.floor(n / 256), F.lit("."), n % 256)
    observed = events.select(
        F.concat(F.lit("O"), "event_id").alias("observation_id"), F.concat(F.lit("T"), F.col("event_id") % 1500).alias("txid"), F.col("ts").alias("observed_at"), home(F.col("user_id")).alias("src_ip"),
        F.when(k < 20, home(k)).otherwise(F.concat(F.lit("192.168.1."), k)).alias("dst_ip"), (1024 + F.col("user_id") % 5).cast("long").alias("src_port"), (8000 + k % 7).cast("long").alias("dst_port"),
        F.upper(F.substring("event_type", 1, 2)).alias("reported_geo_country"), F.when(k % 10 != 0, 64512 + k % 13).cast("long").alias("reported_asn"), F.concat(F.lit("S"), "event_id").alias("source_record_id"),
    )
    return {
        "transactions": orders.select(F.concat(F.lit("T"), "o_orderkey").alias("txid"), cents("o_totalprice").alias("fee_sats"), F.col("o_orderpriority").alias("script_type")),
        "transaction_inputs": side(items.filter("l_linenumber <= 3"), "input_index", F.col("l_suppkey") * 300 + F.col("l_orderkey") % 300, cents("l_extendedprice")),
        "transaction_outputs": side(items.filter("l_linenumber > 3"), "output_index", F.col("l_partkey") * 15 + F.col("l_orderkey") % 15, F.round(F.col("l_extendedprice") / 10000).cast("long") * 1_000_000),
        "network_observations": observed,
        "transaction_sources": observed.select("txid", "source_record_id"),
        "source_records": events.select(F.concat(F.lit("S"), "event_id").alias("source_record_id"), F.lit("events").alias("source_file"), F.lit("json").alias("source_format"), F.sha2(F.lit("events"), 256).alias("source_file_sha256"), F.col("event_id").cast("long").alias("record_index")),
        "rejected_records": events.filter("value > 50").select(F.concat(F.lit("S"), "event_id").alias("source_record_id"), F.lit("events").alias("source_file"), F.col("event_id").cast("long").alias("record_index"), F.lit("INVALID_AMOUNT").alias("error_code"), F.lit("amount is too large").alias("error_message"), F.lit("value").alias("field_name")),
    }


def address_of(host):
    """The IPv4 address of a host by its number, as the SQL counts it.

    Hosts of users from 65,536 on are named with a third part beyond 255 (10.0.300.5), which no address has; their number's address
    is 10.1.44.5.
    """
    part = F.split(host, "\\.")
    number = sum((part[i].cast("long") * (1 << (8 * (3 - i))) for i in range(4)), F.lit(0).cast("long"))
    return F.when(number.isNotNull(), F.concat_ws(".", *[F.shiftright(number, 8 * (3 - i)).bitwiseAND(F.lit(255)) for i in range(4)]))


def host_of(address):
    """The host that :func:`address_of` gave this address; those of 192.168.1 go by their address."""
    part = F.split(address, "\\.")
    third = ((part[0].cast("long") - 10) * 256 + part[1].cast("long")) * 256 + part[2].cast("long")
    return F.when(address.startswith("192.168.1."), address).otherwise(F.concat(F.lit("10.0."), third, F.lit("."), part[3]))


#: Networks of the enrichment examples: network, country, system number, holder.
NETWORKS = (
    ("10.0.0.0/25", "IN", 64500, "North"), ("10.0.0.0/16", "US", 64501, "South"), ("10.0.0.64/26", "BR", 64503, "East"),
    ("192.168.1.0/26", "DE", 64502, "West"), ("192.168.1.64/27", "IN", 64500, "North"),
)

_HOME = "'10.0.' || cast({0} // 256 AS VARCHAR) || '.' || cast({0} % 256 AS VARCHAR)"
_PLACE = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1"

#: The canonical relations for DuckDB: name and body.
SQL_TABLES: dict[str, str] = {
    "transactions": "SELECT 'T' || o_orderkey AS txid, cast(round(o_totalprice * 100) AS BIGINT) AS fee_sats, o_orderpriority AS script_type FROM orders",
    "transaction_inputs": f"SELECT 'T' || l_orderkey AS txid, cast({_PLACE} AS BIGINT) AS input_index, 'A' || (l_suppkey * 300 + l_orderkey % 300) AS address, cast(round(l_extendedprice * 100) AS BIGINT) AS amount_sats FROM lineitem WHERE l_linenumber <= 3",
    "transaction_outputs": f"SELECT 'T' || l_orderkey AS txid, cast({_PLACE} AS BIGINT) AS output_index, 'A' || (l_partkey * 15 + l_orderkey % 15) AS address, cast(round(l_extendedprice / 10000) AS BIGINT) * 1000000 AS amount_sats FROM lineitem WHERE l_linenumber > 3",
    "network_observations": f"""SELECT 'O' || event_id AS observation_id, 'T' || (event_id % 1500) AS txid, ts AS observed_at, {_HOME.format("user_id")} AS src_ip,
        CASE WHEN k < 20 THEN {_HOME.format("k")} ELSE '192.168.1.' || k END AS dst_ip, cast(1024 + user_id % 5 AS BIGINT) AS src_port, cast(8000 + k % 7 AS BIGINT) AS dst_port,
        upper(event_type[1:2]) AS reported_geo_country, CASE WHEN k % 10 <> 0 THEN cast(64512 + k % 13 AS BIGINT) END AS reported_asn, 'S' || event_id AS source_record_id
        FROM (SELECT *, cast(json_extract(props, '$.k') AS BIGINT) AS k FROM events)""",
    "transaction_sources": "SELECT txid, source_record_id FROM network_observations",
    "source_records": "SELECT 'S' || event_id AS source_record_id, 'events' AS source_file, 'json' AS source_format, sha256('events') AS source_file_sha256, cast(event_id AS BIGINT) AS record_index FROM events",
    "rejected_records": "SELECT 'S' || event_id AS source_record_id, cast(event_id AS BIGINT) AS record_index, 'INVALID_AMOUNT' AS error_code FROM events WHERE value > 50",
}


def with_tables(sql: str, *extra: tuple[str, str], recursive: bool = False) -> str:
    """``sql`` with the canonical relations it, or what it uses, names; and further named relations."""
    named = [*SQL_TABLES.items(), *extra]
    text, used = sql, []
    for name, body in reversed(named):
        if name.split("(")[0] in text:
            used.append(f"{name} AS ({body})")
            text += " " + body
    return f"WITH {'RECURSIVE ' * recursive}" + ",\n".join(reversed(used)) + "\n" + sql
