"""Queries of a published store from the command line, as lines of JSON."""

from __future__ import annotations

import argparse
import json
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from .operators import integrity, lookups
from .operators.ingest import canonical_tables
from .sources.records import read_records
from .sources.store import open_store, publish, unchanged

VERSION = "1"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="txstrata", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, **options) -> None:
        sub = commands.add_parser(name, help=about)
        sub.add_argument("--dataset", required=True, help="a published store")
        for option, settings in options.items():
            sub.add_argument(f"--{option}", **settings)

    command("ingest", "read records and publish their canonical tables", source={"required": True})
    command("validate", "count breaches of the integrity rules")
    command("tx", "one transaction", txid={"required": True})
    command("address", "the activity of an address", address={"required": True})
    command("high-value", "transactions by what they pay out", limit={"type": int, "default": 20})
    command("high-fee", "transactions by fee", limit={"type": int, "default": 20})
    command("ip", "the activity of an IP", ip={"required": True})
    command("asn", "the activity of a reported system number", asn={"type": int, "required": True})
    command("temporal", "observations by UTC hour or day", bucket={"choices": ("hour", "day"), "required": True}, start={"type": datetime.fromisoformat}, end={"type": datetime.fromisoformat})
    return top


def answer(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """The rows that a command asks for."""
    if args.command == "ingest":
        before = unchanged(spark, args.source)
        publish(canonical_tables(read_records(spark, args.source)), args.dataset, VERSION, check=lambda _: unchanged(spark, args.source, before))
        tables, _ = open_store(spark, args.dataset, VERSION)
        return integrity.together([integrity.tagged(name, frame) for name, frame in sorted(tables.items())]).withColumnsRenamed({"code": "table", "breaches": "rows"})
    t, _ = open_store(spark, args.dataset, VERSION, verify=args.command == "validate")
    if args.command == "temporal":
        return lookups.temporal_activity(t, args.bucket, args.start, args.end)
    return {
        "validate": lambda: integrity.canonical_checks(t), "tx": lambda: lookups.transaction_rows(t, args.txid), "address": lambda: lookups.address_activity(t, args.address), "high-value": lambda: lookups.high_value_transactions(t, args.limit),
        "high-fee": lambda: lookups.high_fee_transactions(t, args.limit), "ip": lambda: lookups.ip_activity(t, args.ip), "asn": lambda: lookups.asn_activity(t, args.asn),
    }[args.command]()


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Prints the answer; the status is 1 if a validation found breaches."""
    args = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("txstrata").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    breaches = 0
    for row in answer(spark, args).toLocalIterator():
        print(json.dumps(row.asDict(recursive=True), default=str))
        breaches += args.command == "validate" and row["breaches"]
    return int(breaches > 0)
