"""Queries by name, each with the SQL it is compared with."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


#: Places after the point to which doubles are compared; fewer for amounts, whose doubles hold no more, and more for ratios to
#: round amounts, which have ties at nine.
PLACES = 9
AMOUNTS = ((re.compile(r"mean_(input|output)_sats"), 4), (re.compile(r"(input|output)_value_std"), 2), (re.compile(r"input_output_value_ratio"), 12))
#: Means of whole microseconds have ties at nine places, which engines round by the last bit; this much is added first.
SHIFT = {"mean_inter_observation_seconds": 3e-11}


def comparable(frame: DataFrame) -> DataFrame:
    """The comparison layer: doubles to ``PLACES`` places and exact sums as 64-bit integers, so that two engines give the same cells.

    Operators give full precision; only what is compared with SQL goes through here.
    """
    kinds = dict(frame.dtypes)

    def cell(name: str):
        if kinds[name] in ("double", "float"):
            places = next((n for pattern, n in AMOUNTS if pattern.fullmatch(name)), PLACES)
            return F.round(F.col(name).cast("double") + SHIFT.get(name, 0.0), places).alias(name)
        return F.col(name).cast("long").alias(name) if kinds[name].startswith("decimal") or kinds[name] == "int" else F.col(name)

    return frame.select(*map(cell, frame.columns))


def register(name: str, query: Query, sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = (lambda spark, sf_dir: comparable(query(spark, sf_dir))) if sql else query
    if sql:
        ORACLES[name] = sql
