"""Stores of graphs and of entity hypotheses, with what they were derived from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, integrity
from .store import open_store, publish, store_checks

# Versions of the two kinds of stores.
GRAPH_VERSION, ENTITY_VERSION = "1", "1"


def publish_graph(tables: dict[str, DataFrame], path: str, dataset_id: str | None = None) -> dict:
    """Nodes and edges of the property graph, each kind a table, checked against the canonical tables before it is published."""
    parts = {f"nodes_{k}": f for k, f in graph.nodes(tables).items()} | {f"edges_{k.lower()}": f for k, f in graph.edges(tables).items()}

    def check(back: dict[str, DataFrame]) -> None:
        nodes = {k: back[f"nodes_{k}"] for k in graph.nodes(tables)}
        edges = {k: back[f"edges_{k.lower()}"] for k in graph.edges(tables)}
        if wrong := graph.graph_checks(tables, nodes, edges).filter("breaches > 0").collect():
            raise ValueError(f"the graph is not that of its tables: {[r.asDict() for r in wrong]}")

    return publish(parts, path, GRAPH_VERSION, sort_keys={}, check=check, lineage={"canonical": dataset_id})


def import_files(tables: dict[str, DataFrame], path: str) -> None:
    """The same as CSV with the headers that bulk importers of property graphs take: ids, ends, types."""
    for kind, frame in graph.nodes(tables).items():
        key = graph._KEYS[kind]
        frame.select(F.col(key).alias(f"{key}:ID({kind})"), *[c for c in frame.columns if c != key], F.lit(kind.capitalize()).alias(":LABEL")).write.option("header", True).csv(f"{path}/nodes_{kind}")
    for name, frame in graph.edges(tables).items():
        start, end = graph._ENDS[name]
        more = [c for c in frame.columns if c not in (graph._KEYS[start], graph._KEYS[end])]
        ends = (F.col(graph._KEYS[start]).alias(f":START_ID({start})"), F.col(graph._KEYS[end]).alias(f":END_ID({end})"))
        frame.select(*ends, *more, F.lit(name).alias(":TYPE")).write.option("header", True).csv(f"{path}/edges_{name.lower()}")


def publish_entities(parts: dict[str, DataFrame], path: str, canonical_id: str, feature_id: str) -> dict:
    """Hypotheses, evidence and diagnostics as one store that names the stores they came from."""
    return publish(parts, path, ENTITY_VERSION, sort_keys={}, lineage={"canonical": canonical_id, "feature": feature_id})


def read_back(spark: SparkSession, path: str, version: str, parents: dict[str, str], kind: str) -> DataFrame:
    """(code, breaches) of a store's manifest and, for canonical stores, of its rules."""
    found = store_checks(spark, path, version, parents, kind)
    rows = spark.createDataFrame(sorted(found.items()), "code string, breaches long")
    if kind != "CANONICAL":
        return rows
    tables, _ = open_store(spark, path, version)
    return rows.unionByName(integrity.canonical_checks(tables))
