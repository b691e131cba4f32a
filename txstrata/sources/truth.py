"""Truth kept apart from records: scenario labels and hidden owners, checked and joined."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.generate import PARTITIONS, SCENARIOS

# Versions of truth documents.
SCENARIO_VERSIONS, CHALLENGE_VERSION, ENTITY_VERSION = ("1.1.0", "1.2.0"), "1.2.0", "1.0.0"


class TruthError(ValueError):
    """A truth document that cannot be used."""


_SCENARIO = "struct<truth_schema_version:string,not_criminal_ground_truth:boolean,transactions:array<struct<txid:string,scenario_class:string,scenario_group_id:string,scenario_intensity:string,secondary_tags:array<string>>>>"
_ENTITY = "struct<truth_schema_version:string,evaluation_only:boolean,entities:array<struct<entity_id:string,partition:string,addresses:array<string>>>,collaborative_transactions:array<struct<txid:string,partition:string,input_addresses:array<string>>>>"


def _document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row: the document at a path."""
    read = spark.read.schema(T._parse_datatype_string(schema)).option("multiLine", True).option("mode", "FAILFAST")
    return read.json(path)


def _refuse(rows: DataFrame, why: str) -> None:
    """Raises if there is a row; names the first."""
    if found := rows.limit(1).collect():
        raise TruthError(f"{why}: {found[0].asDict()}")


def scenario_truth(spark: SparkSession, path: str) -> DataFrame:
    """(txid, scenario_class, scenario_group_id, scenario_intensity, secondary_tags) of a checked document."""
    doc = _document(spark, path, _SCENARIO)
    head = doc.select("truth_schema_version", "not_criminal_ground_truth", F.col("transactions").isNotNull().alias("listed")).first()
    if head is None or head["truth_schema_version"] not in SCENARIO_VERSIONS:
        raise TruthError("the scenario truth has no supported version")
    if head["not_criminal_ground_truth"] is not True:
        raise TruthError("the scenario truth does not say that it is no criminal ground truth")
    if not head["listed"]:
        raise TruthError("the scenario truth lists no transactions")
    rows = doc.select(F.explode("transactions").alias("t")).select("t.*")
    known = F.array(*map(F.lit, SCENARIOS))
    _refuse(rows.filter("txid IS NULL OR coalesce(scenario_group_id, '') = ''"), "a transaction without an identity or a group")
    _refuse(rows.filter(~F.coalesce(F.array_contains(known, F.col("scenario_class")), F.lit(False))), "an unknown class")
    _refuse(rows.filter(F.size(F.array_except(F.coalesce("secondary_tags", F.array().cast("array<string>")), F.slice(known, 2, len(SCENARIOS)))) > 0), "an unknown secondary tag")
    _refuse(rows.groupBy("txid").count().filter("count > 1"), "a transaction twice")
    if head["truth_schema_version"] != CHALLENGE_VERSION:
        rows = rows.withColumns({"scenario_intensity": F.lit(None).cast("string"), "secondary_tags": F.lit(None).cast("array<string>")})
    return rows


def entity_truth(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entity_id, partition, address) and (txid, partition, input_addresses) of a checked document."""
    doc = _document(spark, path, _ENTITY)
    head = doc.select("truth_schema_version", "evaluation_only").first()
    if head is None or head["truth_schema_version"] != ENTITY_VERSION or head["evaluation_only"] is not True:
        raise TruthError("the entity truth has no supported version or is not for evaluation only")
    entities = doc.select(F.explode("entities").alias("e")).select("e.*")
    _refuse(entities.filter(F.col("entity_id").isNull() | (F.coalesce(F.size("addresses"), F.lit(0)) < 1) | ~F.coalesce(F.col("partition").isin(*PARTITIONS), F.lit(False))), "an entity without identity, addresses or partition")
    _refuse(entities.groupBy("entity_id").count().filter("count > 1"), "an entity twice")
    rows = entities.select("entity_id", "partition", F.explode("addresses").alias("address"))
    _refuse(rows.groupBy("address").count().filter("count > 1"), "an address of several entities")
    return rows, doc.select(F.explode("collaborative_transactions").alias("c")).select("c.*")


def publish_scenario_truth(truth: DataFrame, path: str, version: str = CHALLENGE_VERSION) -> None:
    """Writes truth as one document; it is as large as a list of all transactions, which a reader takes as one row."""
    listed = truth.agg(F.collect_list(F.struct(*truth.columns)).alias("transactions"))
    listed.select(F.lit(version).alias("truth_schema_version"), F.lit(True).alias("not_criminal_ground_truth"), "transactions").coalesce(1).write.json(path)


def publish_entity_truth(entities: DataFrame, collaborative: DataFrame, path: str) -> None:
    owners = entities.groupBy("entity_id", "partition").agg(F.array_sort(F.collect_list("address")).alias("addresses")).agg(F.collect_list(F.struct("entity_id", "partition", "addresses")).alias("entities"))
    several = collaborative.agg(F.collect_list(F.struct("txid", "partition", "input_addresses")).alias("collaborative_transactions"))
    owners.crossJoin(several).select(F.lit(ENTITY_VERSION).alias("truth_schema_version"), F.lit(True).alias("evaluation_only"), "entities", "collaborative_transactions").coalesce(1).write.json(path)


def joined(rows: DataFrame, truth: DataFrame, key: str, what: str = "truth") -> DataFrame:
    """Rows with their truth or features; raises if one has none."""
    missing = rows.select(key).distinct().join(truth.select(key), key, "left_anti")
    if n := missing.count():
        raise TruthError(f"the {what} lacks {n} of the rows, the first {missing.agg(F.min(key)).first()[0]!r}")
    return rows.join(truth, key)
