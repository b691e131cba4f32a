"""Queries that learn, generate or ingest; SQL cannot express them unless noted."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import communities, entities, features, generate, learning, metrics
from ..streaming.activity import streaming_activity
from .registry import register
from .testdata import canonical

COLUMNS = ["total_observation_count", "unique_tx_count", "unique_port_count", "active_hour_count", "mean_inter_observation_seconds", "hour_of_day_entropy", "max_observations_1h"]


def _ips(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = learning.as_doubles(features.ip_features(features.scope(canonical(spark, sf_dir))).select("ip", *COLUMNS), COLUMNS)
    return learning.prepared(rows, COLUMNS).transform(rows).select("ip", "features")


def _isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ips(spark, sf_dir).cache()
    return learning.isolation_scores(rows, learning.isolation_forest(rows)).select("ip", "anomaly_score")


def _pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ips(spark, sf_dir).cache()
    return learning.pca_errors(rows, rows).select("ip", "anomaly_score")


def _lof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.local_outlier_factor(_ips(spark, sf_dir).cache(), "ip")


def _classified(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        split = _split_events(spark, sf_dir)
        model = learning.train_classifier(split.filter("part = 'train'"), FIELDS, "truth", kind, rounds=10)
        out, _ = learning.class_probabilities(model, learning.as_doubles(split.filter("part = 'test'"), FIELDS))
        return metrics.class_metrics(out, "truth", "predicted")

    return run


FIELDS = ["value", "hour", "k"]


def _split_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts", "value", F.col("event_type").alias("truth"), F.hour("ts").alias("hour"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    return metrics.temporal_split(rows, "ts", "event_id").cache()


def _supervised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-class scores of calibrated probabilities on the test part."""
    split = _split_events(spark, sf_dir)
    fitted = learning.calibrate(split.filter("part = 'train'"), FIELDS, "truth", "event_id", "logistic")
    test = learning.as_doubles(split.filter("part = 'test'"), FIELDS)
    scored = fitted.transform(test, "event_id").join(test.select("event_id", "truth"), "event_id").cache()
    return metrics.supervised_scores(scored, "truth", "probabilities", fitted.labels, "event_id")


def _search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.validation_search(_split_events(spark, sf_dir), FIELDS, "truth", [("logistic", 42), ("logistic", 7)])


def _diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.diagnostics(learning.train_classifier(_split_events(spark, sf_dir).filter("part = 'train'"), FIELDS, "truth"))


def _challenge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many challenge transactions as there are orders, audited."""
    c = generate.ChallengeConfig(spark.read.parquet(f"{sf_dir}/orders.parquet").count())
    return generate.challenge_audit(generate.challenge_records(spark, c), generate.challenge_truth(spark, c))


def _entity_challenge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = generate.EntityConfig(max(30, spark.read.parquet(f"{sf_dir}/orders.parquet").count()))
    return generate.entity_audit(generate.entity_records(spark, c), generate.entity_truth(spark, c))


def _communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = entities.cooccurrence_weights(canonical(spark, sf_dir))
    return communities.communities(edges)


def _synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many records as there are events."""
    rows = generate.synthetic_records(spark, generate.SyntheticConfig(spark.read.parquet(f"{sf_dir}/events.parquet").count(), pattern_share=0.15))
    return rows.select("record_index", F.get_json_object("value", "$.txid").alias("txid"), F.get_json_object("value", "$.timestamp").alias("timestamp"), F.sha2("value", 256).alias("digest"))


def _stream_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streaming_activity(canonical(spark, sf_dir)["network_observations"]).select(F.col("bucket_start").cast("timestamp_ntz").alias("bucket_start"), "observation_count")


def register_all() -> None:
    register("isolation_forest", _isolation)
    register("pca_reconstruction", _pca)
    register("local_outlier_factor", _lof)
    for name, kind in (("logistic_regression", "logistic"), ("random_forest", "forest"), ("gradient_boosting", "boosted")):
        register(name, _classified(kind))
    register("supervised_scores", _supervised)
    register("validation_search", _search)
    register("model_diagnostics", _diagnostics)
    register("challenge_audit", _challenge)
    register("entity_challenge_audit", _entity_challenge)
    register("topological_communities", _communities)
    register("synthetic_records", _synthetic)
    register("window_activity", _stream_form, "SELECT date_trunc('hour', ts) AS bucket_start, count(*) AS observation_count FROM events GROUP BY 1")
