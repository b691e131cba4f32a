"""Experiments kept with what identifies them: configuration, measures, predictions and the model."""

from __future__ import annotations

import json
import uuid
from hashlib import sha256

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from .store import StoreError, canonical_json, file_list, paths

VERSION = "1"


def experiment_id(configuration: dict) -> str:
    """The SHA-256 of the configuration's canonical JSON: equal settings have equal names."""
    return sha256(canonical_json(configuration).encode()).hexdigest()


def publish_experiment(root: str, configuration: dict, measures: dict, frames: dict[str, DataFrame], model: PipelineModel | None = None) -> str:
    """Writes an experiment below ``root``, named by its identity, and gives its path; an existing one is never touched.

    ``frames`` are predictions, splits and truth, written as Parquet.
    """
    spark = next(iter(frames.values())).sparkSession
    name = experiment_id(configuration)
    path = f"{root}/{name}"
    fs, target, path_of = paths(spark, path)
    if fs.exists(target):
        raise StoreError(f"{path} exists")
    staged = f"{root}/.staged-{uuid.uuid4().hex}"
    try:
        for part, frame in sorted(frames.items()):
            frame.write.parquet(f"{staged}/{part}")
        if model is not None:
            model.write().save(f"{staged}/model")
        write = lambda value, part: spark.createDataFrame([(canonical_json(value),)], "value string").coalesce(1).write.text(f"{staged}/{part}")
        write(measures, "measures")
        write({"experiment_schema_version": VERSION, "experiment_id": name, "configuration": configuration, "artifacts": file_list(spark, staged)}, "experiment")
        if fs.exists(target) or not fs.rename(path_of(staged), target):
            raise StoreError(f"{path} exists")
        return path
    except BaseException:
        fs.delete(path_of(staged), True)
        raise


def _json(spark: SparkSession, path: str) -> dict:
    return json.loads("".join(r[0] for r in spark.read.text(path).collect()))


def inspect_experiment(spark: SparkSession, path: str) -> dict:
    """The manifest and measures of an experiment whose identity and every file are as stated."""
    manifest = _json(spark, f"{path}/experiment")
    if manifest.get("experiment_schema_version") != VERSION or manifest.get("experiment_id") != experiment_id(manifest.get("configuration", {})):
        raise StoreError(f"{path}: the experiment is of another version or was changed")
    found = [f for f in file_list(spark, path) if not f["file"].startswith("experiment/")]
    if found != manifest["artifacts"]:
        changed = sorted({f["file"] for f in found if f not in manifest["artifacts"]} | {f["file"] for f in manifest["artifacts"] if f not in found})
        raise StoreError(f"{path}: {', '.join(changed[:5])} is not what the manifest states")
    return {"experiment": manifest, "measures": _json(spark, f"{path}/measures")}


def load_model(spark: SparkSession, path: str, trusted: bool = False) -> PipelineModel:
    """The model of a verified experiment; only after the caller has said that its origin is trusted."""
    if trusted is not True:
        raise StoreError("a model is loaded only from a place that is said to be trusted")
    inspect_experiment(spark, path)
    return PipelineModel.load(f"{path}/model")
