"""Anomaly detectors and classifiers over feature columns, on MLlib where it has them."""

from __future__ import annotations

import math
from dataclasses import dataclass
from importlib import import_module

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest
from pyspark.ml.feature import PCA, Imputer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .forests import Forest

#: Columns that tell who a row is, not how it behaves; a model that sees them is refused.
IDENTITY = frozenset({"txid", "address", "ip", "observation_id", "source_record_id", "scenario_class", "scenario_group", "truth", "label", "event_id", "doc_id", "vec_id"})


def behaviour_columns(columns: list[str]) -> list[str]:
    """The columns, if none tells a row's identity or truth."""
    if told := IDENTITY.intersection(columns):
        raise ValueError(f"columns that identify rows: {sorted(told)}")
    return columns


def prepared(train: DataFrame, columns: list[str]) -> PipelineModel:
    """Medians for gaps, then zero mean and unit deviation; all learned from ``train`` only."""
    behaviour_columns(columns)
    filled = [f"_{c}" for c in columns]
    return Pipeline(stages=[Imputer(strategy="median", inputCols=columns, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True)]).fit(train)


def as_doubles(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.withColumns({c: F.col(c).cast("double") for c in columns})


@dataclass
class IsolationForest:
    """Random trees over bounded samples, as flat arrays; scores near 1 are anomalous."""

    feature: np.ndarray
    threshold: np.ndarray
    depth: np.ndarray
    sample: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for f, t, d in zip(self.feature, self.threshold, self.depth, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            while True:
                inner = f[node] >= 0
                if not inner.any():
                    break
                nxt = 2 * node + 1 + (x[rows, np.maximum(f[node], 0)] > t[node])
                node = np.where(inner, nxt, node)
            total += d[node]
        return np.power(2.0, -total / len(self.feature) / max(path_length(self.sample), 1e-9))


def path_length(n: float) -> float:
    """The mean depth of an unsuccessful search among n keys."""
    if n <= 1:
        return 0.0
    return 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


def isolation_forest(train: DataFrame, trees: int = 200, sample: int = 256, seed: int = 42, features: str = "features") -> IsolationForest:
    """Trees over at most ``sample`` rows each, drawn from one bounded sample of the training rows."""
    n = max(1, train.count())
    wanted = 16 * sample
    drawn = train.select(vector_to_array(features).alias("x")).sample(min(1.0, 1.5 * wanted / n), seed).limit(wanted).collect()
    rows = np.array(sorted(tuple(r["x"]) for r in drawn))
    rng, limit = np.random.default_rng(seed), max(1, math.ceil(math.log2(max(2, min(sample, len(rows))))))
    size = (1 << (limit + 1)) - 1
    out = [], [], []
    for _ in range(trees):
        f, t, d = np.full(size, -1), np.zeros(size), np.zeros(size)
        own = rows[rng.permutation(len(rows))[:sample]]

        def grow(node: int, part: np.ndarray, depth: int) -> None:
            spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(part) > 1 and depth < limit else []
            if not len(spread):
                d[node] = depth + path_length(len(part))
                return
            k = rng.choice(spread)
            cut = rng.uniform(part[:, k].min(), part[:, k].max())
            f[node], t[node] = k, cut
            grow(2 * node + 1, part[part[:, k] <= cut], depth + 1)
            grow(2 * node + 2, part[part[:, k] > cut], depth + 1)

        grow(0, own, 0)
        for store, a in zip(out, (f, t, d), strict=True):
            store.append(a)
    return IsolationForest(*map(np.array, out), min(sample, len(rows)))


def isolation_scores(rows: DataFrame, forest: IsolationForest, features: str = "features") -> DataFrame:
    """``rows`` with ``anomaly_score``."""

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(forest.scores(np.array(x.tolist(), dtype=np.float64).reshape(len(x), -1)))

    return rows.withColumn("anomaly_score", score(vector_to_array(features)))


def pca_errors(train: DataFrame, rows: DataFrame, share: float = 0.90, features: str = "features") -> DataFrame:
    """``rows`` with the mean squared distance from the subspace that holds ``share`` of the training variance."""
    width = len(train.select(vector_to_array(features).alias("x")).first()["x"])
    model = PCA(k=width, inputCol=features, outputCol="pc").fit(train)
    held = np.cumsum(model.explainedVariance.toArray())
    k = int(np.searchsorted(held, share - 1e-12) + 1)
    axes = model.pc.toArray()[:, :k]
    means = np.array([r for r in train.select(vector_to_array(features).alias("x")).agg(*[F.avg(F.col("x")[i]) for i in range(width)]).first()])

    @F.pandas_udf("double")
    def error(x: pd.Series) -> pd.Series:
        m = np.array(x.tolist(), dtype=np.float64).reshape(len(x), -1) - means
        return pd.Series(np.square(m - m @ axes @ axes.T).mean(axis=1))

    return rows.withColumn("anomaly_score", error(vector_to_array(features)))


#: Points that a neighbour search may have as its reference set, and queries compared at once.
REFERENCE, AT_ONCE = 20_000, 256


def reference_points(points: DataFrame, key: str, features: str = "features", limit: int = REFERENCE) -> tuple[list, np.ndarray]:
    """Keys and coordinates of the reference set: all points, or of more than ``limit`` the ones whose key hashes lowest."""
    p = points.select(F.col(key).alias("id"), vector_to_array(features).alias("x"))
    rows = p.orderBy(F.xxhash64("id"), "id").limit(limit).collect()
    width = len(rows[0]["x"]) if rows else 0
    return [r["id"] for r in rows], np.array([r["x"] for r in rows], dtype=np.float64).reshape(len(rows), width)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all pairs of rows, added up column by column."""
    total = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        total += np.square(a[:, k, None] - b[None, :, k])
    return np.sqrt(total)


def _nearest(asked: np.ndarray, own: list, ids: list, points: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances and places of the k nearest reference points of each query, itself left out; -1 where there are fewer."""
    far, place = np.full((len(asked), k), np.inf), np.full((len(asked), k), -1)
    at = {i: j for j, i in enumerate(ids)}
    for i in range(0, len(asked), AT_ONCE):
        d = distances(asked[i : i + AT_ONCE], points)
        for r in range(len(d)):
            if (j := at.get(own[i + r])) is not None:
                d[r, j] = np.inf
        order = np.argsort(d, axis=1, kind="stable")[:, :k]
        near = np.take_along_axis(d, order, axis=1)
        far[i : i + AT_ONCE, : order.shape[1]], place[i : i + AT_ONCE, : order.shape[1]] = near, np.where(np.isfinite(near), order, -1)
    return far, place


def neighbours(queries: DataFrame, points: DataFrame, k: int, key: str, features: str = "features", limit: int = REFERENCE) -> DataFrame:
    """Exact (id, other, distance, rank) of the k nearest other points of the reference set.

    The reference set is bounded (:func:`reference_points`) and goes to every
    task, so queries are never shuffled and cost what they number.
    """
    ids, x = reference_points(points, key, features, limit)
    kind = dict(points.dtypes)[key]
    q = queries.select(F.col(key).alias("id"), vector_to_array(features).alias("x"))

    def run(batches):
        for pdf in batches:
            own = pdf["id"].tolist()
            far, place = _nearest(np.array(pdf["x"].tolist(), dtype=np.float64).reshape(len(pdf), -1), own, ids, x, k)
            yield pd.DataFrame([(i, ids[p], float(d), r + 1) for i, ds, ps in zip(own, far, place, strict=True) for r, (d, p) in enumerate(zip(ds, ps, strict=True)) if p >= 0], columns=["id", "other", "distance", "rank"])

    return q.mapInPandas(run, f"id {kind}, other {kind}, distance double, rank int")


def local_outlier_factor(points: DataFrame, key: str, k: int = 20, features: str = "features", limit: int = REFERENCE) -> DataFrame:
    """(key, anomaly_score): the local outlier factor of every point among its k nearest of the reference set.

    Radii and densities of the reference points are made first, by tasks that
    share out the points, and then every point is scored against them.
    """
    ids, x = reference_points(points, key, features, limit)
    k = max(1, min(k, len(ids) - 1))
    spark, kind = points.sparkSession, dict(points.dtypes)[key]

    def own_neighbours(batches):
        for pdf in batches:
            some = pdf["id"].to_numpy()
            far, place = _nearest(x[some], [ids[i] for i in some], ids, x, k)
            yield pd.DataFrame({"i": some, "d": far.tolist(), "p": place.tolist()})

    found = sorted(spark.range(0, len(ids), 1, max(1, len(ids) // 1024)).mapInPandas(own_neighbours, "i long, d array<double>, p array<long>").collect()) if len(ids) > 1 else []
    far, place = np.array([r["d"] for r in found]), np.array([r["p"] for r in found], dtype=np.int64)
    if not len(found):
        return points.select(key, F.lit(1.0).alias("anomaly_score"))
    radius = far[:, -1]
    density = 1 / (np.maximum(far, radius[place]).mean(axis=1) + 1e-10)

    def score(batches):
        for pdf in batches:
            d, p = _nearest(np.array(pdf["x"].tolist(), dtype=np.float64).reshape(len(pdf), -1), pdf["id"].tolist(), ids, x, k)
            mine = 1 / (np.maximum(d, radius[p]).mean(axis=1) + 1e-10)
            yield pd.DataFrame({key: pdf["id"], "anomaly_score": density[p].mean(axis=1) / mine})

    return points.select(F.col(key).alias("id"), vector_to_array(features).alias("x")).mapInPandas(score, f"{key} {kind}, anomaly_score double")


# Settings of the two optional boosting libraries, by their Spark estimators.
_ADAPTERS = {
    "xgboost": ("xgboost.spark", "SparkXGBClassifier", {"n_estimators": 300, "learning_rate": 0.06, "max_depth": 6, "min_child_weight": 2.0, "subsample": 0.85, "colsample_bytree": 0.85, "reg_alpha": 0.05, "reg_lambda": 1.0, "label_col": "_label", "weight_col": "weight"}),
    "lightgbm": ("synapse.ml.lightgbm", "LightGBMClassifier", {"numIterations": 300, "learningRate": 0.06, "numLeaves": 31, "minDataInLeaf": 20, "baggingFraction": 0.85, "featureFraction": 0.85, "lambdaL1": 0.05, "lambdaL2": 1.0, "labelCol": "_label", "weightCol": "weight", "objective": "multiclass"}),
}


def classifier(kind: str, seed: int = 42, rounds: int = 60):
    """An estimator over ``features``, ``_label`` and ``weight``.

    ``boosted`` is one-against-rest boosting of binary trees, an approximation
    of multi-class histogram boosting.
    """
    if kind == "logistic":
        return LogisticRegression(maxIter=1000, regParam=1e-3, weightCol="weight", labelCol="_label", family="multinomial")
    if kind == "forest":
        return Forest(trees=300, depth=16, least=2, seed=seed)
    if kind == "boosted":
        return OneVsRest(labelCol="_label", classifier=GBTClassifier(maxIter=rounds, maxDepth=5, stepSize=0.08, seed=seed))
    if kind in _ADAPTERS:
        module, name, settings = _ADAPTERS[kind]
        try:
            return getattr(import_module(module), name)(**settings, seed=seed)
        except ImportError:
            raise ValueError(f"{kind} needs the package {module.split('.')[0]}, which is not installed") from None
    raise ValueError(f"no such classifier: {kind}")


def balanced(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` with ``weight``, so that every label weighs the same."""
    counts = rows.groupBy(label).agg(F.count("*").alias("_n"))
    totals = counts.agg(F.sum("_n").alias("_all"), F.count("*").alias("_k"))
    return rows.join(F.broadcast(counts.crossJoin(totals)), label).withColumn("weight", F.col("_all") / (F.col("_k") * F.col("_n"))).drop("_n", "_all", "_k")


def train_classifier(train: DataFrame, columns: list[str], label: str, kind: str = "logistic", seed: int = 42, rounds: int = 60) -> PipelineModel:
    """Preparation and classifier in one model, learned from ``train`` only; constant columns are left out."""
    spread = train.agg(*[(F.min(c) < F.max(c)).alias(c) for c in columns]).first()
    used = [c for c in columns if spread[c]]
    ready = prepared(as_doubles(train, used), used)
    index = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc").fit(train)
    rows = index.transform(ready.transform(as_doubles(balanced(train, label), used)))
    return PipelineModel(stages=[*ready.stages, index, classifier(kind, seed, rounds).fit(rows)])


def class_probabilities(model: PipelineModel, rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """``rows`` with ``predicted`` and ``probabilities``, one for each class in order, summing to 1; and the classes.

    Models without probabilities give those of their margins by the logistic
    function.  A row whose values are not finite, negative or all 0 is refused.
    """
    index = next(s for s in model.stages if hasattr(s, "labels"))
    out = model.transform(rows)
    raw = vector_to_array("probability") if "probability" in out.columns else F.transform(vector_to_array("rawPrediction"), lambda m: 1 / (1 + F.exp(-m)))
    total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
    bad = F.exists(raw, lambda x: x.isNull() | F.isnan(x) | (x < 0) | (x == float("inf"))) | (total <= 0)
    shares = F.when(bad, F.raise_error(F.lit("a classifier gave probabilities that cannot be scaled to 1"))).otherwise(F.transform(raw, lambda x: x / total))
    named = F.element_at(F.array(*map(F.lit, index.labels)), F.col("prediction").cast("int") + 1)
    return out.select(*rows.columns, named.alias("predicted"), shares.alias("probabilities")), list(index.labels)


def check_scores(rows: DataFrame, score: str = "anomaly_score") -> DataFrame:
    """``rows``, unless a score is not finite."""
    s = F.col(score)
    return rows.withColumn(score, F.when(s.isNull() | F.isnan(s) | (F.abs(s) == float("inf")), F.raise_error(F.lit("a detector gave a score that is not finite"))).otherwise(s))


@dataclass
class Calibrated:
    """Classifiers of several folds, each with a logistic curve for every class; their means are the probabilities."""

    models: list[PipelineModel]
    curves: list[dict[str, tuple[float, float]]]
    labels: list[str]

    def transform(self, rows: DataFrame, key: str) -> DataFrame:
        """(key, ``predicted``, ``probabilities``) of every row."""
        parts = []
        for model, curve in zip(self.models, self.curves, strict=True):
            out, labels = class_probabilities(model, rows)
            of = lambda c, curve=curve, labels=labels: 1 / (1 + F.exp(-(curve[c][0] * F.col("probabilities")[labels.index(c)] + curve[c][1]))) if c in labels else F.lit(0.0)
            cells = [of(c) for c in self.labels]
            total = sum(cells, F.lit(0.0))
            parts.append(out.select(key, F.array(*[c / total for c in cells]).alias("p")))
        union = parts[0]
        for part in parts[1:]:
            union = union.unionByName(part)
        mean = union.groupBy(key).agg(F.array(*[F.avg(F.col("p")[i]) for i in range(len(self.labels))]).alias("probabilities"))
        best = F.array_position("probabilities", F.array_max("probabilities")).cast("int")
        return mean.select(key, F.element_at(F.array(*map(F.lit, self.labels)), best).alias("predicted"), "probabilities")


def calibrate(train: DataFrame, columns: list[str], label: str, key: str, kind: str = "forest", folds: int = 3, seed: int = 42) -> Calibrated:
    """Sigmoid calibration: each fold's classifier is learned on the other folds and its curves on the fold itself."""
    fold = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(folds))
    models, curves, labels = [], [], sorted(r[0] for r in train.select(label).distinct().collect())
    for k in range(folds):
        model = train_classifier(train.filter(fold != k), columns, label, kind, seed)
        out, known = class_probabilities(model, as_doubles(train.filter(fold == k), columns))
        out = out.select(label, "probabilities").cache()
        curve = {}
        for c in labels:
            own = out.select((F.col(label) == c).cast("double").alias("label"), (F.col("probabilities")[known.index(c)] if c in known else F.lit(0.0)).alias("p"))
            share = own.agg(F.avg("label")).first()[0]
            if share in (None, 0.0, 1.0) or c not in known:
                curve[c] = (0.0, 30.0 if share == 1.0 else -30.0)
                continue
            fitted = LogisticRegression(maxIter=200).fit(VectorAssembler(inputCols=["p"], outputCol="features").transform(own))
            curve[c] = (float(fitted.coefficients[0]), float(fitted.intercept))
        out.unpersist()
        models.append(model)
        curves.append(curve)
    return Calibrated(models, curves, labels)


def validation_search(rows: DataFrame, columns: list[str], label: str, candidates: list[tuple[str, int]], part: str = "part") -> DataFrame:
    """(kind, seed, macro_f1, balanced_accuracy, validation_rows) of every candidate; rows of the test part are never read."""
    from .metrics import averages, class_metrics

    if not candidates:
        raise ValueError("a search needs candidates")
    train, validation = rows.filter(F.col(part) == "train"), as_doubles(rows.filter(F.col(part) == "validation"), columns)
    out = []
    for kind, seed in candidates:
        scored, _ = class_probabilities(train_classifier(train, columns, label, kind, seed), validation)
        r = averages(class_metrics(scored, label, "predicted")).crossJoin(scored.agg(F.count("*").alias("n"))).first()
        out.append((kind, seed, float(r["macro_f1"]), float(r["balanced_accuracy"]), int(r["n"])))
    return rows.sparkSession.createDataFrame(out, "kind string, seed long, macro_f1 double, balanced_accuracy double, validation_rows long")


def diagnostics(model: PipelineModel) -> DataFrame:
    """(kind, class, feature, value): coefficients of a logistic model, or the importances of trees."""
    from pyspark.sql import SparkSession

    last, index = model.stages[-1], next(s for s in model.stages if hasattr(s, "labels"))
    columns = next(s for s in model.stages if isinstance(s, VectorAssembler)).getInputCols()
    names = [c.removeprefix("_") for c in columns]
    if hasattr(last, "coefficientMatrix"):
        rows = [("coefficient", index.labels[i], f, float(v)) for i, line in enumerate(last.coefficientMatrix.toArray()) for f, v in zip(names, line, strict=True)]
    elif hasattr(last, "featureImportances"):
        rows = [("importance", None, f, float(v)) for f, v in zip(names, last.featureImportances.toArray(), strict=True)]
    else:
        rows = [("importance", c, f, float(v)) for c, m in zip(index.labels, last.models, strict=True) for f, v in zip(names, m.featureImportances.toArray(), strict=True)]
    return SparkSession.active().createDataFrame(rows, "kind string, class string, feature string, value double")
