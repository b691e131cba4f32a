"""Splits and evaluation measures as aggregates; ranks come from :mod:`ranking`."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import with_rank, with_running
from .rounds import stored


def temporal_split(rows: DataFrame, time: str, key: str, train: float = 0.70, validation: float = 0.85) -> DataFrame:
    """``rows`` with ``part``: the first 70 % by time, the next 15 % and the rest; equal times stay together."""
    by_time = stored(with_running(rows.groupBy(F.col(time).alias("_at")).agg(F.count("*").alias("_n")), [F.col("_at")], {"_upto": F.col("_n")}))
    n = F.max("_upto").alias("n")
    # The first time at which enough rows have been seen, for both cuts at once.
    total = by_time.agg(n).first()["n"] or 0
    first = by_time.filter(F.col("_upto") >= max(1, int(total * train))).agg(F.min_by(F.struct("_at", "_upto"), "_at").alias("c")).first()["c"]
    known = first["_upto"] if first else 0
    second = by_time.filter(F.col("_upto") >= max(known + 1, int(total * validation))).agg(F.min("_at")).first()[0]
    at = F.col(time)
    part = F.when(at <= F.lit(first["_at"] if first else None), "train").when(at <= F.lit(second), "validation").otherwise("test")
    return rows.withColumn("part", part)


def group_split(rows: DataFrame, group: str, salt: str = "0", train: float = 0.70, validation: float = 0.85) -> DataFrame:
    """``rows`` with ``part`` by a hash of the group, so no group is split."""
    u = F.pmod(F.xxhash64(F.lit(salt), group), F.lit(1 << 30)) / float(1 << 30)
    return rows.withColumn("part", F.when(u < train, "train").when(u < validation, "validation").otherwise("test"))


def stratified_split(rows: DataFrame, label: str, key: str, salt: str = "0", train: float = 0.70, validation: float = 0.85) -> DataFrame:
    """``rows`` with ``part`` by rank of a hash within each label, so every label keeps the shares.

    Ranks come from ordered ranges over all labels, less the rows of the labels
    before, so a label of any size is spread over all of them.
    """
    ranked = with_rank(rows, [F.col(label).asc(), F.xxhash64(F.lit(salt), key).asc(), F.col(key).asc()], "_rank")
    sizes = rows.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("_n"))
    before = with_running(sizes, [F.col("_label").asc()], {"_upto": F.col("_n")})
    joined = ranked.join(F.broadcast(before), F.col(label).eqNullSafe(F.col("_label")))  # one row for each label
    place = F.when(F.col("_n") > 1, (F.col("_rank") - 1 - (F.col("_upto") - F.col("_n"))) / (F.col("_n") - 1)).otherwise(0.0)
    return joined.withColumn("part", F.when(place < train, "train").when(place < validation, "validation").otherwise("test")).select(*rows.columns, "part")


def split_audit(rows: DataFrame, group: str, time: str, label: str) -> DataFrame:
    """For each part its rows, labels and time range, and the number of groups in more than one part."""
    torn = rows.groupBy(group).agg(F.count_distinct("part").alias("k")).agg(F.count_if(F.col("k") > 1).alias("torn_groups"))
    return rows.groupBy("part").agg(F.count("*").alias("rows"), F.count_distinct(label).alias("labels"), F.min(time).alias("first"), F.max(time).alias("last")).crossJoin(torn)


def constant_columns(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, constant): whether a column has at most one value."""
    one = rows.agg(*[F.coalesce(F.min(c) == F.max(c), F.lit(True)).alias(c) for c in columns])
    return one.selectExpr(f"stack({len(columns)}, " + ", ".join(f"'{c}', `{c}`" for c in columns) + ") AS (column, constant)")


def average_precision(rows: DataFrame, score: str, positive: Column, key: str) -> DataFrame:
    """The mean of precision at each positive, in order of falling score and rising key; one row."""
    marked = rows.select(F.col(score).alias("s"), F.col(key).alias("k"), positive.cast("long").alias("y"))
    ranked = with_running(marked, [F.desc("s"), F.asc("k")], {"rank": F.lit(1).cast("long"), "hits": F.col("y")})
    return ranked.filter("y = 1").agg(F.avg(F.col("hits") / F.col("rank")).alias("average_precision"), F.count("*").alias("positives"))


def roc_auc(rows: DataFrame, score: str, positive: Column) -> DataFrame:
    """The chance that a positive scores above a negative, ties counting half; one row."""
    by = rows.groupBy(F.col(score).alias("s")).agg(F.sum(positive.cast("long")).alias("p"), F.sum(1 - positive.cast("long")).alias("q"))
    ranked = with_running(by, [F.asc("s")], {"below": F.col("q")})
    return ranked.agg(F.sum(F.col("p") * (F.col("below") - F.col("q") / 2)).alias("u"), F.sum("p").alias("np"), F.sum("q").alias("nq")).select((F.col("u") / (F.col("np") * F.col("nq"))).alias("roc_auc"))


def top_budget(rows: DataFrame, score: str, positive: Column, key: str, percents: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """For each percentage of rows by falling score: how many, what share of positives, and precision."""
    n = rows.count()
    marked = rows.select(F.col(score).alias("s"), F.col(key).alias("k"), positive.cast("long").alias("y"))
    ranked = with_rank(marked, [F.desc("s"), F.asc("k")])
    top = [max(1, math.ceil(n * p / 100)) for p in percents]
    sums = ranked.agg(F.sum("y").alias("all"), *[F.sum(F.when(F.col("rank") <= k, F.col("y")).otherwise(0)).alias(f"y{p}") for p, k in zip(percents, top, strict=True)])
    cells = ", ".join(f"{p}L, {k}L, y{p}" for p, k in zip(percents, top, strict=True))
    return sums.selectExpr(f"stack({len(percents)}, {cells}) AS (percent, row_count, hits)", "all").select("percent", "row_count", (F.col("hits") / F.col("all")).alias("capture"), (F.col("hits") / F.col("row_count")).alias("precision"))


def confusion_matrix(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    return rows.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def class_metrics(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support of every class; 0 where undefined."""
    cells = confusion_matrix(rows, truth, predicted)
    t = cells.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)).alias("tp"))
    p = cells.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("named"))
    joined = t.join(p, "label", "full").select("label", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("support", "tp", "named")])
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return joined.select("label", share("tp", "named").alias("precision"), share("tp", "support").alias("recall"), F.when(F.col("named") + F.col("support") > 0, 2 * F.col("tp") / (F.col("named") + F.col("support"))).otherwise(0.0).alias("f1"), "support")


def averages(metrics: DataFrame) -> DataFrame:
    """Macro and weighted F1 and balanced accuracy from class metrics; one row."""
    seen = F.col("support") > 0
    return metrics.agg(F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"), F.avg(F.when(seen, F.col("recall"))).alias("balanced_accuracy"))


def probability_scores(rows: DataFrame, truth: Column, probability: Column) -> DataFrame:
    """Brier score and log loss of a binary probability; one row."""
    y, p = truth.cast("double"), F.greatest(F.least(probability, F.lit(1 - 1e-15)), F.lit(1e-15))
    return rows.agg(F.avg(F.pow(probability - y, 2)).alias("brier"), F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"))


def supervised_scores(rows: DataFrame, truth: str, probabilities: str, classes: list[str], key: str) -> DataFrame:
    """One row: macro one-against-rest ROC AUC and average precision, multi-class Brier score and log loss.

    ``probabilities`` is an array in the order of ``classes``; the means are
    over the classes that occur.
    """
    p = [F.col(probabilities)[i] for i in range(len(classes))]
    one = [(F.col(truth) == c).cast("double") for c in classes]
    own = sum((y * x for y, x in zip(one, p, strict=True)), F.lit(0.0))
    losses = rows.agg(F.avg(sum((F.pow(x - y, 2) for x, y in zip(p, one, strict=True)), F.lit(0.0))).alias("multiclass_brier_score"), F.avg(-F.log(F.greatest(own, F.lit(1e-15)))).alias("log_loss"))
    parts = []
    for c, x in zip(classes, p, strict=True):
        scored = rows.withColumn("_p", x)
        area, precision = roc_auc(scored, "_p", F.col(truth) == c), average_precision(scored, "_p", F.col(truth) == c, key)
        parts.append(area.crossJoin(precision).select(F.lit(c).alias("class"), "roc_auc", "average_precision"))
    means = reduce(DataFrame.unionByName, parts).agg(F.avg("roc_auc").alias("roc_auc_ovr_macro"), F.avg("average_precision").alias("average_precision_macro"))
    return means.crossJoin(losses)


def recall_by_group(rows: DataFrame, truth: str, predicted: str, group: str) -> DataFrame:
    return rows.groupBy(F.col(truth).alias("truth"), F.col(group).alias("intensity")).agg(F.avg((F.col(truth) == F.col(predicted)).cast("int")).alias("recall"), F.count("*").alias("support"))


def score_summary(rows: DataFrame, score: str, group: str) -> DataFrame:
    s = F.col(score)
    return rows.groupBy(group).agg(F.count(s).alias("n"), F.min(s).alias("least"), F.avg(s).alias("mean"), F.median(s).alias("median"), F.percentile(s, 0.95).alias("p95"), F.max(s).alias("greatest"))


#: Weights of the selection criteria, and how far from the best F1 a model may be.
WEIGHTS = {"macro_f1": 0.35, "minimum_recall": 0.15, "weak_recall": 0.15, "reliability": 0.10, "stability": 0.10, "efficiency": 0.05, "explainability": 0.05, "simplicity": 0.05}
TOLERANCE = 0.03


def decision_matrix(candidates: DataFrame) -> DataFrame:
    """Candidates with eligibility and the weighted score of eligible ones."""
    best = candidates.agg(F.max("macro_f1").alias("best"))
    marked = candidates.crossJoin(best).withColumn("eligible", F.col("macro_f1") >= F.col("best") - TOLERANCE)
    cost = lambda c: F.when(F.col("eligible"), F.col(c))
    top = marked.agg(*[F.coalesce(F.nullif(F.max(cost(c)), F.lit(0.0)), F.lit(1.0)).alias(f"max_{c}") for c in ("train_seconds", "infer_seconds", "bytes")])
    saved = lambda c: 1 - F.col(c) / F.col(f"max_{c}")
    parts = {
        "efficiency": (saved("train_seconds") + saved("infer_seconds") + saved("bytes")) / 3, "reliability": F.greatest(F.lit(0.0), 1 - F.col("brier") / 2), "stability": F.greatest(F.lit(0.0), 1 - F.col("f1_std") / 0.10),
    }
    total = sum(((parts.get(k, F.col(k) if k not in parts else None)) * w for k, w in WEIGHTS.items()), F.lit(0.0))
    return marked.crossJoin(top).select("name", "macro_f1", "eligible", F.when(F.col("eligible"), total).alias("selection_score"))
