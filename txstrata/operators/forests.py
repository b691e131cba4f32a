"""Random forests whose trees are grown whole by tasks, from training rows grouped by their bins.

The rules are those of MLlib's forest: at most ``maxBins`` bins of a column, Gini
impurity of weighted rows, a Poisson count of every row for every tree, a random
part of the columns at every node, sibling leaves of one prediction merged.  The
sum of Poisson counts of equal rows is a Poisson count of their number, so rows
of the same bins and label are one row with a number, and nothing is left out.
MLlib itself grows a forest node by node from the driver, which is kept for
training rows that have more than ``limit`` different bins and labels.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.util import MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .rounds import stored

#: The most bins of a column, and training rows of different bins and labels that go to every task.
BINS, LIMIT = 32, 1 << 20
#: Quantiles that stand for the values of columns which have more than ``LIMIT``.
GRID = 4096
#: Rows scored at once, and the unit of a tree's probabilities: whole numbers, so that sums don't depend on their order.
BLOCK, UNIT = 1 << 15, 1 << 40
#: Rows of bins whose sums a task holds; small blocks of many parts are held together.
HELD = 1 << 19
#: Bytes of bins to score up to which they are sent to the trees, and not paired with them.
BROADCAST = 1 << 23
#: Parts of a forest that score side by side.
TOGETHER = 8

TREES = "tree long, feature binary, cut binary, child binary, leaf binary, importance array<double>"


def thresholds(rows: DataFrame, weights: np.ndarray, width: int, limit: int = LIMIT) -> list[list[float]]:
    """For every column the bounds between its bins, halfway between two values, by MLlib's rule over all rows.

    Few values are told apart; of many, bins weigh the same.  Where there are
    more than ``limit`` values they are counted on a grid of ``GRID`` quantiles.
    """
    at = rows.select("label", F.posexplode("x").alias("i", "v"))
    counted = lambda at: at.groupBy("i", "v", "label").agg(F.count("*").alias("n"))
    found = counted(at).limit(limit + 1).toArrow()
    if found.num_rows > limit:
        names = [f"c{i}" for i in range(width)]
        grid = [np.unique(g) for g in rows.select([F.col("x")[i].alias(c) for i, c in enumerate(names)]).approxQuantile(names, [k / GRID for k in range(GRID + 1)], 0.1 / GRID)]

        @F.pandas_udf("double")
        def coarse(i: pd.Series, v: pd.Series) -> pd.Series:
            return pd.Series([grid[a][min(np.searchsorted(grid[a], b), len(grid[a]) - 1)] for a, b in zip(i, v, strict=True)])

        found = counted(at.withColumn("v", coarse("i", "v"))).toArrow()
    column, value = found["i"].to_numpy(), found["v"].to_numpy()
    weight = found["n"].to_numpy() * weights[found["label"].to_numpy()]
    out = []
    for i in range(width):
        own = column == i
        v, place = np.unique(value[own], return_inverse=True)
        middle, upto = (v[1:] + v[:-1]) / 2, np.cumsum(np.bincount(place, weight[own], len(v)))
        if len(v) > BINS:
            stride, cuts = upto[-1] / BINS, []
            for k in range(1, len(v)):
                wanted = (len(cuts) + 1) * stride
                if len(cuts) < BINS - 1 and abs(upto[k - 1] - wanted) < abs(upto[k] - wanted):
                    cuts.append(middle[k - 1])
            middle = np.array(cuts)
        out.append(middle.tolist())
    return out


def binned(x, bounds: list[list[float]]):
    """The bins of an array column, one byte each."""

    @F.pandas_udf("binary")
    def cell(x: pd.Series) -> pd.Series:
        m = np.array(x.tolist(), dtype=np.float64).reshape(len(x), -1)
        out = np.stack([np.searchsorted(b, m[:, i]) for i, b in enumerate(bounds)], axis=1).astype(np.uint8)
        return pd.Series([r.tobytes() for r in out])

    return cell(x)


def best_cuts(bins: np.ndarray, label: np.ndarray, n: np.ndarray, node: np.ndarray, counts: np.ndarray, weights: np.ndarray, wanted: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gain, column and bin of the best cut of every node; rows up to the bin go left.  Gains are 0 where there is none.

    ``wanted`` tells which columns a node may use; each side keeps ``least`` rows.
    """
    nodes, classes = counts.shape
    total = counts * weights
    weight = total.sum(axis=1)
    parent = np.square(total).sum(axis=1) / weight
    gain, column, cut = np.zeros(nodes), np.full(nodes, -1), np.zeros(nodes, dtype=np.int64)
    for f in range(bins.shape[1]):
        own = wanted[node, f]
        if not own.any():
            continue
        key = node[own] * BINS + bins[own, f]
        there = np.zeros(nodes * BINS, dtype=bool)
        there[key] = True
        at = np.flatnonzero(there)  # (node, bin) that have rows, in order
        place = np.cumsum(there) - 1
        held = np.bincount(place[key] * classes + label[own], n[own], len(at) * classes).reshape(-1, classes)
        of, bin_of = at // BINS, at % BINS
        first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        part = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(of)]))
        upto = np.cumsum(held, axis=0)
        left = upto - (upto[first] - held[first])[part]
        right = counts[of] - left
        lw, rw = left * weights, right * weights
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.square(lw).sum(axis=1) / lw.sum(axis=1) + np.square(rw).sum(axis=1) / rw.sum(axis=1) - parent[of]
        score[(left.sum(axis=1) < least) | (right.sum(axis=1) < least)] = -np.inf
        top = np.maximum.reduceat(score, first)
        hits = np.flatnonzero(score == top[part])[::-1]
        best = np.zeros(len(first), dtype=np.int64)
        best[part[hits]] = hits  # the first of equal ones
        better = top > gain[of[first]]
        who, best = of[first][better], best[better]
        gain[who], column[who], cut[who] = top[better], f, bin_of[best]
    gain[gain <= 1e-12 * weight] = 0.0  # what rounding leaves
    return gain, column, cut


def grow(bins: np.ndarray, label: np.ndarray, n: np.ndarray, weights: np.ndarray, rng: np.random.Generator, depth: int, least: int, per_node: int | None = None, prune: bool = True) -> dict[str, np.ndarray]:
    """A tree over rows of ``n`` each, level by level.

    ``feature`` is -1 at a leaf, whose ``counts`` of labels are kept; ``child`` is
    the left child, which the right one follows.
    """
    width, classes = bins.shape[1], len(weights)
    node, levels, base = np.zeros(len(n), dtype=np.int64), [], 0
    for level in range(depth + 1):
        nodes = int(node.max()) + 1 if len(node) else 0
        counts = np.bincount(node * classes + label, n, nodes * classes).reshape(nodes, classes)
        gain, column, cut = np.zeros(nodes), np.full(nodes, -1), np.zeros(nodes, dtype=np.int64)
        mixed = (counts > 0).sum(axis=1) > 1
        if level < depth and mixed.any():
            wanted = np.ones((nodes, width), dtype=bool)
            if per_node is not None and per_node < width:
                wanted = rng.random((nodes, width)).argsort(axis=1).argsort(axis=1) < per_node
            gain, column, cut = best_cuts(bins, label, n, node, counts, weights, wanted & mixed[:, None], least)
        split = gain > 0
        rank = np.cumsum(split) - 1
        levels.append([np.where(split, column, -1), cut, np.where(split, base + nodes + 2 * rank, -1), counts, gain])
        base += nodes
        on = split[node]
        if not on.any():
            break
        bins, label, n, node = bins[on], label[on], n[on], node[on]
        node = 2 * rank[node] + (bins[np.arange(len(node)), column[node]] > cut[node])
    feature, cut, child, counts, gain = (np.concatenate(a) for a in zip(*levels, strict=True))
    ends = np.cumsum([len(v[0]) for v in levels])
    told = (counts * weights).argmax(axis=1)
    if prune:
        for start, end in zip([*ends[-2::-1][1:], 0], ends[-2::-1], strict=True) if len(ends) > 1 else ():
            inner = start + np.flatnonzero(feature[start:end] >= 0)
            c = child[inner]
            same = inner[(feature[c] < 0) & (feature[c + 1] < 0) & (told[c] == told[c + 1])]
            feature[same], child[same] = -1, -1
    kept = np.zeros(len(feature), dtype=bool)
    kept[:1] = True
    for start, end in zip([0, *ends[:-1]], ends, strict=True):
        inner = start + np.flatnonzero(kept[start:end] & (feature[start:end] >= 0))
        kept[child[inner]] = kept[child[inner] + 1] = True
    name = np.cumsum(kept) - 1
    feature, cut, child, counts, gain = feature[kept], cut[kept], child[kept], counts[kept], gain[kept]
    child = np.where(feature >= 0, name[child], -1)
    importance = np.bincount(feature[feature >= 0], gain[feature >= 0], width)
    return {"feature": feature, "cut": cut, "child": child, "counts": counts, "importance": importance}


def leaf_of(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, child: np.ndarray) -> np.ndarray:
    """The leaf that each row comes to."""
    node, left = np.zeros(len(bins), dtype=np.int64), np.arange(len(bins))
    while len(left := left[feature[node[left]] >= 0]):
        own = node[left]
        node[left] = child[own] + (bins[left, feature[own]] > cut[own])
    return node


class ForestModel(Model, MLWritable, MLReadable):
    """Trees in a table of the shared folder; rows of equal bins are scored once, when :meth:`transform` is called."""

    def __init__(self, trees: DataFrame | None = None, bounds: list[list[float]] | None = None, weights: list[float] | None = None) -> None:
        super().__init__()
        self.trees, self.bounds, self.weights = trees, bounds, weights

    @property
    def featureImportances(self) -> DenseVector:
        """The gains of a column's nodes, as shares of their tree and then of all trees."""
        rows = np.array([r[0] for r in self.trees.orderBy("tree").select("importance").collect()])
        total = rows.sum(axis=1, keepdims=True)
        mean = np.divide(rows, total, out=np.zeros_like(rows), where=total > 0).sum(axis=0)
        return Vectors.dense(mean / mean.sum() if mean.sum() else mean)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        width, classes, weights = len(self.bounds), len(self.weights), np.array(self.weights)
        rows = dataset.withColumn("_cell", binned(vector_to_array("features"), self.bounds))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(0, batch.num_rows, BLOCK):
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(batch.slice(k, BLOCK).column(0).to_pylist())], pa.binary())], ["cells"])

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[bytes, np.ndarray] = {}
            held_cells = 0

            def given(cells: bytes, total: np.ndarray) -> pa.RecordBatch:
                own = [cells[k : k + width] for k in range(0, len(cells), width)]
                return pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), *[pa.array(total[:, c]) for c in range(classes)]], ["_cell", *[f"_p{c}" for c in range(classes)]])

            for batch in batches:
                for t in batch.to_pylist():
                    feature, cut, child = (np.frombuffer(t[c], kind) for c, kind in (("feature", np.int16), ("cut", np.uint8), ("child", np.int32)))
                    held = np.frombuffer(t["leaf"], np.uint32).reshape(-1, classes) * weights
                    shares = np.rint(held / held.sum(axis=1, keepdims=True) * UNIT).astype(np.int64)
                    number = np.cumsum(feature < 0) - 1
                    x = np.frombuffer(t["cells"], np.uint8).reshape(-1, width)
                    found = shares[number[leaf_of(x, feature, cut, child)]]
                    if t["cells"] in sums:
                        sums[t["cells"]] += found
                    else:
                        if held_cells + len(x) > HELD:
                            yield from (given(*s) for s in sums.items())
                            sums, held_cells = {}, 0
                        sums[t["cells"]] = found
                        held_cells += len(x)
            for cells, total in sums.items():
                yield given(cells, total)

        blocks = rows.select("_cell").distinct().mapInArrow(pack, "cells binary")
        trees = self.trees.select("feature", "cut", "child", "leaf").coalesce(TOGETHER)  # each task gives one row of sums for a cell
        small = math.prod(len(b) + 1 for b in self.bounds) * width <= BROADCAST  # whatever the rows are
        pairs = trees.crossJoin(F.broadcast(blocks)) if small else trees.crossJoin(blocks)
        names = [f"_p{c}" for c in range(classes)]
        parts = pairs.mapInArrow(score, "_cell binary, " + ", ".join(f"{c} long" for c in names))
        sums = stored(parts.groupBy("_cell").agg(*[F.sum(c).alias(c) for c in names]))
        total = sum((F.col(c) for c in names[1:]), F.col(names[0]))
        raw = F.array(*[F.col(c) / F.lit(float(UNIT)) for c in names])
        best = F.array_position(F.array(*names), F.greatest(*names) if classes > 1 else F.col(names[0])) - 1
        out = rows.join(sums, "_cell").withColumns({"rawPrediction": array_to_vector(raw), "probability": array_to_vector(F.array(*[F.col(c) / total for c in names])), "prediction": best.cast("double")})
        return out.drop("_cell", *names)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: ForestModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        from pyspark.ml.util import DefaultParamsWriter

        m = self.model
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession, extraMetadata={"bounds": json.dumps(m.bounds), "weights": json.dumps(m.weights)})
        m.trees.write.parquet(f"{path}/trees")


class _Reader(MLReader):
    def load(self, path: str) -> ForestModel:
        from pyspark.ml.util import DefaultParamsReader

        about = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = ForestModel(self.sparkSession.read.schema(TREES).parquet(f"{path}/trees"), json.loads(about["bounds"]), json.loads(about["weights"]))
        return model._resetUid(about["uid"])


class Forest(Estimator):
    """An estimator over ``features``, ``_label`` and ``weight``, which is the same for all rows of a label."""

    def __init__(self, trees: int = 300, depth: int = 16, least: int = 2, seed: int = 42, limit: int = LIMIT) -> None:
        super().__init__()
        self.trees, self.depth, self.least, self.seed, self.limit = trees, depth, least, seed, limit

    def plain(self) -> RandomForestClassifier:
        """The same forest as MLlib grows it."""
        return RandomForestClassifier(numTrees=self.trees, maxDepth=self.depth, minInstancesPerNode=self.least, weightCol="weight", labelCol="_label", seed=self.seed)

    def _fit(self, dataset: DataFrame):
        spark = SparkSession.active()
        rows = stored(dataset.select(vector_to_array("features").alias("x"), F.col("_label").cast("int").alias("label"), "weight"))
        about = rows.groupBy("label").agg(F.min("weight").alias("least"), F.max("weight").alias("most"), F.max(F.size("x")).alias("width")).collect()
        if not about:
            raise ValueError("a forest needs training rows")
        width, classes = about[0]["width"], max(r["label"] for r in about) + 1
        if any(r["least"] != r["most"] for r in about):
            return self.plain().fit(dataset)
        weights = np.ones(classes)
        for r in about:
            weights[r["label"]] = r["least"]
        bounds = thresholds(rows, weights, width)
        cells = rows.select(binned(F.col("x"), bounds).alias("cell"), "label").groupBy("cell", "label").agg(F.count("*").alias("n")).limit(self.limit + 1).toArrow()
        if cells.num_rows > self.limit:
            return self.plain().fit(dataset)
        cells = cells.sort_by([("cell", "ascending"), ("label", "ascending")])
        bins = np.frombuffer(b"".join(cells["cell"].to_pylist()), np.uint8).reshape(-1, width)
        label, n = cells["label"].to_numpy().astype(np.int64), cells["n"].to_numpy()
        depth, least, seed, per_node = self.depth, self.least, self.seed, math.ceil(math.sqrt(width)) if self.trees > 1 else width

        def run(batches):
            for pdf in batches:
                for tree in pdf["id"].tolist():
                    rng = np.random.default_rng([seed, tree])
                    times = rng.poisson(n)
                    drawn = times > 0
                    if not drawn.any():
                        drawn, times = np.ones(len(n), dtype=bool), n
                    t = grow(bins[drawn], label[drawn], times[drawn], weights, rng, depth, least, per_node)
                    leaf = t["counts"][t["feature"] < 0].astype(np.uint32)
                    yield pd.DataFrame({"tree": [tree], "feature": [t["feature"].astype(np.int16).tobytes()], "cut": [t["cut"].astype(np.uint8).tobytes()], "child": [t["child"].astype(np.int32).tobytes()], "leaf": [leaf.tobytes()], "importance": [t["importance"].tolist()]})

        parts = max(1, min(self.trees, 4 * spark.sparkContext.defaultParallelism))
        trees = stored(spark.range(0, self.trees, 1, parts).mapInPandas(run, TREES))
        return ForestModel(trees, bounds, weights.tolist())
