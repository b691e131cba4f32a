"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are binned by quantiles; trees of one depth are grown
level by level from histograms of gradients, and flattened into arrays that
are walked for all rows at once in numpy.

Training uses a bounded sample of about ``sample`` labelled documents chosen by
a hash of the id; statistics, scores and counts cover all documents.

Defined results: a null or empty text has statistics 0 and is scored like any
other; without labels of both kinds every score is the share of label 1 (0.5
with none).  Several labels of one document count by their greatest; null
labels and ids are not learned from.  Repeated rows give one row each; an empty
table gives none; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_struct, text_buffer, word_hashes, word_spans
from .quality_rules import MEASURES, _measurer

SAMPLE, BINS, DEPTH, TREES, RATE = 20_000, 48, 4, 60, 0.15

STATISTICS = (
    "n_words", "n_chars", "n_lines", "mean_word", "longest_word", "words_a_line", "symbols", "capitals", "digits", "stops", "marks", "bars", "exclamations",
    "non_ascii", "white", "repeated_lines", "repeated_windows", "distinct_words", "top_word", "entropy", "capital_words", "mean_square_word",
)


def statistics(column: pa.Array, measure=None) -> np.ndarray:
    """Texts x STATISTICS, as 32-bit floats."""
    m = dict(zip(MEASURES, (measure or _measurer())(column), strict=True))
    buf, bounds = text_buffer(column)
    n = len(bounds) - 1
    hist = np.zeros((n, 256))
    for i in range(n):
        if bounds[i + 1] > bounds[i]:
            hist[i] = np.bincount(buf[bounds[i] : bounds[i + 1]], minlength=256)
    begin, end, doc = word_spans(buf, bounds)
    size = (end - begin).astype(np.float64)
    words = np.maximum(m["n_words"], 1)
    longest = np.zeros(n)
    np.maximum.at(longest, doc, size)
    key = word_hashes(buf, begin, end, lower=True)
    order = np.lexsort((key, doc))
    k, d = key[order], doc[order]
    first = np.ones(len(k), dtype=bool)
    first[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(first)
    counts = np.diff(np.append(at, len(k)))
    top = np.zeros(n)
    np.maximum.at(top, d[at], counts)
    chars = np.maximum(np.diff(bounds), 1)
    share = hist / chars[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = -np.where(share > 0, share * np.log2(share), 0).sum(axis=1)
    of = lambda text: hist[:, list(text)].sum(axis=1)
    large = (buf[begin] >= 65) & (buf[begin] <= 90) if len(begin) else np.zeros(0)
    lines = np.maximum(m["n_lines"], 1)
    return np.stack(
        [
            m["n_words"], np.diff(bounds), m["n_lines"], m["word_chars"] / words, longest, words / lines, m["n_symbols"] / words, m["n_upper"] / np.maximum(m["word_chars"], 1),
            of(b"0123456789") / chars, of(b".") / words, of(b",;:?") / words, of(b"|") / words, of(b"!") / words,
            hist[:, 128:].sum(axis=1) / chars, of(b" \t\n\r\v\f") / chars, m["n_dup_lines"] / lines, m["n_repeat_words"] / words, np.bincount(d[at], minlength=n) / words,
            top / words, entropy, np.bincount(doc, weights=large, minlength=n) / words, np.bincount(doc, weights=size * size, minlength=n) / words,
        ],
        axis=1,
    ).astype(np.float32)


@dataclass
class Forest:
    """Complete trees as arrays: (tree, inner node) features and thresholds, (tree, leaf) values."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            total += v[node - inner]
        return 1 / (1 + np.exp(-total))


def train(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, ridge: float = 2.0) -> Forest:
    """Boosts log loss; splits are chosen from histograms of gradients and curvatures."""
    inner = (1 << depth) - 1
    empty = Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner), np.float32), np.zeros((0, inner + 1)), 0.0)
    if not len(y):
        return empty
    p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    empty.base = float(np.log(p / (1 - p)))
    if y.min() == y.max():
        return empty
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])).astype(np.float32) for f in range(x.shape[1])]
    code = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    score = np.full(len(y), empty.base)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        q = 1 / (1 + np.exp(-score))
        g, h = y - q, q * (1 - q)
        node = np.zeros(len(y), dtype=np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32)
        for level in range(depth):
            lo, width = (1 << level) - 1, 1 << level
            own = node - lo
            best = np.zeros(width)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                cell = own * bins + code[:, f]
                gs, hs = (np.bincount(cell, weights=w, minlength=width * bins).reshape(width, bins).cumsum(axis=1) for w in (g, h))
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain = np.where((hs > 1) & (ht - hs > 1), gain, 0)[:, : len(e)]
                at = gain.argmax(axis=1)
                top = gain[np.arange(width), at]
                better = top > best + 1e-9
                best = np.where(better, top, best)
                feature[lo : lo + width][better] = f
                threshold[lo : lo + width][better] = e[at[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf = node - inner
        gs, hs = (np.bincount(leaf, weights=w, minlength=inner + 1) for w in (g, h))
        value = rate * gs / (hs + ridge)
        score += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Forest(np.array(features), np.array(thresholds), np.array(values), empty.base)


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``x``, the statistics as an array of floats."""
    fields = T.StructType([T.StructField("x", T.ArrayType(T.FloatType()))])

    def make():
        measure = _measurer()

        def run(column: pa.Array):
            rows = statistics(column, measure)
            flat = pa.array(rows.reshape(-1), pa.float32())
            return [pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), flat)]

        return run

    return append_struct(docs.select(id_col, text_col), text_col, "s", fields, make, keep=[id_col]).select(id_col, "s.x")


def fit(stats: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", label_col: str = "quality", sample: int = SAMPLE) -> Forest:
    """A forest from a bounded sample of the labelled rows for which ``usable`` (over the id) holds."""
    known = labels.filter(labels[label_col].isNotNull() & labels[id_col].isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).cast("double").alias("y")).filter(usable)
    share = min(1.0, sample / max(1, known.count()))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("quality sample")), F.lit(1 << 30)) / float(1 << 30)
    rows = stats.select(F.col(id_col).alias("doc_id"), "x").join(known.filter(draw < share), "doc_id").limit(2 * sample).collect()
    rows = sorted((r["doc_id"], r["y"], r["x"]) for r in rows)
    x = np.array([r[2] for r in rows], dtype=np.float32).reshape(len(rows), len(STATISTICS))
    return train(x, np.array([min(1.0, max(0.0, r[1])) for r in rows]))


def score(stats: DataFrame, forest: Forest, threshold: float = 0.3, id_col: str = "doc_id") -> DataFrame:
    """id, ``score`` and ``predicted`` of every row of statistics."""

    def run(batches):
        for batch in batches:
            x = batch.column(1)
            flat = np.asarray(x.flatten(), dtype=np.float32).reshape(len(x), len(STATISTICS))
            s = forest.scores(flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], [id_col, "score", "predicted"])

    return stats.select(F.col(id_col).cast("long").alias(id_col), "x").mapInArrow(run, f"{id_col} long, score double, predicted int")
