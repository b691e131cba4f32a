"""Language identification by a convolutional network over bytes, trained and run in numpy.

Texts are cut into fixed-length windows, all of them.  In a window filters of
several widths slide over the bytes (ASCII capitals in lower case); the
greatest response of each filter, if above 0, goes into a softmax.  A filter's
response is a sum of table rows, one for each pair of bytes.  The probabilities
of a text's windows are averaged, weighted by the bytes they hold.

Training uses a bounded sample: about ``per_language`` documents of each
language, however many languages there are, chosen by a hash of the id,
``WINDOWS_EACH`` windows spread over each whole text.

Defined results: a null text or one without a letter is ``und`` with score 0,
and so is every text if nothing can be learned from.  Repeated rows give one
row each; null ids are never learned from; an empty table gives none; further
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _LOWER, append_struct, free_name, text_buffer

WINDOW, WIDTHS, FILTERS = 192, (2, 3, 4), 8
PER_LANGUAGE, WINDOWS_EACH = 300, 3
UNKNOWN = "und"
FIELDS = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


@dataclass
class Network:
    """Weights: for each width (place, byte, filter); then (filter, language) and its offsets."""

    labels: list[str]
    filters: list[np.ndarray]
    dense: np.ndarray
    offset: np.ndarray


def windows_of(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (rows of WINDOW bytes, padded with 0) of texts laid end to end, their text numbers and lengths."""
    sizes = np.diff(bounds)
    per = -(-sizes // WINDOW)
    of = np.repeat(np.arange(len(sizes)), per)
    first = np.cumsum(per) - per
    start = bounds[:-1][of] + (np.arange(len(of)) - first[of]) * WINDOW
    length = np.minimum(bounds[1:][of] - start, WINDOW)
    at = start[:, None] + np.arange(WINDOW)
    padded = np.concatenate([_LOWER[buf], np.zeros(WINDOW, dtype=np.uint8)])
    rows = padded[at]
    rows[np.arange(WINDOW) >= length[:, None]] = 0
    return rows, of, length


class Runner:
    """A network ready to be applied: pair tables instead of single bytes."""

    def __init__(self, net: Network, block: int = 128) -> None:
        self.net, self.block, self.parts = net, block, []
        for w in net.filters:
            tables = []
            for p in range(0, len(w), 2):
                pair = w[p][:, None, :] + (w[p + 1][None, :, :] if p + 1 < len(w) else 0)
                tables.append(np.ascontiguousarray(np.broadcast_to(pair, (256, 256, FILTERS)).reshape(65536, FILTERS), dtype=np.float32) if p + 1 < len(w) else w[p].astype(np.float32))
            self.parts.append((len(w), tables))

    def pooled(self, rows: np.ndarray) -> np.ndarray:
        """Greatest responses (windows x filters), at least 0."""
        out = np.empty((len(rows), len(WIDTHS) * FILTERS), dtype=np.float32)
        for i in range(0, len(rows), self.block):
            part = rows[i : i + self.block]
            pairs = part[:, :-1].astype(np.int32) * 256 + part[:, 1:]
            for k, (width, tables) in enumerate(self.parts):
                n = WINDOW - width + 1
                total = np.take(tables[0], pairs[:, :n], axis=0, mode="clip")
                for j, table in enumerate(tables[1:], 1):
                    total += np.take(table, (pairs if len(table) > 256 else part)[:, 2 * j : 2 * j + n], axis=0, mode="clip")
                out[i : i + self.block, k * FILTERS : (k + 1) * FILTERS] = total.max(axis=1)
        return np.maximum(out, 0, out=out)

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        z = self.pooled(rows) @ self.net.dense + self.net.offset
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def train(rows: np.ndarray, labels: list[str], epochs: int = 8, rate: float = 0.01, batch: int = 64, seed: int = 7) -> Network | None:
    """Fits a network to windows and their languages by Adam; None without two windows."""
    names = sorted(set(labels))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    y = np.searchsorted(names, labels)
    weights = [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    weights += [rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(names))).astype(np.float32), np.zeros(len(names), dtype=np.float32)]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    share = np.bincount(y, minlength=len(names))
    weight_of = (len(y) / (len(names) * share))[y].astype(np.float32)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(order), batch):
            pick = order[i : i + batch]
            x, step = rows[pick], step + 1
            best, where = [], []
            for w in weights[: len(WIDTHS)]:
                n = WINDOW - len(w) + 1
                total = w[0][x[:, :n]]
                for p in range(1, len(w)):
                    total += w[p][x[:, p : p + n]]
                at = total.argmax(axis=1)
                where.append(at)
                best.append(np.take_along_axis(total, at[:, None, :], axis=1)[:, 0, :])
            raw = np.concatenate(best, axis=1)
            hidden = np.maximum(raw, 0)
            z = hidden @ weights[-2] + weights[-1]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            d = z / z.sum(axis=1, keepdims=True)
            d[np.arange(len(pick)), y[pick]] -= 1
            d *= weight_of[pick][:, None] / len(pick)
            back = (d @ weights[-2].T) * (raw > 0)
            grads = []
            for k, (w, at) in enumerate(zip(weights, where, strict=False)):
                g = np.zeros_like(w)
                own = back[:, k * FILTERS : (k + 1) * FILTERS]
                f = np.broadcast_to(np.arange(FILTERS), own.shape)
                for p in range(len(w)):
                    np.add.at(g[p], (np.take_along_axis(x, at + p, axis=1), f), own)
                grads.append(g)
            grads += [hidden.T @ d, d.sum(axis=0)]
            for w, g, (m, v) in zip(weights, grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Network(names, weights[: len(WIDTHS)], weights[-2], weights[-1])


def sample_windows(docs: DataFrame, usable: Column, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", per_language: int = PER_LANGUAGE) -> tuple[np.ndarray, list[str]]:
    """Windows and languages of the bounded training sample."""
    known = docs.filter(usable & docs[lang_col].isNotNull() & docs[text_col].isNotNull() & docs[id_col].isNotNull())
    counts = known.groupBy(lang_col).count().collect()
    if not counts:
        return np.zeros((0, WINDOW), dtype=np.uint8), []
    spark = docs.sparkSession
    share = F.broadcast(spark.createDataFrame([(r[0], min(1.0, per_language / r[1])) for r in counts], "known_lang string, share double"))  # one row for each language
    draw = F.pmod(F.xxhash64(id_col, F.lit("language sample")), F.lit(1 << 30)) / float(1 << 30)
    size = F.length("t")
    spread = F.array(*[F.substring(F.col("t"), (F.floor(F.greatest(size - WINDOW, F.lit(0)) * k / max(1, WINDOWS_EACH - 1)) + 1).cast("int"), F.lit(WINDOW)) for k in range(WINDOWS_EACH)])
    drawn = known.select(F.col(id_col).alias("i"), F.col(lang_col).alias("l"), draw.alias("draw"), F.col(text_col).alias("t")).join(share, F.col("l") == F.col("known_lang")).filter("draw < share")
    picked = drawn.select("i", "l", spread.alias("w"))
    rows = sorted((r["i"], r["l"], w) for r in picked.collect() for w in dict.fromkeys(r["w"]) if any(c.isalpha() for c in w))
    out = np.zeros((len(rows), WINDOW), dtype=np.uint8)
    for k, (_, _, text) in enumerate(rows):
        data = text.encode()[:WINDOW]
        out[k, : len(data)] = np.frombuffer(data, dtype=np.uint8)
    return _LOWER[out], [r[1] for r in rows]


def has_letter(column: pa.Array, buf: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which texts hold a letter of any script."""
    flag = np.zeros(256, dtype=bool)
    flag[65:91] = flag[97:123] = True
    total = np.zeros(len(buf) + 1, dtype=np.int64)
    np.cumsum(flag[buf], out=total[1:])
    found = total[bounds[1:]] > total[bounds[:-1]]
    for i in np.flatnonzero(~found & (np.diff(bounds) > 0)):
        found[i] = any(c.isalpha() for c in column[int(i)].as_py())
    return found


def predictor(net: Network | None):
    """A function from an Arrow text column to languages and scores."""
    if net is None:
        return lambda column: [pa.array([UNKNOWN] * len(column), pa.string()), pa.array(np.zeros(len(column)))]
    runner = Runner(net)

    def predict(column: pa.Array):
        buf, bounds = text_buffer(column)
        n = len(bounds) - 1
        letter = has_letter(column, buf, bounds)
        sums = np.zeros((n, len(net.labels)))
        i = 0
        while i < n:  # about 256 KB of windows at once
            j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + (1 << 18), side="right")) - 1)
            part = bounds[i : j + 1] - bounds[i]
            for a in range(0, int(part[-1]), 64 * WINDOW * 64):  # and of a long text
                b = min(int(part[-1]), a + 64 * WINDOW * 64)
                own = np.clip(part, a, b) - a
                rows, of, length = windows_of(buf[bounds[i] + a : bounds[i] + b], own)
                if len(rows):
                    p = runner.probabilities(rows) * length[:, None]
                    for k in range(p.shape[1]):
                        sums[i:j, k] += np.bincount(of, weights=p[:, k], minlength=j - i)
            i = j
        total = sums.sum(axis=1)
        best = sums.argmax(axis=1)
        score = np.where(letter & (total > 0), sums[np.arange(n), best] / np.maximum(total, 1e-12), 0.0)
        names = np.array([*net.labels, UNKNOWN], dtype=object)
        return [pa.array(names[np.where(letter, best, len(net.labels))], pa.string()), pa.array(np.clip(score, 0, 1))]

    return predict


def predict_languages(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``lang_pred`` and ``score`` of every whole text."""
    return append_struct(docs.select(id_col, text_col), text_col, "p", FIELDS, lambda: predictor(net), keep=[id_col]).select(id_col, "p.*")


def kept_documents(docs: DataFrame, net: Network | None, least: float = 0.4, text_col: str = "text") -> DataFrame:
    """Documents, with all their columns, that have a language with at least the score ``least``."""
    name = free_name("language", docs.columns)
    rows = append_struct(docs, text_col, name, FIELDS, lambda: predictor(net))
    return rows.filter((F.col(f"{name}.lang_pred") != UNKNOWN) & (F.col(f"{name}.score") >= least)).drop(name)
