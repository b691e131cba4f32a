"""Quartile bucket digests of texts, and their likeness to an edit and to the next document.

Every three successive bytes are hashed into one of ``BUCKETS`` counters.  The
quartiles of a text's counters turn each into two bits; with a code of the
length they form the digest.  Two digests differ by the sum of differences of
their codes over the sum of their larger codes, a score between 0 and 1, to
which a difference of length adds at most ``LENGTH_SHARE``; likeness is what is
left to 1.

Defined results: a null text is an empty one; texts under three bytes have
empty counters and differ by length alone; equal texts have equal digests and
likeness 1.  Documents of one id are ordered by text; those without an id come
after all others, by a hash of their texts; and the last document is followed by the first; a single document
follows itself.  An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTE_VALUE, by_bytes, text_buffer, texts_only

BUCKETS = 512
#: What lengths far apart add to a difference, and the steps of the length code to the largest such addition.
LENGTH_SHARE, LENGTH_STEPS = 0.2, 8


def digests(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes (texts x buckets, 0 to 3) and length codes (steps of a quarter of a doubling) of a text column."""
    buf, bounds = text_buffer(column)
    n = len(bounds) - 1
    codes = np.zeros((n, BUCKETS), dtype=np.uint8)
    if len(buf) >= 3:
        table = (_BYTE_VALUE >> np.uint64(32)).astype(np.uint32)
        v = table[buf]
        h = v[:-2] * np.uint32(0x85EBCA6B) + v[1:-1] * np.uint32(0xC2B2AE35) + v[2:]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x27D4EB2F)
        bucket = (h >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64)
        for i in range(n):
            lo, hi = bounds[i], bounds[i + 1] - 2
            if hi > lo:
                counts = np.bincount(bucket[lo:hi], minlength=BUCKETS)
                q = np.partition(counts, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1])
                for k in (BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1):
                    codes[i] += counts > q[k]
    size = np.diff(bounds).astype(np.float64)
    return codes, np.rint(4 * np.log2(size + 1)).astype(np.uint8)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Row by row, 1 less the bounded difference of two digests."""
    x, y = a[0].astype(np.int16), b[0].astype(np.int16)
    most = np.maximum(x, y).sum(axis=1)
    body = np.where(most > 0, np.abs(x - y).sum(axis=1) / np.maximum(most, 1), 0.0)
    length = np.minimum(np.abs(a[1].astype(np.int16) - b[1].astype(np.int16)) / LENGTH_STEPS, 1.0)
    return 1.0 - np.minimum(body + LENGTH_SHARE * length, 1.0)


def as_text(digest: tuple[np.ndarray, np.ndarray]) -> list[str]:
    """Hexadecimal form: the length code, then two bits for each bucket."""
    codes = digest[0].reshape(len(digest[0]), BUCKETS // 4, 4)
    packed = (codes * np.array([64, 16, 4, 1], dtype=np.uint8)).sum(axis=2, dtype=np.uint8)
    rows = np.concatenate([digest[1][:, None], packed], axis=1).astype(np.uint8)
    return [r.tobytes().hex() for r in rows]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``fingerprint`` of every whole text."""

    def run(batches):
        for batch in by_bytes(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(as_text(digests(batch.column(1))), pa.string())], [id_col, "fingerprint"])

    return texts_only(docs, id_col, text_col).mapInArrow(run, f"{id_col} long, fingerprint string")


#: Most ranges of ids; their bounds come to the driver.
RANGES = 1 << 16


def _constant(values: list[int]) -> F.Column:
    """One array literal of whole numbers."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")


def _ranges(frame: DataFrame, parts: int) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Ascending ids that end about ``parts`` equal ranges; (range, least hash, number of ranges) of the ranges of rows without an id."""
    shares = ",".join(str(i / parts) for i in range(1, parts))
    cut = F.expr(f"percentile_approx(doc_id, array({shares}), {max(10000, 4 * parts)})") if parts > 1 else F.array().cast("array<long>")
    row = frame.agg(cut.alias("q"), F.max("doc_id").alias("m"), F.count("*").alias("n"), F.count("doc_id").alias("known")).first()
    cuts = [] if row["m"] is None else sorted({*(row["q"] or []), row["m"]})
    if row["known"] == row["n"]:
        return cuts, []
    z = max(1, math.ceil(parts * (row["n"] - row["known"]) / row["n"]))
    rows = frame.filter("doc_id IS NULL").groupBy((len(cuts) + _share(F.col("hash"), z)).cast("int").alias("range")).agg(F.min("hash").alias("first")).orderBy("range").collect()
    return cuts, [(r["range"], r["first"], z) for r in rows]


def _share(h: F.Column, z: int) -> F.Column:
    """Which of z equal parts a hash of 63 bits is in."""
    return F.shiftright(F.shiftright(h, 32) * z, 31)


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of every text and of its edit, whose last half is the head of the next text by descending id.

    Ranges of ids, and after them ranges of the hashes of texts without an id,
    are sorted each in a partition of its own.  The first document of a range
    is sent as a guest to the range before it as well, since it comes next
    there, and that of the first range to the last.
    """
    frame = texts_only(docs, id_col, text_col).withColumn("hash", F.shiftrightunsigned(F.when(F.col("doc_id").isNull(), F.xxhash64("text")), 1))
    parts = max(1, min(RANGES, 2 * frame.rdd.getNumPartitions()))
    cuts, nulls = _ranges(frame.select("doc_id", "hash"), parts)
    n = len(cuts)
    goes = []
    if n:
        values, step = _constant(cuts), max(1, math.isqrt(n))
        low = F.size(F.filter(_constant(cuts[step - 1 :: step]), lambda c: c < F.col("doc_id"))) * step if n > step else F.lit(0)
        own = low + F.size(F.filter(F.slice(values, low + 1, step), lambda c: c < F.col("doc_id")))
        last = nulls[-1][0] if nulls else 0
        before = F.when(F.element_at(values, F.col("bucket") + 1) == F.col("doc_id"), F.when(F.col("bucket") + 1 < n, F.col("bucket") + 1).otherwise(last))
        goes = [(F.col("doc_id").isNotNull(), own, before)]
    if nulls:
        numbers, firsts = [k for k, _, _ in nulls], [u for _, u, _ in nulls]
        place = F.array_position(_constant(numbers), F.col("bucket").cast("long")).cast("int")
        before = F.when(F.element_at(_constant(firsts), place) == F.col("hash"), F.element_at(_constant([0 if n else numbers[-1], *numbers[:-1]]), place))
        goes.append((F.col("doc_id").isNull(), n + _share(F.col("hash"), nulls[0][2]), before))
    bucket = before = None
    for test, own, first in goes:
        bucket = F.when(test, own) if bucket is None else bucket.otherwise(own)
        before = F.when(test, first) if before is None else before.otherwise(first)
    if goes:
        rows = F.array(F.struct(F.col("bucket").alias("range"), F.lit(0).alias("guest")), F.struct(F.col("before").alias("range"), F.lit(1).alias("guest")))
        frame = frame.withColumn("bucket", bucket.cast("int")).withColumn("before", before.cast("int"))
        frame = frame.select("doc_id", "text", "hash", F.explode(F.filter(rows, lambda g: g["range"].isNotNull())).alias("g")).select("doc_id", "text", "hash", "g.range", "g.guest")
    else:
        frame = frame.select("doc_id", "text", "hash", F.lit(0).alias("range"), F.lit(0).alias("guest"))
    total = max(1, n, *[k + 1 for k, _, _ in nulls])
    ordered = frame.repartitionById(total, "range").sortWithinPartitions("range", "guest", F.col("doc_id").desc_nulls_last(), "hash", "text").select("doc_id", "text", "range", "guest")
    schema = f"{id_col} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [x.split()[0] for x in schema.split(", ")]

    def pairs(batches):
        """Slices of (id, text, next text), in order; only the last text of a slice and the first of a range are held."""
        held = first = None  # (range, id, text), text
        for batch in by_bytes(batches):
            out = []
            for i, text, r, guest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is not None and held[0] == r:
                    out.append((held[1], held[2], text))
                elif held is not None:  # the range had no guest: its ids are all null
                    out.append((held[1], held[2], first))
                if guest:
                    if held is not None and held[0] == r:
                        held = None
                    continue
                if held is None or held[0] != r:
                    first = text
                held = (r, i, text)
            if out:
                yield out
        if held is not None:
            yield [(held[1], held[2], first)]

    def run(batches):
        for rows in pairs(batches):
            ids, texts, after = zip(*rows, strict=True)
            edited = [t[: len(t) - len(t) // 2] + a[: len(t) // 2] for t, a in zip(texts, after, strict=True)]
            own, edit, following = (digests(pa.array(x, pa.large_string())) for x in (texts, edited, after))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                    pa.array(as_text(own), pa.string()), pa.array(as_text(edit), pa.string()), pa.array(likeness(own, edit)), pa.array(likeness(own, following)),
                ],
                names,
            )

    return ordered.mapInArrow(run, schema)
