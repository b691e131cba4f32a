"""Packing by powers of two: a document becomes pieces of binary lengths, each its own sequence.

The token count of a document is written in binary: as many pieces of the full
length as fit, then one piece for each set bit of the rest, longest first.
Pieces of equal length share a bucket: each task deals the pieces of a bucket
into batches of ``BATCH_TOKENS`` tokens, all of one length, and gives them out
bucket by bucket.  So nothing is padded and no sequence crosses documents.

Defined results: a null or empty text is its end token alone, one piece of
length 1; repeated rows are packed one by one; null ids are kept; an empty
table gives no pieces; further columns are ignored.  ``sequence_id`` is unique
in one result: it holds the row's place in its partition and, in the lowest
bits, the bucket.  ``batch_id`` and ``batch_row`` tell a piece's batch and its
place there; only a task's last batch of a bucket may be short.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes, texts_only
from .engines import ChunkCache, WordEngine, load, packed
from .token_counts import safe_parts

MAX_LENGTH = 4096
#: Tokens of a batch of equal lengths.
BATCH_TOKENS = 1 << 16


_CACHES: dict[str, ChunkCache] = {}


def encoder(path: str):
    """A function from texts to their packed ids."""
    engine = load(path)
    if isinstance(engine, WordEngine):
        cache = _CACHES.setdefault(path, ChunkCache(lambda chunk: packed(engine.encode(chunk))))

        def encode(texts: list[str]) -> list[bytes]:
            out = []
            for text in texts:
                parts = []
                for part in safe_parts(text):
                    parts.append(b"".join(map(cache.__getitem__, engine.chunks(part))))
                    cache.age()
                out.append(parts[0] if len(parts) == 1 else b"".join(parts))
            return out

        return encode
    library = getattr(engine, "library", engine)
    if hasattr(library, "encode_batch_fast"):
        return lambda texts: [packed(e.ids) for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    return lambda texts: [packed(ids) for ids in library.encode(texts, num_threads=1)]


def binary_lengths(n: int, longest: int = MAX_LENGTH) -> list[int]:
    """Lengths of the pieces of ``n`` tokens, longest first; ``longest`` is a power of two."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(longest.bit_length() - 2, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, tokenizer: str, end_id: int, longest: int = MAX_LENGTH, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, bucket, ids (unless ``with_ids`` is false), CRC-32 of the ids, place."""
    if longest & (longest - 1) or longest < 1:
        raise ValueError("the longest sequence must be a power of two")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket int, batch_id long, batch_row int" + ", ids binary" * with_ids

    def run(batches):
        encode = encoder(tokenizer)
        tail = packed([end_id])
        task = TaskContext.get()
        taken = np.zeros(longest.bit_length(), dtype=np.int64)  # pieces of each bucket so far
        for batch in by_bytes(batches):
            texts = batch.column(1).to_pylist()
            crcs: list[int] = []
            lengths: list[int] = []
            parts: list[bytes] = []
            counts, totals = [], []
            for ids in encode(texts):
                ids += tail
                own = binary_lengths(len(ids) // 4, longest)
                at, view = 0, memoryview(ids)
                for n in own:
                    piece = view[at : at + 4 * n]
                    crcs.append(crc32(piece))
                    if with_ids:
                        parts.append(bytes(piece))
                    at += 4 * n
                lengths += own
                counts.append(len(own))
                totals.append(len(ids) // 4)
            length = np.array(lengths, dtype=np.int64)
            of = np.repeat(np.arange(len(counts)), counts)
            before = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
            first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)[:-1]
            total = np.array(totals, dtype=np.int64)
            start = before[:-1] - before[first][of] if len(length) else length
            bucket = np.log2(np.maximum(length, 1)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            counted = np.bincount(bucket, minlength=len(taken))
            rank = np.empty(len(bucket), dtype=np.int64)
            rank[order] = np.arange(len(bucket)) - np.repeat(np.cumsum(counted) - counted, counted) + np.repeat(taken, counted)
            taken += counted
            rows_each = np.maximum(BATCH_TOKENS >> bucket, 1)
            batch_id = ((task.partitionId() if task else 0) << 40) | (rank // rows_each << 5) | bucket
            columns = [batch.column(0).take(pa.array(of)), pa.array(start), pa.array(length), pa.array(crcs, pa.int64()), pa.array(total[of] if len(of) else length), pa.array(bucket.astype(np.int32)), pa.array(batch_id), pa.array((rank % rows_each).astype(np.int32))]
            if with_ids:
                columns.append(pa.array(parts, pa.binary()))
            columns = [c.take(pa.array(order)) for c in columns]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = [x.split()[0] for x in schema.split(", ")]
    rows = texts_only(docs, id_col, text_col).mapInArrow(run, schema)
    own = [F.col(c).alias(id_col) if c == "doc_id" else F.col(c) for c in names]
    place = F.shiftleft(F.monotonically_increasing_id(), 5).bitwiseOR(F.col("bucket").cast("long"))
    return rows.select(*own, place.alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
