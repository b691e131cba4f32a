"""Shared pieces: column selection, vectorised word scanning, bounded Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text handled at once in a Python worker; bounds its memory.
BATCH_BYTES = 4 << 20

# The six ASCII white-space bytes that separate words.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACE_BYTES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_MULT = 0x9E3779B97F4A7C15
#: The low k bytes of a little-endian word, for k from 0 to 8.
_LOW_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def texts_only(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs, under fixed names, null texts as empty ones."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def id_crc(id_col: str | Column = "doc_id") -> Column:
    """CRC-32 of the id as decimal text."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(col.cast("string").cast("binary"))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: One random-looking 64-bit value per byte, made by rule.
_BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULT))


def word_spans(buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and text number of every word in texts laid end to end.

    ``starts`` has one entry more than there are texts.  Words never cross texts.
    """
    n = len(buf)
    if not n:
        return (np.zeros(0, dtype=np.int64),) * 3
    word = ~_IS_SPACE[buf]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    cut = starts[(starts > 0) & (starts < n)]
    first[cut] = word[cut]
    last[cut - 1] = word[cut - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return begin, end, np.searchsorted(starts, begin, side="right") - 1


def word_hashes(buf: np.ndarray, begin: np.ndarray, end: np.ndarray, lower: bool, block: int = 1 << 21) -> np.ndarray:
    """A 64-bit hash of every span, about ``block`` bytes at a time.

    Each eight bytes of a span are mixed on their own, mixed again with their
    place, and summed, so no structure of a text survives into the sum.
    """
    out = np.empty(len(begin), dtype=np.uint64)
    i = 0
    while i < len(begin):
        j = max(int(np.searchsorted(begin, begin[i] + block, side="left")), i + 1)
        lo, hi = int(begin[i]), int(end[i:j].max())
        part = np.zeros(hi - lo + 8, dtype=np.uint8)
        part[: hi - lo] = _LOWER[buf[lo:hi]] if lower else buf[lo:hi]
        wide = np.ndarray((hi - lo + 1,), "<u8", part.data, strides=(1,))  # the eight bytes from each place on
        at, size = begin[i:j] - lo, end[i:j] - begin[i:j]
        if size.max() <= 8:
            total = mix64(mix64(wide[at] & _LOW_BYTES[size]))
        else:
            k = np.maximum((size + 7) // 8, 1)
            first = np.cumsum(k) - k
            place = np.arange(int(k.sum())) - np.repeat(first, k)
            left = np.minimum(np.repeat(size, k) - 8 * place, 8)
            v = mix64(wide[np.repeat(at, k) + 8 * place] & _LOW_BYTES[left])
            total = np.add.reduceat(mix64(v + place.astype(np.uint64) * np.uint64(_MULT)), first)
        out[i:j] = mix64(total + size.astype(np.uint64))
        i = j
    return out


def equal_spans(buf: np.ndarray, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """Which pairs of spans hold the same bytes, compared byte by byte, about ``block`` bytes at a time."""
    same = (a_end - a) == (b_end - b)
    left = np.flatnonzero(same)
    ends = np.cumsum((a_end - a)[left])
    i = 0
    while i < len(left):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + block, side="right")))
        own = left[i:j]
        size = (a_end - a)[own]
        of = np.repeat(np.arange(len(own)), size)
        step = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
        same[own[of[buf[a[own][of] + step] != buf[b[own][of] + step]]]] = False
        i = j
    return same


def ascending(keys: np.ndarray) -> np.ndarray:
    """The distinct keys in order."""
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column laid end to end and the bounds of its rows; no copy is made."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    flat = np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]] if data is not None and bounds[-1] > bounds[0] else np.zeros(0, dtype=np.uint8)
    return flat, bounds - bounds[0]


def by_bytes(batches: Iterator[pa.RecordBatch], name: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices whose texts hold about ``limit`` bytes; a longer text stands alone."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(name))
        _, bounds = text_buffer(col)
        i, n = 0, batch.num_rows
        while i < n:
            j = int(np.searchsorted(bounds, bounds[i] + limit, side="right")) - 1
            j = min(max(j, i + 1), n)
            yield batch.slice(i, j - i)
            i = j


def free_name(wanted: str, taken: list[str]) -> str:
    """``wanted``, with underscores in front until no other column has it (names ignore case)."""
    used = {x.lower() for x in taken}
    while wanted.lower() in used:
        wanted = f"_{wanted}"
    return wanted


def append_struct(docs: DataFrame, text_col: str, out: str, fields: T.StructType, make, keep: list[str] | None = None, limit: int = BATCH_BYTES) -> DataFrame:
    """Rows of ``docs`` (columns ``keep``; default all) with a struct column ``out``.

    ``make`` takes nothing, is called once in each task, and returns a function
    from an Arrow text column to a list of arrays, one for each of ``fields``.
    """
    kept = docs.columns if keep is None else keep
    text = free_name("text_", kept)
    frame = docs.select(*[docs[c] for c in kept], docs[text_col].cast("string").alias(text))
    schema = T.StructType([*[frame.schema[c] for c in kept], T.StructField(out, fields)])
    names, width = [f.name for f in fields], len(kept)

    def run(batches):
        measure = make()
        for batch in by_bytes(batches, text, limit):
            arrays = [a if isinstance(a, pa.Array) else pa.array(a) for a in measure(batch.column(width))]
            struct = pa.StructArray.from_arrays(arrays, names)
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], struct], [*kept, out])

    return frame.mapInArrow(run, schema)
