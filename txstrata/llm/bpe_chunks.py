"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the bytes of a text cuts it where the content says so, so
a passage shared by documents gives the same chunks in all of them.  A chunk is
encoded once in a worker and kept, with its ids, its decoded bytes and its
outer word bounds, in a bounded cache.  Next to a join the ids of the two
chunks may differ from those of the whole, so the text around it is encoded
again, from a word bound of the left chunk to one of the right, and the ids of
its first and last part are compared with those of the chunks.  If they differ
the window is widened by a bound on either side, and so on; a chunk without
bounds left goes into the window whole.

A blank between two letters is a bound of the pattern whatever surrounds it, so
two parts that agree between two such bounds agree from there on inwards.

Defined results: null and empty texts have no ids; repeated rows give one row
each; null ids are kept; an empty table gives none; further columns are
ignored.  Texts of any length are taken chunk by chunk.
"""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass
from hashlib import sha256
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import _BYTE_VALUE, by_bytes, texts_only
from .engines import ByteEngine, ChunkCache, load

#: Mean, least and most bytes of a chunk; entries of the chunk cache (about 10 KB each).
MEAN_BYTES, LEAST_BYTES, MOST_BYTES, CHUNKS = 1024, 128, 8192, 4000
#: Word bounds of a chunk that are known on either side, so the times that a window is widened before it takes the chunk whole.
DEPTH = 6

#: A blank between two letters is always a bound of the pattern, whatever surrounds it.
_FORCED = re.compile(r"(?<=[A-Za-zÀ-ÖØ-öø-ɏ]) (?=[A-Za-zÀ-ÖØ-öø-ɏ])")


def chunk_bounds(data: bytes, mean: int = MEAN_BYTES, least: int = LEAST_BYTES, most: int = MOST_BYTES) -> list[int]:
    """Ends of the chunks of UTF-8 ``data``: where a hash of the last 16 bytes has its low bits zero, and after ``most`` bytes."""
    n = len(data)
    if n <= least:
        return [n] if n else []
    buf = np.frombuffer(data, dtype=np.uint8)
    h = (_BYTE_VALUE >> np.uint64(32)).astype(np.uint32)[buf]
    for width in (1, 2, 4, 8):
        wide = h.copy()
        wide[width:] += h[:-width] << np.uint32(2 * width)
        h = wide
    spots = np.flatnonzero((h >> np.uint32(20)) % np.uint32(mean) == 0) + 1
    spots = spots[spots < n]
    spots = spots[(buf[spots] & 0xC0) != 0x80]
    out, last = [], 0
    for s in [*spots.tolist(), n]:
        while s - last > most:  # nothing in the content says where to cut
            last += most
            while buf[last] & 0xC0 == 0x80:
                last -= 1
            out.append(last)
        if s == n or s - last >= least:
            out.append(s)
            last = s
    return out


@dataclass(frozen=True)
class Bound:
    """A place between two words: in a chunk's text, its ids and its bytes."""

    text: int
    ids: int
    bytes: int


class Chunk:
    """A chunk's ids, decoded bytes, and the word bounds next to its ends, outermost first."""

    __slots__ = ("text", "ids", "decoded", "left", "right")

    def __init__(self, engine: ByteEngine, text: str) -> None:
        self.text = text
        ids = engine.encode(text)
        self.ids, self.decoded = array("I", ids), engine.decode(ids)
        ends = dict(zip(accumulate(len(engine.token[i]) for i in ids), range(1, len(ids) + 1), strict=True))
        self.left, self.right = [], []
        for m in islice(_FORCED.finditer(text), DEPTH):
            size = len(text[: m.start()].encode())
            self.left.append(Bound(m.start(), ends[size], size))
        end, total = len(text), len(self.decoded)
        while len(self.right) < DEPTH and (end := text.rfind(" ", 0, end)) > 0:
            if _FORCED.match(text, end):
                size = total - len(text[end:].encode())
                self.right.append(Bound(end, ends[size], size))

    def part(self, a: Bound, b: Bound) -> tuple[bytes, bytes]:
        return self.ids[a.ids : b.ids].tobytes(), self.decoded[a.bytes : b.bytes]


class Coder:
    """Encodes and decodes texts; one in each worker."""

    def __init__(self, engine: ByteEngine) -> None:
        self.engine = engine
        self.chunks = ChunkCache(lambda text: Chunk(engine, text), CHUNKS)
        self.joins = ChunkCache(lambda text: tuple(engine.encode(text)), 10 * CHUNKS)

    def window(self, text: str) -> array:
        return array("I", self.joins[text] if len(text) < 256 else self.engine.encode(text))

    def join(self, left: Chunk | None, begin: Bound, middle: str, right: Chunk | None) -> tuple[list[tuple[bytes, bytes]], Bound] | None:
        """What is settled up to a bound of the right chunk, and that bound; None if no window agrees.

        ``begin`` is where the left chunk's ids begin to be wanted.  Without a
        left chunk the window begins with the text, without a right one it ends
        with it.
        """
        for k in range(1, DEPTH):
            a = inner = None
            if left is not None and k < len(left.right) and left.right[k].ids >= begin.ids:
                a, inner = left.right[k], left.right[k - 1]
            if right is not None and k >= len(right.left):
                return None
            text = ("" if left is None else left.text[(a or begin).text :]) + middle + ("" if right is None else right.text[: right.left[k].text])
            ids = self.window(text)
            if a is not None and left.ids[a.ids : inner.ids] != ids[: inner.ids - a.ids]:
                continue
            if right is not None:
                own = right.ids[right.left[k - 1].ids : right.left[k].ids]
                if own != ids[len(ids) - len(own) :]:
                    continue
            done = [] if a is None else [left.part(begin, a)]
            return [*done, (ids.tobytes(), self.engine.decode(ids))], Bound(0, 0, 0) if right is None else right.left[k]
        return None

    def runs(self, text: str):
        """(packed ids, decoded bytes) of the parts of a text without special strings, in order."""
        data, at = text.encode(), 0
        left, begin, middle = None, Bound(0, 0, 0), []
        for end in chunk_bounds(data):
            chunk = self.chunks[data[at:end].decode()]
            at = end
            joined = self.join(left, begin, "".join(middle), chunk) if len(chunk.left) > 1 else None
            if joined is None:  # the window takes in the whole chunk
                middle.append(chunk.text)
                continue
            yield from joined[0]
            left, begin, middle = chunk, joined[1], []
        joined = self.join(left, begin, "".join(middle), None)
        if joined is None:
            ids = self.window(left.text[begin.text :] + "".join(middle))
            yield ids.tobytes(), self.engine.decode(ids)
        else:
            yield from joined[0]
        self.chunks.age()
        self.joins.age()

    def code(self, text: str) -> tuple[bytes, bytes]:
        """Packed ids and decoded bytes of a whole text."""
        parts: list[tuple[bytes, bytes]] = []
        at = 0
        for m in self.engine.split.finditer(text):
            parts += self.whole(text[at : m.start()])
            parts.append((array("I", [self.engine.special[m[0]]]).tobytes(), m[0].encode()))
            at = m.end()
        parts += self.whole(text[at:])
        return b"".join(p[0] for p in parts), b"".join(p[1] for p in parts)

    def whole(self, text: str) -> list[tuple[bytes, bytes]]:
        return list(self.runs(text)) if text else []


_CODERS: dict[str, Coder] = {}


def coder(tokenizer: str) -> Coder:
    """The worker's coder for a tokenizer file."""
    if tokenizer not in _CODERS:
        engine = load(tokenizer)
        if not isinstance(engine, ByteEngine):
            raise ValueError(f"{tokenizer} is no byte-level BPE without normalisation")
        _CODERS[tokenizer] = Coder(engine)
    return _CODERS[tokenizer]


def encode_documents(docs: DataFrame, tokenizer: str, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``n_tokens``, digests of ids and of the decoded text, and, unless turned off, both themselves."""
    schema = f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        code = coder(tokenizer).code
        for batch in by_bytes(batches):
            counts, ids_hash, text_hash, all_ids, decoded = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                ids, back = code(text)
                counts.append(len(ids) // 4)
                ids_hash.append(sha256(ids).hexdigest())
                text_hash.append(sha256(back).hexdigest())
                if with_ids:
                    all_ids.append(ids)
                    decoded.append(back.decode("utf-8", "replace"))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
            columns += [pa.array(all_ids, pa.binary()), pa.array(decoded, pa.string())] if with_ids else []
            yield pa.RecordBatch.from_arrays(columns, names)

    return texts_only(docs, id_col, text_col).mapInArrow(run, schema)
