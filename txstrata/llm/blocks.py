"""Corpus-wide counts of hashed keys, asked and answered by blocks of documents.

Documents are dealt into blocks of a bounded size by a hash of their id and
text.  A block sends each distinct key once, with its own count, towards the
shard that owns the key's range; key lists are Elias-Fano coded.  Messages are
routed like digits of a number: at each level a node takes in at most ``FAN``
messages, merges them, and sends its keys on to at most ``FAN`` nodes, by the
next bits of the keys; answers come back the same way.  So a block, and a node,
sends a fixed number of messages a level, whatever the corpus' size, and the
number of levels follows its logarithm.  No row per occurrence is shuffled, no
hot key meets in one task (a key has at most one entry in each message) and
nothing comes to the driver but the corpus' size in bytes.
"""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from . import elias_fano
from .common import BATCH_BYTES, by_bytes, texts_only

#: Bytes of text in a block, about; bytes a task holds before it sends what it has for each block.
BLOCK_BYTES, HELD_BYTES = 8 << 20, 32 << 20


#: Bits of a key that a level of routing looks at; a node takes in and sends out up to 2**FAN_BITS messages.
FAN_BITS = 7

MESSAGE, REPLY = "node long, child int, kind int, sent binary", "node long, part int, reply binary"


@dataclass
class Asked:
    """Ascending distinct keys of ``bits`` bits, their counts, and ``notes``, bytes that hold for a key wherever it is."""

    keys: np.ndarray
    counts: np.ndarray
    bits: int
    notes: np.ndarray | None = None

    def pack(self) -> bytes:
        """The keys Elias-Fano coded; counts and notes, which repeat, compressed."""
        keys = elias_fano.encode(self.keys, self.bits)
        big = np.flatnonzero(self.counts > 254)
        small = np.minimum(self.counts, 255).astype(np.uint8).tobytes() + self.counts[big].astype("<u8").tobytes()
        rest = small + (b"" if self.notes is None else np.ascontiguousarray(self.notes.T).tobytes())
        return np.array([self.bits, len(keys), len(big), len(rest)], dtype="<u8").tobytes() + keys + pa.compress(rest, codec="zstd", asbytes=True)

    @staticmethod
    def unpack(data: bytes) -> Asked:
        bits, size, n_big, n_rest = np.frombuffer(data, "<u8", 4).tolist()
        view = memoryview(data)
        keys = elias_fano.decode(view[32 : 32 + size])
        rest, n = pa.decompress(view[32 + size :], n_rest, codec="zstd", asbytes=True), len(keys)
        counts = np.frombuffer(rest, np.uint8, n).astype(np.int64)
        counts[counts == 255] = np.frombuffer(rest, "<u8", n_big, n).astype(np.int64)
        notes = np.frombuffer(rest, np.uint8, offset=n + 8 * n_big) if len(rest) > n + 8 * n_big else np.zeros(0, np.uint8)
        return Asked(keys, counts, bits, notes.reshape(-1, n).T if n else notes.reshape(0, 0))

    def cut(self, a: int, b: int, bits: int) -> Asked:
        """The keys from a to b, without their common first bits."""
        return Asked(self.keys[a:b] & np.uint64((1 << bits) - 1), self.counts[a:b], bits, None if self.notes is None else self.notes[a:b])

    def parts(self, width: int) -> np.ndarray:
        """Bounds of the parts that the first ``width`` bits make."""
        return np.searchsorted(self.keys >> np.uint64(self.bits - width), np.arange((1 << width) + 1, dtype=np.uint64))


def merge(lists: list[Asked]) -> Asked:
    """Distinct keys of all lists, with their counts added."""
    keys = np.concatenate([x.keys for x in lists])
    counts = np.concatenate([x.counts for x in lists])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    total = np.add.reduceat(counts[order], first) if len(first) else np.zeros(0, np.int64)
    return Asked(keys[first], total, lists[0].bits, np.concatenate([x.notes for x in lists])[order[first]])


@dataclass
class Answered:
    """For each kind, rows of bytes in the order of the keys asked for, and sums over all shards."""

    rows: list[np.ndarray]
    sums: np.ndarray

    def pack(self) -> bytes:
        head = np.array([len(self.sums), len(self.rows), *(x for r in self.rows for x in r.shape)], dtype="<u8").tobytes()
        body = self.sums.astype("<u8").tobytes() + b"".join(np.ascontiguousarray(r.T).tobytes() for r in self.rows)
        return head + pa.compress(body, codec="zstd", asbytes=True)

    @staticmethod
    def unpack(data: bytes) -> Answered:
        n_sums, n_rows = np.frombuffer(data, "<u8", 2).tolist()
        shapes = np.frombuffer(data, "<u8", 2 * n_rows, 16).astype(np.int64).reshape(n_rows, 2).tolist()
        body = pa.decompress(memoryview(data)[16 * (1 + n_rows) :], 8 * n_sums + sum(n * w for n, w in shapes), codec="zstd", asbytes=True)
        at, rows = 8 * n_sums, []
        for n, width in shapes:
            rows.append(np.frombuffer(body, np.uint8, n * width, at).reshape(width, n).T)
            at += n * width
        return Answered(rows, np.frombuffer(body, "<u8", n_sums))

    @staticmethod
    def together(parts: list[Answered]) -> Answered:
        """Answers to the parts of a list, in order, as one."""
        if not parts:
            return Answered([], np.zeros(0, np.uint64))
        return Answered([np.concatenate(r) for r in zip(*(p.rows for p in parts), strict=True)], sum(p.sums for p in parts))


def as_bytes(values: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as rows of bytes."""
    return np.ascontiguousarray(values, dtype="<u8").view(np.uint8).reshape(-1, 8)


def from_bytes(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows).view("<u8").reshape(-1).astype(np.int64)


class Corpus:
    """Blocks of a table of documents: (block, payload), and their number."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, fan_bits: int = FAN_BITS) -> None:
        frame = texts_only(docs, id_col, text_col)
        self.n_bytes = frame.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        self.n_blocks = n = max(1, math.ceil(self.n_bytes / block_bytes))
        self.shard_bits = bits = max(0, math.ceil(math.log2(n)))
        #: Bits of a key that each level of routing looks at.
        self.widths = [min(fan_bits, bits - b) for b in range(0, max(1, bits), fan_bits)]
        #: Bits that tell apart as many keys as the corpus can have words.
        self.word_bits = max(10, math.ceil(math.log2(max(2, self.n_bytes / 2))))

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            size = 0
            for batch in by_bytes(batches):
                held.append(batch)
                size += batch.nbytes
                if size >= HELD_BYTES:
                    yield from dealt(held)
                    held, size = [], 0
            if held:
                yield from dealt(held)

        def dealt(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            block = blocks_of(table.column("hash").to_numpy(), n)
            order = np.argsort(block, kind="stable")
            ends = np.flatnonzero(np.append(np.diff(block[order]), 1)) + 1
            rows = table.select(["doc_id", "text"])
            start = 0
            for end in ends.tolist():
                sink = pa.BufferOutputStream()
                part = rows.take(pa.array(order[start:end]))
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=5))) as writer:
                    writer.write_table(part)
                yield pa.RecordBatch.from_arrays([pa.array([int(block[order[start]])], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "payload"])
                start = end
            release_memory()

        dealing = frame.select("doc_id", F.xxhash64("doc_id", "text").alias("hash"), "text")
        self.blocks = dealing.mapInArrow(deal, "block long, payload binary").repartition(n, "block")

    def answers(self, ask: Callable, answer: Callable, replies: DataFrame | None = None) -> DataFrame:
        """(node, part, reply) of every shard to every block; a block's node is its number.

        ``ask`` maps the batches of a block, and its :class:`Answered` from an
        earlier round if ``replies`` are given, to one :class:`Asked` for each
        kind.  ``answer`` maps, for one shard, the merged :class:`Asked` of
        each kind to an :class:`Answered`.
        """
        widths, n_blocks, total = self.widths, self.n_blocks, self.shard_bits
        places = [sum(widths[:k]) for k in range(len(widths) + 1)]

        def send(asked: list[Asked], group: int, prefix: int, level: int) -> pa.Table:
            """Messages from node (group, prefix) of a level to the next."""
            width = widths[level]
            out: list[tuple] = []
            child, up = group & ((1 << width) - 1), (group >> width) << total
            for kind, own in enumerate(asked):
                bounds = own.parts(width).tolist()
                for part in range(1 << width):
                    a, b = bounds[part], bounds[part + 1]
                    if b > a:
                        out.append((up | prefix << width | part, child, kind, own.cut(a, b, own.bits - width).pack()))
            release_memory()
            return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ([],) * 4, (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["node", "child", "kind", "sent"])

        def received(table: pa.Table) -> dict[int, dict[int, Asked]]:
            """The lists of each kind by child."""
            out: dict[int, dict[int, Asked]] = {}
            for child, kind, sent in zip(*(table.column(c).to_pylist() for c in ("child", "kind", "sent")), strict=True):
                out.setdefault(kind, {})[child] = Asked.unpack(sent)
            return out

        def merged(lists: dict[int, dict[int, Asked]]) -> list[Asked]:
            none = Asked(np.zeros(0, np.uint64), np.zeros(0, np.int64), 64, np.zeros((0, 0), np.uint8))
            return [merge([lists[k][c] for c in sorted(lists[k])]) if k in lists else none for k in range(max(lists, default=-1) + 1)]

        def reply(lists: dict[int, dict[int, Asked]], whole: list[Asked], found: Answered, node: int, level: int) -> pa.Table:
            """Answers from a node of a level to its children, all of them, since sums go to all."""
            width = widths[level - 1]
            group, prefix = node >> total, node & ((1 << total) - 1)
            children = range(group << width, min((group + 1) << width, -(-n_blocks >> places[level - 1])))
            out = []
            for g in children:
                rows = []
                for kind, table in enumerate(found.rows):
                    own = lists.get(kind, {}).get(g & ((1 << width) - 1))
                    rows.append(table[np.searchsorted(whole[kind].keys, own.keys)] if own is not None else table[:0])
                out.append(Answered(rows, found.sums).pack())
            release_memory()
            to = [(g << total) | (prefix >> width) if level > 1 else g for g in children]
            return pa.table({"node": pa.array(to, pa.int64()), "part": pa.array([prefix & ((1 << width) - 1)] * len(to), pa.int32()), "reply": pa.array(out, pa.binary())})

        def first(table: pa.Table) -> pa.Table:
            return send(ask(payload_batches(table.column("payload"))), table.column("block")[0].as_py(), 0, 0)

        def again(table: pa.Table, earlier: pa.Table) -> pa.Table:
            if not table.num_rows:
                return send([], 0, 0, 0)
            return send(ask(payload_batches(table.column("payload")), replied(earlier)), table.column("block")[0].as_py(), 0, 0)

        def upward(level: int):
            def run(table: pa.Table) -> pa.Table:
                node = table.column("node")[0].as_py()
                return send(merged(received(table)), node >> total, node & ((1 << total) - 1), level)

            return run

        def top(table: pa.Table) -> pa.Table:
            lists = received(table)
            whole = merged(lists)
            return reply(lists, whole, answer(whole), table.column("node")[0].as_py(), len(widths))

        def downward(level: int):
            def run(table: pa.Table, above: pa.Table) -> pa.Table:
                if not table.num_rows:
                    return nothing
                lists = received(table)
                return reply(lists, merged(lists), replied(above), table.column("node")[0].as_py(), level)

            return run

        nothing = pa.table({"node": pa.array([], pa.int64()), "part": pa.array([], pa.int32()), "reply": pa.array([], pa.binary())})
        at = lambda f: f.repartition(n_blocks, "node")
        by_block = self.blocks.groupBy("block")
        sent = by_block.applyInArrow(first, MESSAGE) if replies is None else by_block.cogroup(at(replies).groupBy("node")).applyInArrow(again, MESSAGE)
        levels = [at(sent)]
        for level in range(1, len(widths)):
            levels.append(at(levels[-1].groupBy("node").applyInArrow(upward(level), MESSAGE)))
        found = levels[-1].groupBy("node").applyInArrow(top, REPLY)
        for level in range(len(widths) - 1, 0, -1):
            found = levels[level - 1].groupBy("node").cogroup(at(found).groupBy("node")).applyInArrow(downward(level), REPLY)
        return found

    def with_answers(self, answers: DataFrame, use: Callable, schema: str) -> DataFrame:
        """``use(block, batches of a block, its Answered)`` gives the result's tables."""

        def run(own: pa.Table, replies: pa.Table) -> pa.Table:
            if not own.num_rows:
                return empty
            out = pa.concat_tables([empty, *use(own.column("block")[0].as_py(), payload_batches(own.column("payload")), replied(replies))])
            release_memory()
            return out

        empty = to_arrow_schema(_parse_datatype_string(schema)).empty_table()
        return self.blocks.groupBy("block").cogroup(answers.repartition(self.n_blocks, "node").groupBy("node")).applyInArrow(run, schema)


def blocks_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """The block of each row by its hash; of equal rows each goes one block further, so that many copies of a row fill no block."""
    order = np.argsort(hashes, kind="stable")
    s = hashes[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    again = np.arange(len(s)) - np.repeat(first, np.diff(np.append(first, len(s))))
    out = np.empty(len(s), dtype=np.int64)
    out[order] = (s.view(np.uint64) % np.uint64(n)).astype(np.int64) + again
    return out % n


def replied(table: pa.Table) -> Answered:
    """What a node was answered, in the order of the parts."""
    rows = sorted(zip(table.column("part").to_pylist(), table.column("reply").to_pylist(), strict=True))
    return Answered.together([Answered.unpack(r) for _, r in rows])


def release_memory() -> None:
    """Gives freed memory back to the system, since an idle worker's counts against its executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def payload_batches(payloads: pa.ChunkedArray) -> Iterator[pa.RecordBatch]:
    """Batches (doc_id, text) of a block, in the order in which their payloads are sorted."""
    for data in sorted(payloads.to_pylist()):
        with pa.ipc.open_stream(data) as reader:
            for batch in reader:
                yield from by_bytes([batch], limit=BATCH_BYTES // 2)
