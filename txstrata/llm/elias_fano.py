"""Elias-Fano coding of ascending integers, searched in place, and a trie of n-gram hashes in such levels."""

from __future__ import annotations

import math
import mmap
import struct

import numpy as np

_HEAD = struct.Struct("<QQQ")


def _padded(data: bytes) -> bytes:
    """The bytes, filled up to whole 64-bit words."""
    return data + b"\0" * (-len(data) % 8)


def _pack(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bits of each value: whole bytes as planes, then the rest bit by bit."""
    planes = [((values >> np.uint64(8 * i)) & np.uint64(255)).astype(np.uint8).tobytes() for i in range(width // 8)]
    rest = width % 8
    if rest:
        top = (values >> np.uint64(width - rest)).astype(np.uint8)
        planes.append(np.packbits((top[:, None] >> np.arange(rest, dtype=np.uint8)) & 1).tobytes())
    return b"".join(planes)


def encode(values: np.ndarray, bits: int) -> bytes:
    """Ascending values below 2**bits: high parts in unary, low parts packed."""
    n = len(values)
    low = max(0, bits - max(0, math.ceil(math.log2(n))) if n else 0)
    low = min(low, 63)
    values = values.astype(np.uint64, copy=False)
    high = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    unary = np.zeros(int(high[-1]) + 1 if n else 0, dtype=np.uint8)
    unary[high] = 1
    packed = _padded(np.packbits(unary, bitorder="little").tobytes())
    return _HEAD.pack(n, low, len(packed)) + packed + _padded(_pack(values, low))


def decode(data) -> np.ndarray:
    """All values that :func:`encode` took."""
    return Sequence(data).all()


#: Values of the 8-bit codes: small counts as they are, then steps of 13 per cent.
EXACT = 64
CODEBOOK = np.concatenate([np.arange(EXACT), EXACT * 1.13 ** np.arange(1, 257 - EXACT)])


def quantise(counts: np.ndarray) -> np.ndarray:
    """Codes of counts, rounded on a logarithmic scale from EXACT on."""
    c = np.asarray(counts, dtype=np.float64)
    steps = np.rint(np.log(np.maximum(c, EXACT) / EXACT) / math.log(1.13))
    return np.where(c < EXACT, c, np.minimum(EXACT - 1 + steps, 255)).astype(np.uint8)


#: 64-bit words of a high part for each entry of its directory.
_GROUP = 8


def directory(data) -> bytes:
    """The number of ones before each group of words of a coded sequence's high part."""
    n, _, size = _HEAD.unpack_from(data, 0)
    ones = np.bitwise_count(np.frombuffer(data, np.uint64, size // 8, _HEAD.size)).astype(np.uint64)
    ones = np.concatenate([ones, np.zeros(-len(ones) % _GROUP, np.uint64)]).reshape(-1, _GROUP).sum(axis=1, dtype=np.uint64)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(ones, dtype=np.uint64)]).tobytes()


class Sequence:
    """A coded sequence, read in place; with its directory it is searched without being decoded."""

    def __init__(self, data, index=None) -> None:
        self.n, self.low, size = _HEAD.unpack_from(data, 0)
        self.words = np.frombuffer(data, np.uint64, size // 8, _HEAD.size)
        at = _HEAD.size + size
        self.planes = [np.frombuffer(data, np.uint8, self.n, at + i * self.n) for i in range(self.low // 8)]
        self.rest = self.low % 8
        self.tail = np.frombuffer(data, np.uint8, (self.n * self.rest + 7) // 8, at + len(self.planes) * self.n)
        self.ones = None if index is None else np.frombuffer(index, np.uint64).astype(np.int64)

    def all(self) -> np.ndarray:
        high = np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))[: self.n] - np.arange(self.n)
        out = np.zeros(self.n, dtype=np.uint64)
        for i, plane in enumerate(self.planes):
            out |= plane.astype(np.uint64) << np.uint64(8 * i)
        if self.rest:
            bits = np.unpackbits(self.tail, count=self.n * self.rest).reshape(self.n, self.rest)
            out |= (bits << np.arange(self.rest, dtype=np.uint8)).sum(axis=1, dtype=np.uint64) << np.uint64(self.low - self.rest)
        return (high.astype(np.uint64) << np.uint64(self.low)) | out

    def _low(self, i: np.ndarray) -> np.ndarray:
        """The low parts of some values."""
        out = np.zeros(len(i), dtype=np.uint64)
        for k, plane in enumerate(self.planes):
            out |= plane[i].astype(np.uint64) << np.uint64(8 * k)
        for j in range(self.rest):
            p = i * self.rest + j
            out |= ((self.tail[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1).astype(np.uint64) << np.uint64(self.low - self.rest + j)
        return out

    def _select(self, k: np.ndarray, bit: int) -> np.ndarray:
        """The place of the k-th one, or zero, of the high part, from 0; it must have as many."""
        before = self.ones if bit else np.arange(len(self.ones)) * (64 * _GROUP) - self.ones
        group = np.searchsorted(before, k, side="right") - 1
        k = k - before[group]
        at = group * _GROUP
        last = len(self.words) - 1
        for _ in range(_GROUP - 1):
            word = self.words[np.minimum(at, last)]
            count = np.bitwise_count(word if bit else ~word).astype(np.int64)
            on = (k >= count) & (at < last)
            k = np.where(on, k - count, k)
            at = at + on
            if not on.any():
                break
        word = self.words[np.minimum(at, last)]
        word = word if bit else ~word
        place = at * 64
        for step in (32, 16, 8, 4, 2, 1):
            count = np.bitwise_count(word & np.uint64((1 << step) - 1)).astype(np.int64)
            on = k >= count
            k = np.where(on, k - count, k)
            word = np.where(on, word >> np.uint64(step), word)
            place = place + on * step
        return place

    def at(self, i: np.ndarray) -> np.ndarray:
        """Some values, by place."""
        high = self._select(i, 1) - i
        return (high.astype(np.uint64) << np.uint64(self.low)) | self._low(i)

    def _below(self, high: np.ndarray) -> np.ndarray:
        """How many values have a lesser high part."""
        zeros = len(self.words) * 64 - self.n
        out = np.full(len(high), self.n, dtype=np.int64)
        out[high == 0] = 0
        some = np.flatnonzero((high > 0) & (high <= zeros))
        out[some] = np.minimum(self._select(high[some] - 1, 0) - (high[some] - 1), self.n)
        return out

    def find(self, values: np.ndarray, begin: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """The places of values, within ranges if given; -1 where one isn't there.

        The high part gives the few places where a value can be; the first
        among them that isn't less is its successor.
        """
        if not self.n or not len(values):
            return np.full(len(values), -1, dtype=np.int64)
        high, low = (values >> np.uint64(self.low)).astype(np.int64), values & np.uint64((1 << self.low) - 1)
        lo, hi = self._below(high), self._below(high + 1)
        if begin is not None:
            lo, hi = np.maximum(lo, begin), np.minimum(hi, end)
        stop = hi.copy()
        left = np.flatnonzero(lo < hi)
        while len(left):
            mid = (lo[left] + hi[left]) // 2
            less = self._low(mid) < low[left]
            lo[left] = np.where(less, mid + 1, lo[left])
            hi[left] = np.where(less, hi[left], mid)
            left = left[lo[left] < hi[left]]
        out = np.full(len(values), -1, dtype=np.int64)
        near = np.flatnonzero(lo < stop)
        hit = near[self._low(lo[near]) == low[near]]
        out[hit] = lo[hit]
        return out


class Trie:
    """Two linked levels in one memory map, searched in place.

    A key is a node's hash above that of a word within the node.  Level one has
    the distinct nodes, ascending, with their values; monotone pointers bound
    each node's range in level two, where its words ascend with theirs.
    """

    def __init__(self, keys: np.ndarray, node_values: np.ndarray, values: np.ndarray, bits: int, word_bits: int) -> None:
        width = np.uint64(word_bits)
        nodes = keys >> width
        first = np.flatnonzero(np.concatenate([[True], nodes[1:] != nodes[:-1]])) if len(keys) else np.zeros(0, np.int64)
        # Words ascend within a node only; with the node's place above them they are monotone.
        place = np.repeat(np.arange(len(first), dtype=np.uint64), np.diff(np.append(first, len(keys))))
        self.word_bits = word_bits
        levels = (
            encode(nodes[first], bits - word_bits),
            encode(np.append(first, len(keys)).astype(np.uint64), max(1, int(len(keys)).bit_length())),
            encode((place << width) | (keys & np.uint64((1 << word_bits) - 1)), word_bits + max(1, len(first).bit_length())),
        )
        parts = [part for level in levels for part in (level, directory(level))] + [_padded(node_values[first].tobytes()), _padded(values.tobytes())]
        self.size = sum(map(len, parts))
        self.map = mmap.mmap(-1, max(1, self.size))
        views, at = [], 0
        for part in parts:
            self.map[at : at + len(part)] = part
            views.append(memoryview(self.map)[at : at + len(part)])
            at += len(part)
        self.views = views
        self.nodes, self.pointers, self.words = (Sequence(views[k], views[k + 1]) for k in (0, 2, 4))
        self.node_values, self.values = np.frombuffer(views[6], np.uint8, len(first)), np.frombuffer(views[7], np.uint8, len(keys))

    def lookup(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of the keys' nodes and of the keys themselves, 0 where the trie lacks one."""
        node_value, value = np.zeros(len(keys), dtype=np.uint8), np.zeros(len(keys), dtype=np.uint8)
        wanted = keys >> np.uint64(self.word_bits)
        fresh = np.concatenate([[True], wanted[1:] != wanted[:-1]]) if len(keys) else np.zeros(0, bool)
        if not self.nodes.n:
            return node_value, value
        node = self.nodes.find(wanted[fresh])  # once for each run of keys of a node
        known = np.maximum(node, 0)
        begin, end = (self.pointers.at(known + k).astype(np.int64) for k in (0, 1))
        run = np.cumsum(fresh) - 1
        on = np.flatnonzero(node[run] >= 0)
        if len(on):
            run = run[on]
            node_value[on] = self.node_values[node[run]]
            leaf = self.words.find((node[run].astype(np.uint64) << np.uint64(self.word_bits)) | (keys[on] & np.uint64((1 << self.word_bits) - 1)), begin[run], end[run])
            hit = leaf >= 0
            value[on[hit]] = self.values[leaf[hit]]
        return node_value, value

    def close(self) -> None:
        """Gives the map back."""
        del self.nodes, self.pointers, self.words, self.node_values, self.values
        for view in self.views:
            view.release()
        self.map.close()
