"""N-gram language-model scores from Elias-Fano tries over shards of the corpus' n-grams.

Two rounds of questions go from blocks of documents to shards of n-grams
(:mod:`blocks`).  In the first the blocks learn exact counts of their words and
bigrams in the training documents.  In the second they send their trigrams
w1 w2 w3 to the shard that owns w2 w3, each with two quantised numbers that
hold wherever the trigram occurs: the smoothed probability p(w3 | w2) and the
count of its context w1 w2.  A shard keeps them as a trie in compact levels:

- level one has a node for each bigram w2 w3, ascending, with the quantised
  p(w3 | w2); monotone pointers bound each node's range in level two;
- level two has the words w1 that extend the node to the left, ascending within
  their node, with the quantised smoothed probability p(w3 | w1 w2).

The levels are Elias-Fano coded in one memory-mapped file and searched there:
a node by its high bits and then within the few values that share them, a word
w1 as successor within the range of its node.  Where the trie has no such word,
the answer backs off along the path, to the node's probability times the weight
that the context leaves to shorter histories.

Smoothing is p(w | h) = (c(hw) + s p(w | shorter h)) / (c(h) + s), down to the
add-half estimate of words, with a pseudo-count s = k c(h)**e for each order
(``PSEUDO``); counts are exact, so probabilities of a context sum to 1 but for
the quantisation.  Keys are hashed as wholes, so a
word that makes up a third of all text loads all shards alike.  Of the bits of
a trigram's key, the bigram takes as many as tell the corpus' words apart and
four more; a word w1 has 20 within its node, so an unseen one passes for one of
the node's with a chance of their number over a million.

Defined results: null and empty texts consist of their end alone; repeated rows
are counted and scored one by one; rows with a null id are training rows and
are scored; an empty table gives none; further columns are ignored.  Without
training text every count is 0.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import elias_fano
from .blocks import Answered, Asked, Corpus, as_bytes, from_bytes
from .common import ascending, mix64, text_buffer, word_hashes, word_spans

#: Pseudo-counts k c**e of the orders 2 and 3, as (k, e).
PSEUDO = ((10.0, 0.7), (4.0, 0.7))

_END = mix64(np.array([0xE0D], dtype=np.uint64))[0]
_BEGIN = mix64(np.array([0xB0B], dtype=np.uint64))[0]

#: Log10 probabilities of the codes 1 to 255: from 1 down to 1e-20, in steps that grow from 4 per cent near 1 to 14 at
#: 1e-4; code 0 is no value.
LOWEST, BEND = -20.0, 0.5
STEP = np.log1p(-LOWEST * BEND) / 254
LOG_VALUE = np.concatenate([[np.nan], -np.expm1(STEP * np.arange(255)) / BEND])


def quantised(p: np.ndarray) -> np.ndarray:
    """Codes of probabilities."""
    down = -np.log10(np.clip(p, 10.0**LOWEST, 1.0))
    return (np.rint(np.log1p(down * BEND) / STEP) + 1).astype(np.uint8)


def value_of(code: np.ndarray) -> np.ndarray:
    return 10.0 ** LOG_VALUE[code]


def weight(context: np.ndarray, pseudo: tuple[float, float]) -> np.ndarray:
    """The pseudo-count of contexts that occur so often; 1 where one never does."""
    return np.where(context > 0, pseudo[0] * np.maximum(context, 1.0) ** pseudo[1], 1.0)


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, an end after each text, and each token's text."""
    buf, bounds = text_buffer(column)
    n = len(bounds) - 1
    begin, end, doc = word_spans(buf, bounds)
    at = np.arange(len(doc)) + doc
    last = np.cumsum(np.bincount(doc, minlength=n)) + np.arange(n)
    out = np.empty(len(doc) + n, dtype=np.uint64)
    of = np.empty(len(doc) + n, dtype=np.int64)
    out[at], out[last] = word_hashes(buf, begin, end, lower=True), _END
    of[at], of[last] = doc, np.arange(n)
    return out, of


def histories(h: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word before each token and the one before that; a mark before a text's first."""
    one, two = np.full(len(h), _BEGIN), np.full(len(h), _BEGIN)
    same = of[1:] == of[:-1]
    one[1:][same] = h[:-1][same]
    same = of[2:] == of[:-2]
    two[2:][same] = h[:-2][same]
    return one, two


def bigram_keys(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    return mix64(mix64(before) * np.uint64(3) + h)


def distinct(keys: np.ndarray, trained: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, how often each occurs among training tokens, and where each first stands."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    return s[first], np.add.reduceat(trained[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64), order[first]


def held_out_ids(ids: pa.Array, folds: int, fold: int) -> np.ndarray:
    return np.array([i is not None and crc32(b"%d" % i) % folds == fold for i in ids.to_pylist()], dtype=bool)


class Block:
    """Tokens of a whole block and their keys."""

    def __init__(self, batches, folds: int, fold: int, bits: tuple[int, int, int], pseudo=PSEUDO) -> None:
        ids, held, hashes, ofs, n = [], [], [], [], 0
        for b in batches:
            h, of = tokens_of(b.column(1))
            ids.append(b.column(0))
            held.append(held_out_ids(b.column(0), folds, fold))
            hashes.append(h)
            ofs.append(of + n)
            n += b.num_rows
        self.ids, self.held, self.pseudo, self.bits = pa.chunked_array(ids, pa.int64()), np.concatenate(held), pseudo, bits
        self.h, self.of = np.concatenate(hashes), np.concatenate(ofs)
        self.trained = ~self.held[self.of]
        one, two = histories(self.h, self.of)
        pair = bigram_keys(one, self.h)
        self.pairs = pair >> np.uint64(64 - bits[0])
        node, word = bits[1:]
        self.triples = ((pair >> np.uint64(64 - node)) << np.uint64(word)) | (mix64(mix64(two) + pair) >> np.uint64(64 - word))
        self.first = np.concatenate([[True], self.of[1:] != self.of[:-1]]) if len(self.of) else np.zeros(0, bool)

    def questions(self) -> list[Asked]:
        """Bigrams and words."""
        return [Asked(*distinct(self.pairs, self.trained)[:2], self.bits[0]), Asked(*distinct(self.h, self.trained)[:2], 64)]

    def learn_words(self, found: Answered) -> np.ndarray:
        """Takes in the counts of words, the last kind of either round; returns those of the distinct words."""
        _, place = np.unique(self.h, return_inverse=True)
        count = from_bytes(found.rows[1])
        self.types, self.total = found.sums.tolist()
        self.count = count[place].astype(np.float64)
        self.base = (self.count + 0.5) / (self.total + 0.5 * (self.types + 1))
        return count

    def learn(self, found: Answered) -> None:
        """Takes all counts in, and makes the probabilities up to order 2."""
        count, words = self.learn_words(found), ascending(self.h)
        _, place = np.unique(self.pairs, return_inverse=True)
        pair_count = from_bytes(found.rows[0])[place].astype(np.float64)
        # A text's begin occurs as often as its end.
        ends = float(count[np.searchsorted(words, _END)]) if len(words) else 0.0
        back = lambda values: np.where(self.first, ends, np.concatenate([[0.0], values[:-1]])) if len(values) else values
        context, self.context = back(self.count), back(pair_count)
        s = weight(context, self.pseudo[0])
        self.p2 = (pair_count + s * self.base) / (context + s)

    def requests(self) -> list[Asked]:
        """Trigrams, with the code of p(w3 | w2) and that of their context's count."""
        keys, counts, at = distinct(self.triples, self.trained)
        words, own, _ = distinct(self.h, self.trained)
        bits, notes = sum(self.bits[1:]), np.stack([quantised(self.p2[at]), elias_fano.quantise(self.context[at])], axis=1)
        return [Asked(keys, counts, bits, notes), Asked(words, own, 64)]


def count_answers(asked: list[Asked]) -> Answered:
    """Exact counts of bigrams and words; the number of words known and the tokens they make up are summed."""
    pairs, words = (asked[k].counts if k < len(asked) else np.zeros(0, np.int64) for k in (0, 1))
    return Answered([as_bytes(pairs), as_bytes(words)], np.array([(words > 0).sum(), words.sum()], dtype=np.uint64))


def score_documents(docs: DataFrame, folds: int = 5, fold: int = 1, pseudo: tuple[tuple[float, float], ...] = PSEUDO, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of all texts under a model of those whose CRC-32 of the id modulo ``folds`` is not ``fold``."""
    corpus = Corpus(docs, id_col, text_col)
    known = max(14, corpus.word_bits, corpus.shard_bits)
    node = min(44, known + 4)
    bits = (min(64, known + 14), node, min(64, known + 24) - node)  # of a bigram, of a node, of a word within it

    def block_of(batches) -> Block:
        return Block(batches, folds, fold, bits, pseudo)

    def requests(batches, found: Answered) -> list[Asked]:
        block = block_of(batches)
        block.learn(found)
        return block.requests()

    def trie_answers(asked: list[Asked]) -> Answered:
        counted = count_answers(asked)
        if not asked or not len(asked[0].keys):
            return Answered([np.zeros((0, 1), np.uint8), counted.rows[1]], counted.sums)
        own = asked[0]
        seen = own.counts > 0
        p2, context = value_of(own.notes[:, 0]), elias_fano.CODEBOOK[own.notes[:, 1]]
        s = weight(context, pseudo[1])
        p3 = np.minimum((np.minimum(own.counts, context) + s * p2) / (context + s), 1.0)
        trie = elias_fano.Trie(own.keys[seen], own.notes[seen, 0], quantised(p3[seen]), own.bits, bits[2])
        try:
            node_code, leaf = trie.lookup(own.keys)
        finally:
            trie.close()
        shorter = np.where(node_code > 0, node_code, own.notes[:, 0])
        code = np.where(leaf > 0, leaf, quantised(value_of(shorter) * s / (context + s))).astype(np.uint8)
        return Answered([code[:, None], counted.rows[1]], counted.sums)

    counts = corpus.answers(lambda batches: block_of(batches).questions(), count_answers)
    scored = corpus.answers(requests, trie_answers, counts)

    def use(_, batches, found: Answered):
        block = block_of(batches)
        block.learn_words(found)
        n = len(block.held)
        _, place = np.unique(block.triples, return_inverse=True)
        p = LOG_VALUE[found.rows[0][place, 0]]
        add = lambda w: np.bincount(block.of, weights=w, minlength=n)
        yield pa.table(
            {
                "doc_id": block.ids, "held_out": pa.array(block.held), "n_tokens": pa.array(np.bincount(block.of, minlength=n).astype(np.int64)), "n_known": pa.array(add(block.count > 0).astype(np.int64)),
                "train_tokens": pa.array(np.full(n, block.total, dtype=np.int64)), "base_score": pa.array(add(np.log10(block.base))), "score": pa.array(add(p)),
            }
        )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return corpus.with_answers(scored, use, schema).withColumnRenamed("doc_id", id_col)
