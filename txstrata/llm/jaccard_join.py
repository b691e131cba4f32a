"""Self-join of documents on the Jaccard similarity of word n-grams, by adaptive multi-match prefixes.

A document is the set of hashes of its distinct shingles.  All sets are ordered
alike, rare shingles first; by the pigeonhole rule two similar sets share at
least m of the first |s| - ceil(t |s|) + m shingles of each, for any m up to the
required overlap.  Each document picks the m, and with it the length of the
prefix that it sends, that makes the estimated work least: the entries that its
prefix meets, and the verifications left when m of them must agree.  Two sets
are verified only if they share m shingles of their prefixes of that length,
for the lesser of their two m, which both prefixes reach.  Frequencies come
from :mod:`blocks`; a shingle that no other document has is never sent.

Equal sets are one class, with one row for each block of documents.  The least
class that has a shingle leads it; the classes of one leader meet in tasks of
about ``CHUNK``, each with the leader's own set and a few others, where sets are
compared one after another and pairs that are connected already are passed over.  Where a
leader has several such chunks and its classes aren't all connected yet, its
chunks are compared with each other as well, ``TOGETHER`` at once, so every pair
of classes that shares a shingle meets in a task unless links connect it anyway.  A shingle's rows are
salted by its frequency, and a leader's by the class, so none meets in one task.

Defined results: null and empty texts and those without words have no set and
are linked with nothing; under ``width`` words the whole sequence is one
shingle.  Repeated rows give one row each, all in one class.  Null ids take part
in links but no component is named after them unless it has no other id.  An
empty table gives none; further columns are ignored.  Shingles are compared by
64-bit hashes: two different ones pass for one with a chance of 2**-64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from . import elias_fano
from .blocks import Answered, Asked, Corpus
from .common import ascending, free_name, mix64, text_buffer, word_hashes, word_spans
from .storage import Rounds, stored

WIDTH, PERCENT = 5, 75
#: The longest multi-match considered, and the work of a verification in entries met.
MOST_MATCHES, VERIFY = 4, 4.0


def shingle_sets(column: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of distinct shingles, ascending within a text, and the bounds of the texts."""
    buf, bounds = text_buffer(column)
    n = len(bounds) - 1
    begin, end, doc = word_spans(buf, bounds)
    h = word_hashes(buf, begin, end, lower=True)
    words = np.bincount(doc, minlength=n)
    first = np.concatenate([[0], np.cumsum(words)]).astype(np.int64)
    start = np.flatnonzero(doc[width - 1 :] == doc[: len(doc) - width + 1]) if len(doc) >= width else np.zeros(0, np.int64)
    key = h[start]
    for j in range(1, width):
        key = mix64(key * np.uint64(3) + h[start + j])
    of = doc[start]
    short = np.flatnonzero((words > 0) & (words < width))
    if len(short):
        whole = np.zeros(len(short), dtype=np.uint64)
        for j in range(width - 1):
            has = words[short] > j
            whole[has] = mix64(whole[has] * np.uint64(5) + h[first[short[has]] + j] + np.uint64(1))
        key, of = np.concatenate([key, whole]), np.concatenate([of, short])
    order = np.lexsort((key, of))
    key, of = key[order], of[order]
    if len(key):
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (of[1:] != of[:-1])])
        key, of = key[new], of[new]
    return key, np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))]).astype(np.int64)


def choose_prefix(freq: np.ndarray, percent: int = PERCENT) -> tuple[int, int]:
    """For ascending frequencies of one set: the chosen m, and the least prefix (of m = 1)."""
    n = len(freq)
    need = -(-percent * n // 100)
    base = n - need + 1
    met = np.cumsum(np.maximum(freq[: min(n, base + MOST_MATCHES - 1)] - 1, 0.0))
    m = np.arange(1, min(MOST_MATCHES, need) + 1)
    entries = met[np.minimum(base + m - 2, len(met) - 1)]
    return int(m[np.argmin(entries + VERIFY * entries / m)]), base


#: Rows of a shingle or leader that one task takes; more are salted or dealt into chunks.
CHUNK = 2048
#: Classes of a leader that meet all others of it, about, so that those alike are connected however many chunks they are dealt into.
PIVOTS = 24
#: Chunks that are taken together where the chunks of a leader are compared with each other.
TOGETHER = 1
#: Tasks among which the rows of a leader are spread while its chunks are counted.
SALTS = 16


def _ask(bits: int, width: int):
    def ask(batches):
        parts = []
        for batch in batches:
            key, _ = shingle_sets(batch.column(1), width)
            parts.append(key >> np.uint64(64 - bits))
        keys = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        return [Asked(*np.unique(keys, return_counts=True), bits)]

    return ask


def _answer(asked: list[Asked]) -> Answered:
    """Quantised frequencies."""
    counts = asked[0].counts if asked else np.zeros(0, np.int64)
    return Answered([elias_fano.quantise(counts)[:, None]], np.zeros(0, np.uint64))


SCHEMA = "block long, class binary, ids array<long>, n_shingles long, matches int, tokens array<long>, spread array<int>, levels array<int>, positions array<int>, shingles array<long>"


def _use(bits: int, width: int, percent: int):
    def use(block: int, batches, found: Answered):
        held = [(b.column(0).to_pylist(), *shingle_sets(b.column(1), width)) for b in batches]
        short = [key >> np.uint64(64 - bits) for _, key, _ in held]
        distinct = ascending(np.concatenate(short)) if short else np.zeros(0, np.uint64)
        value = elias_fano.CODEBOOK[found.rows[0][:, 0]] if found.rows else np.zeros(0)
        members: dict[bytes | None, list] = {}
        rows: list[tuple] = []

        def flush():
            columns = list(zip(*rows, strict=True))
            kinds = (pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()))
            names = ("class", "ids", "n_shingles", "matches", "tokens", "spread", "levels", "positions", "shingles")
            return pa.table({"block": pa.array([block] * len(rows), pa.int64()), **{name: pa.array(c, k) for name, c, k in zip(names, columns, kinds, strict=True)}})

        for (ids, key, bounds), cut in zip(held, short, strict=True):
            freq = value[np.searchsorted(distinct, cut)]
            a, b = mix64(key), mix64(key + np.uint64(0x51ED))
            total = np.zeros((2, len(key) + 1), dtype=np.uint64)
            np.cumsum(a, out=total[0, 1:])
            np.cumsum(b, out=total[1, 1:])
            for i, lo, hi in zip(ids, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                digest = None if hi == lo else (total[:, hi] - total[:, lo]).tobytes()
                if digest in members:
                    members[digest].append(i)
                    continue
                members[digest] = own_ids = [i]
                m = 0
                token = spread = level = place = own = None
                if digest:
                    k, f = key[lo:hi], freq[lo:hi]
                    order = np.lexsort((k, f))
                    m, base = choose_prefix(f[order], percent)
                    head = order[: base + m - 1]
                    shared = np.flatnonzero(f[head] > 1)
                    if len(shared):
                        token = k[head[shared]].view(np.int64)
                        spread = np.ceil(f[head[shared]] / CHUNK).astype(np.int32)
                        level = np.maximum(shared - base + 2, 1).astype(np.int32)
                        place = shared.astype(np.int32)
                        own = k.view(np.int64)
                rows.append((digest, own_ids, hi - lo, m, token, spread, level, place, own))
        if rows:
            yield flush()

    return use


class _Parts:
    """Labels of items that are joined one link at a time."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def join(self, a: int, b: int) -> None:
        x, y = self.label[a], self.label[b]
        self.label[self.label == max(x, y)] = min(x, y)


def spanning_links(n: np.ndarray, matches: np.ndarray, tokens: list, levels: list, places: list, sets: list, percent: int = PERCENT, labels: np.ndarray | None = None, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what all links between the given sets connect, beyond those that ``labels`` stand for.

    With ``sides`` only sets of different sides are compared.

    Sets are taken one after another.  Those before it that share enough prefix
    shingles, at places and with sizes that allow the similarity, and are not
    yet in its component, are verified all at once.
    """
    count = len(n)
    size = np.array([len(t) for t in tokens])
    of = np.repeat(np.arange(count), size)
    token, level, place = (np.concatenate(x) for x in (tokens, levels, places))
    order = np.lexsort((of, token))
    first = np.flatnonzero(np.concatenate([[True], token[order][1:] != token[order][:-1]]))
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    where = np.empty(len(order), dtype=np.int64)
    where[order] = np.arange(len(order))
    start, end = first[group[where]], where  # the entries of the same shingle that come before
    bounds = np.concatenate([[0], np.cumsum(size)])
    owner, lv, pl = of[order], level[order], place[order]
    parts, links = _Parts(count), []
    if labels is not None:
        _, first_of, inverse = np.unique(labels, return_index=True, return_inverse=True)
        parts.label = first_of[inverse]
    for d in range(1, count):
        own = np.arange(bounds[d], bounds[d + 1])
        run = end[own] - start[own]
        total = int(run.sum())
        if not total:
            continue
        mine = np.repeat(own, run)
        at = np.repeat(start[own], run) + np.arange(total) - np.repeat(np.cumsum(run) - run, run)
        other = owner[at]
        new = parts.label[other] != parts.label[d]
        if sides is not None:
            new &= sides[other] != sides[d]
        mine, at, other = mine[new], at[new], other[new]
        alike = 100 * np.minimum(n[other], n[d]) >= percent * np.maximum(n[other], n[d])
        need = np.minimum(matches[other], matches[d])  # both prefixes reach as far
        within = (level[mine] <= need) & (lv[at] <= need) & alike
        left = np.minimum(n[other] - pl[at], n[d] - place[mine])
        # The place bound holds at the first shared shingle, so at one of them at least.
        fits = percent * (n[other] + n[d]) <= (100 + percent) * left
        if not within.any():
            continue
        agreed = np.bincount(other[within], minlength=count) >= np.maximum(np.minimum(matches, matches[d]), 1)
        agreed &= np.bincount(other[within & fits], minlength=count) > 0
        found = np.flatnonzero(agreed)
        if not len(found):
            continue
        for i in range(0, len(found), 512):
            part = found[i : i + 512]
            flat = np.concatenate([sets[k] for k in part])
            ends = np.cumsum([len(sets[k]) for k in part])
            spot = np.minimum(np.searchsorted(sets[d], flat), len(sets[d]) - 1)
            hits = np.concatenate([[0], np.cumsum(sets[d][spot] == flat)])
            common = hits[ends] - hits[ends - n[part]]
            for k in part[100 * common >= percent * (n[part] + n[d] - common)]:
                if parts.label[k] != parts.label[d]:
                    parts.join(int(k), d)
                    links.append((int(k), d))
    return links


def _salt(of: str, spread) -> F.Column:
    return F.pmod(F.xxhash64(of), spread).cast("int")


def _meetings(rows: DataFrame, rounds: Rounds) -> DataFrame:
    """(leader, chunks, class): the classes that share a shingle with a leader, which is one of them."""
    heads = rows.filter("tokens IS NOT NULL").select("class", "tokens", "spread").dropDuplicates(["class"])
    every = heads.select("class", F.explode(F.arrays_zip("tokens", "spread")).alias("t")).select("class", F.col("t.tokens").alias("token"), "t.spread").withColumn("salt", _salt("class", F.col("spread")))
    # Each task sends one partial row for a shingle, so its leader is found without salt; only the join back needs it.
    least = every.groupBy("token").agg(F.min("class").alias("leader"), F.max("class").alias("last"), F.max("spread").alias("spread"))
    lead = least.filter("leader < last").select("token", "leader", F.explode(F.sequence(F.lit(0), F.col("spread") - 1)).alias("salt"))
    met = rounds.keep(every.select("class", "token", "salt").join(lead, ["token", "salt"]).select("leader", "class").distinct())
    chunks = met.groupBy("leader").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return met.withColumn("salt", _salt("class", F.lit(SALTS))).join(chunks, ["leader", "salt"]).select("leader", "chunks", "class")


def _compare(percent: int):
    """A function from the sets of a task to links among them."""

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("class")
        name = table.column("class").to_pylist()

        def lists(column: str) -> list[np.ndarray]:
            a = table.column(column).combine_chunks()
            return np.split(np.asarray(a.flatten()), a.offsets.to_numpy()[1:-1] - a.offsets[0].as_py())

        tokens, levels, places = (lists(c) for c in ("tokens", "levels", "positions"))
        sets = [x.view(np.uint64) for x in lists("shingles")]
        known = np.array([x or b"" for x in table.column("component").to_pylist()], dtype=object)
        labels = np.where(known == b"", np.array(name, dtype=object), known)
        side = table.column("side").to_numpy()
        found = spanning_links(table.column("n_shingles").to_numpy(), table.column("matches").to_numpy(), tokens, levels, places, sets, percent, labels, side if len(set(side.tolist())) > 1 else None)
        return pa.table({"a": pa.array([name[x] for x, _ in found], pa.binary()), "b": pa.array([name[y] for _, y in found], pa.binary())})

    return compare


def class_components(rows: DataFrame, percent: int, rounds: Rounds) -> DataFrame:
    """(vertex, component) of every class that has a link."""
    met = rounds.keep(_meetings(rows, rounds).withColumn("chunk", _salt("class", F.col("chunks"))))
    of_set = ("class", "n_shingles", "matches", "tokens", "levels", "positions", "shingles")
    sets = rows.filter("tokens IS NOT NULL").select(*of_set).join(met.select("class").distinct(), "class", "left_semi").dropDuplicates(["class"])
    chosen = (F.col("leader") == F.col("class")) | (F.pmod(F.xxhash64("class", F.lit("pivot")), F.col("chunks") * CHUNK) < PIVOTS)
    guests = met.filter((F.col("chunks") > 1) & chosen).withColumn("chunk", F.explode(F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: c != F.col("chunk"))))
    tasks = met.unionByName(guests).select("leader", "chunk", "class").join(sets, "class").withColumns({"component": F.lit(None).cast("binary"), "side": F.lit(0)})
    links = rounds.keep(tasks.groupBy("leader", "chunk").applyInArrow(_compare(percent), "a binary, b binary").distinct())
    groups = connected_components(links, "a", "b")
    large = met.filter("chunks > 1")
    if not large.limit(1).count():
        return groups
    named = rounds.keep(large.join(groups.withColumnRenamed("vertex", "class"), "class", "left").withColumn("component", F.coalesce("component", "class")))
    torn = named.groupBy("leader").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a < b").select("leader").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    left = named.withColumn("salt", _salt("class", F.lit(SALTS))).join(torn, ["leader", "salt"], "left_semi").drop("salt")
    own, last = F.floor(F.col("chunk") / TOGETHER).cast("int"), F.floor((F.col("chunks") - 1) / TOGETHER).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("last")), lambda k: F.struct(F.least(k, F.col("side")).alias("i"), F.greatest(k, F.col("side")).alias("j")))
    across = left.withColumns({"side": own, "last": last}).select("leader", "class", "component", "side", F.explode(pairs).alias("p"))
    across = across.select("leader", "p.i", "p.j", "class", "component", "side").join(sets, "class")
    more = rounds.keep(across.groupBy("leader", "i", "j").applyInArrow(_compare(percent), "a binary, b binary").distinct())
    return connected_components(links.union(more), "a", "b") if more.limit(1).count() else groups


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``n_shingles`` and ``component_id`` (the least id reachable by links) of every document."""
    corpus = Corpus(docs, id_col, text_col)
    bits = min(56, max(corpus.word_bits + 5, corpus.shard_bits))
    answers = corpus.answers(_ask(bits, width), _answer)
    rounds = Rounds(docs.sparkSession)
    rows = rounds.keep(corpus.with_answers(answers, _use(bits, width, percent), SCHEMA))
    groups = class_components(rows, percent, rounds)

    # One row for each block and class, so even a class of a third of all documents has few.
    own = rows.filter("class IS NOT NULL").select("block", "class", F.array_min("ids").alias("least"))
    by_class = own.groupBy("class").agg(F.min("least").alias("least"))
    linked = rounds.keep(by_class.join(groups.withColumnRenamed("vertex", "class"), "class"))
    rounds.only(rows, linked)
    least = linked.groupBy("component").agg(F.min("least").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    named = linked.withColumn("salt", _salt("class", F.lit(SALTS))).join(least, ["component", "salt"]).select("class", "component_id")
    homes = own.select("block", "class").join(by_class.join(named, "class", "left").select("class", F.coalesce("component_id", "least").alias("component_id")), "class")
    listed = rows.select("block", "class", "ids", "n_shingles").join(homes, ["block", "class"], "left")
    out = listed.select(F.explode("ids").alias("doc_id"), "n_shingles", "component_id")
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents, with all their columns, less those whose component has a lesser id.

    Of rows with one id and equal texts, which are copies of each other, one
    stays, whatever their other columns hold.  Documents with a null id stay.
    """
    found = jaccard_components(docs, width, percent, id_col, text_col).filter(F.col(id_col).isNotNull())
    marks = found.groupBy(F.col(id_col).alias("marked_id")).agg(F.min(F.col("component_id") == F.col(id_col)).alias("stays"), (F.count("*") > 1).alias("again")).filter("NOT stays OR again")
    marks = stored(marks.select("marked_id", "stays"))
    mark = free_name("stays", docs.columns)
    kept = docs.join(marks.withColumnRenamed("stays", mark), docs[id_col] == F.col("marked_id"), "left").filter(F.coalesce(F.col(mark), F.lit(True)))
    if not marks.filter("stays").limit(1).count():
        return kept.select(*[docs[c] for c in docs.columns])
    single, again = kept.filter(F.col(mark).isNull()), kept.filter(F.col(mark).isNotNull()).dropDuplicates([id_col, text_col])
    return single.unionByName(again).select(*docs.columns)
