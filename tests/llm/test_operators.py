"""The other corpus operators against brute force, exact round trips, and held-out accuracy."""

import math
import random
import re
from collections import Counter
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from txstrata.llm import blocks, chat_template, common, elias_fano, fingerprints, jaccard_join, language_id, lm_scoring, quality_model, quality_rules
from txstrata.llm.common import id_crc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def some_texts():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(words).capitalize() if rng.random() < 0.1 else rng.choice(words) for _ in range(n))
    out = [None, "", " \n\t ", "one", "One two THREE", "a b c d e", "A b c\td e", "x" * 5000]
    for _ in range(25):
        t = say(rng.randint(20, 200))
        out += [t, t]
        for _ in range(3):
            w = t.split(" ")
            for _ in range(rng.randint(1, 1 + len(w) // 40)):
                w[rng.randrange(len(w))] = rng.choice(words)
            out.append(" ".join(w))
    shared = say(60)
    out += [shared + " " + say(8) for _ in range(20)] + ["line one\nline two\nline one\n\n" * 5, "### $$$ %%% &&& " * 20, "SHOUT LOUD " * 60, " ".join(["lone"] * 4000)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 7) for i, t in enumerate(some_texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, component_id string, class string, score long").repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def brute_digest(text):
    """The digest of a text, byte triplet by byte triplet."""
    data, counts = text.encode(), [0] * fingerprints.BUCKETS
    value = [int(v) >> 32 for v in common._BYTE_VALUE]
    for x, y, z in zip(data, data[1:], data[2:], strict=False):
        h = (value[x] * 0x85EBCA6B + value[y] * 0xC2B2AE35 + value[z]) % 2**32
        h = (h ^ h >> 15) * 0x27D4EB2F % 2**32
        counts[h * fingerprints.BUCKETS >> 32] += 1
    ranked = sorted(counts)
    cuts = [ranked[fingerprints.BUCKETS * k // 4 - 1] for k in (1, 2, 3)]
    return round(4 * math.log2(len(data) + 1)), [sum(c > q for q in cuts) if len(data) > 2 else 0 for c in counts]


def brute_likeness(a, b):
    most = sum(map(max, a[1], b[1]))
    body = sum(abs(x - y) for x, y in zip(a[1], b[1], strict=True)) / most if most else 0.0
    return 1 - min(1.0, body + 0.2 * min(1.0, abs(a[0] - b[0]) / 8))


def digest_text(d):
    return f"{d[0]:02x}" + "".join(f"{64 * a + 16 * b + 4 * c + e:02x}" for a, b, c, e in zip(*[iter(d[1])] * 4, strict=True))


def test_fingerprints(spark, docs, none):
    t = {i: x or "" for i, x in enumerate(some_texts())}
    t[len(t)] = "a very long text " * 60_000
    n = len(t)
    clash = spark.createDataFrame([(i, x, "f", 0.5) for i, x in t.items()], "doc_id long, text string, fingerprint string, near_next double").repartition(4)
    rows = {r["doc_id"]: r for r in fingerprints.with_edits(clash).collect()}
    assert sorted(rows) == list(range(n))
    for i in range(n):
        after = t[i - 1] if i else t[n - 1]
        half = len(t[i]) // 2
        edited = t[i][: len(t[i]) - half] + after[:half]
        own, edit, nxt = map(brute_digest, (t[i], edited, after))
        r = rows[i]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(t[i]), sha256(edited.encode()).hexdigest(), digest_text(own), digest_text(edit))
        assert r["near_edited"] == pytest.approx(brute_likeness(own, edit)) and r["near_next"] == pytest.approx(brute_likeness(own, nxt)) and 0 <= r["near_next"] <= 1
    assert fingerprints.with_edits(none).count() == 0
    assert fingerprints.with_edits(clash.filter("doc_id = 9")).first()["near_next"] == 1.0
    assert fingerprints.fingerprints(docs).count() == n - 1


@pytest.mark.parametrize("known", [0, 1, 40])
def test_fingerprints_follow_one_another_without_ids(spark, known):
    """Whatever has an id comes first, by descending id; then the rest by a hash of the text; then the first again."""
    rows = [(5 * i, f"text {i} " * (i % 5 + 1)) for i in range(known)] + [(None, f"no id {i}") for i in range(60)] + [(0, "text 0 ")] * 2 * bool(known)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    order = [r["text"] for r in frame.withColumn("h", F.shiftrightunsigned(F.when(F.col("doc_id").isNull(), F.xxhash64("text")), 1)).orderBy(F.desc_nulls_last("doc_id"), "h", "text").collect()]
    want = Counter()
    for own, after in zip(order, [*order[1:], order[0]], strict=True):
        half = len(own) // 2
        want[sha256((own[: len(own) - half] + after[:half]).encode()).hexdigest()] += 1
    assert Counter(r["edited_sha256"] for r in fingerprints.with_edits(frame).collect()) == want


def test_templates():
    run = lambda source, **v: "".join(x for x in chat_template.compile_template(source)(v) if isinstance(x, str))
    assert run("{% for m in ms %}{{ loop.index }}{{ m.x|upper }}{% if not loop.last %},{% endif %}{% endfor %}", ms=[{"x": "a"}, {"x": "b"}]) == "1A,2B"
    assert run("{% set a = 1 + 2 %}{{ a }}{% if a == 3 and 'b' in 'abc' %}yes{% elif a %}no{% else %}-{% endif %}{# gone #}") == "3yes"
    assert run("{{ 'x' if n else 'y' }}{{ d['k'] ~ d.gone }}", n=0, d={"k": 1}) == "y1"
    for bad in ("{{ x", "{% for %}", "{{ a.b() }}", "{{ 1 | no }}", "{% if a %}", "{% include 'x' %}", "{{ a + }}"):
        with pytest.raises(chat_template.TemplateError):
            chat_template.compile_template(bad)
    assert run("{{ x.__class__ }}{{ x.upper }}", x="s") == ""
    tree = chat_template.fold(chat_template.parse("a{{ 'b' ~ 1 }}{% if 1 == 2 %}no{% else %}c{% endif %}"))
    assert tree == [chat_template.Emit(chat_template.Const("ab1c"))]
    rng = random.Random(1)
    for _ in range(300):
        s = "".join(rng.choice(["\\", "<", "s>", "</s>", "[INST]", "[/INST]", "x", "[", "\n", "[ROLE]"]) for _ in range(12))
        e = chat_template.escape(s)
        assert chat_template.unescape(e) == s and not chat_template._CONTROL.search(e)


def test_conversations(spark):
    said = "</s>[INST] ok [/INST]"
    rng = random.Random(2)
    rows = [(-1, 0, "user", said), (-1, 1, "assistant", said), (4, 0, None, None), (4, 1, "assistant", None), (None, 0, "user", "x")]
    rows += [(c, t, rng.choice(["user", "assistant", "system", "[ROLE]"]), rng.choice(["", said, "\\", "plain é 😀", "<s>", "[/INST]</s>\n"])) for c in range(10, 30) for t in range(rng.randint(1, 6))]
    rows += [(30, t, "assistant", f"long {t} " * 20) for t in range(50)] + [(31, 0, "user", "same"), (31, 0, "user", "same")]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string").repartition(4)
    formatted = chat_template.format_conversations(turns, segment=500)
    assert formatted.filter("conv_id = 30").count() > 5
    found = {r["conv_id"]: r for r in chat_template.conversation_digests(formatted).collect()}
    whole = {r["conv_id"]: r for r in chat_template.conversation_digests(chat_template.format_conversations(turns)).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t, role or "", text or ""))
    assert found == whole == {r["conv_id"]: r for r in chat_template.conversation_digests(formatted, in_order=True).collect()} and set(found) == set(by)
    plan = chat_template.conversation_digests(chat_template.format_conversations(turns), in_order=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert chat_template.conversation_digests(chat_template.format_conversations(turns.limit(0)), in_order=True).count() == 0
    for c, own in by.items():
        own.sort()
        loss = "".join(x for _, role, x in own if role == "assistant")
        r = found[c]
        assert (r["n_turns"], r["turns_sha256"]) == (len(own), sha256("".join(f"{a}\n{b}\n" for _, a, b in own).encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), sha256(loss.encode()).hexdigest())
    with pytest.raises(ValueError):
        chat_template.read_turns("<s>open")


def test_elias_fano():
    rng = np.random.default_rng(4)
    for n, bits in ((0, 40), (1, 5), (1000, 10), (5000, 64), (700, 33), (3, 60), (20_000, 47)):
        v = np.sort(rng.integers(0, 1 << bits, n, dtype=np.uint64)) if bits < 64 else np.sort(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        data = elias_fano.encode(v, bits)
        assert np.array_equal(elias_fano.decode(data), v)
        found = elias_fano.Sequence(data, elias_fano.directory(data))
        some = rng.permutation(n)
        assert np.array_equal(found.at(some), v[some]) and np.array_equal(v[found.find(v)], v)
        other = rng.integers(0, 1 << min(bits, 63), 500, dtype=np.uint64)
        assert np.array_equal(found.find(other) >= 0, np.isin(other, v))
    keys = np.unique(rng.integers(0, 1 << 30, 4000, dtype=np.uint64))
    node = keys >> np.uint64(20)
    trie = elias_fano.Trie(keys[::2], (node[::2] % 251 + 1).astype(np.uint8), (np.arange(len(keys[::2])) % 255 + 1).astype(np.uint8), 30, 20)
    of_node, value = trie.lookup(keys)
    assert np.array_equal(value[::2], np.arange(len(keys[::2])) % 255 + 1) and not value[1::2].any()
    assert np.array_equal(of_node, np.where(np.isin(node, node[::2]), node % 251 + 1, 0))
    assert trie.size < 6.5 * len(keys[::2])  # of 30-bit keys with two bytes of values; a decoded table has 10
    trie.close()
    assert elias_fano.quantise(np.arange(64)).tolist() == list(range(64)) and abs(elias_fano.CODEBOOK[elias_fano.quantise(np.array([10**6]))[0]] / 10**6 - 1) < 0.07


def trained_counts(t, held):
    c1, c2, c3 = Counter(), Counter(), Counter()
    for i, w in t.items():
        if not held[i]:
            p = ["<b>", "<b>", *w]
            c1.update(w)
            c2.update(zip(p[1:], p[2:], strict=False))
            c3.update(zip(p, p[1:], p[2:], strict=False))
    return c1, c2, c3


def brute_model(c1, c2, c3):
    """p(w), p(w | b) and p(w | a b), as defined, with quantised numbers where the operator has them."""
    total, types = sum(c1.values()), len(c1)
    q = lambda c: float(elias_fano.CODEBOOK[elias_fano.quantise(np.array([c]))[0]])
    near = lambda p: float(lm_scoring.value_of(lm_scoring.quantised(np.array([p])))[0])
    s = lambda c, k: lm_scoring.PSEUDO[k][0] * c ** lm_scoring.PSEUDO[k][1] if c else 1.0
    p1 = lambda w: (c1[w] + 0.5) / (total + 0.5 * (types + 1))

    def p2(b, w):
        context = c1["<end>" if b == "<b>" else b]
        return (c2[b, w] + s(context, 0) * p1(w)) / (context + s(context, 0))

    def p3(a, b, w):
        context = q(c1["<end>"] if b == "<b>" else c2[a, b])
        lower, weight = near(p2(b, w)), s(context, 1)
        if c3[a, b, w]:
            return near(min(1.0, (min(c3[a, b, w], context) + weight * lower) / (context + weight)))
        return near(lower * weight / (context + weight))

    return p1, p2, p3


@pytest.mark.parametrize("block,fan", [(1 << 23, 7), (2000, 2)])
def test_language_model(spark, docs, none, monkeypatch, block, fan):
    corpus = lm_scoring.Corpus
    monkeypatch.setattr(lm_scoring, "Corpus", lambda d, i, t: corpus(d, i, t, block, fan))
    t = {i: WORD.findall((x or "").translate(LOW)) + ["<end>"] for i, x in enumerate(some_texts())}
    held = {i: crc32(str(i).encode()) % 5 == 1 for i in t}
    c1, c2, c3 = trained_counts(t, held)
    p1, _, p3 = brute_model(c1, c2, c3)
    rows = {r["doc_id"]: r for r in lm_scoring.score_documents(docs).collect()}
    gain = 0.0
    for i, w in t.items():
        p = ["<b>", "<b>", *w]
        base = sum(math.log10(p1(x)) for x in w)
        model = sum(math.log10(p3(*p[k - 2 : k + 1])) for k in range(2, len(p)))
        r = rows[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(w), sum(c1[x] > 0 for x in w), sum(c1.values()))
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(model, abs=0.2)  # a code may fall to the other side
        gain += (r["score"] - r["base_score"]) * held[i]
    assert gain > 0 and len(rows) == len(t)
    assert lm_scoring.score_documents(none).count() == 0


def test_probabilities_sum_to_one():
    t = {i: WORD.findall((x or "").translate(LOW)) + ["<end>"] for i, x in enumerate(some_texts())}
    c1, c2, c3 = trained_counts(t, dict.fromkeys(t, False))
    p1, p2, p3 = brute_model(c1, c2, c3)
    unseen = 0.5 / (sum(c1.values()) + 0.5 * (len(c1) + 1))  # all words not in training, as one
    assert sum(map(p1, c1)) + unseen == pytest.approx(1)
    for a, b in [k for k, _ in c2.most_common(5)] + [("<b>", "<b>"), ("no", "such")]:
        assert sum(p2(b, w) for w in [*c1, "never"]) == pytest.approx(1)
        assert sum(p3(a, b, w) for w in [*c1, "never"]) == pytest.approx(1, abs=0.08)  # steps of 4 to 14 per cent


def test_messages_grow_with_the_input(spark):
    """Rows sent a level are at most ``2**fan`` a block, at any size."""
    sent = {}
    for n in (400, 1600):
        rows = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(40))) for i in range(n)], "doc_id long, text string")
        corpus = blocks.Corpus(rows, block_bytes=2000, fan_bits=3)
        ask = lambda batches: [blocks.Asked(*np.unique(np.concatenate([jaccard_join.shingle_sets(b.column(1))[0] for b in batches]), return_counts=True), 64)]
        answer = lambda asked: blocks.Answered([blocks.as_bytes(asked[0].counts)], np.array([asked[0].counts.sum()], np.uint64))
        found = corpus.answers(ask, answer)
        assert found.groupBy("node").count().agg(F.max("count")).first()[0] <= 8
        sent[n] = (found.count(), corpus.n_blocks, len(corpus.widths))
        total = corpus.with_answers(found, lambda block, batches, f: [pa.table({"n": [int(f.sums[0])]})], "n long").distinct().collect()
        assert [r["n"] for r in total] == [36 * n]  # sums reach every block
    (a, blocks_a, _), (b, blocks_b, levels) = sent[400], sent[1600]
    assert levels >= 2 and b / a <= 1.2 * blocks_b / blocks_a


def test_copies_of_a_row_are_spread_over_blocks():
    hashes = np.concatenate([np.full(1000, 77), np.arange(50)]).astype(np.int64)
    found = blocks.blocks_of(hashes, 16)
    assert np.bincount(found, minlength=16).max() < 80 and np.array_equal(np.sort(blocks.blocks_of(hashes[::-1].copy(), 16)), np.sort(found))


THUE = {n: "".join("ab"[bin(i).count("1") & 1] for i in range(n)) for n in (1024, 2048, 4096)}


def test_hashes_tell_crafted_words_apart(spark):
    swap = str.maketrans("ab", "ba")
    words = [w for x in THUE.values() for w in (x, x.translate(swap), x + "a", x[8:] + x[:8], x[:-8], "\0" + x)] + ["a", "a\0", "aaaaaaaab", "baaaaaaaa"]
    column = pa.array([" ".join(words)])
    buf, bounds = common.text_buffer(column)
    begin, end, _ = common.word_spans(buf, bounds)
    assert len(set(common.word_hashes(buf, begin, end, lower=True).tolist())) == len(words)
    assert common.equal_spans(buf, begin, end, begin, end, 100).all() and not common.equal_spans(buf, begin[:2], end[:2], begin[[1, 0]], end[[1, 0]]).any()
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(THUE.values())] + [(10 + i, w.translate(swap)) for i, w in enumerate(THUE.values())] + [(20, f"{THUE[1024]}\n{THUE[1024].translate(swap)}")], "doc_id long, text string")
    assert jaccard_join.jaccard_components(rows).filter("doc_id <> component_id").count() == 0
    assert quality_rules.ledger(rows).filter("n_dup_lines > 0").count() == 0
    known = {r["doc_id"]: r["n_known"] for r in lm_scoring.score_documents(rows, folds=2, fold=crc32(b"0") % 2).collect()}
    assert known[0] == 1 + (crc32(b"20") % 2 != crc32(b"0") % 2)  # its end, and the one other text with its word


def brute_components(texts):
    sets, parent = {}, {}
    for i, x in texts.items():
        w = WORD.findall((x or "").translate(LOW))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("block,chunk", [(1 << 23, 2048), (3000, 3)])
def test_jaccard_join(spark, docs, none, monkeypatch, block, chunk):
    monkeypatch.setattr(jaccard_join, "CHUNK", chunk)
    corpus = jaccard_join.Corpus
    monkeypatch.setattr(jaccard_join, "Corpus", lambda d, i, t: corpus(d, i, t, block, 3))
    want = brute_components(dict(enumerate(some_texts())))
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs).collect()}
    assert found == want and sum(i != c for i, (_, c) in want.items()) > 40
    if chunk == 3:
        kept = jaccard_join.one_of_each(docs.union(docs.filter("doc_id = 3")))
        assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if i == c)
        assert jaccard_join.jaccard_components(none).count() == 0


def test_classes_of_a_leader_that_are_not_alike_all_meet(spark, monkeypatch):
    """One passage in all documents, which is most of some and little of others: many chunks, several components."""
    rng = random.Random(8)
    shared = [f"s{k}" for k in range(60)]
    own = lambda n: [f"o{rng.random()}" for _ in range(n)]
    texts = [" ".join(shared + own(rng.choice([2, 4, 6, 9, 14, 20, 30]))) for _ in range(40)]
    tails = [" ".join(shared[:30] + [f"t{g}w{k}" for k in range(60)] + own(rng.choice([1, 3]))) for g in range(4) for _ in range(6)]
    texts += tails
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = brute_components(dict(enumerate(texts)))
    for chunk, together in ((2, 2), (3, 1), (7, 4)):
        monkeypatch.setattr(jaccard_join, "CHUNK", chunk)
        monkeypatch.setattr(jaccard_join, "TOGETHER", together)
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(rows).collect()} == want
    assert 4 < len({c for _, c in want.values()}) < len(texts)


def test_prefixes_lose_no_pair():
    rng = np.random.default_rng(9)
    base = [np.unique(rng.integers(0, 400, 60, dtype=np.uint64)) for _ in range(6)]
    sets = [np.unique(np.concatenate([rng.permutation(b)[: len(b) - rng.integers(0, 14)], rng.integers(0, 400, rng.integers(0, 9), dtype=np.uint64)])) for b in base for _ in range(12)]
    df = Counter(int(x) for s in sets for x in s)
    heads = []
    for s in sets:
        f = np.array([df[int(x)] for x in s], dtype=float)
        order = np.lexsort((s, f))
        m, first = jaccard_join.choose_prefix(f[order])
        head = order[: first + m - 1]
        heads.append((m, s[head].view(np.int64), np.maximum(np.arange(len(head)) - first + 2, 1), np.arange(len(head))))
    n = np.array([len(s) for s in sets])
    links = jaccard_join.spanning_links(n, np.array([h[0] for h in heads]), [h[1] for h in heads], [h[2] for h in heads], [h[3] for h in heads], sets)
    parts = jaccard_join._Parts(len(sets))
    for a, b in links:
        parts.join(a, b)
    want = jaccard_join._Parts(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 75 * (n[i] + n[j] - both):
                want.join(j, i)
    assert np.array_equal(parts.label, want.label) and len(set(want.label)) < len(sets)


def read(spark, name):
    return spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")


def brute_probabilities(net, row):
    """Responses of all filters at all places by direct convolution, their greatest, softmax."""
    pooled = []
    for w in net.filters:
        places = [[sum(float(w[p, row[i + p], f]) for p in range(len(w))) for i in range(len(row) - len(w) + 1)] for f in range(w.shape[2])]
        pooled += [max(0.0, max(p)) for p in places]
    z = [sum(pooled[k] * float(net.dense[k, j]) for k in range(len(pooled))) + float(net.offset[j]) for j in range(len(net.labels))]
    e = [math.exp(x - max(z)) for x in z]
    return [x / sum(e) for x in e]


def test_windows_against_direct_convolution(spark):
    rng = np.random.default_rng(6)
    net = language_id.Network(["a", "b", "c"], [rng.normal(0, 1, (w, 256, language_id.FILTERS)).astype(np.float32) for w in language_id.WIDTHS], rng.normal(0, 1, (len(language_id.WIDTHS) * language_id.FILTERS, 3)).astype(np.float32), rng.normal(0, 1, 3).astype(np.float32))
    texts = ["Some words, ÄÖ and more " * k for k in (1, 9, 30)] + ["x", None, "12 34", "", "Some words, ÄÖ and more "]
    rows = spark.createDataFrame([(i, t, "q", 0.0) for i, t in enumerate(texts)] + [(None, "null id", "q", 0.0), (0, texts[0], "q", 0.0)], "doc_id long, text string, lang_pred string, score double")
    out = language_id.predict_languages(rows, net).collect()
    assert len(out) == len(texts) + 2
    for r in out:
        text = "null id" if r["doc_id"] is None else texts[r["doc_id"]]
        if not any(c.isalpha() for c in text or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        data = bytes(c + 32 if 65 <= c < 91 else c for c in text.encode())
        parts = [data[i : i + language_id.WINDOW] for i in range(0, len(data), language_id.WINDOW)]
        total = np.sum([np.array(brute_probabilities(net, part.ljust(language_id.WINDOW, b"\0"))) * len(part) for part in parts], axis=0) / len(data)
        assert r["lang_pred"] == net.labels[int(total.argmax())] and r["score"] == pytest.approx(total.max(), abs=1e-4)
    assert language_id.kept_documents(rows, net, least=0.0).columns == rows.columns


def test_every_language_is_learned(spark):
    rows = spark.createDataFrame([(i, f"word{chr(97 + i % 26)}{i % 300} " * 10, f"l{i % 300}") for i in range(1200)], "doc_id long, text string, lang string")
    assert len(set(language_id.sample_windows(rows, F.lit(True), per_language=50)[1])) == 300


def test_languages(spark, none):
    docs = read(spark, "documents")
    net = language_id.train(*language_id.sample_windows(docs, id_crc() % 5 != 0))
    out = language_id.predict_languages(docs, net).join(docs, "doc_id").filter(id_crc() % 5 == 0)
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, "x"), (5, "the and of " * 30_000)], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict_languages(odd, net).collect()}
    assert all(got[i] == ("und", 0.0) for i in (1, 2, 3)) and got[4][0] != "und" and 0 < got[5][1] <= 1
    assert language_id.predict_languages(none, net).count() == 0
    assert language_id.sample_windows(none, id_crc() % 5 != 0)[1] == [] and language_id.train(np.zeros((0, language_id.WINDOW), np.uint8), []) is None
    assert {r["lang_pred"] for r in language_id.predict_languages(odd, None).collect()} == {"und"}
    assert language_id.kept_documents(docs, net).columns == docs.columns


def test_quality_model(spark, none):
    docs, labels = read(spark, "documents"), read(spark, "labels")
    stats = quality_model.document_statistics(docs)
    forest = quality_model.fit(stats, labels, id_crc() % 5 != 0)
    out = quality_model.score(stats, forest).join(labels, "doc_id").filter(id_crc() % 5 == 0)
    r = out.agg(F.avg((F.col("quality") == F.col("predicted")).cast("int")), F.min("score"), F.max("score")).first()
    assert r[0] > 0.93 and r[1] >= 0 and r[2] <= 1
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 100_000), (None, "y")], "doc_id long, text string")
    assert quality_model.score(quality_model.document_statistics(odd), forest).filter("score BETWEEN 0 AND 1").count() == 4
    assert quality_model.score(quality_model.document_statistics(none), forest).count() == 0
    flat = quality_model.fit(stats, labels.limit(0), id_crc() % 5 != 0)
    assert {r["score"] for r in quality_model.score(quality_model.document_statistics(odd), flat).collect()} == {0.5}
    x = np.random.default_rng(0).normal(size=(400, 3)).astype(np.float32)
    assert np.mean((quality_model.train(x, ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)).scores(x) > 0.5) == ((x[:, 0] > 0) ^ (x[:, 1] > 0))) > 0.95


def test_quality_rules(spark, docs, none):
    rows = quality_rules.apply_policy(quality_rules.ledger(docs)).cache()
    found = {r["doc_id"]: r for r in rows.collect()}
    for i, x in enumerate(some_texts()):
        w = WORD.findall(x or "")
        lines = [ln for ln in (x or "").split("\n") if WORD.search(ln)]
        seen = Counter(zip(w, w[1:], w[2:], strict=False))
        again = {k + j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(3)}
        r = found[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_lines"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x or "")), len(lines), len(lines) - len(set(lines)), len(again),
        )
        assert bool(r["failures"] & 1) == (len(w) < 50) and bool(r["failures"] & 2) == (100 * len(again) > 50 * len(w))
    out = {r["rule"]: (r["n_failed"], r["n_only_this"]) for r in quality_rules.ablations(rows).collect()}
    fails = [r["failures"] for r in found.values()]
    assert out == {k: (sum(bool(f & b) for f in fails), sum(f == b for f in fails)) for k, b in quality_rules.BIT.items()}
    assert quality_rules.ledger(none).count() == 0 and quality_rules.kept_documents(docs).columns == docs.columns
    clean = read(spark, "documents").join(read(spark, "labels").filter("quality = 1"), "doc_id")
    kept = quality_rules.apply_policy(quality_rules.ledger(clean)).filter("NOT kept AND n_words >= 50").count()
    assert kept <= 0.02 * clean.count()


def test_equal_hashes_are_told_apart(monkeypatch):
    """Lines and words are compared byte by byte, so even a useless hash gives right results."""
    text = ["one two three four\nfive six\none two three four\nx\n" * 2, "a b c d e f g h", "a b c a b c\n a b c", "\n\n \n"]
    want = [quality_rules.repeated(t.encode()) for t in text]
    plain = quality_rules._measurer()(pa.array(text))
    assert list(zip(plain[4].tolist(), plain[5].tolist(), strict=True)) == want and want[0][0] > 0
    monkeypatch.setattr(quality_rules, "word_hashes", lambda buf, begin, end, lower: np.zeros(len(begin), np.uint64))
    bad = quality_rules._measurer()(pa.array(text))
    assert list(zip(bad[4].tolist(), bad[5].tolist(), strict=True)) == want


def test_pipeline(spark, tmp_path):
    """Against the stages' own brute force: rules in Python, the network's word for the language, all pairs, the library's ids."""
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(21)
    base = read(spark, "documents").filter("lang IS NOT NULL AND length(text) BETWEEN 800 AND 4000").orderBy("doc_id").limit(120).collect()
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], "extra") for r in base]
    words = base[0]["text"].split(" ")
    near = words[:]
    near[rng.randrange(20, len(near))] = "altered"
    rows += [(900_001, base[0]["text"], "en", "s", 1, "copy"), (900_002, " ".join(near), "en", "s", 1, "near copy"), (900_003, None, "en", "s", 1, "null"), (900_004, "too short", "en", "s", 1, "short"), (900_005, "1234 5678 " * 60, "en", "s", 1, "no letters"), (None, base[1]["text"], "en", "s", 1, "no id"), rows[2]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component_id string").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    good = corpus_pipeline.quality_stage(spark, docs, "")
    spoken = corpus_pipeline.language_stage(spark, good, "")
    ids = lambda f: sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in f.collect())
    assert good.columns == spoken.columns == docs.columns
    assert not {900_003, 900_004} & {r["doc_id"] for r in good.collect()} and 900_005 not in {r["doc_id"] for r in spoken.collect()}
    texts = {r["doc_id"]: r["text"] for r in spoken.collect() if r["doc_id"] is not None}
    groups = brute_components(texts)
    want = sorted([(False, i) for i, (_, c) in groups.items() if i == c] + [(True, 0)])
    single = corpus_pipeline.duplicate_stage(spark, spoken, "")
    assert ids(single) == want and single.columns == docs.columns and not {900_001, 900_002} & {r["doc_id"] for r in single.collect()}
    library, total = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter()
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        total[r["doc_id"]] += r["length"]
    assert total == Counter({r["doc_id"]: len(library.encode(r["text"], add_special_tokens=False).ids) + 1 for r in single.collect()})
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "").count() == 0


def odd_rows(spark, names="doc_id long, text string"):
    """Null ids and texts, repeated rows, a very long text, columns named like outputs."""
    long = " ".join(f"w{k % 5000}" for k in range(150_000))
    rows = [(1, "one two three four five six"), (1, "one two three four five six"), (None, "one two three four five six"), (None, None), (2, None), (3, ""), (4, long), (5, long), (6, "one two three four five seven")]
    return spark.createDataFrame([(*r, 0.5, "x", True) for r in rows], f"{names}, score double, component_id string, held_out boolean").repartition(3), long


def test_odd_rows_of_counting_operators(spark):
    rows, long = odd_rows(spark)
    links = jaccard_join.jaccard_components(rows).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in links) == [(0, 0, 0), (0, 2, 1), (1, 2, 1), (1, 2, 1), (2, 0, 2), (3, 0, 3), (4, 5000, 4), (5, 5000, 4), (6, 2, 6)]
    scores = lm_scoring.score_documents(rows).collect()
    held = lambda i: i is not None and crc32(str(i).encode()) % 5 == 1
    size = {1: 7, 2: 1, 3: 1, 4: 150_001, 5: 150_001, 6: 7}
    assert sorted(r["n_tokens"] for r in scores) == sorted([7, 7, 7, 1, 1, 1, 150_001, 150_001, 7])
    assert {r["train_tokens"] for r in scores} == {sum(size[i] * (2 if i == 1 else 1) for i in size if not held(i)) + 8}
    ledger = quality_rules.ledger(rows).collect()
    assert sorted(r["n_words"] for r in ledger) == [0, 0, 0, 6, 6, 6, 6, 150_000, 150_000] and sum(r["doc_id"] is None for r in ledger) == 2
    assert quality_rules.kept_documents(rows).columns == rows.columns
    stats = quality_model.document_statistics(rows)
    forest = quality_model.train(np.random.default_rng(1).normal(size=(300, len(quality_model.STATISTICS))).astype(np.float32), np.arange(300) % 2.0)
    out = quality_model.score(stats, forest).collect()
    assert len(out) == 9 and all(0 <= r["score"] <= 1 for r in out) and len({r["score"] for r in out if r["doc_id"] in (4, 5)}) == 1


def test_flattened_trees_against_a_walk():
    rng = np.random.default_rng(12)
    x = rng.normal(size=(500, 4)).astype(np.float32)
    forest = quality_model.train(x, (x[:, 0] * x[:, 1] > 0.1).astype(float), trees=12, depth=4)

    def walk(row):
        total = forest.base
        for f, t, v in zip(forest.feature, forest.threshold, forest.value, strict=True):
            node = 0
            for _ in range(4):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            total += v[node - 15]
        return 1 / (1 + math.exp(-total))

    assert forest.scores(x[:100]) == pytest.approx([walk(r) for r in x[:100]])
