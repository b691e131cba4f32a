"""Token counts, chunked coding and packing against the libraries themselves."""

import random
from hashlib import sha256
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer
from txstrata.llm import bpe_chunks, engines, packing, token_counts

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def texts():
    rng = random.Random(3)
    out = [None, "", " ", "\n\t", "It's DON'T we'll ’s İstanbul ΣΑΣ naïve é \x1c\x1d a\x1cb <|endoftext|> a<|endoftext|>b ª²³ ½   日本語 ẞ Ÿ × \x85 a\xa0b", "'s't're 'S X'Ve ''s", "x" * 3000, " " * 2000 + "y", "word " * 4000]
    out += ["".join(rng.choice("aB'sS .,!éÉǺ\n\t\x0b\x1f <|>1९Σς​😀") for _ in range(60)) for _ in range(150)]
    base = " ".join(rng.choice(["the", "quick", "Brown", "fox,", "über", "jumps", "12", "over."]) for _ in range(3000))
    return [*out, base, base[:9000] + " an edit " + base[9000:], base]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "n", 1.5) for i, t in enumerate(texts())] + [(3, "\n\t", "again", 2.0), (None, "no id", "x", 0.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, ids double").repartition(3)


def test_counts(docs):
    lib = Tokenizer.from_file(WORDS)
    rows = token_counts.token_counts(docs, WORDS, limit=100).collect()
    assert len(rows) == docs.count()
    by = {r["doc_id"]: r for r in rows}
    for i, t in enumerate(texts()):
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        assert (by[i]["n_bytes"], by[i]["n_tokens"], by[i]["over_limit"]) == (len((t or "").encode()), n, n > 100)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_under_other_tokenizers(docs, name):
    path = public_tokenizers.path(name)
    rows = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, path).collect()}
    if name.endswith("json"):
        lib = Tokenizer.from_file(path)
        count = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    else:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(sp.encode(t))
    assert all(rows[i] == count(t or "") for i, t in enumerate(texts()))


def test_parts_are_cut_at_white_space():
    t = "ab cd\nef " * 50
    parts = list(token_counts.safe_parts(t, 20))
    assert "".join(parts) == t and max(map(len, parts)) <= 20 and all(p[0].isspace() for p in parts[1:])
    assert list(token_counts.safe_parts("x" * 50, 20)) == ["x" * 50] or "".join(token_counts.safe_parts("x" * 50, 20)) == "x" * 50


def test_coding(docs):
    lib = Tokenizer.from_file(BYTES)
    rows = {r["doc_id"]: r for r in bpe_chunks.encode_documents(docs, BYTES).collect()}
    for i, t in enumerate(texts()):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        back = lib.decode(ids, skip_special_tokens=False)
        r = rows[i]
        assert (r["n_tokens"], bytes(r["ids"]), r["decoded"]) == (len(ids), np.array(ids, "<u4").tobytes(), back)
        assert (r["ids_sha256"], r["decoded_sha256"]) == (sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256(back.encode()).hexdigest())


def test_chunks_follow_content():
    body = (" ".join(str(i * 7919 % 1009) for i in range(4000))).encode()
    cut = lambda d: {d[a:b] for a, b in zip([0, *bpe_chunks.chunk_bounds(d)], bpe_chunks.chunk_bounds(d), strict=False)}
    assert len(cut(body) & cut(b"something in front " + body)) >= len(cut(body)) - 2


class EdgeEngine:
    """Ids are bytes; in a text that doesn't begin with a blank those within ``reach`` words of its ends are others."""

    def __init__(self, reach):
        self.reach, self.token = reach, [b"%c" % (b % 256) for b in range(768)]

    def encode(self, text):
        data, words = text.encode(), text.split(" ")
        cut = not text.startswith(" ")
        head, tail = (len(" ".join(w).encode()) * cut for w in (words[: self.reach], words[-self.reach :]))
        return [b + (256 if i < head else 512 if i >= len(data) - tail else 0) for i, b in enumerate(data)]

    def decode(self, ids):
        return bytes(i % 256 for i in ids)


def test_joins_are_widened_until_they_agree():
    """Chunks are wrong ``reach`` words deep, so windows have to grow beyond that; at last they take chunks whole."""
    rng = random.Random(5)
    text = "".join(" " + rng.choice(["alpha", "beta", "gamma", "delta", "epsilon"]) for _ in range(3000)) + " 1 2 3 " * 700 + "end of it all"
    widths = {}
    for reach in (1, 2, 3, 50):
        coder, seen = bpe_chunks.Coder(EdgeEngine(reach)), []
        window = coder.window
        coder.window = lambda t, window=window, seen=seen: (seen.append(len(t)), window(t))[1]
        parts = coder.whole(text)
        assert b"".join(p[1] for p in parts) == text.encode()
        assert np.frombuffer(b"".join(p[0] for p in parts), "<u4").tolist() == list(text.encode())
        widths[reach] = sum(seen)
    assert widths[1] < widths[2] < widths[3] < widths[50]


def test_chunks_are_bounded():
    for data in (b"x" * 100_000, "é".encode() * 50_000, b"\0" * 9000):
        ends = bpe_chunks.chunk_bounds(data)
        assert ends[-1] == len(data) and max(b - a for a, b in zip([0, *ends], ends, strict=False)) <= bpe_chunks.MOST_BYTES
        assert all(data[a:b].decode() for a, b in zip([0, *ends], ends, strict=False))


def test_very_long_texts(spark):
    long = " ".join(f"word{i % 997} ünï {i}." for i in range(120_000))
    rows = spark.createDataFrame([(1, long), (2, "x" * 300_000 + " y")], "doc_id long, text string")
    words, pieces = Tokenizer.from_file(WORDS), Tokenizer.from_file(BYTES)
    for r in token_counts.token_counts(rows, WORDS).collect():
        text = long if r["doc_id"] == 1 else "x" * 300_000 + " y"
        assert r["n_tokens"] == len(words.encode(text, add_special_tokens=False).ids)
    ids = pieces.encode(long, add_special_tokens=False).ids
    r = bpe_chunks.encode_documents(rows.filter("doc_id = 1"), BYTES, with_ids=False).first()
    assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    assert packing.pack(rows, WORDS, 2).groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).filter("`sum(length)` <> `max(doc_tokens)`").count() == 0


def test_batches_of_packing_have_one_length(spark):
    rows = spark.createDataFrame([(i, "word " * (i * 37 % 900)) for i in range(300)], "doc_id long, text string").coalesce(2)
    by = {}
    for r in packing.pack(rows, WORDS, 2, with_ids=False).collect():
        by.setdefault(r["batch_id"], []).append((r["length"], r["batch_row"]))
    for own in by.values():
        length = own[0][0]
        assert {x for x, _ in own} == {length} and sorted(y for _, y in own) == list(range(len(own))) and len(own) * length <= packing.BATCH_TOKENS
    assert len(by) < 60


def test_packing(docs):
    lib = Tokenizer.from_file(WORDS)
    rows = [r for r in packing.pack(docs, WORDS, 2).collect() if r["doc_id"] not in (3, None)]
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    for i, t in enumerate(texts()):
        if i == 3:
            continue
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted(by[i], key=lambda r: r["start"])
        assert own[0]["start"] == 0 and all(a["start"] + a["length"] == b["start"] for a, b in zip(own, own[1:], strict=False)) and own[-1]["start"] + own[-1]["length"] == len(ids)
        for r in own:
            piece = ids[r["start"] : r["start"] + r["length"]].tobytes()
            assert r["length"] & (r["length"] - 1) == 0 and r["length"] <= 4096 and r["offset"] == 0 and (bytes(r["ids"]), r["ids_crc32"], r["doc_tokens"]) == (piece, crc32(piece), len(ids))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.token_counts(none, WORDS).count() == packing.pack(none, WORDS, 2).count() == bpe_chunks.encode_documents(none, BYTES).count() == 0


@pytest.mark.parametrize("path,suffix", [(WORDS, "</w>"), (BYTES, None)])
def test_a_token_has_one_way_to_be_made(path, suffix):
    """Every token's text, merged by ranks below its own, gives the pair of its merge and nothing else."""
    import json

    spec = json.load(open(path, encoding="utf-8"))
    ranks = engines._ranks(spec, suffix)
    table = engines._byte_of_symbol()
    raw = lambda s: bytes(table[c] for c in s[: -len(suffix)]) + b"\xff" if suffix and s.endswith(suffix) else bytes(table[c] for c in s)
    for m in spec["model"]["merges"]:
        a, b = map(raw, m.split(" ") if isinstance(m, str) else m)
        top = ranks[a + b]
        parts = [bytes([c]) for c in a + b]
        while True:
            best = min((r for x, y in zip(parts, parts[1:], strict=False) if (r := ranks.get(x + y, top)) < top), default=None)
            if best is None:
                break
            i = next(i for i in range(len(parts) - 1) if ranks.get(parts[i] + parts[i + 1]) == best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert parts == [a, b]
