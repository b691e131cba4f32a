"""Exact, fast encoders for public tokenizer files, with the library as fallback.

A byte-pair merge table whose ids follow the merge order can be run by a plain
rank-based merger: by induction over ranks the pair that makes a token is the
only pair that can ever stand for it (``tests/llm/test_tokens.py`` checks the
property for every merge of the files used).  Text outside the ranges named
below, control strings and anything unusual go through the library itself.
"""

from __future__ import annotations

import json
import re
from array import array

#: Entries in each of the two generations of a worker's cache of encoded chunks.
CACHE_ENTRIES = 150_000


class ChunkCache(dict):
    """Values of text chunks in two generations: what is used again outlives what is not."""

    def __init__(self, make, entries: int = CACHE_ENTRIES) -> None:
        super().__init__()
        self.make, self.entries, self.old = make, entries, {}

    def __missing__(self, chunk):
        value = self.old.get(chunk)
        if value is None:
            value = self.make(chunk)
        self[chunk] = value
        return value

    def age(self) -> None:
        """To be called between texts: starts a new generation when this one is full."""
        if len(self) > self.entries:
            self.old = dict(self)
            self.clear()


def _byte_of_symbol() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: visible Latin-1 as is, the rest from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    table = {chr(b): b for b in shown}
    table |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    return table


def _ranks(spec: dict, suffix: str | None) -> dict[bytes, int]:
    """Token bytes and ids; a word-end suffix is written as byte 0xFF, which UTF-8 never has."""
    table, special = _byte_of_symbol(), {t["content"] for t in spec["added_tokens"]}
    out = {}
    for token, i in spec["model"]["vocab"].items():
        if token in special:
            continue
        end = b""
        if suffix and token.endswith(suffix):
            token, end = token[: -len(suffix)], b"\xff"
        out[bytes(table[c] for c in token) + end] = i
    return out


def _merges_in_order(spec: dict, base: int) -> bool:
    vocab = spec["model"]["vocab"]
    pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
    return all(vocab.get(a + b) == base + i for i, (a, b) in enumerate(pairs))


# The split pattern of the word-level file this engine knows.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


# Letters, numbers and white space among the characters up to U+00FF, lower-cased.
_LETTERS = rb"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
_NUMBERS = rb"0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACES = rb"\t-\r \x85\xa0"


class WordEngine:
    """Lower-casing word-end BPE.

    Text up to U+00FF is always in normal form and is cut here as the file's
    pattern cuts it; other chunks between ASCII white space, which always
    separates, and those with control strings go to the library.
    """

    def __init__(self, path: str, spec: dict) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.merge = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=_ranks(spec, "</w>"), special_tokens={})._core_bpe.encode_single_piece
        self.cut = re.compile(rb"'(?:s|t|re|ve|m|ll|d)|[%b]+|[%b]|[^%b%b%b]+" % (_LETTERS, _NUMBERS, _SPACES, _LETTERS, _NUMBERS)).findall

    @staticmethod
    def knows(spec: dict) -> bool:
        n, p, m = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}, spec["model"]
        steps, cuts = n.get("normalizers") or [], p.get("pretokenizers") or []
        return (
            [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"]
            and [x["type"] for x in cuts] == ["Split", "ByteLevel"]
            and cuts[0]["pattern"] == {"Regex": WORD_PATTERN}
            and m.get("end_of_word_suffix") == "</w>"
            and not m.get("dropout")
            and all(not re.search(r"\s", t["content"]) and not (t["lstrip"] or t["rstrip"]) and "<|" in t["content"] for t in spec["added_tokens"])
            and _merges_in_order(spec, 512)
        )

    def chunks(self, text: str) -> list[bytes | str]:
        """Parts whose ids, one after another, are the text's: bytes for :meth:`merge`, else for the library."""
        if "<|" not in text:
            try:
                return self.cut(text.lower().encode("latin-1"))
            except UnicodeEncodeError:
                pass
        out: list[bytes | str] = []
        for word in text.encode().split():
            chunk = word.decode()
            try:
                out += self.cut(chunk.lower().encode("latin-1")) if "<|" not in chunk and max(chunk) <= "ÿ" else [chunk]
            except UnicodeEncodeError:
                out.append(chunk)
        return out

    def encode(self, chunk: bytes | str) -> list[int]:
        """Ids of a part made by :meth:`chunks`."""
        if isinstance(chunk, bytes):
            return self.merge((chunk if chunk.isascii() else chunk.decode("latin-1").encode()) + b"\xff")
        return self.library.encode(chunk, add_special_tokens=False).ids


class ByteEngine:
    """Byte-level BPE without normalisation, over any text."""

    def __init__(self, path: str, spec: dict) -> None:
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        ranks = _ranks(spec, None)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.ordinary = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        size = max([*ranks.values(), *self.special.values()]) + 1
        self.token: list[bytes] = [b""] * size
        for b, i in [*ranks.items(), *((s.encode(), i) for s, i in self.special.items())]:
            self.token[i] = b

    @staticmethod
    def knows(spec: dict) -> bool:
        p = spec.get("pre_tokenizer") or {}
        return (
            spec.get("normalizer") is None
            and (p.get("type"), p.get("add_prefix_space"), p.get("use_regex")) == ("ByteLevel", False, True)
            and not spec["model"].get("dropout")
            and all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in spec["added_tokens"])
            and _merges_in_order(spec, 256)
        )

    def encode(self, text: str) -> list[int]:
        """Ids of text without special strings."""
        if not text:
            return []
        try:
            return self.ordinary(text)
        except BaseException as e:  # the merger's regular expressions give up on some very long runs
            if type(e).__name__ not in ("PanicException", "ValueError", "RuntimeError"):
                raise
            return self.library.encode(text, add_special_tokens=False).ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


_LOADED: dict[str, object] = {}


def load(path: str):
    """The engine of a file, once in each worker: an engine above, or the library's own object."""
    if path not in _LOADED:
        if path.endswith(".model"):
            import sentencepiece

            _LOADED[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            kind = next((k for k in (WordEngine, ByteEngine) if spec["model"].get("type", "BPE") == "BPE" and k.knows(spec)), None)
            if kind:
                _LOADED[path] = kind(path, spec)
            else:
                from tokenizers import Tokenizer

                _LOADED[path] = Tokenizer.from_file(path)
                _LOADED[path].no_truncation()
                _LOADED[path].no_padding()
    return _LOADED[path]


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    a = array("I", ids)
    return a.tobytes()
