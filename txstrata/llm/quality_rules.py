"""Rule bitmask ledger: every rule is evaluated once and its failure kept as one bit.

:func:`ledger` measures whole texts and stores measurements and failure bits.
:func:`apply_policy` turns bits into verdicts under a versioned policy and
:func:`ablations` says, from the bits alone, what each rule of a policy changes.

Defined results: a null or empty text has no words, every measurement 0, and
fails ``few_words``.  Repeated rows are judged alike, one result each; null ids
are kept; an empty table gives an empty ledger.  Equal lines and windows are found by
hashes and compared byte by byte.  Further columns are carried
through :func:`annotate` and ignored by :func:`ledger`, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_struct, equal_spans, free_name, mix64, text_buffer, word_hashes, word_spans

# The white space that separates words.
_SPACES = b" \t\n\x0b\x0c\r"

# The symbols that count as noise.
SYMBOLS = "#*$%&|<>"

#: Rules in bit order: name and condition of failure over the measurements.
#: All are integer comparisons, so that every engine gives the same bits.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 25 * n_words"),
    ("capitals", "100 * n_upper > 50 * word_chars"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}

#: Versioned policies: the rules whose failure rejects a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "2026-1": ("few_words", "repeated_windows", "symbols", "repeated_lines", "short_words", "long_words"),
    "2026-2": tuple(BIT),
}
CURRENT = "2026-2"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper")
FIELDS = T.StructType([T.StructField(n, T.LongType()) for n in MEASURES])


def policy_mask(version: str) -> int:
    return sum(BIT[name] for name in POLICIES[version])


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def repeated(text: bytes) -> tuple[int, int]:
    """Lines equal to an earlier one, and words in repeated windows of three, without hashes of ours."""
    lines = [x for x in text.split(b"\n") if x.strip(_SPACES)]
    words = [w for w in re.split(b"[%b]+" % _SPACES, text) if w]
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    seen = Counter(windows)
    return len(lines) - len(set(lines)), len({k + j for k, w in enumerate(windows) if seen[w] > 1 for j in range(3)})


def _measurer():
    symbol = np.zeros(256, dtype=bool)
    symbol[list(SYMBOLS.encode())] = True
    inside = (np.arange(256) & 0xC0) != 0x80  # first byte of a character
    upper = np.zeros(256, dtype=bool)
    upper[65:91] = True
    space = np.zeros(256, dtype=bool)
    space[[0x20, 9, 10, 11, 12, 13]] = True
    inside &= ~space

    def measure(column: pa.Array) -> list[np.ndarray]:
        buf, bounds = text_buffer(column)
        n = len(bounds) - 1
        begin, end, doc = word_spans(buf, bounds)
        n_words = np.bincount(doc, minlength=n).astype(np.int64)
        # Lines: between line feeds and text bounds; those with a word count.
        stops = np.flatnonzero(buf == 10)
        edge = np.unique(np.concatenate([bounds, stops + 1]))
        edge = edge[edge <= len(buf)]
        lo, hi = edge[:-1], edge[1:]
        line_of_word = np.searchsorted(edge, begin, side="right") - 1
        full = np.unique(line_of_word)
        lo, hi = lo[full], hi[full]
        trimmed = hi - (buf[hi - 1] == 10)  # the line feed isn't part of the line
        line_doc = np.searchsorted(bounds, lo, side="right") - 1
        lines = np.bincount(line_doc, minlength=n).astype(np.int64)
        key = mix64(word_hashes(buf, lo, trimmed, lower=False) + mix64(line_doc.astype(np.uint64)))
        order = np.argsort(key, kind="stable")
        again = np.flatnonzero(key[order][1:] == key[order][:-1])
        x, y = order[again], order[again + 1]
        repeats = np.bincount(line_doc[y], minlength=n)
        torn = np.zeros(n, dtype=bool)  # texts in which a hash stands for two things
        torn[line_doc[y[~((line_doc[x] == line_doc[y]) & equal_spans(buf, lo[x], trimmed[x], lo[y], trimmed[y]))]]] = True
        # Three-word windows within one text.
        h = word_hashes(buf, begin, end, lower=False)
        marked = np.zeros(len(h), dtype=bool)
        if len(h) > 2:
            w = np.flatnonzero(doc[2:] == doc[:-2])
            k = mix64(mix64(mix64(h[w] + mix64(doc[w].astype(np.uint64))) + h[w + 1]) + h[w + 2])
            order = np.argsort(k)
            s = k[order]
            same = np.zeros(len(s) + 1, dtype=bool)
            same[1:-1] = s[1:] == s[:-1]
            x, y = w[order[:-1][same[1:-1]]], w[order[1:][same[1:-1]]]
            alike = doc[x] == doc[y]
            for shift in range(3):
                alike &= equal_spans(buf, begin[x + shift], end[x + shift], begin[y + shift], end[y + shift])
            torn[doc[y[~alike]]] = True
            again = w[order[same[1:] | same[:-1]]]
            for shift in range(3):
                marked[again + shift] = True
        repeat_words = np.bincount(doc[marked], minlength=n)
        for i in np.flatnonzero(torn):
            repeats[i], repeat_words[i] = repeated(buf[bounds[i] : bounds[i + 1]].tobytes())
        return [n_words, _per_text(inside[buf], bounds), _per_text(symbol[buf], bounds), lines, repeats.astype(np.int64), repeat_words.astype(np.int64), _per_text(upper[buf], bounds)]

    return measure


def failure_bits(field) -> Column:
    """Bits of all rules over measurement columns; ``field`` maps a name to its column."""
    bits = F.lit(0).cast("long")
    for name, condition in RULES:
        sql = " ".join(field(word) if word in MEASURES else word for word in condition.split())
        bits = bits.bitwiseOR(F.when(F.expr(sql), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, the measurements, and ``failures``, the bits of failed rules."""
    out = append_struct(docs.select(id_col, text_col), text_col, "m", FIELDS, _measurer, keep=[id_col])
    return out.select(id_col, "m.*", failure_bits(lambda n: f"m.{n}").alias("failures"))


def annotate(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, str]:
    """All columns of ``docs`` and a struct with the measurements; returns the struct's name too."""
    name = free_name("measured", docs.columns)
    return append_struct(docs, text_col, name, FIELDS, _measurer), name


def apply_policy(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """The ledger with ``kept``: no rule of the policy failed."""
    return rows.withColumn("kept", F.col("failures").bitwiseAND(F.lit(policy_mask(version))) == 0)


def ablations(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """For each rule of a policy: documents it fails, and those that only it rejects."""
    mask = policy_mask(version)
    hit = F.col("failures").bitwiseAND(F.lit(mask))
    sums = rows.agg(
        F.count("*").alias("n_docs"), F.bit_or(hit).alias("any_failed"),
        *[F.count_if(hit.bitwiseAND(F.lit(BIT[r])) != 0).alias(f"f_{r}") for r in POLICIES[version]],
        *[F.count_if(hit == BIT[r]).alias(f"o_{r}") for r in POLICIES[version]],
    )
    pairs = ", ".join(f"'{r}', f_{r}, o_{r}" for r in POLICIES[version])
    return sums.selectExpr(f"stack({len(POLICIES[version])}, {pairs}) AS (rule, n_failed, n_only_this)", "n_docs")


def kept_documents(docs: DataFrame, version: str = CURRENT, text_col: str = "text") -> DataFrame:
    """The documents that a policy keeps, with all their columns."""
    rows, m = annotate(docs, text_col)
    return rows.filter(failure_bits(lambda n: f"{m}.{n}").bitwiseAND(F.lit(policy_mask(version))) == 0).drop(m)
