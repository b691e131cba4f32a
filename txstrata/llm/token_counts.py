"""Token counts: Arrow batches are encoded and only lengths come back.

Batches hold about equal bytes of text.  Under a tokenizer for which white
space always separates, long texts are split at it, and the lengths of pieces
seen before come from a bounded cache; the lengths are added up.
Under other tokenizers whole texts go to the library in one call a batch.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows
give one row each; null ids are kept; an empty table gives none; further
columns are ignored.  Very long texts are handled ``SPLIT_CHARS`` at a time.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_struct
from .engines import ChunkCache, WordEngine, load

#: A longer text is split at white space into parts of about so many characters.
SPLIT_CHARS = 1 << 19

# ASCII white space.
WHITE = " \n\t\r\v\f"

FIELDS = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])


def safe_parts(text: str, size: int = SPLIT_CHARS):
    """Parts of about ``size`` characters, cut at ASCII white space only."""
    i = 0
    while len(text) - i > size:
        j = max(text.rfind(c, i + 1, i + size) for c in WHITE)
        if j < 0:
            j = min((k for c in WHITE if (k := text.find(c, i + size)) >= 0), default=len(text))
        yield text[i:j]
        i = j
    yield text[i:]


_CACHES: dict[str, ChunkCache] = {}


def counter(path: str):
    """A function from an Arrow column of texts to their byte and token counts."""
    engine = load(path)
    if isinstance(engine, WordEngine):
        cache = _CACHES.setdefault(path, ChunkCache(lambda chunk: len(engine.encode(chunk))))

        def count(column: pa.Array):
            sizes, totals = [], []
            for text in column.to_pylist():
                text = text or ""
                n = 0
                for part in safe_parts(text):
                    n += sum(map(cache.__getitem__, engine.chunks(part)))
                    cache.age()
                totals.append(n)
                sizes.append(len(text.encode()))
            return [pa.array(sizes, pa.int64()), pa.array(totals, pa.int64())]

        return count

    if hasattr(engine, "encode_batch_fast"):
        lengths = lambda texts: [len(e) for e in engine.encode_batch_fast(texts, add_special_tokens=False)]
    elif hasattr(engine, "library"):
        lengths = lambda texts: [len(e) for e in engine.library.encode_batch_fast(texts, add_special_tokens=False)]
    else:
        lengths = lambda texts: [len(x) for x in engine.encode(texts, num_threads=1)]

    def count(column: pa.Array):
        texts = [t if t is not None else "" for t in column.to_pylist()]
        return [pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(lengths(texts), pa.int64())]

    return count


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``n_bytes``, ``n_tokens`` and ``over_limit`` of every document under the file ``tokenizer``."""
    rows = append_struct(docs.select(id_col, text_col), text_col, "c", FIELDS, lambda: counter(tokenizer), keep=[id_col])
    return rows.select(id_col, "c.*", (F.col("c.n_tokens") > limit).alias("over_limit"))
