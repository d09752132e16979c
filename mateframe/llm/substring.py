"""Substring dedup over words: FM-index per shard, matching statistics by backward search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table
from .fmindex import repeated
from .repeats import covered, spans_of, text_key
from .words import WordHashes

WINDOW, GRAM = 35, 8
RANGES = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))


def word_cutter():
    def cut(text: str | None):
        words = (text or "").encode("utf-8", "surrogatepass").split()
        return lambda a, b: b" ".join(words[a:b])

    return cut


def find(window: int = WINDOW):
    """Which windows of a shard's sequences occur twice or more, by the shard's FM-index."""

    def of(data: list[bytes]) -> list[np.ndarray]:
        ids: dict[bytes, int] = {}
        parts = [[ids.setdefault(w, len(ids) + 1) for w in d.split()] for d in data]
        lengths = np.array([len(p) for p in parts], np.int64)
        begin = np.cumsum(lengths + 1) - lengths - 1
        x = np.zeros(int((lengths + 1).sum()), np.int64)
        for b, p in zip(begin, parts, strict=True):
            x[b : b + len(p)] = p
        hit = repeated(x, begin, begin + lengths, window)
        return [hit[b : b + n - window + 1] for b, n in zip(begin, lengths, strict=True)]

    return of


def dedup(docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Remove every word covered by a window of ``window`` words that also starts elsewhere.

    ``docs`` is (doc_id, text, any others). Adds ``kept`` (the words left, joined by one space),
    ``n_words``, ``n_removed`` and ``removed``, ranges of word numbers. Windows are judged on the
    input. Null and empty texts have no words; texts shorter than a window lose none; repeated
    rows lose all their windows; ids may be null or repeat.
    """
    rows = docs.withColumn("__k", text_key(F.col("text")))
    spans = spans_of(rows.select(F.col("__k").alias("key"), "text"), window=window, gram=gram, symbols=WordHashes, cut=word_cutter, find=find(window), places=4, shard_symbols=400_000)
    spans = spans.select(F.col("key").alias("__s"), F.col("spans").alias("__spans"))
    names = [c for c in docs.columns if c not in ("kept", "n_words", "n_removed", "removed")]  # a column of such a name is replaced
    joined = rows.hint("merge").join(spans.hint("merge"), F.col("__k") == F.col("__s"), "left").select(*names, F.col("text").alias("__text"), "__spans")
    schema = joined.select(*names).schema.add("kept", "string").add("n_words", "long").add("n_removed", "long").add("removed", RANGES)

    def clean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                kept, n_words, n_removed, removed = [], [], [], []
                for text, spans in zip(part.column(len(names)).to_pylist(), part.column(len(names) + 1).to_pylist(), strict=True):
                    words = (text or "").encode("utf-8", "surrogatepass").split()
                    gone, left, end = covered(spans, window, len(words)), [], 0
                    for a, b in gone:
                        left += words[end:a]
                        end = b
                    left += words[end:]
                    kept.append(b" ".join(left).decode("utf-8", "surrogatepass"))
                    n_words.append(len(words))
                    n_removed.append(len(words) - len(left))
                    removed.append([{"start": a, "stop": b} for a, b in gone])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(kept, pa.string()), pa.array(n_words), pa.array(n_removed), pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))], [*names, "kept", "n_words", "n_removed", "removed"])

    return joined.mapInArrow(clean, schema)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT r, unnest(range(0, len(w) - {WINDOW - 1})) AS s FROM d WHERE len(w) >= {WINDOW}),
key AS (SELECT win.r, s, md5(array_to_string(w[s + 1 : s + {WINDOW}], ' ')) AS k FROM win JOIN d ON win.r = d.r),
dup AS (SELECT r, s FROM key WHERE k IN (SELECT k FROM key GROUP BY k HAVING count(*) > 1)),
gone AS (SELECT DISTINCT r, s + o AS p FROM dup, range(0, {WINDOW}) t(o)),
word AS (SELECT r, unnest(w) AS x, unnest(range(0, len(w))) AS p FROM d),
left_ AS (SELECT word.r, string_agg(x, ' ' ORDER BY p) AS kept, count(*) AS n FROM word ANTI JOIN gone ON word.r = gone.r AND word.p = gone.p GROUP BY word.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN left_ ON d.r = left_.r
"""
