"""Suffix-array dedup over bytes by prefix doubling.

The frame in ``repeats`` ranks positions by their first 32 bytes across the corpus (minimizers)
and drops unique ones; Spark sorts and counts these ranks. What is left is ranked on inside
shards that share no window: a position's rank at length 2k is the pair of the ranks at length k
of itself and of the position k further on. Pairs are sorted, positions with a pair of their own
leave, and the rest go on with doubled offset until the length passes the threshold.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table
from .repeats import covered, spans_of, text_key
from .segments import mix, symbol_hashes
from .words import ByteHashes

WINDOW, GRAM = 200, 32
RANGES = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))


def byte_cutter():
    def cut(text: str | None):
        raw = (text or "").encode("utf-8", "surrogatepass")
        return lambda a, b: raw[a:b]

    return cut


def find(window: int = WINDOW):
    """Which windows of a shard's byte strings occur twice or more, by prefix doubling."""

    def of(data: list[bytes]) -> list[np.ndarray]:
        x = np.frombuffer(b"".join(data), np.uint8)
        lengths = np.array([len(d) for d in data], np.int64)
        begin = np.cumsum(lengths) - lengths
        starts = [np.arange(b, b + max(n - window + 1, 0)) for b, n in zip(begin, lengths, strict=True)]
        live = np.concatenate(starts) if starts else np.empty(0, np.int64)
        # ranks are named by 64-bit hashes, so that each is known without its neighbours in the order
        rank, k = symbol_hashes(256, 6)[x], 1
        while k < window and len(live):
            step = min(k, window - k)
            pair = rank[: len(rank) - step] * np.uint64(0xC2B2AE3D27D4EB4F) + rank[step:]
            rank, k = mix(pair), k + step
            if k >= 32:
                own = rank[live]
                order = np.argsort(own)
                same = np.diff(own[order]) == 0
                live = live[order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]]
        hit = np.zeros(len(x) + 1, bool)
        hit[live] = True
        return [hit[b : b + max(n - window + 1, 0)] for b, n in zip(begin, lengths, strict=True)]

    return of


def dedup(docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Remove every byte covered by a string of ``window`` bytes that also starts elsewhere.

    ``docs`` is (doc_id, text, any others). Adds ``kept`` (binary: what is left, joined),
    ``n_bytes``, ``n_removed`` and ``removed``, the maximal removed ranges. Strings are judged on
    the input and never cross texts. Null counts as empty; texts shorter than a window lose
    nothing; repeated rows of that length lose all; ids may be null or repeat.
    """
    rows = docs.withColumn("__k", text_key(F.col("text")))
    spans = spans_of(rows.select(F.col("__k").alias("key"), "text"), window=window, gram=gram, symbols=ByteHashes, cut=byte_cutter, find=find(window), places=16, shard_symbols=2_000_000)
    spans = spans.select(F.col("key").alias("__s"), F.col("spans").alias("__spans"))
    names = [c for c in docs.columns if c not in ("kept", "n_bytes", "n_removed", "removed")]  # a column of such a name is replaced
    joined = rows.hint("merge").join(spans.hint("merge"), F.col("__k") == F.col("__s"), "left").select(*names, F.col("text").alias("__text"), "__spans")
    schema = joined.select(*names).schema.add("kept", "binary").add("n_bytes", "long").add("n_removed", "long").add("removed", RANGES)

    def clean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                kept, n_bytes, n_removed, removed = [], [], [], []
                for text, spans in zip(part.column(len(names)).to_pylist(), part.column(len(names) + 1).to_pylist(), strict=True):
                    raw = (text or "").encode("utf-8", "surrogatepass")
                    gone = covered(spans, window, len(raw))
                    edges = [0, *[e for g in gone for e in g], len(raw)]
                    kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                    n_bytes.append(len(raw))
                    n_removed.append(len(raw) - len(kept[-1]))
                    removed.append([{"start": a, "stop": b} for a, b in gone])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(kept, pa.binary()), pa.array(n_bytes), pa.array(n_removed), pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))], [*names, "kept", "n_bytes", "n_removed", "removed"])

    return joined.mapInArrow(clean, schema)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
