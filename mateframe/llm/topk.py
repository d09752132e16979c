"""Exact top-k by inner product with block-at-a-time pruning.

Components are terms. Vectors are cut into blocks, each a range of an order that keeps similar
vectors together (their signs on the leading components). A block keeps its forward index (the
integer vectors) and, per term, its largest and smallest value. For a query the sum over terms
of ``max(q * largest, q * smallest)`` bounds every score in the block from above. Blocks are
visited in the order of that bound, and a query is done when the next bound is below its k-th
score so far.

Spark runs it in two rounds over tiles of (query block, document block). A plan works out bounds,
for groups of block summaries, and names tiles only: in the first round, for every query block,
the few document blocks with the highest bounds, whose scores give each query a k-th; in the
second, all other tiles with a query whose bound reaches its k-th. A task gets a query block and
a bounded chunk of its tiles, visits them in the order of their bounds, raises each query's k-th as
it goes, and gives back only scores that reach it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

K = 20
#: Vectors of a document block and queries of a query block.
BLOCK, QUERIES = 2048, 512
#: Document blocks that each query block scores in the first round.
FIRST = 4
#: Block summaries in a group of the plan, and document blocks in a chunk that one task visits.
GROUP, CHUNK = 64, 16


def quantize(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, x array<long>) of the vectors that take part: not null, all components finite.

    ``floor(scale * component)``; vectors of other lengths than the longest count as filled up with zeros.
    """
    x = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * scale)).alias("x"))


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return out


def _scores(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Integer inner products; in doubles where those are exact."""
    q, d = q.astype(np.int64, copy=False), d.astype(np.int64, copy=False)
    most = float(np.abs(q).max(initial=0)) * float(np.abs(d).max(initial=0)) * q.shape[1]
    if most < 2**24:
        return (q.astype(np.float32) @ d.astype(np.float32).T).astype(np.int64)
    return (q.astype(np.float64) @ d.astype(np.float64).T).astype(np.int64) if most < 2**53 else q @ d.T


def _best(k: int, ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Places of the k highest scores of one query, ties to the smaller id."""
    if len(ids) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
    else:
        near = np.arange(len(ids))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def _bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Upper bound of each query's score in each block, never too low."""
    q = q.astype(np.float64)
    bound = np.maximum(q, 0) @ high.astype(np.float64).T + np.minimum(q, 0) @ low.astype(np.float64).T  # (query, block)
    return bound + np.abs(bound) * 1e-9


def _pack(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _unpack(raw: bytes, width: int, dtype: str = "int64") -> np.ndarray:
    return np.frombuffer(raw, dtype).reshape(-1, width)


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int = K, block: int = BLOCK, query_block: int = QUERIES, first: int = FIRST) -> DataFrame:
    """The ``k`` rows of ``vectors`` with the highest inner product for each row of ``queries``.

    Both are (vec_id, x array<long>). A query's own vec_id is no candidate. Ties go to the
    smaller vec_id; a query with fewer candidates gets all of them, an empty table gives no rows.
    Rows that repeat a vec_id are candidates each; as queries they count once, with the smallest x.
    """
    spark = vectors.sparkSession
    largest = lambda df: df.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("w"), F.max(F.array_max(F.transform("x", F.abs))).alias("top")).first()
    # numbers of rows are written, so that a task that runs again finds the same ones
    vectors = stored(vectors.select("vec_id", "x", F.monotonically_increasing_id().alias("__row")), "topk-vectors")
    queries = queries.groupBy("vec_id").agg(F.min("x").alias("x")).withColumn("__row", F.lit(0))
    found, asked = largest(vectors), largest(queries)
    n, n_queries = found["n"], asked["n"]
    width = max(found["w"] or 0, asked["w"] or 0, 1)
    dtype = "int16" if max(found["top"] or 0, asked["top"] or 0) < 1 << 15 else "int64"
    out = "query_id long, rank int, vec_id long, score long"
    if not n or not n_queries:
        return spark.createDataFrame([], out)
    # similar vectors get near keys: signs of the leading components, then the id
    signs = F.aggregate(F.slice("x", 1, 12), F.lit(0).cast("long"), lambda a, v: a * 2 + F.when(v > 0, 1).otherwise(0))
    n_blocks, n_query_blocks = math.ceil(n / block), math.ceil(n_queries / query_block)

    def gather(key: str, with_bounds: bool):
        def blocks(pdf: pd.DataFrame) -> pd.DataFrame:
            m = _matrix(pdf["x"], width)
            row = {key: [int(pdf[key].iloc[0])], "ids": [_pack(pdf["vec_id"].to_numpy())], "m": [_pack(m.astype(dtype))]}
            if with_bounds:
                row |= {"high": [_pack(m.max(axis=0))], "low": [_pack(m.min(axis=0))]}
            return pd.DataFrame(row)

        return blocks

    # ranges of the order, split further by id where many vectors are alike, and by row where they share an id
    in_ranges = lambda df, parts, name: df.withColumn("__sign", signs).repartitionByRange(parts, "__sign", "vec_id", "__row").withColumn(name, F.spark_partition_id().cast("long")).select(name, "vec_id", "x")
    docs = stored(in_ranges(vectors, n_blocks, "block").groupBy("block").applyInPandas(gather("block", True), "block long, ids binary, m binary, high binary, low binary"), "topk-blocks")
    asks = stored(in_ranges(queries, n_query_blocks, "qblock").groupBy("qblock").applyInPandas(gather("qblock", False), "qblock long, ids binary, m binary"), "topk-queries")

    # bounds: summaries of document blocks, in groups of their own tasks, against each query block
    groups = max(1, math.ceil(n_blocks / GROUP))
    summary = docs.select(F.pmod("block", F.lit(groups)).alias("g"), "block", "high", "low").groupBy("g").agg(F.sort_array(F.collect_list(F.struct("block", "high", "low"))).alias("all"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))

    def plan(asks: DataFrame, best: int | None) -> DataFrame:
        """Tiles (qblock, block, most): the ``best`` of each group, or all that a query still needs."""

        def tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for r in pdf.itertuples():
                    high = np.stack([_unpack(b["high"], width)[0] for b in r.all])
                    low = np.stack([_unpack(b["low"], width)[0] for b in r.all])
                    bound = _bounds(_unpack(r.m, width, dtype), high, low)
                    most = np.ceil(bound.max(axis=0)).astype(np.int64)
                    keep = np.argsort(-most, kind="stable")[:best] if best else np.flatnonzero((np.ceil(bound) >= _unpack(r.kth, 1)).any(axis=0))
                    yield pd.DataFrame({"qblock": r.qblock, "block": [r.all[i]["block"] for i in keep], "most": most[keep]})

        both = asks.withColumn("g", every).join(summary.hint("shuffle_hash"), "g")
        return both.select("qblock", "m", "kth", "all").mapInPandas(tiles, "qblock long, block long, most long")

    def visit(pdf: pd.DataFrame) -> pd.DataFrame:
        """Best k of each query in a chunk of document blocks, from the highest bound down."""
        pdf = pdf.sort_values(["most", "block"], ascending=[False, True])
        top = pdf.iloc[0]
        q_ids, q = _unpack(top["q_ids"], 1)[:, 0], _unpack(top["q"], width, dtype)
        least = np.iinfo(np.int64).min
        kth = _unpack(top["kth"], 1)[:, 0].copy() if top["kth"] is not None else np.full(len(q_ids), least)
        held: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(q_ids)
        for r in pdf.itertuples():
            bound = np.ceil(_bounds(q, _unpack(r.high, width), _unpack(r.low, width)))[:, 0]
            rows = np.flatnonzero(bound >= kth)
            if not len(rows):
                continue
            ids = _unpack(r.ids, 1)[:, 0]
            for i, s in zip(rows.tolist(), _scores(q[rows], _unpack(r.m, width, dtype)), strict=True):
                good = np.flatnonzero((s >= kth[i]) & (ids != q_ids[i]))
                if not len(good):
                    continue
                old_ids, old = held[i]
                new_ids, new = np.concatenate([old_ids, ids[good]]), np.concatenate([old, s[good]])
                best = _best(k, new_ids, new)
                held[i] = new_ids[best], new[best]
                if len(best) == k:
                    kth[i] = max(kth[i], new[best[-1]])
        sizes = [len(i) for i, _ in held]
        return pd.DataFrame({"qblock": int(top["qblock"]), "query_id": np.repeat(q_ids, sizes), "vec_id": np.concatenate([i for i, _ in held]), "score": np.concatenate([s for _, s in held])})

    def visited(tiles: DataFrame, asks: DataFrame, chunks: int) -> DataFrame:
        """Each tile gets its document block and its chunk the query block, by shuffles; then a task a chunk."""
        left = tiles.join(docs.hint("merge"), "block").withColumn("chunk", F.pmod(F.xxhash64("block"), F.lit(chunks)))
        both = left.join(asks.select("qblock", F.col("ids").alias("q_ids"), F.col("m").alias("q"), "kth").hint("merge"), "qblock")
        return both.groupBy("qblock", "chunk").applyInPandas(visit, "qblock long, query_id long, vec_id long, score long")

    begin = asks.withColumn("kth", F.lit(None).cast("binary"))
    ranked = plan(begin, first).withColumn("__r", F.row_number().over(Window.partitionBy("qblock").orderBy(F.desc("most"), "block")))
    seeds = stored(ranked.where(F.col("__r") <= first).drop("__r"), "topk-first-tiles")
    one = stored(visited(seeds, begin, 1), "topk-first")

    # k-th score so far of every query, in the order of its block's ids
    best_so_far = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = one.withColumn("__r", F.row_number().over(best_so_far)).where(F.col("__r") == k).select("qblock", "query_id", "score")

    def thresholds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        least = np.iinfo(np.int64).min
        for pdf in batches:
            known = [{e["query_id"]: e["score"] for e in known} if known is not None else {} for known in pdf["known"]]
            kths = [_pack(np.array([of.get(i, least) for i in _unpack(ids, 1)[:, 0].tolist()], np.int64)) for of, ids in zip(known, pdf["ids"], strict=True)]
            yield pdf[["qblock", "ids", "m"]].assign(kth=kths)

    # no more entries than a block has queries
    known = kth.groupBy("qblock").agg(F.collect_list(F.struct("query_id", "score")).alias("known"))
    with_kth = stored(asks.join(known.hint("merge"), "qblock", "left").select("qblock", "ids", "m", "known").mapInPandas(thresholds, "qblock long, ids binary, m binary, kth binary"), "topk-kth")
    rest = stored(plan(with_kth, None).join(seeds.select("qblock", "block").hint("merge"), ["qblock", "block"], "left_anti"), "topk-tiles")
    two = visited(rest, with_kth, max(1, math.ceil(n_blocks / CHUNK)))
    final = one.unionByName(two).withColumn("rank", F.row_number().over(best_so_far)).where(F.col("rank") <= k)
    return final.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantize(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(list_zip(q.x, d.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
