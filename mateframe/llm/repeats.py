"""Windows that repeat anywhere in a corpus: the frame of both substring operators.

1. Every text is cut into segments (see ``segments``); a segment is (minimizer, content hash).
2. Spark counts minimizers. One seen once holds no repeat. One whose segments are all equal
   repeats as a whole. Only minimizers with different segments go on.
3. Of those, each different segment is fetched once from its text and sent to a shard by its
   minimizer, so all windows that could be equal meet. A minimizer with very many different
   segments is split: equal windows also agree in the minimizer's place inside them, so windows
   travel in groups by that place. Beyond a second bound no bytes travel: Spark counts the hashes
   of that minimizer's windows.
4. A shard function finds the windows that occur twice or more in the shard.
5. Marked windows return to all texts that hold the segment, by joins on the segment's key.

Equal texts have one key, their hash: their marks are made distinct before they are gathered, so
a text that repeats very often costs as much as its rows. Hot keys: equal segments are counted
before they move; totals by a key are written before rows join them on that key, so that
adaptive execution can split a hot key's rows; shards have a bounded share of the work. Segments
and lone windows count as equal if two 64-bit hashes of theirs are (of the minimizer and of the
content), texts if their 128-bit digests are; bytes are compared inside the shards only.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .segments import Segmenter, mix
from .words import parts

#: Different segments of a minimizer above which its windows travel by their place around it,
#: and above which only hashes of its windows travel.
HOT, HOTTER = 1000, 200_000
#: The least number of shards.
SHARDS = 32


def text_key(text: Column) -> Column:
    """What rows with equal texts have in common: 128 bits, so that no two of 10^10 different texts are likely to share them (1e-19)."""
    return F.unhex(F.md5(text.cast("binary")))


def spans_of(docs: DataFrame, *, window: int, gram: int, symbols: Callable[[], Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]], cut: Callable[[], Callable[[str | None], Callable[[int, int], bytes]]], find: Callable[[list[bytes]], list[np.ndarray]], places: int, shard_symbols: int) -> DataFrame:
    """(key, spans) of the texts that hold repeated windows; ``docs`` is (key, text), ``key`` being ``text_key``.

    ``symbols`` makes a reader of columns of texts as 64-bit symbol hashes, ``cut`` one that gives the bytes
    of symbols a to b, ``find`` tells for each of a shard's byte strings which of its windows
    occur more than once in the shard. ``places`` is the number of places around a hot minimizer
    that travel together, ``shard_symbols`` what a shard holds on average. ``spans`` are ranges of
    window starts, end exclusive.
    """

    def segment(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = segmenter = None
        for batch in batches:
            reader, segmenter = reader or symbols(), segmenter or Segmenter(window, gram)
            for part in parts(batch, 1, 1 << 20):
                keys = part.column(0)
                edges, x = reader(part.column(1))
                for owner, start, n, mini, seg in segmenter.segments([x[a:b] for a, b in zip(edges[:-1], edges[1:])]):
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(owner)), pa.array(start), pa.array(n.astype(np.int32)), pa.array(mini), pa.array(seg)], ["key", "start", "n", "mini", "seg"])

    segments = stored(docs.select("key", "text").mapInArrow(segment, "key binary, start long, n int, mini long, seg long"), "segments")
    minis = segments.groupBy("mini").agg(F.count("*").alias("c"), F.min("seg").alias("a"), F.max("seg").alias("b")).where("c > 1")
    minis = stored(minis.select("mini", F.expr("a = b").alias("same")), "repeated-minimizers")
    again = stored(segments.join(minis.hint("merge"), "mini"), "repeated-segments")

    mixed = again.where("NOT same")
    kinds = stored(mixed.groupBy("mini", "seg").agg(F.count("*").alias("times"), F.min(F.struct("key", "start", "n")).alias("r")), "kinds-of-segments")
    hot = kinds.groupBy("mini").agg(F.count("*").alias("kinds")).where(F.col("kinds") > HOT).select("mini", F.when(F.col("kinds") > HOTTER, 2).otherwise(1).alias("hot"))
    wanted = kinds.join(stored(hot, "hot-minimizers").hint("merge"), "mini", "left").select(
        F.col("r.key").alias("__key"), F.struct("mini", "seg", "r.start", "r.n", "times", F.coalesce("hot", F.lit(0)).alias("hot")).alias("w")
    )
    # no more segments than the text has windows
    by_text = stored(wanted.groupBy("__key").agg(F.collect_list("w").alias("ws")), "wanted-segments")

    def fetch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = reader = segmenter = None
        names = ["route", "mini", "seg", "at", "times", "size", "data"]
        kinds_ = [pa.int64()] * 6 + [pa.binary()]
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                part, out = batch.slice(at, 16), []
                for text, ws in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    cutter = cutter or cut()
                    slices, xs = cutter(text), None
                    for w in ws:
                        if not w["hot"]:
                            out.append((w["mini"], w["mini"], w["seg"], 0, w["times"], w["n"] + window - 1, slices(w["start"], w["start"] + w["n"] + window - 1)))
                            continue
                        reader, segmenter = reader or symbols(), segmenter or Segmenter(window, gram)
                        xs = reader(pa.array([text], pa.string()))[1] if xs is None else xs
                        prefix = segmenter.prefix(xs[w["start"] : w["start"] + w["n"] + window - 1])
                        if w["hot"] == 2:
                            routes = segmenter.hashes(prefix, np.arange(w["n"]), window).view(np.int64)
                            out += [(route, w["mini"], w["seg"], i, w["times"], 0, None) for i, route in enumerate(routes.tolist())]
                            continue
                        place = int(segmenter.hashes(prefix, np.arange(window - gram + 1), gram).argmin())
                        group = (place - np.arange(w["n"])) // places
                        begin = np.flatnonzero(np.diff(group, prepend=group[0] + 1))
                        routes = mix(np.uint64(w["mini"] & (1 << 64) - 1) + group[begin].astype(np.uint64)).view(np.int64)
                        for i, j, route in zip(begin.tolist(), [*begin[1:].tolist(), w["n"]], routes.tolist(), strict=True):
                            out.append((route, w["mini"], w["seg"], i, w["times"], j - i + window - 1, slices(w["start"] + i, w["start"] + j + window - 1)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds_, strict=True)], names)

    # of equal texts one is read; copies fall together within each task before they move
    texts = docs.select("key", "text").dropDuplicates(["key"]).hint("merge").join(by_text.hint("merge"), F.col("key") == F.col("__key")).select("text", "ws")
    pieces = stored(texts.mapInArrow(fetch, "route long, mini long, seg long, at long, times long, size long, data binary"), "pieces")
    shards = SHARDS + math.ceil((pieces.agg(F.sum("size")).first()[0] or 0) / shard_symbols)

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["mini", "seg", "at"], kind="stable")
        rows = []
        for r, marks in zip(pdf.itertuples(), find(pdf["data"].tolist()), strict=True):
            marks = np.ones_like(marks) if r.times > 1 else marks
            edges = np.flatnonzero(np.diff(np.concatenate([[False], marks, [False]]).astype(np.int8)))
            rows += [(r.mini, r.seg, r.at + int(a), r.at + int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True)]
        return pd.DataFrame(rows, columns=["mini", "seg", "a", "b"]).astype("int64")

    routed = pieces.where("data IS NOT NULL").withColumn("shard", F.pmod(F.xxhash64("route"), F.lit(shards)))
    in_shards = stored(routed.groupBy("shard").applyInPandas(shard, "mini long, seg long, a long, b long"), "marks")
    # windows of the hottest minimizers: hashes are counted before they move
    alone = pieces.where("data IS NULL").select("mini", "seg", "at", "times", "route")
    often = stored(alone.groupBy("mini", "route").agg(F.sum("times").alias("n")).where("n > 1").select("mini", "route"), "repeated-windows")
    counted = alone.join(often.hint("merge"), ["mini", "route"]).select("mini", "seg", F.col("at").alias("a"), (F.col("at") + 1).alias("b"))
    found = stored(in_shards.unionByName(counted).groupBy("mini", "seg").agg(F.collect_list(F.struct("a", "b")).alias("marks")), "marks-by-segment")
    whole = again.where("same").select("key", "start", (F.col("start") + F.col("n")).alias("stop"))
    partly = mixed.join(found.hint("merge"), ["mini", "seg"]).select("key", "start", F.explode("marks").alias("m"))
    partly = partly.select("key", (F.col("start") + F.col("m.a")).alias("start"), (F.col("start") + F.col("m.b")).alias("stop"))
    # equal texts give equal marks, which fall together before they move
    spans = whole.unionByName(partly).distinct().groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return stored(spans, "spans")


def covered(spans: list | None, window: int, n: int) -> list[tuple[int, int]]:
    """Maximal ranges of symbols that the windows starting in ``spans`` cover."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["start"], min(s["stop"] + window - 1, n)) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out
