"""Benchmark decontamination by spaced seeds, with SQL functions only.

An item and a document are compared along a diagonal, on which every word of the item has its
place in the document. A pair counts when, in some window of ``WIDTH`` words of the item (or the
whole item, if shorter), at least ``SIMILAR`` of the words agree.

Candidates come from spaced seeds: a fixed mask names some of the places of a short span, the
words at these places are hashed and those in between are ignored. The masks for windows of ``w``
words of which ``m`` may differ are chosen so that for each of the ``C(w, m)`` sets of differing
words some mask stands clear of them somewhere in the window. So every pair that counts shares a
seed, on the diagonal that counts, whichever words differ; masks are few, and of as many words as that allows,
because seeds of few words also meet by chance.
"""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

WIDTH, SIMILAR = 20, 0.75
#: Words hashed by a mask at most, its span at most, and masks of one family at most.
WEIGHT, SPAN, MASKS = 5, 12, 3
#: Windows from this length on share one family of masks.
LONG = 15
#: Sets of differing words up to which masks are searched; beyond it one mask of adjoining words is taken.
SETS = 200_000
#: Words are runs of letters and digits, lower-cased.
TOKEN = r"[\p{L}\p{N}]+"
#: A benchmark of at most so many seeds (about 32 bytes each) is broadcast; a larger one is shuffled.
BROADCAST_SEEDS = 500_000


def missed(mask: tuple[int, ...], width: int, differing: np.ndarray) -> np.ndarray:
    """Which sets of differing words (as bits) spoil a mask wherever it stands in the window."""
    bits = sum(1 << p for p in mask)
    return np.all([(differing & (bits << at)) != 0 for at in range(width - mask[-1])], axis=0)


def differing_sets(width: int, other: int) -> np.ndarray:
    """All sets of ``other`` of ``width`` words, as bits."""
    return np.array([sum(1 << p for p in c) for c in itertools.combinations(range(width), other)], np.int64)


@functools.cache
def masks(cases: tuple[tuple[int, int], ...]) -> tuple[tuple[int, ...], ...]:
    """Masks for windows of w words of which m may differ, for all (w, m) in ``cases`` at once.

    Of each weight, from the largest down, masks are picked greedily, those that stand clear of
    most sets left first, until none is left. A mask of ``w div (m + 1)`` adjoining words always
    does, as m words can't break a window into pieces that are all shorter.
    """
    least = min(w // (m + 1) for w, m in cases)
    if max(math.comb(w, m) for w, m in cases) > SETS:
        return (tuple(range(least)),)
    sets = [(w, differing_sets(w, m)) for w, m in cases]
    for weight in range(min(WEIGHT, *(w - m for w, m in cases)), least, -1):
        span = min(SPAN, *(w for w, _ in cases))
        every = [(0, *c) for c in itertools.combinations(range(1, span), weight - 1)]
        spoilt = np.array([np.concatenate([missed(mask, w, s) for w, s in sets]) for mask in every])
        left, found = np.ones(spoilt.shape[1], bool), []
        while left.any() and len(found) < MASKS:
            best = int(spoilt[:, left].sum(axis=1).argmin())
            found.append(every[best])
            left &= spoilt[best]
        if not left.any():
            return tuple(found)
    return (tuple(range(least)),)


def tokens(text: Column) -> Column:
    """Hashes of the words of a text; null has none."""
    return F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0)), lambda w: F.xxhash64(w))


def seeds(h: Column, mask: tuple[int, ...]) -> Column:
    """Array of (pos, seed) over all places of a mask in an array of word hashes."""
    found = F.transform(F.sequence(F.lit(0), F.size(h) - (mask[-1] + 1)), lambda i: F.struct(i.alias("pos"), F.xxhash64(F.lit(str(mask)), *[F.get(h, i + o) for o in mask]).alias("seed")))
    return F.when(F.size(h) > mask[-1], found).otherwise(_none())


def _none() -> Column:
    return F.array().cast("array<struct<pos:int,seed:bigint>>")


def row_key(doc_id: Column, text: Column) -> Column:
    """What rows of one id and text have in common, in 128 bits: a clash would make a clean document share a dirty one's lot."""
    return F.unhex(F.md5(F.concat_ws("\0", F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))).cast("binary")))


def contaminated(docs: DataFrame, benchmark: DataFrame, *, width: int = WIDTH, similar: float = SIMILAR, key: Column | None = None) -> DataFrame:
    """(key, doc_id, item_id, width, matched) of documents that hold a passage of an item.

    ``matched`` is the largest number of agreeing words in a window of ``width``. Texts and items
    without a word match nothing; short ones follow the same rule as long ones (of up to three
    words all must agree). Rows with the same id and text give one result; a null doc_id is kept
    as null; rows of the benchmark that share an item_id are items each, of which the best counts; those without one are left out.
    Every place of every text is hashed, with each mask that the items ask for. Benchmark items
    are few, so their seeds are broadcast up to a checked number, and shuffled beyond it.
    """
    if width > 62:
        raise ValueError("windows have 62 words at most")
    key = row_key(F.col("doc_id"), F.col("text")) if key is None else key
    items = benchmark.where("item_id IS NOT NULL").select("item_id", tokens(F.col("text")).alias("item"))
    items = items.withColumn("wide", F.least(F.size("item"), F.lit(width))).where("wide > 0")
    items = items.withColumn("other", F.col("wide") - F.ceil(F.col("wide") * similar).cast("int"))
    items = stored(items.withColumn("row", F.xxhash64("item_id", "item")), "benchmark-words")
    # at most ``width`` different lengths
    cases = sorted((r["wide"], r["other"]) for r in items.select("wide", "other").distinct().collect())
    together = tuple(c for c in cases if c[0] >= LONG)
    families = {c: masks(together if c in together else (c,)) for c in cases}
    every = sorted({m for f in families.values() for m in f})
    own = [F.when(functools.reduce(lambda a, b: a | b, [F.col("wide") == w for (w, _), f in families.items() if m in f]), seeds(F.col("item"), m)).otherwise(_none()) for m in every]
    theirs = items.select("item_id", "row", (F.col("other") == 0).alias("whole"), F.explode(F.flatten(F.array(*own) if own else F.array(_none()))).alias("s"))
    theirs = stored(theirs.select("item_id", "row", "whole", F.col("s.pos").alias("at"), F.col("s.seed").alias("seed")).distinct(), "benchmark-seeds")
    small = theirs.count() <= BROADCAST_SEEDS
    words = docs.select(key.alias("key"), tokens(F.col("text")).alias("h"))
    placed = words.select("key", F.explode(F.concat(*[seeds(F.col("h"), m) for m in every]) if every else _none()).alias("s")).select("key", "s.pos", "s.seed")
    hits = placed.join(theirs.hint("broadcast" if small else "merge"), "seed").withColumn("place", F.col("pos") - F.col("at"))
    # where no word may differ a hit is the whole passage, and one diagonal tells as much as all
    diagonals = hits.groupBy("key", "item_id", "row", F.when(~F.col("whole"), F.col("place")).alias("of")).agg(F.min("place").alias("diagonal"))
    # no more diagonals than the text and the item have words
    pairs = stored(diagonals.groupBy("key", "item_id", "row").agg(F.collect_list("diagonal").alias("diagonals")).withColumnRenamed("key", "__key"), "benchmark-hits")
    texts = docs.select(key.alias("key"), "doc_id", "text").join(pairs.select("__key").distinct().hint("merge"), F.col("key") == F.col("__key"), "left_semi")
    # split into words once, not again for each item
    texts = stored(texts.dropDuplicates(["key", "doc_id"]).select("key", "doc_id", tokens(F.col("text")).alias("h")), "benchmark-texts")
    found = pairs.join(items.select("item_id", "row", "item", "wide").dropDuplicates(["item_id", "row"]).hint("broadcast" if small else "merge"), ["item_id", "row"])
    rows = texts.join(found.hint("merge"), F.col("key") == F.col("__key")).select("key", "doc_id", "item_id", "item", "wide", "diagonals", "h")

    def best(g: Column) -> Column:
        """Most agreeing words in a window on one diagonal: the last ``wide`` words as bits, counted at each step."""
        here = lambda q: (q + g >= 0) & (q + g < F.size("h"))
        same = F.transform("item", lambda w, q: F.when(here(q) & (F.get(F.col("h"), q + g) == w), 1).otherwise(0))
        window = F.expr("shiftleft(1L, wide) - 1")

        def step(a: Column, b: Column) -> Column:
            bits = (a["bits"] * 2 + b).bitwiseAND(window)
            return F.struct(bits.alias("bits"), F.greatest(a["top"], F.bit_count(bits)).alias("top"))

        return F.aggregate(same, F.struct(F.lit(0).cast("long").alias("bits"), F.lit(0).alias("top")), step, lambda a: a["top"])

    matched = F.array_max(F.transform("diagonals", best))
    good = F.max(F.when(F.col("matched") >= F.ceil(F.col("wide") * similar), F.struct("wide", "matched")))
    # the test comes after the aggregate: as a filter on these columns it would be copied into them
    out = rows.withColumn("matched", matched).groupBy("key", "doc_id", "item_id").agg(good.alias("r")).where("r IS NOT NULL")
    return out.select("key", "doc_id", "item_id", F.col("r.wide").cast("long").alias("width"), F.col("r.matched").cast("long").alias("matched"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no passage of ``benchmark``, with all their columns."""
    key = row_key(F.col("doc_id"), F.col("text"))
    bad = contaminated(docs, benchmark).select(F.col("key").alias("__key")).distinct()
    return docs.join(bad.hint("merge"), key == F.col("__key"), "left_anti")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = contaminated(docs.select("doc_id", "text"), items.select("item_id", "text"))
    return found.groupBy("doc_id", "item_id").agg(F.max("width").alias("width"), F.max("matched").alias("matched"))


#: Independent of the masks: of w words m may differ, so a run of w div (m + 1) words agrees; all runs are joined.
_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id AS id, w, least(len(w), {WIDTH}) AS width, CAST(least(len(w), {WIDTH}) // (least(len(w), {WIDTH}) - ceil(least(len(w), {WIDTH}) * {SIMILAR}) + 1) AS BIGINT) AS run
      FROM (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL) WHERE len(w) > 0),
ds AS (SELECT id, run, i AS pos, array_to_string(w[i + 1 : i + run], ' ') AS k
       FROM (SELECT id, w, run, unnest(range(0, len(w) - run + 1)) AS i FROM d, (SELECT DISTINCT run FROM b) WHERE len(w) >= run)),
bs AS (SELECT id, run, i AS pos, array_to_string(w[i + 1 : i + run], ' ') AS k FROM (SELECT id, w, run, unnest(range(0, len(w) - run + 1)) AS i FROM b)),
diag AS (SELECT DISTINCT ds.id AS did, bs.id AS item_id, ds.pos - bs.pos AS g FROM ds JOIN bs ON ds.run = bs.run AND ds.k = bs.k),
cmp AS (SELECT d.doc_id, did, item_id, g, width,
          list_transform(range(0, len(b.w)), lambda q: CASE WHEN q + g >= 0 AND q + g < len(d.w) AND d.w[q + g + 1] = b.w[q + 1] THEN 1 ELSE 0 END) AS same
        FROM diag JOIN d ON d.id = did JOIN b ON b.id = item_id),
best AS (SELECT doc_id, item_id, width,
          list_max(list_transform(range(0, len(same) - width + 1), lambda s: list_sum(same[s + 1 : s + width]))) AS matched FROM cmp)
SELECT doc_id, item_id, CAST(max(width) AS BIGINT) AS width, CAST(max(matched) AS BIGINT) AS matched
FROM best WHERE matched >= ceil(width * {SIMILAR}) GROUP BY doc_id, item_id
"""
