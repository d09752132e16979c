"""Mixing sources to target weights, with DataFrame expressions only.

Every row gets a hash-random key. Keys are cut into ranges (their leading hex digits), so a
source of any size is spread over many (source, range) groups: a small table of range totals
gives each range its start in the source's order, and a window inside one range adds the rest.
That is a distributed prefix sum; no task ever holds a whole source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, table

#: Weights of the sources in code point order, repeating (fixed by the contract).
WEIGHTS = (5, 2, 1)
#: Share of all words that the mix takes, and the most often a word may be taken.
SHARE, MOST = 1.5, 2
#: Rows of a range on average, at most; a range is what one window sorts.
RANGE_ROWS = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size) -> target words per source.

    ``target = min(most * size, level * weight)`` where ``level`` makes the targets add up to
    ``share`` of all words: what a capped source can't use goes to the others by weight. With
    sources sorted by the level at which each is capped, the level follows from prefix sums.
    One row per source, so the two windows over all rows stay small.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy("cap_level", F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = (
        sizes.withColumn("place", F.row_number().over(by_name) - 1)
        .withColumn("weight", weight.cast("long"))
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("cap_level", F.col("cap").cast("double") / F.col("weight"))
        .withColumn("used", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weights_left", F.sum("weight").over(after))
        .withColumn("total", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("level", (F.col("total") * F.lit(share) - F.col("used")) / F.col("weights_left"))
    )
    # the first source in this order that is not capped fixes the level for it and all after it
    fixed = F.min(F.when(F.col("level") <= F.col("cap_level"), F.struct("cap_level", "level"))).over(Window.partitionBy())
    target = F.least(F.col("cap").cast("double"), F.coalesce(fixed["level"] * F.col("weight"), F.col("cap").cast("double")))
    return ranked.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 7, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add ``size, source_size, target, taken`` to every row of ``docs`` (doc_id, text, source).

    Each source repeats ``floor(target / source_size)`` whole epochs and then takes rows in key
    order up to exactly the rest of its budget, so the row at the cut gives only some of its
    words. Keys are md5 of seed, id and text: reruns agree, and rows that share an id, or have
    none, are spread like all others. A range holds the keys with the same leading hex digits,
    three or more of them, so that it has ``range_rows`` rows at most on average; the result is
    the same for any number.

    Null text and empty text have size 0 and take nothing; a null source is a source of its own,
    last in order; a null doc_id counts as the empty one; repeated rows are rows of their own and
    stand together (which of them is cut makes no difference); an empty table gives an empty
    result; columns of the added names are replaced.
    """
    digits = max(3, math.ceil(math.log(max(docs.count() / range_rows, 1), 16)))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string"), F.col("text")).cast("binary"))
    rows = docs.withColumns({"__size": word_count(F.col("text")), "__key": key}).withColumn("__range", F.substring("__key", 1, digits))
    ranges = rows.groupBy("source", "__range").agg(F.sum("__size").alias("__words"))
    sums = ranges.withColumn("__from", F.sum("__words").over(Window.partitionBy("source").orderBy("__range")) - F.col("__words"))
    want = targets(ranges.groupBy("source").agg(F.sum("__words").alias("source_size")), weights, share, most)
    # one row per source against its ranges
    plan = sums.alias("s").join(want.hint("merge").alias("w"), F.col("s.source").eqNullSafe(F.col("w.source"))).select(
        F.col("s.source").alias("__source"), F.col("s.__range").alias("__r"), "__from", F.col("w.source_size").alias("__whole"), F.col("w.target").alias("__target")
    )
    joined = rows.join(plan.hint("merge"), F.col("source").eqNullSafe(F.col("__source")) & (F.col("__range") == F.col("__r")))
    inside = Window.partitionBy("__source", "__range").orderBy("__key", "doc_id", "__size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("__from") + F.coalesce(F.sum("__size").over(inside), F.lit(0))
    epochs = F.when(F.col("__whole") > 0, F.floor(F.col("__target") / F.col("__whole"))).otherwise(F.lit(0))
    rest = F.floor(F.col("__target")) - F.col("__epochs") * F.col("__whole")
    extra = F.greatest(F.lit(0), F.least(F.col("__size"), rest - F.col("__start")))
    taken = (F.col("__epochs") * F.col("__size") + extra).cast("long")
    return (
        joined.withColumns({"__start": start, "__epochs": epochs})
        .withColumns({"size": F.col("__size"), "source_size": F.col("__whole"), "target": F.col("__target"), "taken": taken})
        .drop("__size", "__key", "__range", "__source", "__r", "__from", "__whole", "__target", "__start", "__epochs")
    )


def expand(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """One row per copy that the mix takes, with ``columns`` only.

    A row that is cut goes whole if at least half of its words are inside the budget.
    """
    copies = F.floor((F.col("taken") * 2 + F.col("size")) / (F.col("size") * 2)).cast("int")
    rows = mixed.where((F.col("size") > 0) & (copies > 0)).withColumn("__copies", copies)
    return rows.select(*columns, F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("__copy")).select(*columns)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(concat_ws('|', '7', CAST(doc_id AS VARCHAR), text)) AS k FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
         source_size * 2 AS cap FROM sources),
leveled AS (
  SELECT *, CAST(cap AS DOUBLE) / weight AS cap_level,
         (CAST((SELECT sum(source_size) FROM sources) AS DOUBLE) * 1.5 - CAST(coalesce(sum(cap) OVER before, 0) AS DOUBLE))
           / CAST(sum(weight) OVER after AS DOUBLE) AS level
  FROM weighed
  WINDOW before AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         after AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
goal AS (
  SELECT source, source_size,
         least(CAST(cap AS DOUBLE), coalesce((SELECT arg_min(level, cap_level) FROM leveled WHERE level <= cap_level) * weight, CAST(cap AS DOUBLE))) AS target
  FROM leveled),
placed AS (
  SELECT s.doc_id, s.size, g.source_size, g.target,
         CASE WHEN g.source_size > 0 THEN CAST(floor(g.target / g.source_size) AS BIGINT) ELSE 0 END AS epochs,
         CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - epochs * source_size - start)) AS BIGINT) AS taken
FROM placed
"""
