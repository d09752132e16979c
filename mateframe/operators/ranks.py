"""Global row numbers without a global window, and what builds on them.

Rows are dealt into ranges of an order and sorted inside; a row's number is its place in its range
plus the rows of all ranges before. Ranges are bounded by all order columns, so a value that
very many rows share is split by the columns behind it. Only one row per range (and group)
is ever brought together, to add up the ranges' sizes.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import stored

#: Bits of ``monotonically_increasing_id`` that number rows inside a partition.
_INSIDE = 33


#: Rows up to which a stored table is broadcast; larger ones are joined by sorting.
SMALL = 1 << 20
#: Ranges that are added up together, and then their sums.
_BLOCK = 256


def sized(table: DataFrame) -> DataFrame:
    """A stored table with the join hint that its number of rows asks for."""
    return F.broadcast(table) if table.count() <= SMALL else table.hint("merge")


def _before(sizes: DataFrame, by: list[str]) -> DataFrame:
    """Rows of earlier ranges (of the group, if there is one): ``sizes`` is (by, __range, __n), a stored row per range. Ranges are added up in blocks, then the blocks."""
    rows = sizes.withColumn("__block", F.floor(F.col("__range") / _BLOCK))
    sums = rows.groupBy(*by, "__block").agg(F.sum("__n").alias("__b"))
    inside = F.sum("__n").over(Window.partitionBy(*by, "__block").orderBy("__range")) - F.col("__n")
    inner = rows.withColumn("__inside", inside)
    if not by:  # a row per block of ranges comes to the driver
        found = sorted((r["__block"], r["__b"]) for r in sums.collect())
        ends = list(accumulate(b for _, b in found))
        starts = F.create_map(*[F.lit(v) for (block, b), end in zip(found, ends, strict=True) for v in (block, end - b)]) if found else F.create_map().cast("map<bigint, bigint>")
        return inner.select("__range", F.lit(ends[-1] if ends else 0).cast("long").alias("__size"), (F.col("__inside") + starts[F.col("__block")]).alias("__before"))
    blocks = sums.groupBy(*by).agg(F.sum("__b").alias("__size"), F.collect_list(F.struct("__block", "__b")).alias("__bs"))
    earlier = F.aggregate(F.filter("__bs", lambda b: b["__block"] < F.col("__block")), F.lit(0).cast("long"), lambda a, b: a + b["__b"])
    return _null_safe(inner, sized(stored(blocks, "range-blocks")), by).select(*by, "__range", "__size", (F.col("__inside") + earlier).alias("__before"))


def ranked(df: DataFrame, order: list[Column | str], *, within: str | None = None, rank: str = "rank", size: str = "size") -> DataFrame:
    """Number all rows from 0 in an order, or those of each group; also add how many there are.

    The order has to tell rows apart for reruns to agree; rows that are equal in it take their numbers in any
    order. Nulls come first, also as a group. Columns named like the new ones are replaced. A group that holds most rows is
    dealt over ranges like any other. The table is written once, sorted.
    """
    df = df.drop(rank, size)
    by = [] if within is None else [within]
    keys = [*by, *order]
    ordered = df.repartitionByRange(*[F.col(k) if isinstance(k, str) else k for k in keys]).sortWithinPartitions(*keys)
    rows = stored(ordered.withColumn("__id", F.monotonically_increasing_id()), "ordered").withColumn("__range", F.shiftright("__id", _INSIDE))
    # a group's rows of one range stand together: number them from the first
    sizes = stored(rows.groupBy(*by, "__range").agg(F.count("*").alias("__n"), F.min("__id").alias("__first")), "range-sizes")
    placed = _null_safe(sizes.select(*by, "__range", "__first"), _before(sizes, by).hint("merge"), [*by, "__range"])
    joined = _null_safe(rows, sized(stored(placed, "range-offsets")), [*by, "__range"])
    return joined.select(*df.columns, (F.col("__id") - F.col("__first") + F.col("__before")).alias(rank), F.col("__size").alias(size))


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join in which null equals null."""
    right = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    return left.join(right, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]).drop(*[f"__r_{k}" for k in keys])


#: Rows of a bucket in ``stitched``.
BUCKET = 1 << 20


def stitched(df: DataFrame, rank: str = "rank", *, before: int = 0, after: int = 0, bucket: int = BUCKET) -> DataFrame:
    """Numbered rows in buckets of equal size, each with the rows that stand just outside its borders.

    Adds ``__bucket`` and ``__own`` (false for such copies). A window over a bucket by rank that looks back or
    ahead no further than ``before`` and ``after`` rows gives an own row what a window over all
    rows would, at any group size; filter by ``__own`` afterwards.
    """
    home = F.floor(F.col(rank) / bucket)
    first, last = F.floor((F.col(rank) - after) / bucket), F.floor((F.col(rank) + before) / bucket)
    return df.select("*", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)).alias("__bucket")).withColumn("__own", F.col("__bucket") == home)


def successor(df: DataFrame, order: list[Column | str], value: str, *, within: str, name: str = "next", bucket: int = BUCKET) -> DataFrame:
    """Each row's ``value`` of the row behind it in its group's order; null for the last. One row of a bucket is copied to the one before."""
    numbered = ranked(df, [within, *order], rank="__rank", size="__of")
    window = Window.partitionBy("__bucket").orderBy("__rank")
    ahead = stitched(numbered, "__rank", after=1, bucket=bucket).withColumns({"__v": F.lead(value).over(window), "__g": F.lead(within).over(window), "__more": F.lead(F.lit(True)).over(window)})
    same = F.coalesce(F.col("__more"), F.lit(False)) & F.col("__g").eqNullSafe(F.col(within))
    return ahead.where("__own").select(*df.columns, F.when(same, F.col("__v")).alias(name))


#: Bits of a hash that a round of ``smallest`` counts, and rows of a bin that are ranked at once.
BITS, ENOUGH = 12, 1 << 20


def uniform(key: Column | str, seed: int | str) -> Column:
    """60 bits of the md5 of key and seed, as a number."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.col(key) if isinstance(key, str) else key, F.lit(str(seed))).cast("binary")), 1, 15), 16, 10).cast("long")


def smallest(df: DataFrame, rows: int, score: Column, ties: list[Column | str], *, enough: int = ENOUGH) -> DataFrame:
    """Exactly ``rows`` rows of least score (all, if fewer), a number of 60 bits; ties go by ``ties``.

    The score's leading bits are counted (a row per value of 12 bits comes to the driver), which gives the bin the
    cut falls in; that bin's next bits are counted in turn until it is small or bits run out, and only
    its rows are put in order. All others are taken or left by a filter. ``df`` is read once
    per round, so it should be a table or a cheap plan. ``enough`` changes the work, not the result.
    """
    scored = df.withColumn("__s", score)
    low, bits, want = 0, 60, rows
    while want > 0:
        bits -= BITS
        part = scored.where((F.col("__s") >= low) & (F.col("__s") < low + (1 << (bits + BITS))))
        counts = sorted((r["b"], r["n"]) for r in part.groupBy(F.shiftright(F.col("__s") - low, bits).alias("b")).agg(F.count("*").alias("n")).collect())
        held = 0
        for b, n in counts:
            if n >= want:
                low, held = low + (b << bits), n
                break
            want -= n
        else:  # fewer rows than asked for
            return scored.where("__s IS NOT NULL").select(df.columns)
        if held == want or held <= enough or bits == 0:
            break
    if want <= 0:
        return scored.where(F.lit(False)).select(df.columns)
    sure, high = scored.where(F.col("__s") < low), low + (1 << bits)
    cut = scored.where((F.col("__s") >= low) & (F.col("__s") < high))
    if held == want:
        return scored.where(F.col("__s") < high).select(df.columns)
    last = ranked(cut, ["__s", *ties], rank="__rank", size="__of").where(F.col("__rank") < want)
    return sure.select(df.columns).unionByName(last.select(df.columns))


def sample(df: DataFrame, key: str, share: float, seed: int, *, ties: list[Column | str] = ()) -> DataFrame:
    """Exactly floor(share * rows) rows, those of least hash; rows of one hash go by key, then ``ties``."""
    return smallest(df, int(df.count() * share), uniform(key, seed), [key, *ties])


def tail_split(df: DataFrame, order: list[Column | str], share: float = 0.1) -> DataFrame:
    """``part``: the last rows in the order are validation, the first int((1 - share) * rows) are train."""
    numbered = ranked(df, order, rank="__rank", size="__of")
    return numbered.withColumn("part", F.when(F.col("__rank") < F.floor(F.col("__of") * F.lit(1 - share)), "train").otherwise("validation")).drop("__rank", "__of")


def shard_quota(df: DataFrame, stratum: str, key: str, *, rows: int, shards: int, seed: int, ties: list[str] = ()) -> DataFrame:
    """Shards that each hold ``rows`` rows of every stratum: adds epoch, shard and place.

    A stratum's rows are dealt in a seeded order, shard after shard; when all have been dealt, they
    are dealt again in an order of the next epoch. So a small stratum repeats and a large one is
    used in part, and a row repeats only after all of its stratum. ``place`` is a row's seeded place in its shard,
    over all strata. Rows that share a key go by ``ties``. Reruns agree.
    """
    total = rows * shards
    df = df.drop("epoch", "shard", "place")
    sizes = stored(df.groupBy(stratum).agg(F.count("*").alias("__size")), "stratum-sizes")
    known = _null_safe(df, sized(sizes), [stratum])
    epochs = F.ceil(F.lit(total) / F.col("__size")).cast("int")
    dealt = known.select(*df.columns, F.explode(F.sequence(F.lit(0), epochs - 1)).alias("epoch"))
    dealt = dealt.withColumn("__order", F.md5(F.concat_ws("|", F.col(key), F.lit(str(seed)), "epoch").cast("binary")))
    # epochs follow each other, so a row's number in (stratum, epoch, order) is its slot
    slots = ranked(dealt, ["epoch", "__order", key, *ties], within=stratum, rank="__slot", size="__of").where(F.col("__slot") < total)
    sharded = slots.withColumn("shard", F.floor(F.col("__slot") / rows).cast("int"))
    mixed = F.md5(F.concat_ws("|", F.col(key), F.lit(str(seed)), "epoch", "shard").cast("binary"))
    placed = ranked(sharded.withColumn("__mix", mixed), ["__mix", stratum, "__slot"], within="shard", rank="place", size="__of")
    return placed.select(*df.columns, "epoch", "shard", "place")


def interval_join(points: DataFrame, intervals: DataFrame, point: str, start: str, length: str) -> DataFrame:
    """Points with the intervals [start, start + length) that hold them, as an equality join.

    An interval of some magnitude (the next power of two) touches at most two cells of that width; a
    point lies in one cell of each magnitude that occurs. So disjoint intervals offer a point at most three candidates per magnitude,
    however many there are and whatever their lengths. Empty intervals hold nothing, null
    points lie in none; the two tables share no column name.
    """
    cell = lambda x, level: F.call_function("shiftright", x.cast("long"), F.col(level))
    inner = intervals.where(F.col(length) > 0).withColumn("__level", F.length(F.bin(F.col(length) - 1)))
    tall = stored(inner.select("*", F.explode(F.sequence(cell(F.col(start), "__level"), cell(F.col(start) + F.col(length) - 1, "__level"))).alias("__cell")), "interval-cells")
    levels = sorted(r[0] for r in tall.select("__level").distinct().collect())  # at most 64
    probes = points.where(F.col(point).isNotNull()).withColumn("__l", F.explode(F.array(*[F.lit(v) for v in levels]).cast("array<int>"))).withColumn("__c", cell(F.col(point), "__l"))
    hit = probes.join(sized(tall), [F.col("__l") == F.col("__level"), F.col("__c") == F.col("__cell")])
    return hit.where((F.col(point) >= F.col(start)) & (F.col(point) < F.col(start) + F.col(length))).drop("__l", "__c", "__level", "__cell")


def offsets(df: DataFrame, shard: str) -> DataFrame:
    """Rows of every shard and the global number of its first one: shard, n, first_row."""
    sizes = stored(df.groupBy(shard).agg(F.count("*").alias("n")), "shard-sizes")
    # the rows before a shard are those of its range before it, and those of all ranges before
    ordered = stored(sizes.repartitionByRange(shard).sortWithinPartitions(shard).withColumn("__range", F.spark_partition_id().cast("long")), "shards-in-order")
    sums = stored(ordered.groupBy("__range").agg(F.sum("n").alias("__n")), "range-sizes")
    inside = F.sum("n").over(Window.partitionBy("__range").orderBy(shard)) - F.col("n")
    return ordered.withColumn("__in", inside).join(sized(stored(_before(sums, []), "range-offsets")), "__range").select(shard, "n", (F.col("__in") + F.col("__before")).alias("first_row"))


def locate(indices: DataFrame, index: str, shards: DataFrame, shard: str) -> DataFrame:
    """Global row numbers as shard and local row: adds ``shard`` and ``local_row``; numbers outside have no row."""
    found = interval_join(indices, shards.select(shard, "n", "first_row"), index, "first_row", "n")
    return found.withColumn("local_row", F.col(index) - F.col("first_row")).drop("n", "first_row")
