"""Enumeration of placements and the filters that make them positions."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.board import CHECKS, LETTERS, PAWN, Slot, canonical_key, check_marks, chebyshev, fixed, in_check, king, packed, rank, with_keys, with_kings, with_masks


def unrank_permutation(n: int, index: Column, squares: int = 64) -> Column:
    """Array of the squares of the ordered selection with this lexicographic rank.

    The rank's digits count free squares. From the last digit back, each square that isn't below
    an earlier digit steps over it.
    """
    found = _digits(n, index, squares)
    for i in range(n - 2, -1, -1):
        found[i + 1 :] = [s + (s >= found[i]).cast("int") for s in found[i + 1 :]]
    return F.array(*found)


def _digits(n: int, index: Column, squares: int = 64) -> list[Column]:
    return [F.floor(index % math.perm(squares - i, n - i) / math.perm(squares - i - 1, n - i - 1)).cast("int") for i in range(n)]


def unrank_combination(k: int, index: Column, squares: int = 64) -> Column:
    """Array of the squares of the k-subset with this rank, descending."""
    tables = F.array(*[F.array(*[F.lit(math.comb(s, left)) for s in range(squares)]) for left in range(k, 0, -1)])

    def pick(acc: Column, i: Column) -> Column:
        table = F.get(tables, i)
        square = F.size(F.filter(table, lambda c: c <= acc["rest"])) - 1
        return F.struct((acc["rest"] - F.get(table, square)).alias("rest"), F.concat(acc["out"], F.array(square)).alias("out"))

    begin = F.struct(index.cast("long").alias("rest"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), begin, pick, lambda acc: acc["out"])


def unrank_odometer(n: int, index: Column) -> list[Column]:
    """Base-64 digits, most significant first; rows with equal squares are to be filtered out."""
    return [F.shiftright(index, 6 * (n - 1 - i)).bitwiseAND(63).cast("int") for i in range(n)]


def full_cycle(index: Column, start: int, stride: int, n: int) -> Column:
    """``(start + index * stride) mod n``: every rank once, in shuffled order, if gcd(stride, n) = 1."""
    if math.gcd(stride, n) != 1:
        raise ValueError("stride and n have a common divisor")
    if n * stride < 1 << 63:
        return F.pmod(F.lit(start) + index * stride, F.lit(n))
    wide = F.lit(start).cast("decimal(38,0)") + index.cast("decimal(20,0)") * F.lit(stride).cast("decimal(18,0)")
    return F.pmod(wide, F.lit(n).cast("decimal(38,0)")).cast("long")


def pieces_of(config: str) -> list[tuple[int, int]]:
    """(type, white) per slot of a configuration such as KQvK."""
    white, black = config.replace("V", "v").split("v")
    return [(LETTERS.index(p) + 1, 1) for p in white] + [(LETTERS.index(p) + 1, 0) for p in black]


def with_pieces(df: DataFrame, configs: list[str], config: str = "config") -> DataFrame:
    """Add t0.., c0.. for the slots of each row's configuration; all have as many pieces."""
    n = len(pieces_of(configs[0]))
    pick = lambda i, part: reduce(lambda acc, c: acc.when(F.col(config) == c, pieces_of(c)[i][part]), configs, F)
    return df.withColumns({f"{'tc'[part]}{i}": pick(i, part) for i in range(n) for part in range(2)})


def enumerate_placements(spark: SparkSession, config: str, *, offset: int = 0, limit: int = 0, turns: str = "both", partitions: int | None = None) -> DataFrame:
    """All placements of a configuration by rank: config, idx, s0.., t0.., c0.., turn.

    A range of ranks, unranked by arithmetic: any slice can be made alone, and nothing is shuffled.
    ``limit`` 0 means no limit. ``turns`` is ``both`` or ``white``.
    """
    n = len(pieces_of(config))
    stop = slice_end(n, offset, limit)
    ranks = spark.range(offset, stop, 1, partitions) if partitions else spark.range(offset, stop)
    df = ranks.withColumnRenamed("id", "idx").withColumn("config", F.lit(config))
    return both_turns(placed_by_rank(df, [config], F.col("idx")), turns)


def placed(df: DataFrame, configs: list[str], squares: Column) -> DataFrame:
    """Add the slots s, t, c of each row and the kings' squares k1 and k0 from an array of squares."""
    n = len(pieces_of(configs[0]))
    df = fixed(df, __sq=squares)
    return _with_men(df.withColumns({f"s{i}": F.get("__sq", F.lit(i)) for i in range(n)}).drop("__sq"), configs)


def placed_by_rank(df: DataFrame, configs: list[str], index: Column) -> DataFrame:
    """``placed`` by ``unrank_permutation``, digit by digit: as one expression the last square holds each digit many times over."""
    n = len(pieces_of(configs[0]))
    df = fixed(df, **{f"s{i}": d for i, d in enumerate(_digits(n, index))})
    for i in range(n - 2, -1, -1):
        df = fixed(df, **{f"s{j}": F.col(f"s{j}") + (F.col(f"s{j}") >= F.col(f"s{i}")).cast("int") for j in range(i + 1, n)})
    return _with_men(df, configs)


def _with_men(df: DataFrame, configs: list[str]) -> DataFrame:
    n = len(pieces_of(configs[0]))
    df = with_pieces(df, configs)
    return with_kings(fixed(df, **{f"{p}{i}": F.col(f"{p}{i}") for i in range(n) for p in "tc"}) if len(configs) > 1 else df, n)


def slice_end(n: int, offset: int, limit: int) -> int:
    """Rank behind the last of a slice of the placements of n pieces; ``limit`` 0 means to the end."""
    return min(offset + limit, math.perm(64, n)) if limit else math.perm(64, n)


def enumerate_combinations(spark: SparkSession, config: str, turns: str = "both") -> DataFrame:
    """One placement per square set: slot 0 gets the highest square."""
    n = len(pieces_of(config))
    df = spark.range(math.comb(64, n)).withColumnRenamed("id", "idx").withColumn("config", F.lit(config))
    return both_turns(placed(df, [config], unrank_combination(n, F.col("idx"))), turns)


def both_turns(df: DataFrame, turns: str = "both") -> DataFrame:
    """Side to move as a row each: 1 white, 0 black."""
    return df.withColumn("turn", F.explode(F.array(F.lit(1), F.lit(0)))) if turns == "both" else df.withColumn("turn", F.lit(1))


def no_edge_pawns(slots: list[Slot]) -> Column:
    return reduce(and_, [~((s.kind == PAWN) & rank(s.square).isin(0, 7)) for s in slots])


def ascending_twins(slots: list[Slot]) -> Column:
    """Equal pieces stand in ascending order, so each placement counts once."""
    pairs = [(a, b) for i, a in enumerate(slots) for b in slots[i + 1 :]]
    return reduce(and_, [~((a.kind == b.kind) & (a.white == b.white)) | (a.square < b.square) for a, b in pairs])


def possible_checks(slots: list[Slot], turn: Column) -> Column:
    """No move gives more checks than two, nor two along one line through the king."""
    if len(slots) < 4:
        return F.lit(True)
    # of checks along a line of the king's, each may occur once
    pairs = [a + b for i, a in enumerate(CHECKS) for b in CHECKS[:i]] + [2 * CHECKS[-1]]
    return check_marks(slots, turn).isin(0, *CHECKS, *pairs)


def legal(slots: list[Slot], turn: Column) -> Column:
    """Kings apart, the side that has just moved not in check, and checks that a move can have given."""
    return (chebyshev(king(1), king(0)) > 1) & ~in_check(slots, 1 - turn) & possible_checks(slots, turn)


def is_canonical(slots: list[Slot], turn: Column, mode: str = "auto") -> Column:
    """The position is the smallest of its images: keeps one per orbit without a shuffle."""
    return packed(slots, turn) == canonical_key(slots, turn, mode)


def canonical(df: DataFrame, n: int, mode: str = "auto") -> DataFrame:
    """The rows of canonical positions; keys are worked out once, as columns, and dropped."""
    return with_keys(df, n, "__own", "__key", mode).where("__own = __key").drop("__own", "__key")


def positions(df: DataFrame, n: int) -> DataFrame:
    """Cheap filters first, legality last, on masks worked out for what is left."""
    slots, turn = Slot.of(n, masks=True), F.col("turn")
    cheap = df.where(ascending_twins(Slot.of(n))).where(no_edge_pawns(Slot.of(n))).where(chebyshev(king(1), king(0)) > 1)
    safe = fixed(with_masks(cheap, n), __left=in_check(slots, 1 - turn)).where("NOT __left")
    if n >= 4:
        safe = fixed(safe, __given=possible_checks(slots, turn)).where("__given")
    return safe.drop("__left", "__given", *[f"m{i}" for i in range(n)])


def material(slots: list[Slot]) -> Column:
    """White letters, v, black letters, strongest first."""
    side = lambda white: F.array_join(F.transform(F.reverse(F.array_sort(F.filter(F.array(*[F.when(s.white == white, s.kind) for s in slots]), lambda x: x.isNotNull()))), lambda t: F.substring(F.lit(LETTERS), t, 1)), "")
    return F.concat(side(1), F.lit("v"), side(0))


def config_catalogue(spark: SparkSession, pieces: int) -> DataFrame:
    """All configurations of so many pieces with one king a side: (config).

    Each side is its king and a multiset of the other letters, strongest first. White holds at
    least half of the other pieces, rounded down.
    """
    sides = {0: spark.createDataFrame([("",)], "side string")}
    letters = spark.createDataFrame([(i, p) for i, p in enumerate("QRBNP")], "place int, letter string")
    grown = spark.createDataFrame([("", 0)], "side string, least int")
    for n in range(1, pieces - 1):
        grown = grown.join(F.broadcast(letters), F.col("place") >= F.col("least")).select(F.concat("side", "letter").alias("side"), F.col("place").alias("least"))
        sides[n] = grown.select("side")
    out = [sides[w].withColumnRenamed("side", "w").crossJoin(F.broadcast(sides[pieces - 2 - w].withColumnRenamed("side", "b"))) for w in range((pieces - 2) // 2, pieces - 1)]
    return reduce(DataFrame.unionByName, out).select(F.concat(F.lit("K"), "w", F.lit("vK"), "b").alias("config")).distinct()


def explode_config(df: DataFrame, config: str = "config") -> DataFrame:
    """One row per slot: slot, piece_type, color (1 white)."""
    sides = F.split(F.regexp_replace(config, "V", "v"), "v")
    letters = lambda i: F.filter(F.split(F.element_at(sides, i), ""), lambda c: c != "")
    slots = F.concat(F.transform(letters(1), lambda c: F.struct(c.alias("letter"), F.lit(1).alias("color"))), F.transform(letters(2), lambda c: F.struct(c.alias("letter"), F.lit(0).alias("color"))))
    return df.select("*", F.posexplode(slots).alias("slot", "__s")).select(*df.columns, "slot", F.instr(F.lit(LETTERS), F.col("__s.letter")).alias("piece_type"), F.col("__s.color").alias("color"))


def config_category(config: Column) -> Column:
    """Rough class of a configuration by its name."""
    white, black = F.split_part(config, F.lit("v"), F.lit(1)), F.split_part(config, F.lit("v"), F.lit(2))
    bare = (white.isin("KB", "KN") & black.isin("KB", "KN")) | (white.isin("KBB", "KNN") & (black == "K"))
    heavy = (white.contains("QQ") | white.contains("RR") | white.contains("QR")) & (black == "K")
    return (
        F.when(bare, "draw").when(heavy, "easy").when(config.contains("P"), "promotion").when(F.length(white) == F.length(black), "complex").otherwise("promotion")
    )
