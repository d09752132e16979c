"""Moves as tables: successors, terminal positions, the first score of a cascade (no castling, no en passant)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.board import PAWN, Slot, fixed, has, in_check, occupied, push_mask, rank, with_kings, with_masks


def successors(df: DataFrame, n: int, keep: list[str]) -> DataFrame:
    """Legal moves: keep..., slot, src, dst, captured slot (or null), and the child's slots.

    A captured piece stands on its taker's square with colour null in the child. Promotions
    give a queen.
    """
    slots = Slot.of(n, masks=True)
    own = [f"{p}{i}" for i in range(n) for p in "tcs"]
    dst, turn, none = F.col("dst"), F.col("turn"), F.lit(0).cast("long")
    rows = with_masks(df.select(*dict.fromkeys([*keep, *own, "turn"])), n)
    rows = fixed(rows, __own=occupied(slots, turn), __all=occupied(slots))

    def goes(s: Slot):
        take = s.mask.bitwiseAND(F.bitwise_not("__own"))
        return F.when(s.white == turn, F.when(s.kind == PAWN, take.bitwiseAND(F.col("__all")).bitwiseOR(push_mask(s, F.col("__all")))).otherwise(take)).otherwise(none)

    # a row per piece that moves, then its 64 squares in generated code, of which the few it goes to go on
    rows = fixed(rows, __goes=F.array(*[F.struct(F.lit(i).alias("slot"), s.square.alias("src"), goes(s).alias("__to")) for i, s in enumerate(slots)]))
    rows = rows.select(*dict.fromkeys([*keep, *own, "turn"]), F.inline("__goes")).where(F.col("__to") != 0)
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("dst")).where(has(F.col("__to"), dst)).drop("__to")
    rows = fixed(rows, taken=F.coalesce(*[F.when(s.square == dst, F.lit(i)) for i, s in enumerate(slots)]))
    child = {}
    for i in range(n):
        moved, gone = F.col("slot") == i, F.coalesce(F.col("taken") == i, F.lit(False))
        child[f"s{i}"] = F.when(moved, dst).when(gone, F.lit(-1)).otherwise(F.col(f"s{i}"))
        child[f"c{i}"] = F.when(gone, F.lit(-1)).otherwise(F.col(f"c{i}"))
        child[f"t{i}"] = F.when(moved & (F.col(f"t{i}") == PAWN) & rank(dst).isin(0, 7), F.lit(5)).otherwise(F.col(f"t{i}"))
    rows = with_kings(fixed(rows, **child, turn=1 - turn), n)
    return rows.where(~in_check(Slot.of(n), 1 - turn))


def terminal(df: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """Rows without a legal move: mate or stalemate (``checked`` tells which)."""
    moving = successors(df, n, keys).select(*keys).distinct()
    slots = Slot.of(n)
    checked = F.when(F.col("turn") == 1, in_check(slots, 1)).otherwise(in_check(slots, 0))
    return df.join(moving.hint("merge"), keys, "left_anti").withColumn("checked", checked)


def cascade_score(df: DataFrame, terminal_score: str, oracle: str, model: str, draw: float = 1.0) -> DataFrame:
    """First of: terminal score, oracle (material changed), model, draw."""
    return df.withColumn("score", F.coalesce(terminal_score, oracle, model, F.lit(draw)))
