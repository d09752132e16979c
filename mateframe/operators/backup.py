"""Values backed up over any table of parents and children, ply by ply."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import stored
from .ranks import sized


def _scored(children: DataFrame, scores: DataFrame, missing: float) -> DataFrame:
    """Edges (parent, child, own): own is the child's own score, which the table brings as ``value`` or the scores have."""
    edges = children.where("parent IS NOT NULL AND child IS NOT NULL")
    if "value" in children.columns:
        return edges.select("parent", "child", F.coalesce(F.col("value").cast("double"), F.lit(missing)).alias("own"))
    own = scores.select(F.col("node").alias("__n"), F.col("value").cast("double").alias("own"))
    found = edges.select("parent", "child").join(own.hint("merge"), F.col("child") == F.col("__n"), "left")
    return stored(found.select("parent", "child", F.coalesce("own", F.lit(missing)).alias("own")), "edges")


def descend(roots: DataFrame, children: DataFrame, scores: DataFrame, plies: int | None = None, missing: float = 0.0) -> tuple[list[DataFrame], list[DataFrame]]:
    """Stored levels (node, maximise) from the roots down, and the edges (node, maximise, child, own) between them; own is the child's own score.

    A level with no children ends the descent, or ``plies`` do. A node that several parents lead to stands once in
    a level for each side to move. Without ``plies`` the table must have no cycles.
    """
    return _descend(roots, _scored(children, scores, missing), plies)


def _descend(roots: DataFrame, edges: DataFrame, plies: int | None) -> tuple[list[DataFrame], list[DataFrame]]:
    levels, between = [stored(roots.select("node", "maximise").distinct(), "level")], []
    while plies is None or len(between) < plies:
        down = stored(edges.join(sized(levels[-1]), F.col("node") == F.col("parent")).select("node", "maximise", "child", "own"), "between")
        if down.isEmpty():
            break
        between.append(down)
        levels.append(stored(down.select(F.col("child").alias("node"), (~F.col("maximise")).alias("maximise")).distinct(), "level"))
    return levels, between


def backups(roots: DataFrame, children: DataFrame, scores: DataFrame, plies: list[int | None], *, missing: float = 0.0) -> DataFrame:
    """``backup`` to several depths over one descent and one way back up: node, maximise, value, plies (null: to the leaves).

    Children at the last ply count their own scores, so of those only each parent's extremes are brought together.
    """
    deepest = None if None in plies else max(plies)
    edges = _scored(children, scores, missing)
    levels, between = _descend(roots, edges, deepest and deepest - 1)
    taken = lambda most, least: F.when(F.col("maximise"), most).otherwise(least)
    best, names = None, {}
    if deepest and len(between) == deepest - 1:
        ends = edges.groupBy("parent").agg(F.max("own").alias("most"), F.min("own").alias("least"))
        names = {deepest: f"v{deepest}"}
        best = stored(ends.join(sized(levels[-1]), F.col("node") == F.col("parent")).select("node", "maximise", taken(F.col("most"), F.col("least")).alias(names[deepest])), "value")
    for k in range(len(between) - 1, -1, -1):
        rows, below = between[k], {d: F.coalesce(v, "own") for d, v in names.items()}
        if best is not None:
            seen = best.select(F.col("node").alias("child"), (~F.col("maximise")).alias("maximise"), *names.values())
            rows = rows.join(sized(seen), ["child", "maximise"], "left")
        # depths that end here, or beyond the last level
        below |= {d: F.col("own") for d in plies if d not in below and (d == k + 1 or k + 1 == len(between) and (d is None or d > k))}
        names = {d: f"v{d}" for d in below}
        best = rows.groupBy("node", "maximise").agg(*[taken(F.max(x), F.min(x)).alias(names[d]) for d, x in below.items()])
        best = stored(best, "value")
    own = scores.select("node", F.col("value").cast("double").alias("own"))
    found = levels[0].hint("merge").join(own, "node", "left").select("node", "maximise", F.coalesce("own", F.lit(missing)).alias("own"))
    if best is not None:
        found = found.join(sized(best), ["node", "maximise"], "left")
    values = F.array(*[F.struct((F.coalesce(names[d], "own") if d in names else F.col("own")).alias("value"), F.lit(d).cast("int").alias("plies")) for d in plies])
    return stored(found.select("node", "maximise", F.inline(values)), "value")


def backup(roots: DataFrame, children: DataFrame, scores: DataFrame, *, plies: int | None = None, missing: float = 0.0) -> DataFrame:
    """Value of each root (node, maximise, value): the best child's, seen by the side to move, down to ``plies`` or to the leaves.

    ``roots`` is (node, maximise): that side takes the greatest value, its opponent the least, in
    turns. ``children`` is (parent, child), ``scores`` (node, value) with a node at most once; where ``children`` has the
    child's own score too, as ``value``, only roots look theirs up in ``scores``. Nodes at the last ply and
    nodes without children count their own score (``missing`` without one), so plies of 0 give the roots' scores.
    Null parents and children are no edges. Each ply is a join and a partial aggregate, written before the next.
    """
    return backups(roots, children, scores, [plies], missing=missing).drop("plies")
