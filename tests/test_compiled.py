"""Generated methods small enough for the JVM to compile, and what is worked out in them against plain walks."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_universe import ray_attacks

from mateframe import registry
from mateframe.operators import search as M
from mateframe.operators import universe as U
from mateframe.plans.common import placements

#: The JVM interprets methods of more bytes than this.
MOST = 8000


def largest_method(spark, df):
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df.select("*")._jdf.queryExecution().executedPlan()
        parts = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenStringSeq(plan)
        return max(parts.apply(i)._3().maxMethodCodeSize() for i in range(parts.size()))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


@pytest.mark.parametrize("name", ["b5_terminal", "c19_moves", "d4_successors", "b3_legal_five", "b4_canonical_five", "c20_channels_five", "c11_encode_five", "c12_encode_v6", "c13_encode_v7", "c28_mirror"])
def test_methods_are_compiled(spark, sf, name):
    assert 0 < largest_method(spark, registry.queries()[name](spark, sf)) <= MOST


def walked_moves(p, n):
    """(slot, dst, taken) of every move that leaves the mover's king unattacked."""
    men = [(p[f"t{i}"], p[f"c{i}"], p[f"s{i}"]) for i in range(n)]
    at, side, out = {s: i for i, (_, _, s) in enumerate(men)}, p["turn"], set()
    for i, (t, c, s) in enumerate(men):
        if c != side:
            continue
        to = {q for q in ray_attacks(t, c, s, set(at) - {s}) if q not in at or men[at[q]][1] != side}
        if t == 1:
            to, step = {q for q in to if q in at}, 8 if c else -8
            if 0 <= s + step < 64 and s + step not in at:
                to.add(s + step)
                if s // 8 == (1 if c else 6) and s + 2 * step not in at:
                    to.add(s + 2 * step)
        for q in to:
            after = [(k, w, q if j == i else x) for j, (k, w, x) in enumerate(men) if j == i or x != q]
            king = next((x for k, w, x in after if k == 6 and w == side), None)
            if not any(w != side and king in ray_attacks(k, w, x, {y for _, _, y in after} - {x}) for k, w, x in after):
                out.add((i, q, at.get(q)))
    return out


@pytest.mark.parametrize("config", ["KPvK", "KPvKP", "KRPvKP", "KBNvK"])
def test_moves_of_all_pieces(spark, config):
    """Pawns of both colours, their double steps and captures too; kings apart at first."""
    n = len(U.pieces_of(config))
    ranks = spark.range(400).select(U.full_cycle(F.col("id"), 11, 1_000_003, math.perm(64, n)).alias("idx"), F.lit(config).alias("config"))
    df = U.positions(U.both_turns(U.placed(ranks, [config], U.unrank_permutation(n, F.col("idx")))), n).cache()
    got = {}
    for r in M.successors(df.withColumn("mover", F.col("turn")), n, ["idx", "mover"]).collect():
        got.setdefault((r["idx"], r["mover"]), set()).add((r["slot"], r["dst"], r["taken"]))
    rows = df.collect()
    assert rows and all(got.get((p["idx"], p["turn"]), set()) == walked_moves(p, n) for p in rows)


@pytest.fixture(scope="module")
def thrice(spark, sf, tmp_path_factory):
    """Line items three times, with keys shifted by whole rounds of ranks, so that the copies name the same positions."""
    path = str(tmp_path_factory.mktemp("thrice"))
    li = spark.read.parquet(f"{sf}/lineitem.parquet").where("l_orderkey < 300")
    copies = spark.range(3).select((F.col("id") * 249984).alias("__shift"))
    li.crossJoin(F.broadcast(copies)).withColumn("l_orderkey", F.col("l_orderkey") + F.col("__shift")).drop("__shift").write.parquet(f"{path}/lineitem.parquet")
    legal = U.positions(placements(spark, path), 3).collect()
    assert len(legal) > 900 and len({(p["config"], p["idx"], p["turn"]) for p in legal}) * 3 <= len(legal)
    return path, [(p, walked_moves(p, 3)) for p in legal]


@pytest.fixture
def moved(monkeypatch):
    """The tables whose moves were worked out."""
    seen, successors = [], M.successors
    monkeypatch.setattr(M, "successors", lambda df, n, keep: seen.append(df) or successors(df, n, keep))
    return seen


def once(seen, legal):
    """Each position's moves were worked out once, not once for each line item that names it."""
    return len(seen) == 1 and seen[0].count() == len({(p["config"], p["idx"], p["turn"]) for p, _ in legal})


def test_c19_moves_once_a_position(spark, thrice, moved):
    path, legal = thrice
    moves, captures = Counter(), Counter()
    for p, found in legal:
        for slot, _, taken in found:
            moves[p["config"], slot] += 1
            captures[p["config"], slot] += taken is not None
    got = registry.queries()["c19_moves"](spark, path).collect()
    assert {(r["config"], r["slot"]): (r["moves"], r["captures"]) for r in got} == {k: (n, captures[k]) for k, n in moves.items()}
    assert once(moved, legal)


def test_b5_terminal_once_a_position(spark, thrice, moved):
    path, legal = thrice
    want = Counter((p["config"], p["turn"]) for p, found in legal if not found)
    got = Counter()
    for r in registry.queries()["b5_terminal"](spark, path).collect():
        got[r["config"], r["turn"]] += r["n"]
    assert got == want and once(moved, legal)


def test_d4_successors_once_a_position(spark, thrice, moved):
    path, legal = thrice
    want = {p["id"]: len(found) for p, found in legal if found}
    assert len({p["id"] for p, _ in legal}) == len(legal)
    got = registry.queries()["d4_successors"](spark, path).collect()
    assert {r["id"]: r["children"] for r in got} == want and once(moved, legal)
