"""Golden counts and properties of enumeration, symmetry and encodings."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from mateframe.functions import board as B
from mateframe.functions.board import Slot
from mateframe.operators import encode as E
from mateframe.operators import search as M
from mateframe.operators import universe as U


@pytest.mark.parametrize("config, both, white, canonical", [("KQvK", 368452, 144508, 46137), ("KRvK", 399112, 175168, 50015), ("KPvK", 331352, 163328, 165676)])
def test_permutations(spark, config, both, white, canonical):
    df = U.positions(U.enumerate_placements(spark, config, partitions=4), 3)
    found = df.agg(F.count("*").alias("n"), F.sum("turn").alias("w"), F.count_if(U.is_canonical(Slot.of(3), F.col("turn"))).alias("c")).first()
    assert (found["n"], found["w"], found["c"]) == (both, white, canonical)


@pytest.mark.parametrize("config, legal, auto", [("KQvK", 64631, 32060), ("KRvK", 70672, 34825), ("KPvK", 74984, 46312)])
def test_combinations(spark, config, legal, auto):
    df = U.positions(U.enumerate_combinations(spark, config), 3)
    found = df.agg(F.count("*").alias("n"), F.count_distinct(B.canonical_key(Slot.of(3), F.col("turn"))).alias("k")).first()
    assert (found["n"], found["k"]) == (legal, auto)


def test_catalogue(spark):
    assert [U.config_catalogue(spark, n).count() for n in (3, 4, 5)] == [10, 40, 185]


def test_slices_and_cycle(spark):
    whole = U.enumerate_placements(spark, "KQvK", turns="white")
    part = U.enumerate_placements(spark, "KQvK", turns="white", offset=1000, limit=50)
    assert whole.count() == math.perm(64, 3) and part.agg(F.min("idx"), F.max("idx")).first()[:] == (1000, 1049)
    assert spark.range(64).select(U.full_cycle(F.col("id"), 5, 27, 64).alias("x")).distinct().count() == 64
    with pytest.raises(ValueError):
        U.full_cycle(F.col("id"), 0, 2, 64)
    wide = spark.range(3).select(U.full_cycle(F.col("id"), 1, 10**10 + 1, 64**6 - 64).alias("x")).collect()
    assert [r["x"] for r in wide] == [(1 + i * (10**10 + 1)) % (64**6 - 64) for i in range(3)]


@pytest.fixture(scope="module")
def some(spark):
    return U.positions(U.enumerate_placements(spark, "KRvK", offset=100_000, limit=300, partitions=2), 3).cache()


@pytest.mark.parametrize("version, moves, width", [(1, False, 43), (1, True, 64), (4, False, 45), (5, False, 45), (6, False, 57), (7, False, 63)])
def test_widths(some, version, moves, width):
    assert {r["w"] for r in E.encode(some.limit(20), 3, version, moves=moves).select(F.size("x").alias("w")).collect()} == {width}


def test_flip_and_orbit(some):
    twice = E.flip(E.flip(some, 3), 3)
    assert twice.exceptAll(some).isEmpty()
    keys = E.orbit(some, 3).groupBy("idx", "turn").agg(F.min("image_key").alias("k")).join(some.select("idx", "turn", B.canonical_key(Slot.of(3), F.col("turn"), "dihedral").alias("c")), ["idx", "turn"])
    assert keys.where("k <> c").isEmpty()


def test_mirrors_beside_their_rows(some):
    """A vector's mirror is the vector of the mirrored position, and labels go along."""
    mirrored = some.select(*[c for c in some.columns if c not in ("s0", "s1", "s2")], *[F.col(f"s{i}").bitwiseXOR(F.lit(7)).alias(f"s{i}") for i in range(3)])
    sided = lambda df: E.encode(df.withColumn("side", F.col("turn")), 3, 4).select("idx", "side", "x")
    vectors = lambda df: {(r["idx"], r["side"]): r["x"] for r in sided(df).collect()}
    both = E.with_mirrors(sided(some), 3).collect()
    plain, turned = vectors(some), vectors(mirrored)
    assert len(both) == 2 * len(plain) and all(r["x"] == pytest.approx((turned if r["mirrored"] else plain)[r["idx"], r["side"]]) for r in both)


def ray_attacks(kind, white, square, occupied):
    f, r = square % 8, square // 8
    line = [(1, 0), (-1, 0), (0, 1), (0, -1)]
    slant = [(1, 1), (1, -1), (-1, 1), (-1, -1)]
    if kind == 6:
        jumps = line + slant
    elif kind == 2:
        jumps = [(a, b) for a in (-2, -1, 1, 2) for b in (-2, -1, 1, 2) if abs(a * b) == 2]
    elif kind == 1:
        jumps = [(1, 1 if white else -1), (-1, 1 if white else -1)]
    else:
        out = set()
        for a, b in {3: slant, 4: line, 5: line + slant}[kind]:
            x, y = f + a, r + b
            while 0 <= x < 8 and 0 <= y < 8:
                out.add(y * 8 + x)
                if y * 8 + x in occupied:
                    break
                x, y = x + a, y + b
        return out
    return {(r + b) * 8 + f + a for a, b in jumps if 0 <= f + a < 8 and 0 <= r + b < 8}


MEN = ["KRvK", "KBNvK", "KRvKP", "KBBvKN", "KQPvKR"]


@pytest.fixture(scope="module", params=MEN)
def spread(request, spark):
    """(number of pieces, some placements from all over a space, legal or not)."""
    n = len(U.pieces_of(request.param))
    ranks = spark.range(250).select(U.full_cycle(F.col("id"), 11, 1_000_003, math.perm(64, n)).alias("idx"), F.lit(request.param).alias("config"))
    return n, U.both_turns(U.placed(ranks, [request.param], U.unrank_permutation(n, F.col("idx")))).cache()


def walked(p, i, n, others=None):
    occupied = {p[f"s{j}"] for j in range(n) if j != i} if others is None else others
    return ray_attacks(p[f"t{i}"], p[f"c{i}"], p[f"s{i}"], occupied)


def test_attacks_by_walking(spread):
    """Attacked squares, and those behind exactly one piece, which are attacked once that piece is gone."""
    n, df = spread
    edges = {}
    for r in E.attack_edges(df, n, ["idx", "turn"], xray=True).collect():
        edges.setdefault((r["idx"], r["turn"], r["src"], r["channel"]), set()).add(r["dst"])
    for p in df.collect():
        for i in range(n):
            open_, others = walked(p, i, n), {p[f"s{j}"] for j in range(n) if j != i}
            key = (p["idx"], p["turn"], p[f"s{i}"])
            behind = set().union(*(walked(p, i, n, others - {o}) for o in others)) - open_
            assert (edges.get((*key, 1), set()), edges.get((*key, 2), set())) == (open_, behind)


def checks_can_arise(p, n):
    """Two checks at most, and not from two squares of one line through the king."""
    own = next(p[f"s{i}"] for i in range(n) if p[f"t{i}"] == 6 and p[f"c{i}"] == p["turn"])
    by = [p[f"s{i}"] for i in range(n) if p[f"c{i}"] != p["turn"] and own in walked(p, i, n)]
    lines = [{own + k * (dr * 8 + df) for k in range(-7, 8) if 0 <= own % 8 + k * df < 8 and 0 <= own // 8 + k * dr < 8} for df, dr in ((1, 0), (0, 1), (1, 1), (1, -1))]
    return len(by) < 2 or (len(by) == 2 and not any(set(by) <= line for line in lines))


@pytest.mark.parametrize("config", ["KRRvK", "KQBNvK", "KPBvK", "KQQvK"])
def test_checks_that_no_move_gives(spark, config):
    """All places of the other pieces around black's king on d4, black to move."""
    n = len(U.pieces_of(config))
    near = [q for q in range(64) if max(abs(q % 8 - 3), abs(q // 8 - 3)) <= 2 and q != 27]
    ways = [(0, *pick, 27) for pick in itertools.permutations(near[:: n - 3], n - 2)]
    df = U.placed(spark.createDataFrame([(config, list(w), 0) for w in ways], "config string, q array<int>, turn int"), [config], F.col("q"))
    df = B.with_masks(df, n).select("*", U.possible_checks(Slot.of(n, masks=True), F.col("turn")).alias("ok")).collect()
    assert all(p["ok"] == checks_can_arise(p, n) for p in df) and {p["ok"] for p in df} == {True, False}


def test_legal_and_pinned_by_walking(spread):
    n, df = spread
    slots = Slot.of(n)
    sliders = {c for t, c in U.pieces_of(df.first()["config"]) if 3 <= t <= 5}
    pins = [B.pinned(s, slots).alias(f"pin{i}") for i, s in enumerate(slots)]
    some_pinned = False
    for p in df.select("*", U.legal(slots, F.col("turn")).alias("legal"), *pins).collect():
        kings = {p[f"c{i}"]: p[f"s{i}"] for i in range(n) if p[f"t{i}"] == 6}
        apart = max(abs(kings[0] % 8 - kings[1] % 8), abs(kings[0] // 8 - kings[1] // 8)) > 1
        left = 1 - p["turn"]
        assert p["legal"] == (apart and not any(p[f"c{i}"] != left and kings[left] in walked(p, i, n) for i in range(n)) and checks_can_arise(p, n))
        for i in range(n):
            own = kings[p[f"c{i}"]]
            gone = {p[f"s{j}"] for j in range(n) if j != i}
            want = p[f"t{i}"] != 6 and any(p[f"c{j}"] != p[f"c{i}"] and own not in walked(p, j, n) and own in walked(p, j, n, gone - {p[f"s{j}"]}) for j in range(n) if j != i)
            assert p[f"pin{i}"] == want
            some_pinned |= want
    assert some_pinned or len(sliders) < 2


def test_tactics_by_walking(spread):
    """Pinned, attackers, defenders, hanging, safe squares and king of versions 6 and 7, piece by piece."""
    n, df = spread
    slots = Slot.of(n)
    for p in df.select("*", E.tactics(slots, 7).alias("f"), *[B.pinned(s, slots).alias(f"pin{i}") for i, s in enumerate(slots)]).limit(60).collect():
        for i in range(n):
            q, white = p[f"s{i}"], p[f"c{i}"]
            on = lambda square, side: sum(p[f"c{j}"] == side and square in walked(p, j, n) for j in range(n))
            safe = sum(on(t, 1 - white) == 0 for t in walked(p, i, n))
            want = [float(p[f"pin{i}"]), min(on(q, 1 - white) / 3, 1.0), min(on(q, white) / 3, 1.0), float(on(q, 1 - white) > on(q, white)), min(safe / 14, 1.0), float(p[f"t{i}"] == 6)]
            assert p["f"][q] == pytest.approx(want)


def test_keys_by_hand(spark):
    """White sorts first, then the type, the rank and the file; the side to move leads."""
    df = U.placed(spark.createDataFrame([("KQvK", [0, 63, 10])], "config string, q array<int>"), ["KQvK"], F.col("q")).withColumn("turn", F.lit(0))
    key = 1
    for white, kind, square in [(1, 5, 63), (1, 6, 0), (0, 6, 10)]:
        key = key * 1024 + (1 - white) * 512 + kind * 64 + square
    found = df.select(B.packed(Slot.of(3), F.col("turn")).alias("key"), E.canonical_form(Slot.of(3), F.col("turn")).alias("form")).first()
    assert found["key"] == key
    # the queen on the lowest square, a1, is the least piece: half a turn brings it there, and of the
    # two images that do, the one with black's king on the lower square is the smaller
    assert found["form"]["key"] == ((1 * 1024 + 5 * 64) * 1024 + 6 * 64 + 63) * 1024 + 512 + 6 * 64 + min(53, 46)


def test_moves_by_walking(some):
    """Black's only piece is its king: its moves are those to squares white does not attack afterwards."""
    got = {}
    for r in M.successors(some, 3, ["idx"]).where("slot = 2").collect():
        got.setdefault(r["idx"], set()).add(r["dst"])
    for p in some.where("turn = 0").collect():
        want = set()
        for q in ray_attacks(6, 0, p["s2"], set()):
            white = [(p[f"t{i}"], p[f"s{i}"]) for i in range(2) if p[f"s{i}"] != q]
            occupied = {s for _, s in white} | {q}
            if not any(q in ray_attacks(t, 1, s, occupied) for t, s in white):
                want.add(q)
        assert got.get(p["idx"], set()) == want


def test_terminal_by_walking(some):
    """Black to move, its king without a safe square: terminal, and in check or not."""
    ended = {r["idx"]: r["checked"] for r in M.terminal(some.where("turn = 0"), 3, ["idx"]).collect()}
    moving = {r["idx"] for r in M.successors(some.where("turn = 0"), 3, ["idx"]).collect()}
    rows = some.where("turn = 0").collect()
    assert ended.keys() == {p["idx"] for p in rows} - moving
    for p in rows:
        if p["idx"] in ended:
            occupied = {p[f"s{i}"] for i in range(3)}
            assert ended[p["idx"]] == any(p["s2"] in ray_attacks(p[f"t{i}"], 1, p[f"s{i}"], occupied) for i in range(2))
