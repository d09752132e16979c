"""Line items whose keys make numbers of more than 64 bits, and placements that many of them name."""

import math

import pytest
from pyspark.sql import functions as F

from mateframe import registry
from mateframe.operators import encode as E

#: Order keys this far apart name the same placements of three and of five pieces.
ROUND = math.perm(64, 5)


@pytest.fixture(scope="module")
def tables(spark, sf, tmp_path_factory):
    """Some line items, and the same with a copy whose order keys are a round further on."""
    near, both = (str(tmp_path_factory.mktemp(name)) for name in ("near", "both"))
    li = spark.read.parquet(f"{sf}/lineitem.parquet").where("l_orderkey < 60")
    li.write.parquet(f"{near}/lineitem.parquet")
    li.unionByName(li.withColumn("l_orderkey", F.col("l_orderkey") + ROUND)).write.parquet(f"{both}/lineitem.parquet")
    return near, both


def same_but_for_keys(spark, tables, name):
    """Rows of the near line items, then of both: the copies' ids are a round further on, and all else is the same."""
    near, both = ([tuple(r) for r in registry.queries()[name](spark, d).collect()] for d in tables)
    return near and sorted(both) == sorted(near + [(r[0] + ROUND * 10**12, *r[1:]) for r in near])


def test_ids_are_long_while_they_fit(spark, tables):
    assert [registry.queries()["a1_unrank"](spark, d).schema["id"].dataType.simpleString() for d in tables] == ["bigint", "decimal(38,0)"]


def test_a20_fen_beyond_64_bits(spark, tables):
    assert same_but_for_keys(spark, tables, "a20_fen")


def test_a20_fen_once_a_placement(spark, tables, monkeypatch):
    seen, with_fen = [], E.with_fen
    monkeypatch.setattr(E, "with_fen", lambda df, *rest: seen.append(df) or with_fen(df, *rest))
    rows = registry.queries()["a20_fen"](spark, tables[1]).count()
    assert len(seen) == 1 and seen[0].count() * 2 <= rows


def test_fen_of_any_board(spark):
    """Full ranks, empty ones, corners, a piece off the board and two on one square (the first one counts)."""
    boards = {"start": [4, 2, 3, 5, 6, 3, 2, 4] + [1] * 8 + [0] * 32 + [7] * 8 + [10, 8, 9, 11, 12, 9, 8, 10], "empty": [0] * 64, "corners": [6] + [0] * 62 + [12]}
    df = spark.createDataFrame(list(boards.items()), "name string, board array<int>")
    out = {r["name"]: r for r in E.with_fen_pieces(E.with_fen(df, "board"), "fen").collect()}
    assert {k: r["fen"] for k, r in out.items()} == {"start": "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR", "empty": "8/8/8/8/8/8/8/8", "corners": "7k/8/8/8/8/8/8/K7"}
    assert all([tuple(p) for p in out[k]["pieces"]] == [(q, c) for q, c in enumerate(b) if c] for k, b in boards.items())
    men = spark.createDataFrame([(6, 1, 5, 4, 1, -1, 6, 0, 5), (6, 1, 0, 1, 0, 62, 6, 0, 63)], ", ".join(f"t{i} int, c{i} int, s{i} int" for i in range(3)))
    got = [r["board"] for r in E.with_board(men, 3).select("board").collect()]
    assert got == [r["b"] for r in men.select(E.board_array(E.Slot.of(3)).alias("b")).collect()] and sum(map(bool, got[0])) == 1


def test_c11_encode_five_beyond_64_bits(spark, tables):
    assert same_but_for_keys(spark, tables, "c11_encode_five")


def test_c10_encode_v2_beyond_64_bits(spark, tables):
    assert same_but_for_keys(spark, tables, "c10_encode_v2")


def test_c10_encode_v2_once_a_position(spark, tables, monkeypatch):
    seen, encode = [], E.encode
    monkeypatch.setattr(E, "encode", lambda df, *rest, **more: seen.append(df) or encode(df, *rest, **more))
    rows = registry.queries()["c10_encode_v2"](spark, tables[1]).count()
    assert len(seen) == 1 and seen[0].count() * 2 <= rows
