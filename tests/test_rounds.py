"""Iterative jobs: backups over trees, refit rounds, manifests in the writing pass, adjacency channels."""

import random

import pytest
from pyspark.sql import functions as F

from mateframe import registry
from mateframe.operators import backup as D
from mateframe.operators import encode as E
from mateframe.operators import ml
from mateframe.operators import shards as H


def value(node, maximise, children, scores, plies):
    below = children.get(node, [])
    if not below or plies == 0:
        return scores.get(node, 0.0)
    return (max if maximise else min)(value(c, not maximise, children, scores, None if plies is None else plies - 1) for c in below)


def test_backup_over_a_random_graph(spark):
    """Nodes with several parents, on both sides to move, leaves at all depths, missing scores, repeated edges."""
    rng = random.Random(3)
    edges = [(f"n{rng.randrange(i)}", f"n{i}") for i in range(1, 40)] + [(f"n{a}", f"n{a + rng.randrange(1, 9)}") for a in range(0, 30, 3)]
    scores = {f"n{i}": round(rng.uniform(-9, 9), 3) for i in range(0, 125) if i % 7}
    children = {}
    for a, b in edges:
        children.setdefault(a, []).append(b)
    table = spark.createDataFrame([*edges, edges[4], (None, "n3"), ("n3", None)], "parent string, child string")
    roots = [("n0", True), ("n0", False), ("n5", True), ("alone", False)]
    got = D.backups(spark.createDataFrame(roots, "node string, maximise boolean"), table, spark.createDataFrame(list(scores.items()), "node string, value double"), [0, 2, None])
    rows = {(r["node"], r["maximise"], r["plies"]): r["value"] for r in got.collect()}
    assert rows == {(n, m, p): value(n, m, children, scores, p) for n, m in roots for p in (0, 2, None)}


def test_backup_stops_and_plans_stay_small(spark):
    chain = spark.range(9).select(F.col("id").cast("string").alias("parent"), (F.col("id") + 1).cast("string").alias("child"))
    scores = spark.createDataFrame([("9", 5.0), ("3", 2.0)], "node string, value double")
    root = spark.createDataFrame([("0", True)], "node string, maximise boolean")
    levels, between = D.descend(root, chain, scores)
    assert len(levels) == 10 and len(between) == 9
    found = D.backup(root, chain, scores, plies=3)
    assert found.first()["value"] == 2.0 and "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert D.backup(root.where("false"), chain, scores).count() == 0


def test_refit_rounds(spark):
    """Training rows grow by the wrong ones; what a round reads is a written table, however many rounds were before."""
    rng = random.Random(1)
    rows = [(i, [rng.random(), rng.random()], rng.randrange(2) if i % 5 == 0 else int(i % 2)) for i in range(200)]
    rows = [(i, [x[0] + y, x[1]], y) for i, x, y in rows]
    df = spark.createDataFrame(rows, "id long, x array<double>, y int")
    model, log = ml.refit_on_errors(df, label="y", key="id", rounds=3, copies=2)
    log = log.orderBy("round").collect()
    assert [r["round"] for r in log] == [0, 1, 2, 3] and log[0]["rows"] == 200
    assert all(b["rows"] == 200 + 2 * a["wrong"] for a, b in zip(log, log[1:]))
    wrong = ml.predict(model, df).where("pred <> y").count()
    assert wrong == log[-1]["wrong"]


@pytest.fixture
def vectors(spark):
    return spark.createDataFrame([(f"c{i % 3}", i * 2, [0.5] * (4 + i % 2)) for i in range(50)], "config string, idx long, x array<float>").repartition(3)


def test_manifest_counts_what_was_written(spark, vectors, tmp_path):
    """One pass over the input: every row passes the counter once."""
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    row = H.write_described(vectors.mapInArrow(seen, vectors.schema), str(tmp_path / "a"), "idx", "x", version="v4").first()
    assert row.asDict() == {"total_positions": 50, "configs": 3, "first_index": 0, "last_index": 98, "dims": 5, "dtype": "array<float>", "version": "v4"}
    assert reads.value == 50 and spark.read.parquet(str(tmp_path / "a/data")).count() == 50
    none = H.write_described(vectors.where("idx < 0"), str(tmp_path / "b"), "idx", "x").first()
    assert none["total_positions"] == 0 and none["first_index"] is None and none["dims"] is None


def test_adjacency(spark):
    """Against a dense tensor filled edge by edge."""
    rng = random.Random(9)
    edges = [(g, rng.randrange(18), rng.randrange(6), rng.randrange(6) + 30) for g in range(3) for _ in range(80)]
    got = E.adjacency(spark.createDataFrame([*edges, edges[0]], "g int, kind int, src int, dst int"), ["g"]).collect()
    want = {}
    for g, kind, a, b in edges:
        if kind < 16:
            want[g, kind, a, b] = 1.0
        dx, dy = b % 8 - a % 8, b // 8 - a // 8
        for i, w in enumerate((dx / 7, dy / 7, (abs(dx) + abs(dy)) / 14, max(abs(dx), abs(dy)) / 7)):
            want[g, 16 + i, a, b] = w
    assert len(got) == len(want) and all(abs(want[r["g"], r["channel"], r["src"], r["dst"]] - r["w"]) < 1e-9 for r in got)


@pytest.mark.parametrize("plies", [[0, 1, 3], [2, 30], [1, None]])
def test_backup_with_scores_beside_the_edges(spark, plies):
    """Depths inside the graph, beyond it and to its leaves; edges bring their child's score, missing ones too."""
    rng = random.Random(5)
    edges = [(f"n{rng.randrange(i)}", f"n{i}") for i in range(1, 30)] + [(f"n{a}", f"n{a + rng.randrange(1, 6)}") for a in range(0, 24, 3)]
    scores = {f"n{i}": round(rng.uniform(-9, 9), 3) for i in range(40) if i % 6}
    children = {}
    for a, b in edges:
        children.setdefault(a, []).append(b)
    table = spark.createDataFrame([(a, b, scores.get(b)) for a, b in [*edges, edges[4]]], "parent string, child string, value double")
    roots = [("n0", True), ("n0", False), ("n2", True), ("alone", False)]
    own = spark.createDataFrame([(n, scores[n]) for n in ("n2",)], "node string, value double")
    got = D.backups(spark.createDataFrame(roots, "node string, maximise boolean"), table, own, plies).collect()
    assert len(got) == len(roots) * len(plies)
    assert {(r["node"], r["maximise"], r["plies"]): r["value"] for r in got} == {(n, m, p): value(n, m, children, scores, p) for n, m in roots for p in plies}


def test_depth_query_stores_no_row_per_leaf(spark, sf, monkeypatch):
    sizes, stored = [], D.stored
    monkeypatch.setattr(D, "stored", lambda df, name: sizes.append(stored(df, name)) or sizes[-1])
    assert registry.queries()["e15_depth"](spark, sf).count() == 100
    rows = {t: spark.read.parquet(f"{sf}/{t}.parquet").count() for t in ("orders", "lineitem")}
    assert sizes and max(t.count() for t in sizes) <= rows["orders"] < rows["lineitem"]
