"""Archives of vectors and of graphs, and log lines, written and read back."""

import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from mateframe.functions.board import Slot
from mateframe.operators import encode as E
from mateframe.operators import evaluate as V
from mateframe.operators import ml
from mateframe.operators import universe as U
from mateframe.sources import logs, npz


def arrays(path):
    """All archives of a folder, as NumPy reads them."""
    return [dict(np.load(io.BytesIO(p.read_bytes()))) for p in sorted(path.glob("*.npz"))]


def test_vectors(spark, tmp_path):
    rows = [([i / 2, 1.0, float(-i)], i % 5 - 2, (i - 50) * (1000 if i > 90 else 1)) for i in range(100)]
    files = npz.write(spark.createDataFrame(rows, "x array<float>, wdl int, dtz int").coalesce(1), str(tmp_path / "v"), 30).collect()
    assert sum(f["rows"] for f in files) == 100 and len(files) == 4
    kept = arrays(tmp_path / "v")
    assert {a["x"].dtype for a in kept} == {np.dtype(np.float32)} and {a["dtz"].dtype for a in kept} == {np.dtype(np.int16), np.dtype(np.int32)} and not list((tmp_path / "v").glob(".*npz-*"))
    back = sorted((r["dtz"], r["wdl"], list(r["x"])) for r in npz.read(spark, str(tmp_path / "v")).collect())
    assert back == sorted((d, w, x) for x, w, d in rows)
    only = npz.read(spark, str(tmp_path / "v")).select("wdl")
    assert only.count() == 100


def test_graphs(spark, tmp_path):
    """Boards as graphs: shapes and types of the arrays, padding, and each edge and node by the tall tables."""
    df = U.positions(U.enumerate_placements(spark, "KRvK", offset=70_000, limit=60, partitions=2), 3)
    g = E.graphs(df, 3, ["idx", "turn"]).select("p_ids", "node_tac", "edges", "edge_counts", F.lit(2).alias("wdl"), F.col("idx").cast("int").alias("dtz"), "turn")
    npz.write(g, str(tmp_path / "g"), 25, "graph").collect()
    for a in arrays(tmp_path / "g"):
        n = len(a["wdl"])
        assert a["p_ids"].shape == (n, 64) and a["node_tac"].shape == (n, 64, 4) and a["edges"].shape == (n, a["edge_counts"].max())
        assert [a[k].dtype for k in ("p_ids", "node_tac", "edges", "edge_counts", "wdl", "turn")] == [np.int8, np.uint8, np.uint16, np.uint16, np.int8, np.int8]
        assert all((row[c:] == 0).all() for row, c in zip(a["edges"], a["edge_counts"]))
    back = {(r["dtz"], r["turn"]): r for r in npz.read(spark, str(tmp_path / "g"), "graph").collect()}
    edges, nodes = {}, {}
    for r in E.attack_edges(df, 3, ["idx", "turn"], xray=True).collect():
        edges.setdefault((r["idx"], r["turn"]), []).append(r["channel"] << 12 | r["src"] << 6 | r["dst"])
    for r in E.square_features(df, 3, ["idx", "turn"]).collect():
        nodes.setdefault((r["idx"], r["turn"]), {})[r["square"]] = [r["white_atk"], r["black_atk"], r["mask"], r["flags"]]
    boards = {(r["idx"], r["turn"]): r["b"] for r in df.select("idx", "turn", E.board_array(Slot.of(3)).alias("b")).collect()}
    assert back.keys() == boards.keys()
    for key, r in back.items():
        assert list(r["edges"]) == sorted(edges[key]) and r["edge_counts"] == len(edges[key]) and list(r["p_ids"]) == list(boards[key])
        assert list(r["node_tac"]) == [v for q in range(64) for v in nodes[key][q]]


def test_metric_lines(spark):
    lines = ["00:01:05 | Epoch 3 | Batch 100 | Loss: 0.5123 (-0.0100) | Acc: 0.9 (+0.1) | MAE: 3.25 (+0.00) | Speed: 12 pos/s", "LAUNCH COMMAND: x", "10:00:00 | Epoch 3 finished. Global Acc: 0.9", "x | Epoch 1 | Batch 2 | Loss: nan"]
    found = logs.metric_log(spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "n int, value string")).orderBy("n").collect()
    assert [tuple(r) for r in found] == [(0, 65, 3.0, 100.0, 0.5123, 0.9, 3.25), (3, None, 1.0, 2.0, None, None, None)]


def test_edges_beyond_the_bound(spark):
    edges = spark.createDataFrame([(b, k, s, d) for b in (1, 2) for k in (1, 2) for s in range(3) for d in range(b * 4)], "b int, kind int, src int, dst int")
    got = E.packed_edges(edges, "b", 10).groupBy("b").agg(F.array_sort(F.collect_list("edge")).alias("e")).collect()
    assert {r["b"]: list(r["e"]) for r in got} == {b: sorted(k << 12 | s << 6 | d for k in (1, 2) for s in range(3) for d in range(b * 4))[:10] for b in (1, 2)}


def test_widths_and_arity(spark):
    known = {(w, n, v) for w, n, v in E.widths()}
    assert {(43, 3, "v1"), (65, 4, "v1"), (91, 5, "v1"), (64, 3, "v2"), (107, 4, "v2"), (161, 5, "v2"), (46, 3, "v2_old"), (57, 3, "v6"), (92, 4, "v7"), (320, 5, "compact")} <= known
    got = {r["w"]: r["i"] for r in spark.createDataFrame([(w,) for w in (43, 45, 95, 1)], "w int").select("w", E.infer(F.col("w")).alias("i")).collect()}
    assert got[1] is None and got[43]["versions"] == ["v1"] and got[45]["versions"] == got[95]["versions"] == ["v4", "v5"] and got[95]["pieces"] == [5]
    labels = spark.createDataFrame([("a", -2), ("a", 0), ("a", None), ("b", 1), ("b", -2), (None, 2)], "t string, w int")
    assert {r["t"]: r["arity"] for r in V.label_arity(labels, "t", "w").collect()} == {"a": 3, "b": 5, None: 3}
    mapped = labels.select("t", "w", V.mapped_class(F.col("w"), F.when(F.col("t") == "b", 5).otherwise(3)).alias("c")).collect()
    assert [(r["w"], r["c"]) for r in mapped] == [(-2, 0), (0, 1), (None, None), (1, 3), (-2, 0), (2, 2)]


def test_product_and_grid(spark):
    a, b = spark.range(30), spark.range(4).withColumnRenamed("id", "k")
    assert V.product(a, b).count() == 120
    with pytest.raises(ValueError):
        V.product(a, b, most=100)
    vectors = spark.createDataFrame([(3, [0.35, 0.1]), (7, [0.71, 0.3]), (1, [0.9, 0.12])], "y int, x array<double>")
    scores = ml.grid_scores(vectors, label="y", x="x", scales=[10.0, 100.0])
    assert {(r["place"], r["scale"]): r["correct"] for r in scores.collect()} == {(0, 10.0): 2, (0, 100.0): 0, (1, 10.0): 1, (1, 100.0): 0}
    assert tuple(ml.best_of_grid(scores).first()) == (0, 10.0, 2)
    p = spark.createDataFrame([([1.0, 2.0, 3.0],)], "x array<double>").select(V.softmax(F.col("x")).alias("p")).first()["p"]
    want = np.exp([1.0, 2.0, 3.0]) / np.exp([1.0, 2.0, 3.0]).sum()
    assert np.allclose(p, want)
