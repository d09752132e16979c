"""Queries over sources, sinks, moves, models and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import board as B
from ..functions.board import Slot
from ..functions.storage import scratch as _place
from ..functions.storage import stored
from ..operators import encode as E
from ..operators import evaluate as V
from ..operators import ml
from ..operators import search as M
from ..operators import shards as H
from ..operators import universe as U
from ..operators.ranks import sized
from ..sources import logs, npz
from ..streaming import streams
from .audit import event_classes
from .common import CANONICAL, CUSTOMER_POS, LEGAL, POS, SQL_CHANNELS as _CHANNELS, customer_placements, indexed, placements, ranked_placements, sql_attack, sql_key, table


def a9_available(spark, d):
    names = F.concat(F.element_at(F.array(F.lit("KQvK"), F.lit("KRvK"), F.lit("KPvK")), (F.col("o_orderkey") % 3 + 1).cast("int")), F.when(F.col("o_orderkey") % 2 == 0, "_canonical.npz").otherwise(".npz"))
    o = table(spark, d, "orders").select(names.alias("name"))
    return o.groupBy(logs.configs_of_files(F.col("name")).alias("config"), F.col("name").contains("_canonical").alias("canonical")).agg(F.count("*").alias("n"))


def a11_npz(spark, d):
    """Vectors to archives and back."""
    v = table(spark, d, "embeddings").select(F.col("embedding").alias("x"), (F.col("label") % 3).cast("int").alias("wdl"), F.col("vec_id").cast("int").alias("dtz"))
    path = _place(spark, "npz")
    npz.write(v, path).agg(F.sum("rows")).collect()
    return npz.read(spark, path).groupBy("wdl").agg(F.count("*").alias("n"), F.sum("dtz").alias("dtz"), F.max(F.size("x")).alias("width"))


def a11_graph(spark, d):
    """Boards that customers name, as graph archives and back: pieces, node features and edges of each."""
    legal = U.positions(customer_placements(spark, d), 3)
    path = _place(spark, "graphs")
    g = E.graphs(legal, 3, ["id", "turn"]).select("p_ids", "node_tac", "edges", "edge_counts", (F.col("id") % 5 - 2).cast("int").alias("wdl"), F.col("id").cast("int").alias("dtz"), "turn")
    npz.write(g, path, 1000, "graph").agg(F.sum("rows")).collect()
    text = lambda c: F.md5(F.array_join(F.col(c).cast("array<string>"), ",").cast("binary")).alias(c)
    return npz.read(spark, path, "graph").select(F.col("dtz").cast("long").alias("id"), "turn", "wdl", "edge_counts", text("p_ids"), text("node_tac"), text("edges"))


def a12_union(spark, d):
    li = table(spark, d, "lineitem")
    paths = [_place(spark, "part") for _ in range(2)]
    for i, p in enumerate(paths):
        li.where(F.col("l_linenumber") % 2 == i).select("l_orderkey", "l_returnflag").write.parquet(p)
    return spark.read.parquet(*paths).groupBy("l_returnflag").agg(F.count("*").alias("n"))


def a13_shards(spark, d):
    """Shards of at most 2,000 rows per configuration, then their sizes."""
    path = _place(spark, "shards")
    # a configuration may hold most rows, so hash buckets deal it over tasks
    H.write_shards(indexed(spark, d).select("config", "id", "idx", "turn").repartition("config", F.pmod(F.xxhash64("id"), F.lit(16))), path, 2000, "config")
    files = spark.read.parquet(path).groupBy("config", F.input_file_name().alias("f")).agg(F.count("*").alias("n"))
    return files.groupBy("config").agg(F.sum("n").alias("rows"), (F.max("n") <= 2000).alias("bounded"))


def a14_combine(spark, d):
    """Chunk files combined into fewer, of a bounded number of rows: same rows."""
    parts, whole = _place(spark, "chunks"), _place(spark, "combined")
    table(spark, d, "orders").select("o_orderkey", "o_orderpriority").repartition(6, "o_orderkey").write.parquet(parts)
    # files of an even, advised size by adaptive execution; the bound on rows holds besides
    spark.read.parquet(parts).hint("rebalance").write.option("maxRecordsPerFile", 1_000_000).parquet(whole)
    return spark.read.parquet(whole).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


def a15_manifest(spark, d):
    """A data set's description, counted while it is written."""
    v = table(spark, d, "embeddings").select(F.col("label").alias("config"), "vec_id", "embedding")
    return H.write_described(v, _place(spark, "manifest"), "vec_id", "embedding", version="v4", canonical="auto", enumeration="permutation")


def a16_resume(spark, d):
    """A run that maps some customers, and one that takes up the rest and appends it; nobody is mapped twice."""
    path, o = _place(spark, "mapped"), table(spark, d, "orders")
    mapped = lambda rows, run: rows.groupBy("o_custkey").agg(F.count("*").alias("orders")).withColumn("run", F.lit(run))
    mapped(o.where("o_custkey % 3 = 0"), 1).write.parquet(path)
    return H.resume(o, path, "o_custkey", lambda rest: mapped(rest, 2)).groupBy("run").agg(F.count("*").alias("customers"), F.sum("orders").alias("orders"))


def a17_training_log(spark, d):
    """Log lines built from events, parsed back."""
    v = F.format_string("%s - Epoch %d/100 - Train Loss: %s - Val Loss: %s - Val Acc: %s - LR: 1e-3", F.lit("12:00"), F.col("event_id") % 100, F.col("value").cast("string"), (F.col("event_id") % 7).cast("string"), (F.col("event_id") % 11).cast("string"))
    rows = logs.training_log(table(spark, d, "events").select(v.alias("value")))
    return rows.groupBy(F.col("epoch").cast("int").alias("epoch")).agg(F.round(F.max("train_loss"), 4).alias("loss"), F.sum("val_loss").alias("val_loss"), F.sum("val_acc").alias("val_acc"))


def a18_engine(spark, d):
    """Scores read from engine output that stands at the end of long texts."""
    k = F.col("n_chars")
    line = F.when(k % 3 == 0, F.concat(F.lit("Final evaluation +"), (k % 100).cast("string"), F.lit(".25 (white side)"))).when(k % 3 == 1, F.concat(F.lit("info depth 1 score cp -"), k.cast("string"), F.lit(" nodes 1"))).otherwise("info score mate -3")
    return table(spark, d, "documents").select("doc_id", logs.engine_score(F.concat_ws("\n", "text", line)).alias("cp"))


def a19_result_map(spark, d):
    path = _place(spark, "results")
    acc = event_classes(spark, d).groupBy((F.col("user_id") % 5).cast("string").alias("config")).agg(F.count_if(F.col("true") == F.col("pred")).alias("hit"), F.count("*").alias("samples"))
    row = acc.select(F.struct("config", F.struct((F.col("hit") / F.col("samples")).alias("accuracy"), F.col("samples")).alias("r")).alias("e"))
    row.agg(F.to_json(F.map_from_entries(F.collect_list("e"))).alias("value")).write.text(path)
    return logs.result_map(spark, path).select("config", F.round("accuracy", 6).alias("accuracy"), "samples")


def a21_evaluations(spark, d):
    path = _place(spark, "evals")
    fen = F.concat(F.lit("8/8/8/8/8/8/8/K1k5 "), F.when(F.col("event_id") % 2 == 0, "w").otherwise("b"), F.lit(" - - 0 1"))
    table(spark, d, "events").select(fen.alias("fen"), (F.col("value") - 50).alias("cp")).write.json(path)
    return logs.evaluations(spark, path).groupBy("turn", "wdl_class", "source").agg(F.count("*").alias("n"))


def a22_report(spark, d):
    path = _place(spark, "report")
    V.micro_and_macro(table(spark, d, "orders"), "o_orderpriority", F.col("o_totalprice") > 150000).coalesce(1).write.option("header", True).csv(path)
    return spark.read.schema("config string, correct long, total long, accuracy double").option("header", True).csv(path)


def _legal(spark, d):
    return U.positions(placements(spark, d), 3)


def _named(spark, d):
    """Legal positions that line items name, each once, and how many name it (lines); side to move in mover too.

    There are at most 2 x 3 x 249,984, so moves are worked out for no more, however long the table is.
    """
    ranks = indexed(spark, d).groupBy("config", "idx", "turn").agg(F.count("*").alias("lines"))
    return U.positions(ranked_placements(ranks), 3).withColumn("mover", F.col("turn"))


def b5_terminal(spark, d):
    return M.terminal(_named(spark, d), 3, ["config", "idx", "mover"]).groupBy("config", "turn", "checked").agg(F.sum("lines").alias("n"))


def _tactical(version):
    def query(spark, d):
        x = E.encode(_legal(spark, d), 3, version).select("config", "x")
        return x.groupBy("config").agg(F.count("*").alias("n"), F.max(F.size("x")).alias("width"), F.round(F.sum(F.aggregate("x", F.lit(0.0), lambda a, b: a + b)), 3).alias("total"))

    return query


def c19_moves(spark, d):
    captured = F.when(F.col("taken").isNotNull(), F.col("lines")).otherwise(0)
    return M.successors(_named(spark, d), 3, ["config", "lines"]).groupBy("config", "slot").agg(F.sum("lines").alias("moves"), F.sum(captured).alias("captures"))


def c20_channels(spark, d):
    """Influence and x-ray edges of all pieces: nothing, or exactly one piece, in between."""
    return E.attack_edges(placements(spark, d), 3, ["id"], xray=True).select("id", "channel", "src", "dst")


def c25_adjacency(spark, d):
    """Coordinates of a many-channel adjacency: a row per channel, source and destination."""
    e = E.attack_edges(placements(spark, d), 3, ["id", "config"])
    w = E.edge_weights(F.col("src"), F.col("dst"))
    channels = F.array(*[F.struct(F.lit(16 + i).alias("channel"), x.alias("w")) for i, x in enumerate(w)])
    tall = e.select("config", "id", "src", "dst", F.inline(channels))
    return tall.groupBy("config", "channel").agg(F.count("*").alias("n"), F.round(F.sum("w"), 3).alias("w"))


def c25_channels(spark, d):
    """All coordinates of the 20 channels, of positions that customers name: influence in channel 1, x-rays in 2."""
    e = E.attack_edges(customer_placements(spark, d), 3, ["id"], xray=True).withColumnRenamed("channel", "kind")
    return E.adjacency(e, ["id"]).select("id", "channel", F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst"), F.round("w", 6).alias("w"))


def d4_successors(spark, d):
    """Children per position: counted once for all line items that name it."""
    of = ["config", "idx", "mover"]
    counts = stored(M.successors(_named(spark, d), 3, of).groupBy(*of).agg(F.count("*").alias("children")), "children")
    lines = indexed(spark, d).withColumnRenamed("turn", "mover")
    return lines.join(sized(counts), of).groupBy("id").agg(F.sum("children").alias("children"))


def h1_sample(spark, d):
    """The first 500 canonical positions in shuffled order, each once, among the first 200,000 places tried."""
    place = U.full_cycle(F.col("idx"), 777, 100003, 249984)
    tried = U.canonical(_legal(spark, d).withColumn("place", place).where("place < 200000"), 3)
    keyed = tried.select("id", "config", "turn", "place", B.packed(Slot.of(3), F.col("turn")).alias("key"))
    once = keyed.groupBy("key").agg(F.min(F.struct("place", "id", "config", "turn")).alias("r"))
    return once.select("r.*").orderBy("place", "id").limit(500).select("id", "config", "turn")


def _vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), (F.col("label") % 3).cast("int").alias("label"))


def j1_score(spark, d):
    """A linear model opened once per task."""
    def load():
        import numpy as np

        w = np.random.default_rng(3).normal(size=(64, 3))

        def run(x):
            z = np.exp(x @ w - (x @ w).max(axis=1, keepdims=True))
            return z / z.sum(axis=1, keepdims=True)

        return run

    return ml.score(_vectors(spark, d), load, key="vec_id").select("vec_id", "pred")


def j2_fit(spark, d):
    v = _vectors(spark, d)
    return ml.predict(ml.fit(v, label="label"), v).groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("pred") == F.col("label")).alias("correct"))


def j2_distance(spark, d):
    """The regressor beside the classifier: a distance from vectors, and its mean error by class."""
    v = _vectors(spark, d).withColumn("dtz", (F.col("vec_id") % 50).cast("double"))
    found = ml.fit_distance(v, label="dtz").transform(ml.features(v))
    return found.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("prediction") - F.col("dtz"))), 4).alias("mae"))


def j3_refit(spark, d):
    """Rounds of fitting with the wrong rows joined in: rows trained on and rows wrong, per round."""
    return ml.refit_on_errors(_vectors(spark, d), label="label", key="vec_id")[1]


def j4_sweep(spark, d):
    v = _vectors(spark, d)
    best = ml.sweep(v, label="label").bestModel
    return ml.predict(best, v).agg(F.count("*").alias("n"), F.count_if(F.col("pred") == F.col("label")).alias("correct"))


def _events_stream(spark, d):
    """Events in files, read as a stream."""
    path = _place(spark, "events")
    e = table(spark, d, "events")
    e.repartition(4, "event_id").write.parquet(path)
    return streams.shards(spark, path, e.schema, 1)


def k1_shards(spark, d):
    out = streams.drain(_events_stream(spark, d), _place(spark, "k1"), _place(spark, "cp"), "append")
    return out.groupBy("event_type").agg(F.count("*").alias("n"))


def _arriving(spark, rows, time, run):
    """Rows as files that arrive in four slices of time, with a stream over them that ``run`` starts anew after each."""
    path = _place(spark, "arriving")
    streams.in_slices(spark, rows, time, path, 4, lambda k: run(streams.shards(spark, path, rows.schema, 1 << 20)))


def k2_totals(spark, d):
    """Counts that each batch brings up to date, over four restarts."""
    path, checkpoint, e = _place(spark, "k2"), _place(spark, "cp"), table(spark, d, "events")
    _arriving(spark, e, "ts", lambda stream: streams.live_totals(stream, "event_type", path, checkpoint).awaitTermination())
    return streams.latest(spark, path, streams.totals(e, "event_type").schema)


def k3_metrics(spark, d):
    """Lines of a live log, each with the best so far and the change to the line before in its run, across batches and restarts."""
    path, checkpoint = _place(spark, "k3"), _place(spark, "cp")
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "value")
    _arriving(spark, e, "ts", lambda stream: streams.live_log(stream, path, checkpoint, run="user_id", order=["ts", "event_id"], metrics=["value"], lead="value").awaitTermination())
    return streams.log_lines(spark, path, e.schema, ["value"]).select("event_id", "user_id", "best", "better", F.round("delta_value", 4).alias("delta"))


def k3_log(spark, d):
    """The same over text lines of training runs, parsed as they arrive."""
    path, checkpoint, k = _place(spark, "k3"), _place(spark, "cp"), F.col("event_id")
    acc = F.concat(F.lit("0."), F.lpad((k * 7919 % 1000).cast("string"), 3, "0"))
    line = F.concat(F.date_format("ts", "HH:mm:ss"), F.lit(" | Epoch "), (k % 7).cast("string"), F.lit(" | Batch "), k.cast("string"), F.lit(" | Loss: "), F.col("value").cast("string"), F.lit(" (+0.0) | Acc: "), acc, F.lit(" (+0.0) | MAE: "), (k % 13).cast("string"), F.lit(".5 (-0.1)"))
    e = table(spark, d, "events").select("event_id", "user_id", "ts", line.alias("value"))
    parsed = logs.metric_log(e)
    metrics = ["loss", "acc", "mae"]
    _arriving(spark, e, "ts", lambda stream: streams.live_log(logs.metric_log(stream), path, checkpoint, run="user_id", order=["ts", "event_id"], metrics=metrics, lead="acc").awaitTermination())
    return streams.log_lines(spark, path, parsed.schema, metrics).select("event_id", "elapsed", F.col("epoch").cast("int").alias("epoch"), "best", "better", *[F.round(f"delta_{m}", 4).alias(f"delta_{m}") for m in metrics])


def k4_dedup(spark, d):
    s = _events_stream(spark, d).select("user_id", "event_type")
    return streams.drain(streams.distinct_keys(s, ["user_id", "event_type"]), _place(spark, "k4"), _place(spark, "cp"), "append")


def k4_event_time(spark, d):
    """Events of which every third is sent again half an hour later: each once, with a state of two hours."""
    path, checkpoint, e = _place(spark, "k4"), _place(spark, "cp"), table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    again = e.where("event_id % 3 = 0").withColumn("ts", F.col("ts") + F.expr("INTERVAL 30 MINUTES"))
    found = []
    _arriving(spark, e.unionByName(again), "ts", lambda stream: found.append(streams.drain(streams.distinct_keys(stream, ["event_id"], "ts", "2 hours"), path, checkpoint, "append")))
    return found[-1].select("event_id", "user_id")


_EV = "ev AS (SELECT event_id, user_id, value, event_id % 3 AS t, CASE WHEN value - 50 > 25 THEN 2 WHEN value - 50 < -25 THEN 0 ELSE 1 END AS p FROM events)"
_MICRO = "WITH g AS (SELECT o_orderpriority AS config, CAST(count(*) FILTER (o_totalprice > 150000) AS BIGINT) AS correct, count(*) AS total FROM orders GROUP BY 1) SELECT config, correct, total, round(CAST(correct AS DOUBLE) / total, 6) AS accuracy FROM g UNION ALL SELECT 'micro', CAST(sum(correct) AS BIGINT), CAST(sum(total) AS BIGINT), round(CAST(sum(correct) AS DOUBLE) / sum(total), 6) FROM g UNION ALL SELECT 'macro', CAST(sum(correct) AS BIGINT), CAST(sum(total) AS BIGINT), round(avg(CAST(correct AS DOUBLE) / total), 6) FROM g"

QUERIES = {
    "a9_available": (a9_available, "SELECT CASE o_orderkey % 3 WHEN 0 THEN 'KQvK' WHEN 1 THEN 'KRvK' ELSE 'KPvK' END AS config, o_orderkey % 2 = 0 AS canonical, count(*) AS n FROM orders GROUP BY 1, 2"),
    "a11_npz": (a11_npz, "SELECT CAST(label % 3 AS INTEGER) AS wdl, count(*) AS n, CAST(sum(vec_id) AS BIGINT) AS dtz, CAST(max(len(embedding)) AS INTEGER) AS width FROM embeddings GROUP BY 1"),
    "a11_graph": (a11_graph, f"""WITH {CUSTOMER_POS}, l AS (SELECT * FROM p WHERE {LEGAL}), e AS ({_CHANNELS.replace("FROM p,", "FROM l AS p,")}),
es AS (SELECT id, count(*) AS n, array_to_string(list(channel * 4096 + src * 64 + dst ORDER BY channel * 4096 + src * 64 + dst), ',') AS edges FROM e GROUP BY id),
a AS (SELECT id, turn, q, s0, s1, s2, t1, CAST({sql_attack(0, "q")} AS INT) + CAST({sql_attack(1, "q")} AS INT) AS w, CAST({sql_attack(2, "q")} AS INT) AS b,
    CASE WHEN {sql_attack(0, "q")} OR {sql_attack(2, "q")} THEN 32 ELSE 0 END | CASE WHEN {sql_attack(1, "q")} THEN CAST(power(2, t1 - 1) AS INTEGER) ELSE 0 END AS m,
    CASE WHEN q IN (s0, s1) THEN 1 WHEN q = s2 THEN 0 ELSE turn END AS who, CASE WHEN q = s0 THEN 6 WHEN q = s1 THEN t1 WHEN q = s2 THEN 12 ELSE 0 END AS code FROM l, range(64) t(q)),
f AS (SELECT *, CASE WHEN who = 1 THEN b ELSE w END AS theirs, CASE WHEN who = 1 THEN w ELSE b END AS ours FROM a),
g AS (SELECT *, CASE WHEN (turn = 1 AND q = s0 AND b > 0) OR (turn = 0 AND q = s2 AND w > 0) THEN 1 ELSE 0 END + CASE WHEN theirs = 0 THEN 4 ELSE 0 END
    + CASE WHEN code > 0 AND theirs > 0 AND ours = 0 THEN 8 ELSE 0 END + CASE WHEN ours > 0 THEN 16 ELSE 0 END AS flags FROM f),
ns AS (SELECT id, turn, array_to_string(list(code ORDER BY q), ',') AS p_ids, array_to_string(list(concat_ws(',', w, b, m, flags) ORDER BY q), ',') AS node_tac FROM g GROUP BY id, turn)
SELECT ns.id, turn, CAST(ns.id % 5 - 2 AS INTEGER) AS wdl, CAST(n AS INTEGER) AS edge_counts, md5(p_ids) AS p_ids, md5(node_tac) AS node_tac, md5(edges) AS edges FROM ns JOIN es ON ns.id = es.id"""),
    "a12_union": (a12_union, "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1"),
    "a13_shards": (a13_shards, f"WITH {POS} SELECT config, count(*) AS rows, true AS bounded FROM ix GROUP BY 1"),
    "a14_combine": (a14_combine, "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1"),
    "a15_manifest": (a15_manifest, "SELECT count(*) AS total_positions, count(DISTINCT label) AS configs, min(vec_id) AS first_index, max(vec_id) AS last_index, CAST(max(len(embedding)) AS INTEGER) AS dims, 'array<float>' AS dtype, 'v4' AS version, 'auto' AS canonical, 'permutation' AS enumeration FROM embeddings"),
    "a16_resume": (a16_resume, "SELECT CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE 2 END AS run, count(DISTINCT o_custkey) AS customers, count(*) AS orders FROM orders GROUP BY 1"),
    "a17_training_log": (a17_training_log, "SELECT CAST(event_id % 100 AS INTEGER) AS epoch, round(max(value), 4) AS loss, CAST(sum(event_id % 7) AS DOUBLE) AS val_loss, CAST(sum(event_id % 11) AS DOUBLE) AS val_acc FROM events GROUP BY 1"),
    "a18_engine": (a18_engine, "SELECT doc_id, CAST(CASE n_chars % 3 WHEN 0 THEN (n_chars % 100) * 100 + 25 WHEN 1 THEN -n_chars ELSE -10000 END AS INTEGER) AS cp FROM documents"),
    "a19_result_map": (a19_result_map, f"WITH {_EV} SELECT CAST(user_id % 5 AS VARCHAR) AS config, round(avg(CASE WHEN t = p THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS samples FROM ev GROUP BY 1"),
    "a21_evaluations": (a21_evaluations, f"WITH {_EV} SELECT CAST(CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS turn, CASE WHEN value - 50 > 50 THEN 2 WHEN value - 50 < -50 THEN 0 ELSE 1 END AS wdl_class, 'eval' AS source, count(*) AS n FROM ev GROUP BY 1, 2"),
    "a22_report": (a22_report, _MICRO),
    "b5_terminal": (b5_terminal, None),
    "c12_encode_v6": (_tactical(6), None),
    "c13_encode_v7": (_tactical(7), None),
    "c19_moves": (c19_moves, None),
    "c20_channels": (c20_channels, f"WITH {POS} {_CHANNELS}"),
    "c25_adjacency": (c25_adjacency, f"""WITH {POS}, e AS ({" UNION ALL ".join(f"SELECT config, s{i} AS a, q AS b FROM p, range(64) t(q) WHERE {sql_attack(i, 'q')}" for i in range(3))}),
w AS (SELECT config, unnest([16, 17, 18, 19]) AS channel, unnest([CAST(b % 8 - a % 8 AS DOUBLE) / 7, CAST(b // 8 - a // 8 AS DOUBLE) / 7, CAST(abs(b % 8 - a % 8) + abs(b // 8 - a // 8) AS DOUBLE) / 14, CAST(greatest(abs(b % 8 - a % 8), abs(b // 8 - a // 8)) AS DOUBLE) / 7]) AS w FROM e)
SELECT config, channel, count(*) AS n, round(sum(w), 3) AS w FROM w GROUP BY 1, 2"""),
    "c25_channels": (c25_channels, f"""WITH {CUSTOMER_POS}, e AS ({_CHANNELS}),
g AS (SELECT DISTINCT id, src, dst, src % 8 AS x, src // 8 AS y, dst % 8 AS u, dst // 8 AS v FROM e)
SELECT DISTINCT id, CAST(channel AS INTEGER) AS channel, src, dst, 1.0::DOUBLE AS w FROM e
UNION ALL SELECT id, CAST(16 + i AS INTEGER) AS channel, src, dst, round(CASE i WHEN 0 THEN CAST(u - x AS DOUBLE) / 7 WHEN 1 THEN CAST(v - y AS DOUBLE) / 7 WHEN 2 THEN CAST(abs(u - x) + abs(v - y) AS DOUBLE) / 14 ELSE CAST(greatest(abs(u - x), abs(v - y)) AS DOUBLE) / 7 END, 6) AS w FROM g, range(4) t(i)"""),
    "d4_successors": (d4_successors, None),
    "h1_sample": (h1_sample, f"WITH {POS}, k AS (SELECT id, config, turn, (777 + idx * 100003) % 249984 AS place, {sql_key(0)} AS key FROM p WHERE {LEGAL} AND {sql_key(0)} = {CANONICAL} AND (777 + idx * 100003) % 249984 < 200000) SELECT id, config, turn FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY place, id) AS r FROM k) WHERE r = 1 ORDER BY place, id LIMIT 500"),
    "j1_score": (j1_score, None),
    "j2_fit": (j2_fit, None),
    "j2_distance": (j2_distance, None),
    "j3_refit": (j3_refit, None),
    "j4_sweep": (j4_sweep, None),
    "k1_shards": (k1_shards, "SELECT event_type, count(*) AS n FROM events GROUP BY 1"),
    "k2_totals": (k2_totals, "SELECT event_type, count(*) AS n FROM events GROUP BY 1"),
    "k3_metrics": (k3_metrics, "WITH w AS (SELECT event_id, user_id, value, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS best, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT event_id, user_id, best, past IS NULL OR value > past AS better, round(coalesce(value - before, 0), 4) AS delta FROM w"),
    "k3_log": (k3_log, """WITH e AS (SELECT *, CAST(event_id * 7919 % 1000 AS DOUBLE) / 1000 AS acc, CAST(event_id % 13 AS DOUBLE) + 0.5 AS mae FROM events),
w AS (SELECT *, max(acc) OVER r AS best, max(acc) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past, lag(value) OVER r AS l, lag(acc) OVER r AS a, lag(mae) OVER r AS m FROM e WINDOW r AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, CAST(extract(hour FROM ts) * 3600 + extract(minute FROM ts) * 60 + floor(extract(second FROM ts)) AS INTEGER) AS elapsed, CAST(event_id % 7 AS INTEGER) AS epoch, best, past IS NULL OR acc > past AS better,
round(coalesce(value - l, 0), 4) AS delta_loss, round(coalesce(acc - a, 0), 4) AS delta_acc, round(coalesce(mae - m, 0), 4) AS delta_mae FROM w"""),
    "k4_dedup": (k4_dedup, "SELECT DISTINCT user_id, event_type FROM events"),
    "k4_event_time": (k4_event_time, "SELECT event_id, user_id FROM events"),
}
