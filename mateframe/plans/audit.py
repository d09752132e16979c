"""Queries that audit, balance, join and rank ordinary tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import backup as D
from ..operators import encode as E
from ..operators import evaluate as V
from ..operators import ml
from ..operators import shards as H
from ..operators.search import cascade_score
from ..functions.board import Slot, canonical_key
from .common import CANONICAL, POS, csv, customer_placements, placements, table


def predictions(spark, d):
    """Labels as truth, a rule on the text's length as prediction: doc_id, config, true, pred."""
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("config"), F.when(F.col("n_chars") > 900, 1).otherwise(0).alias("pred"))
    return table(spark, d, "labels").select("doc_id", F.col("quality").alias("true")).join(docs, "doc_id")


def event_classes(spark, d):
    """Events with three classes: the true one by id, the predicted one by value."""
    e = table(spark, d, "events")
    return e.select("event_id", "user_id", "ts", "value", (F.col("event_id") % 3).cast("int").alias("true"), V.threshold_class(F.col("value") - 50, 25).alias("pred"))


PRED = "pr AS (SELECT l.doc_id, d.lang AS config, l.quality AS true_, CASE WHEN d.n_chars > 900 THEN 1 ELSE 0 END AS pred FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"
EV = "ev AS (SELECT event_id, user_id, ts, value, CAST(event_id % 3 AS INTEGER) AS true_, CASE WHEN value - 50 > 25 THEN 2 WHEN value - 50 < -25 THEN 0 ELSE 1 END AS pred FROM events)"


def b7_mispredicted(spark, d):
    return predictions(spark, d).where(F.col("true") != F.col("pred")).select("doc_id", "true", "pred")


def b8_outliers(spark, d):
    """Line items far from the mean quantity of their part."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    mean = li.groupBy("l_partkey").agg(F.avg("l_quantity").alias("m"))
    return li.join(mean, "l_partkey").where(F.abs(F.col("l_quantity") - F.col("m")) > 20).groupBy("l_partkey").agg(F.count("*").alias("n"))


def b9_cascade(spark, d):
    """Rows wrong at depth 0, of those at depth 1, of those at depth 2; and each depth over all rows."""
    e = event_classes(spark, d)
    at = {0: F.col("pred"), 1: V.threshold_class(F.col("value") - 40, 25), 2: V.threshold_class(F.col("value") - 30, 20)}
    wrong = {k: F.col("true") != v for k, v in at.items()}
    return e.agg(F.count_if(wrong[0]).alias("wrong0"), F.count_if(wrong[0] & wrong[1]).alias("wrong01"), F.count_if(wrong[0] & wrong[1] & wrong[2]).alias("wrong012"), F.count_if(wrong[1]).alias("full1"), F.count_if(wrong[2]).alias("full2"))


def c24_batches(spark, d):
    """Graphs in batches of 32: node ids move by 64 per graph of the batch."""
    e = table(spark, d, "events").select("event_id", "user_id")
    row = F.col("event_id") % 32
    return e.select("event_id", F.floor(F.col("event_id") / 32).alias("batch"), (row * 64 + F.col("user_id") % 64).alias("src"), (row * 64 + F.col("event_id") % 64).alias("dst"))


def c26_pad(spark, d):
    x = F.transform("embedding", lambda v: v.cast("double"))
    v = table(spark, d, "embeddings").select("vec_id", F.slice(x, F.lit(1), (F.col("vec_id") % 5 + 2).cast("int")).alias("x"))
    widest = v.agg(F.max(F.size("x")).alias("w"))
    return v.crossJoin(F.broadcast(widest)).select("vec_id", csv(E.pad(F.col("x"), F.col("w"), keep_last=True)).alias("x"))


def c29_labels(spark, d):
    wdl = (F.col("event_id") % 5 - 2).cast("int")
    return table(spark, d, "events").select("event_id", *[V.label_class(wdl, r).alias(r) for r in ("sign", "floor", "exact", "else_win", "five")], V.threshold_class(F.col("value") - 50, 25).alias("by_value"))


def c30_white_view(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", V.white_view((k % 3).cast("int"), (k % 2).cast("int")).alias("white_class"))


def c31_softmax(spark, d):
    """Probabilities over a whole vector: the best class, the expected one, and that rounded half to even."""
    x = F.transform("embedding", lambda v: v.cast("double") * 5)
    p = table(spark, d, "embeddings").select("vec_id", V.softmax(x).alias("p"))
    expected = F.aggregate(F.transform("p", lambda v, i: v * i), F.lit(0.0), lambda a, b: a + b)
    return p.select("vec_id", (F.array_position("p", F.array_max("p")) - 1).alias("best"), F.round(expected, 6).alias("expected"), F.bround(F.round(expected, 6)).cast("int").alias("rounded"))


def c32_infer(spark, d):
    """Pieces and versions that vectors' widths allow: embeddings, and positions of customers in four encodings."""
    rows = customer_placements(spark, d)
    ways = [(1, False), (1, True), (4, False), (5, False)]
    encoded = [E.encode(rows.where(F.col("id") % 4 == k), 3, version, moves=moves).select(F.lit("position").alias("source"), "id", F.size("x").alias("width")) for k, (version, moves) in enumerate(ways)]
    vectors = table(spark, d, "embeddings").select(F.lit("embedding").alias("source"), F.col("vec_id").alias("id"), F.size("embedding").alias("width"))
    every = reduce(DataFrame.unionByName, encoded, vectors).withColumn("i", E.infer(F.col("width")))
    return every.select("source", "id", "width", F.array_join("i.pieces", "|").alias("pieces"), F.array_join("i.versions", "|").alias("versions"), (F.size("i.versions") > 1).alias("ambiguous"))


def c32_arity(spark, d):
    """Data sets with three or five kinds of labels, told by the labels, and their classes."""
    k = F.col("event_id")
    wdl = F.when(F.col("event_type").isin("click", "view"), (k % 3 - 1) * 2).otherwise(k % 5 - 2).cast("int")
    e = table(spark, d, "events").select("event_type", wdl.alias("wdl"))
    arity = V.label_arity(e, "event_type", "wdl").withColumnRenamed("event_type", "__t")
    mapped = e.join(arity.hint("merge"), F.col("event_type").eqNullSafe(F.col("__t"))).withColumn("class", V.mapped_class(F.col("wdl"), F.col("arity")))
    return mapped.groupBy("event_type", "arity", "class").agg(F.count("*").alias("n"))


def d1_attach(spark, d):
    return predictions(spark, d).groupBy("config").agg(F.count("*").alias("n"), F.sum("true").alias("good"))


def d2_fallback(spark, d):
    """An order's score: its own, else its customer's balance, else a guess by its state, else a draw."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    own, guess = F.when(F.col("o_totalprice") > 200000, F.col("o_totalprice")), F.when(F.col("o_orderkey") % 2 == 0, F.lit(100.0))
    joined = o.join(c.where("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey"), "left").withColumns({"own": own, "guess": guess})
    return cascade_score(joined, "own", "c_acctbal", "guess", 0.0).select("o_orderkey", "score")


def d3_cache(spark, d):
    """Score every distinct part once, then give it back to all its rows."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    scored = li.select("l_partkey").distinct().withColumn("score", F.col("l_partkey") * 37 % 101)
    return li.join(scored, "l_partkey").groupBy("score").agg(F.count("*").alias("n"))


def d5_pairs(spark, d):
    """All pairs of line numbers inside an order, first before second."""
    li = table(spark, d, "lineitem").where("l_orderkey IS NOT NULL").select("l_orderkey", "l_partkey")
    both = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("ps"))
    pairs = F.flatten(F.transform("ps", lambda a, i: F.transform(F.slice("ps", i + 2, F.size("ps")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return both.select("l_orderkey", F.inline(pairs))


def d6_inventory(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    keys = c.select(F.col("c_custkey").alias("k"), "c_nationkey")
    have = o.select(F.col("o_custkey").alias("k"))
    missing, there = keys.join(have, "k", "left_anti"), keys.join(have, "k", "left_semi")
    count = lambda df, s: df.groupBy("c_nationkey").agg(F.count("*").alias("n")).withColumn("state", F.lit(s))
    return count(missing, "missing").unionByName(count(there, "there"))


def d7_compare(spark, d):
    o = table(spark, d, "orders")
    acc = lambda lo: o.where(F.col("o_orderkey") % 2 == lo).groupBy("o_orderpriority").agg(F.avg((F.col("o_totalprice") > 150000).cast("double")).alias("accuracy"))
    return V.compare_runs(acc(0), acc(1), "o_orderpriority", "accuracy").select("o_orderpriority", F.round("old", 6).alias("old"), F.round("new", 6).alias("new"), "change")


def d8_models(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.when(F.length("text") > 700, 1).otherwise(0).alias("other"))
    p = predictions(spark, d).join(docs, "doc_id")
    a, b = F.col("pred") == F.col("true"), F.col("other") == F.col("true")
    return p.agg(F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("first_only"), F.count_if(~a & b).alias("second_only"), F.count_if(~a & ~b).alias("neither"))


def d9_sidecar(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return c.groupBy("r_name").agg(F.count("*").alias("n"))


def d10_overlay(spark, d):
    p = predictions(spark, d)
    wrong = p.where(F.col("true") != F.col("pred")).select("doc_id", F.col("true").alias("pred"))
    fixed = V.overlay(p, wrong, "doc_id", "pred")
    return fixed.agg(F.count("*").alias("n"), F.count_if(F.col("true") == F.col("pred")).alias("correct"))


def d11_verify(spark, d):
    """Stored labels against a second source, on a seeded sample."""
    return H.fraction(predictions(spark, d), "doc_id", 0.5, 3).agg(F.count("*").alias("checked"), F.count_if(F.col("true") != F.col("pred")).alias("mismatches"))


def d12_product(spark, d):
    """Every pair of priority and state, seen or not, with its number of orders; both sides are counted before they are multiplied."""
    o = table(spark, d, "orders")
    sides = [o.select(c).distinct() for c in ("o_orderpriority", "o_orderstatus")]
    counts = o.groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    pairs = V.product(*sides)
    return pairs.join(counts, ["o_orderpriority", "o_orderstatus"], "left").fillna(0, "n")


def e1_distribution(spark, d):
    return V.distribution(table(spark, d, "labels"), "toxic")


def e2_weights(spark, d):
    return V.class_weights(table(spark, d, "labels"), "quality")


def e3_summary(spark, d):
    return V.summary(table(spark, d, "lineitem"), "l_quantity", "l_returnflag")


def e4_quality(spark, d):
    x = F.col("embedding")
    return table(spark, d, "embeddings").groupBy("label").agg(F.count_if(F.exists(x, F.isnan)).alias("nan"), F.count_if(F.exists(x, lambda v: F.abs(v) == float("inf"))).alias("inf"), F.count_if(F.size(x) != 64).alias("bad_width"), F.count("*").alias("n"))


def e5_accuracy(spark, d):
    return V.accuracy(predictions(spark, d))


def e6_per_class(spark, d):
    return V.per_class(predictions(spark, d))


def e7_confusion(spark, d):
    return V.confusion(event_classes(spark, d), 3)


def e8_fatal(spark, d):
    return V.fatal(event_classes(spark, d))


def e9_mistakes(spark, d):
    return V.mistakes(event_classes(spark, d))


def e10_mae(spark, d):
    li = table(spark, d, "lineitem").select("l_partkey", "l_quantity", "l_returnflag")
    mean = li.groupBy("l_partkey").agg(F.avg("l_quantity").alias("m"))
    return li.join(mean, "l_partkey").groupBy("l_returnflag").agg(F.round(F.avg(F.abs(F.col("l_quantity") - F.col("m"))), 6).alias("mae"))


def e11_micro_macro(spark, d):
    return V.micro_and_macro(table(spark, d, "orders"), "o_orderpriority", F.col("o_totalprice") > 150000)


def e14_keep_first(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", F.md5(F.col("text").cast("binary")).alias("pos_key"))
    return H.keep_first(docs, ["pos_key"], "doc_id").select("pos_key", "doc_id")


def e15_minimax(spark, d):
    """Best of the worst of the best price down the tree nation, customer, order, line item."""
    li, o, c = table(spark, d, "lineitem"), table(spark, d, "orders"), table(spark, d, "customer")
    orders = V.minimax(li.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_extendedprice").alias("v")), "o_orderkey", "v", True)
    scored = o.join(orders, "o_orderkey", "left").select(F.col("o_custkey").alias("c_custkey"), F.coalesce("v", F.lit(0.0)).alias("v"))
    customers = V.minimax(scored, "c_custkey", "v", False)
    leaf = c.join(customers, "c_custkey", "left").select("c_nationkey", F.coalesce("v", F.lit(0.0)).alias("v"))
    best = V.minimax(leaf, "c_nationkey", "v", True)
    # the value in half-even thousands, and as the other side sees it
    rounded = F.bround(F.col("v") / 1000).cast("int")
    return best.select("c_nationkey", "v", rounded.alias("rounded"), V.white_view(F.pmod(rounded, F.lit(3)), F.col("c_nationkey") % 2).alias("seen"))


def e15_depth(spark, d):
    """The same tree as a table of parents and children, backed up to each depth; nodes at that depth count their own score."""
    c, o, li = (table(spark, d, t) for t in ("customer", "orders", "lineitem"))
    named = lambda letter, col: F.concat(F.lit(letter), F.col(col))
    edges = lambda t, parent, child, value: t.select(parent.alias("parent"), child.alias("child"), F.col(value).alias("value"))
    priced = F.concat_ws(":", named("l", "l_orderkey"), F.col("l_extendedprice").cast("decimal(18,4)"))
    children = edges(c, named("n", "c_nationkey"), named("c", "c_custkey"), "c_acctbal").unionByName(edges(o, named("c", "o_custkey"), named("o", "o_orderkey"), "o_totalprice")).unionByName(edges(li, named("o", "l_orderkey"), priced, "l_extendedprice"))
    roots = table(spark, d, "nation").select(named("n", "n_nationkey").alias("node"), F.lit(True).alias("maximise"))
    # a nation's own score is 0; the others' come with their edges
    found = D.backups(roots, children, roots.select("node", F.lit(0.0).alias("value")).distinct(), [0, 1, 2, 3])
    return found.select(F.expr("CAST(substr(node, 2) AS BIGINT)").alias("n_nationkey"), F.col("plies").alias("depth"), F.round("value", 2).alias("v"))


def e16_best_move(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_discount").alias("x"), F.min("l_quantity").alias("q"))
    return V.best_move(li, "l_orderkey", "l_linenumber", F.round((F.col("x") - 0.05) * 10, 6), F.col("q"))


def e17_optimal(spark, d):
    """Is the move chosen on rough values the best one on exact values?"""
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_discount").alias("x"), F.min("l_quantity").alias("q"))
    exact = V.best_move(li, "l_orderkey", "l_linenumber", F.round((F.col("x") - 0.05) * 10, 6), F.col("q")).select("l_orderkey", F.col("l_linenumber").alias("best"))
    rough = V.best_move(li, "l_orderkey", "l_linenumber", F.round((F.col("x") - 0.05) * 10, 6), F.floor(F.col("q") / 10).cast("double")).select("l_orderkey", F.col("l_linenumber").alias("chosen"))
    return exact.join(rough, "l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("best") == F.col("chosen")).alias("optimal"))


def e18_invariance(spark, d):
    """Spread of scores over the members of each orbit, by the orbit's key."""
    key = canonical_key(Slot.of(3), F.col("turn"))
    s = placements(spark, d).select("config", key.alias("key"), (F.col("idx") % 97).cast("double").alias("score"))
    return s.groupBy("config", "key").agg(F.round(F.var_pop("score"), 6).alias("variance"), (F.max("score") - F.min("score")).alias("spread"))


def e19_break_even(spark, d):
    return V.break_even(predictions(spark, d), F.col("true") != F.col("pred"), 350, 956)


def e20_neighbours(spark, d):
    """Per edge type, the sum of the sources' features at each destination."""
    e = table(spark, d, "events").select((F.col("event_id") % 4).alias("etype"), (F.col("user_id") % 64).alias("src"), (F.col("event_id") % 64).alias("dst"))
    f = table(spark, d, "events").groupBy((F.col("user_id") % 64).alias("src")).agg(F.count("*").alias("feature"))
    return e.join(f, "src").groupBy("dst", "etype").agg(F.sum("feature").alias("message"))


def e21_pooling(spark, d):
    e = table(spark, d, "events")
    return e.groupBy((F.col("user_id") % 64).alias("board")).agg(F.round(F.avg("value"), 4).alias("mean"), F.max("value").alias("most"))


def e22_strata(spark, d):
    p = predictions(spark, d)
    kept = H.quota(p, "config", "doc_id", 40, 5)
    return kept.groupBy("config").agg(F.count("*").alias("n"), F.count_if(F.col("true") == F.col("pred")).alias("correct"))


def run_order():
    """Lines of a run, in time; a window needs a running session, so it is made on call."""
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


def f1_delta(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.round(F.coalesce(F.col("value") - F.lag("value").over(run_order()), F.lit(0.0)), 4).alias("delta"))


def f2_running(spark, d):
    w = run_order().rowsBetween(Window.unboundedPreceding, 0)
    hit = (F.col("true") == F.col("pred")).cast("long")
    return event_classes(spark, d).select("event_id", F.round(F.sum(hit).over(w) / F.count("*").over(w), 6).alias("accuracy"))


def f3_trend(spark, d):
    w = run_order().rowsBetween(-19, 0)
    e = table(spark, d, "events").select("event_id", F.sum("value").over(w).alias("m"), F.stddev_pop("value").over(w).alias("s"), F.count("*").over(w).alias("n"))
    return e.select("event_id", F.round("m", 3).alias("sum20"), F.round("s", 3).alias("std20"), (F.col("n") == 20).alias("full_window"))


def f4_best_epoch(spark, d):
    order = Window.partitionBy("user_id").orderBy(F.desc("value"), "ts", "event_id")
    return table(spark, d, "events").withColumn("r", F.row_number().over(order)).where("r = 1").select("user_id", "event_id", "value")


def _improved(spark, d):
    before = F.max("value").over(run_order().rowsBetween(Window.unboundedPreceding, -1))
    return table(spark, d, "events").select("event_id", "user_id", "ts", "value", F.coalesce(F.col("value") > before, F.lit(True)).alias("improved"))


def f5_checkpoints(spark, d):
    return _improved(spark, d).where("improved").groupBy("user_id").agg(F.count("*").alias("checkpoints"), F.max("value").alias("best"))


def f6_patience(spark, d):
    """First event after five without an improvement, per run."""
    islands = _improved(spark, d).withColumn("island", F.sum(F.col("improved").cast("int")).over(run_order()))
    waited = islands.withColumn("wait", F.row_number().over(Window.partitionBy("user_id", "island").orderBy("ts", "event_id")) - 1).where("wait = 5")
    return waited.groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("stop_at"))


def f8_first_last(spark, d):
    w = run_order().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    e = table(spark, d, "events").select("user_id", F.first("value").over(w).alias("first_value"), F.last("value").over(w).alias("last_value"), F.nth_value("value", 3).over(w).alias("third"))
    return e.distinct().withColumn("gain", F.round(F.col("last_value") - F.col("first_value"), 4))


def g1_ranked(spark, d):
    o = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.round(F.avg((F.col("o_totalprice") > 150000).cast("double")), 6).alias("accuracy"))
    band = F.when(F.col("accuracy") < 0.4, "weak").when(F.col("accuracy") < 0.6, "fair").otherwise("good")
    return o.withColumn("status", band).orderBy("accuracy", "o_orderpriority")


def g2_first_failures(spark, d):
    return predictions(spark, d).where(F.col("true") != F.col("pred")).orderBy("doc_id").limit(20).select("doc_id", "config", "true", "pred")


def h2_fraction(spark, d):
    return H.fraction(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", 0.3, 1)


def h3_split(spark, d):
    return H.split(table(spark, d, "documents").select("doc_id"), "doc_id", 2)


def h4_quota(spark, d):
    return H.quota(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 150, 4).groupBy("doc_id", "lang").agg(F.count("*").alias("copies"))


def h5_relabel(spark, d):
    return H.relabel(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "quality", 1, 2, 0.5, 9)


def h6_reweight(spark, d):
    p = predictions(spark, d)
    return p.select("doc_id", F.round(H.hard_weight(F.col("true") != F.col("pred"), 2.0, 50), 6).alias("weight"))


def i1_union(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    a, b = o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1").select("o_orderpriority", "o_orderkey")
    return a.unionByName(b).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


def i2_sets(spark, d):
    c, o = table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    only, both = c.subtract(o).withColumn("part", F.lit("only")), c.intersect(o).withColumn("part", F.lit("both"))
    return only.unionByName(both)


def i3_distinct(spark, d):
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


SCALES = [10.0, 20.0, 30.0]


def j5_sweep(spark, d):
    """A grid of places and scales over whole vectors: how often each reads the label."""
    return ml.grid_scores(table(spark, d, "embeddings"), label="label", x="embedding", scales=SCALES)


def j5_best(spark, d):
    return ml.best_of_grid(j5_sweep(spark, d))


_H = lambda key, seed: f"md5(concat_ws('|', CAST({key} AS VARCHAR), '{seed}'))"
_U = lambda key, seed: f"CAST(CAST(('0x' || substr({_H(key, seed)}, 1, 8)) AS BIGINT) AS DOUBLE) / 4294967296.0"
_RUN = "PARTITION BY user_id ORDER BY ts, event_id"
_QUOTA = lambda src, stratum, key, rows, seed: f"""z AS (SELECT *, count(*) OVER (PARTITION BY {stratum}) AS size FROM {src}),
y AS (SELECT *, {rows} // size AS epochs, row_number() OVER (PARTITION BY {stratum} ORDER BY md5(concat_ws('|', CAST({key} AS VARCHAR), '{seed}', CAST({rows} // size AS VARCHAR)))) AS r FROM z),
quota AS (SELECT *, epochs + CASE WHEN r <= {rows} - epochs * size THEN 1 ELSE 0 END AS copies FROM y)"""  # noqa: E731

_GRID = "SELECT CAST(i AS INTEGER) AS place, CAST(s AS DOUBLE) AS scale, count(*) FILTER (((CAST(floor(CAST(embedding[i + 1] AS DOUBLE) * s) AS BIGINT) % 10) + 10) % 10 = label) AS correct FROM embeddings, range(64) t(i), (VALUES (10), (20), (30)) u(s) GROUP BY 1, 2"

QUERIES = {
    "b7_mispredicted": (b7_mispredicted, f'WITH {PRED} SELECT doc_id, true_ AS "true", pred FROM pr WHERE true_ <> pred'),
    "b8_outliers": (b8_outliers, "SELECT l_partkey, count(*) AS n FROM (SELECT l_partkey, l_quantity, avg(l_quantity) OVER (PARTITION BY l_partkey) AS m FROM lineitem) WHERE abs(l_quantity - m) > 20 GROUP BY 1"),
    "b9_cascade": (b9_cascade, f"WITH {EV}, w AS (SELECT true_ <> pred AS a, true_ <> CASE WHEN value - 40 > 25 THEN 2 WHEN value - 40 < -25 THEN 0 ELSE 1 END AS b, true_ <> CASE WHEN value - 30 > 20 THEN 2 WHEN value - 30 < -20 THEN 0 ELSE 1 END AS c FROM ev) SELECT count(*) FILTER (a) AS wrong0, count(*) FILTER (a AND b) AS wrong01, count(*) FILTER (a AND b AND c) AS wrong012, count(*) FILTER (b) AS full1, count(*) FILTER (c) AS full2 FROM w"),
    "c24_batches": (c24_batches, "SELECT event_id, event_id // 32 AS batch, event_id % 32 * 64 + user_id % 64 AS src, event_id % 32 * 64 + event_id % 64 AS dst FROM events"),
    "c26_pad": (c26_pad, "WITH v AS (SELECT vec_id, list_transform(embedding[1 : vec_id % 5 + 2], lambda y: CAST(y AS DOUBLE)) AS x FROM embeddings), w AS (SELECT max(len(x)) AS w FROM v) SELECT vec_id, array_to_string(list_transform(x[1 : len(x) - 1] || list_transform(range(0, w - len(x)), lambda i: CAST(0 AS DOUBLE)) || x[len(x) : len(x)], lambda y: CAST(CAST(floor(y * 1000000 + 0.5) AS BIGINT) AS VARCHAR)), ',') AS x FROM v, w"),
    "c29_labels": (c29_labels, "WITH e AS (SELECT event_id, value, CAST(event_id % 5 - 2 AS INTEGER) AS w FROM events) SELECT event_id, CAST(sign(w) + 1 AS INTEGER) AS sign, CAST(floor(w / 2.0) + 1 AS INTEGER) AS floor, CASE w WHEN -2 THEN 0 WHEN 2 THEN 2 ELSE 1 END AS exact, CASE w WHEN -2 THEN 0 WHEN 0 THEN 1 ELSE 2 END AS else_win, w + 2 AS five, CASE WHEN value - 50 > 25 THEN 2 WHEN value - 50 < -25 THEN 0 ELSE 1 END AS by_value FROM e"),
    "c30_white_view": (c30_white_view, "SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 2 - o_orderkey % 3 ELSE o_orderkey % 3 END AS INTEGER) AS white_class FROM orders"),
    "c31_softmax": (c31_softmax, "WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: exp(CAST(v AS DOUBLE) * 5)) AS e, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS v FROM embeddings), y AS (SELECT vec_id, v, round(list_sum(list_transform(range(len(e)), lambda i: e[i + 1] * i)) / list_sum(e), 6) AS m FROM x) SELECT vec_id, CAST(list_position(v, list_max(v)) - 1 AS BIGINT) AS best, m AS expected, CAST(round_even(m, 0) AS INTEGER) AS rounded FROM y"),
    "c32_infer": (c32_infer, """WITH w AS (SELECT 'embedding' AS source, vec_id AS id, CAST(len(embedding) AS INTEGER) AS width FROM embeddings UNION ALL SELECT 'position', c_custkey, CAST(CASE c_custkey % 4 WHEN 0 THEN 43 WHEN 1 THEN 64 ELSE 45 END AS INTEGER) FROM customer),
l AS (SELECT n, unnest(['v1', 'v2_old', 'v2', 'v4', 'v5', 'v6', 'v7', 'compact']) AS v, unnest([10 * n + 2 * n * (n - 1) + 1, 10 * n + 5 * (n * (n - 1) // 2) + 1, 10 * n + 11 * (n * (n - 1) // 2) + 1, 11 * n + 2 * n * (n - 1), 11 * n + 2 * n * (n - 1), 15 * n + 2 * n * (n - 1), 17 * n + 2 * n * (n - 1), 64 * n]) AS width FROM (VALUES (3), (4), (5)) t(n))
SELECT source, id, w.width, string_agg(DISTINCT CAST(n AS VARCHAR), '|' ORDER BY CAST(n AS VARCHAR)) AS pieces, string_agg(DISTINCT v, '|' ORDER BY v) AS versions, count(DISTINCT v) > 1 AS ambiguous FROM w JOIN l ON w.width = l.width GROUP BY 1, 2, 3"""),
    "c32_arity": (c32_arity, """WITH e AS (SELECT event_type, CASE WHEN event_type IN ('click', 'view') THEN (event_id % 3 - 1) * 2 ELSE event_id % 5 - 2 END AS wdl FROM events),
a AS (SELECT event_type AS t, CASE WHEN count(*) FILTER (wdl IN (-1, 1)) > 0 THEN 5 ELSE 3 END AS arity FROM e GROUP BY 1)
SELECT event_type, CAST(arity AS INTEGER) AS arity, CAST(CASE arity WHEN 5 THEN wdl + 2 ELSE wdl // 2 + 1 END AS INTEGER) AS class, count(*) AS n FROM e JOIN a ON t = event_type GROUP BY 1, 2, 3"""),
    "d1_attach": (d1_attach, f"WITH {PRED} SELECT config, count(*) AS n, CAST(sum(true_) AS BIGINT) AS good FROM pr GROUP BY 1"),
    "d2_fallback": (d2_fallback, "SELECT o_orderkey, coalesce(CASE WHEN o_totalprice > 200000 THEN o_totalprice END, c_acctbal, CASE WHEN o_orderkey % 2 = 0 THEN 100.0 END, 0.0) AS score FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey"),
    "d3_cache": (d3_cache, "SELECT l_partkey * 37 % 101 AS score, count(*) AS n FROM lineitem GROUP BY 1"),
    "d5_pairs": (d5_pairs, "WITH x AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) SELECT a.l_orderkey, a.l_partkey AS a, b.l_partkey AS b FROM x a JOIN x b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey"),
    "d6_inventory": (d6_inventory, "SELECT c_nationkey, count(*) AS n, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'there' ELSE 'missing' END AS state FROM customer GROUP BY 1, 3"),
    "d7_compare": (d7_compare, "WITH a AS (SELECT o_orderpriority, avg(CASE WHEN o_totalprice > 150000 THEN 1.0 ELSE 0.0 END) FILTER (o_orderkey % 2 = 0) AS old, avg(CASE WHEN o_totalprice > 150000 THEN 1.0 ELSE 0.0 END) FILTER (o_orderkey % 2 = 1) AS new FROM orders GROUP BY 1) SELECT o_orderpriority, round(old, 6) AS old, round(new, 6) AS new, round(new - old, 6) AS change FROM a"),
    "d8_models": (d8_models, f"WITH {PRED}, q AS (SELECT pred = true_ AS a, CASE WHEN length(text) > 700 THEN 1 ELSE 0 END = true_ AS b FROM pr JOIN documents USING (doc_id)) SELECT count(*) FILTER (a AND b) AS both, count(*) FILTER (a AND NOT b) AS first_only, count(*) FILTER (NOT a AND b) AS second_only, count(*) FILTER (NOT a AND NOT b) AS neither FROM q"),
    "d9_sidecar": (d9_sidecar, "SELECT r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "d10_overlay": (d10_overlay, f"WITH {PRED} SELECT count(*) AS n, count(*) AS correct FROM pr"),
    "d11_verify": (d11_verify, f"WITH {PRED} SELECT count(*) AS checked, count(*) FILTER (true_ <> pred) AS mismatches FROM pr WHERE {_U('doc_id', 3)} < 0.5"),
    "d12_product": (d12_product, "SELECT a.o_orderpriority, b.o_orderstatus, count(o.o_orderkey) AS n FROM (SELECT DISTINCT o_orderpriority FROM orders) a CROSS JOIN (SELECT DISTINCT o_orderstatus FROM orders) b LEFT JOIN orders o ON o.o_orderpriority = a.o_orderpriority AND o.o_orderstatus = b.o_orderstatus GROUP BY 1, 2"),
    "e1_distribution": (e1_distribution, "SELECT toxic, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM labels GROUP BY 1"),
    "e2_weights": (e2_weights, "SELECT quality, count(*) AS n, round(CAST(sum(count(*)) OVER () AS DOUBLE) / (count(*) OVER () * count(*)), 6) AS weight FROM labels GROUP BY 1"),
    "e3_summary": (e3_summary, "SELECT l_returnflag, min(l_quantity) AS lo, max(l_quantity) AS hi, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS std, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag)"),
    "e4_quality": (e4_quality, "SELECT label, count(*) FILTER (len(list_filter(embedding, lambda x: isnan(x))) > 0) AS nan, count(*) FILTER (len(list_filter(embedding, lambda x: isinf(x))) > 0) AS inf, count(*) FILTER (len(embedding) <> 64) AS bad_width, count(*) AS n FROM embeddings GROUP BY 1"),
    "e5_accuracy": (e5_accuracy, f"WITH {PRED} SELECT round(avg(CASE WHEN true_ = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM pr"),
    "e6_per_class": (e6_per_class, f'WITH {PRED} SELECT true_ AS "true", count(*) FILTER (true_ = pred) AS correct, count(*) AS total, round(CAST(count(*) FILTER (true_ = pred) AS DOUBLE) / count(*), 6) AS accuracy FROM pr GROUP BY 1'),
    "e7_confusion": (e7_confusion, f'WITH {EV} SELECT true_ AS "true", count(*) FILTER (pred = 0) AS pred_0, count(*) FILTER (pred = 1) AS pred_1, count(*) FILTER (pred = 2) AS pred_2 FROM ev GROUP BY 1'),
    "e8_fatal": (e8_fatal, f"WITH {EV} SELECT count(*) FILTER (true_ = 2 AND pred = 0) AS win_as_loss, count(*) FILTER (true_ = 0 AND pred = 2) AS loss_as_win, round(CAST(count(*) FILTER (abs(true_ - pred) = 2) AS DOUBLE) / count(*), 6) AS rate FROM ev"),
    "e9_mistakes": (e9_mistakes, f'WITH {EV} SELECT true_ AS "true", pred, count(*) AS n FROM ev WHERE true_ <> pred GROUP BY 1, 2'),
    "e10_mae": (e10_mae, "SELECT l_returnflag, round(avg(abs(l_quantity - m)), 6) AS mae FROM (SELECT l_returnflag, l_quantity, avg(l_quantity) OVER (PARTITION BY l_partkey) AS m FROM lineitem) GROUP BY 1"),
    "e11_micro_macro": (e11_micro_macro, "WITH g AS (SELECT o_orderpriority AS config, CAST(count(*) FILTER (o_totalprice > 150000) AS BIGINT) AS correct, count(*) AS total FROM orders GROUP BY 1) SELECT config, correct, total, round(CAST(correct AS DOUBLE) / total, 6) AS accuracy FROM g UNION ALL SELECT 'micro', CAST(sum(correct) AS BIGINT), CAST(sum(total) AS BIGINT), round(CAST(sum(correct) AS DOUBLE) / sum(total), 6) FROM g UNION ALL SELECT 'macro', CAST(sum(correct) AS BIGINT), CAST(sum(total) AS BIGINT), round(avg(CAST(correct AS DOUBLE) / total), 6) FROM g"),
    "e14_keep_first": (e14_keep_first, "SELECT md5(text) AS pos_key, min(doc_id) AS doc_id FROM documents GROUP BY 1"),
    "e15_minimax": (e15_minimax, "WITH o AS (SELECT o_custkey, coalesce(max(l_extendedprice), 0.0) AS v FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_custkey), c AS (SELECT c_nationkey, coalesce(min(v), 0.0) AS v FROM customer LEFT JOIN o ON c_custkey = o_custkey GROUP BY c_custkey, c_nationkey) SELECT c_nationkey, v, r AS rounded, CAST(CASE WHEN c_nationkey % 2 = 0 THEN 2 - r % 3 ELSE r % 3 END AS INTEGER) AS seen FROM (SELECT c_nationkey, max(v) AS v, CAST(round_even(max(v) / 1000, 0) AS INTEGER) AS r FROM c GROUP BY 1)"),
    "e15_depth": (e15_depth, """WITH o AS (SELECT o_custkey, o_totalprice, coalesce(max(l_extendedprice), o_totalprice) AS v FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_custkey, o_totalprice),
c AS (SELECT c_nationkey, c_acctbal, coalesce(min(o_totalprice), c_acctbal) AS v2, coalesce(min(v), c_acctbal) AS v3 FROM customer LEFT JOIN o ON c_custkey = o_custkey GROUP BY c_custkey, c_nationkey, c_acctbal),
n AS (SELECT n_nationkey, coalesce(max(c_acctbal), 0) AS v1, coalesce(max(v2), 0) AS v2, coalesce(max(v3), 0) AS v3 FROM nation LEFT JOIN c ON n_nationkey = c_nationkey GROUP BY 1)
SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(depth AS INTEGER) AS depth, round(CAST(CASE depth WHEN 0 THEN 0 WHEN 1 THEN v1 WHEN 2 THEN v2 ELSE v3 END AS DOUBLE), 2) AS v FROM n, range(4) t(depth)"""),
    "e16_best_move": (e16_best_move, "WITH l AS (SELECT l_orderkey, l_linenumber, round((min(l_discount) - 0.05) * 10, 6) AS w, min(l_quantity) AS q FROM lineitem GROUP BY 1, 2), b AS (SELECT *, CASE WHEN w > 0.3 THEN 1 WHEN w < -0.3 THEN -1 ELSE 0 END AS bucket FROM l), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY bucket DESC, CASE WHEN bucket <> 0 THEN -q ELSE 0 END DESC, w DESC, l_linenumber) AS r FROM b) SELECT l_orderkey, l_linenumber, bucket FROM r WHERE r = 1"),
    "e17_optimal": (e17_optimal, "WITH l AS (SELECT l_orderkey, l_linenumber, round((min(l_discount) - 0.05) * 10, 6) AS w, min(l_quantity) AS q FROM lineitem GROUP BY 1, 2), b AS (SELECT *, CASE WHEN w > 0.3 THEN 1 WHEN w < -0.3 THEN -1 ELSE 0 END AS bucket FROM l), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY bucket DESC, CASE WHEN bucket <> 0 THEN -q ELSE 0 END DESC, w DESC, l_linenumber) AS r, row_number() OVER (PARTITION BY l_orderkey ORDER BY bucket DESC, CASE WHEN bucket <> 0 THEN -floor(q / 10) ELSE 0 END DESC, w DESC, l_linenumber) AS s FROM b) SELECT count(*) FILTER (r = 1) AS n, count(*) FILTER (r = 1 AND s = 1) AS optimal FROM r"),
    "e18_invariance": (e18_invariance, f"WITH {POS}, k AS (SELECT config, {CANONICAL} AS key, CAST(idx % 97 AS DOUBLE) AS score FROM p) SELECT config, key, round(var_pop(score), 6) AS variance, max(score) - min(score) AS spread FROM k GROUP BY 1, 2"),
    "e19_break_even": (e19_break_even, f"WITH {PRED}, e AS (SELECT count(*) FILTER (true_ <> pred) AS errors, count(*) AS n FROM pr) SELECT errors, errors * 5 + 350 AS bytes, round(956.0::DOUBLE / (errors * 5 + 350), 6) AS compression, round(1 - (956 - 350) / (n * 5.0::DOUBLE), 6) AS break_even FROM e"),
    "e20_neighbours": (e20_neighbours, "WITH f AS (SELECT user_id % 64 AS src, count(*) AS feature FROM events GROUP BY 1) SELECT event_id % 64 AS dst, event_id % 4 AS etype, CAST(sum(feature) AS BIGINT) AS message FROM events JOIN f ON user_id % 64 = src GROUP BY 1, 2"),
    "e21_pooling": (e21_pooling, "SELECT user_id % 64 AS board, round(avg(value), 4) AS mean, max(value) AS most FROM events GROUP BY 1"),
    "e22_strata": (e22_strata, f"WITH {PRED}, {_QUOTA('pr', 'config', 'doc_id', 40, 5)} SELECT config, CAST(sum(copies) AS BIGINT) AS n, CAST(sum(CASE WHEN true_ = pred THEN copies ELSE 0 END) AS BIGINT) AS correct FROM quota GROUP BY 1"),
    "f1_delta": (f1_delta, f"SELECT event_id, round(coalesce(value - lag(value) OVER ({_RUN}), 0.0), 4) AS delta FROM events"),
    "f2_running": (f2_running, f"WITH {EV} SELECT event_id, round(avg(CASE WHEN true_ = pred THEN 1.0 ELSE 0.0 END) OVER ({_RUN} ROWS UNBOUNDED PRECEDING), 6) AS accuracy FROM ev"),
    "f3_trend": (f3_trend, f"SELECT event_id, round(sum(value) OVER w, 3) AS sum20, round(stddev_pop(value) OVER w, 3) AS std20, count(*) OVER w = 20 AS full_window FROM events WINDOW w AS ({_RUN} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"),
    "f4_best_epoch": (f4_best_epoch, "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, ts, event_id) AS r FROM events) WHERE r = 1"),
    "f5_checkpoints": (f5_checkpoints, f"WITH b AS (SELECT *, max(value) OVER ({_RUN} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events) SELECT user_id, count(*) AS checkpoints, max(value) AS best FROM b WHERE coalesce(value > before, true) GROUP BY 1"),
    "f6_patience": (f6_patience, f"WITH b AS (SELECT *, coalesce(value > max(value) OVER ({_RUN} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS up FROM events), i AS (SELECT *, sum(CASE WHEN up THEN 1 ELSE 0 END) OVER ({_RUN}) AS island FROM b), w AS (SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY ts, event_id) - 1 AS wait FROM i) SELECT user_id, arg_min(event_id, (ts, event_id)) AS stop_at FROM w WHERE wait = 5 GROUP BY 1"),
    "f8_first_last": (f8_first_last, f"SELECT DISTINCT user_id, first(value) OVER w AS first_value, last(value) OVER w AS last_value, nth_value(value, 3) OVER w AS third, round(last(value) OVER w - first(value) OVER w, 4) AS gain FROM events WINDOW w AS ({_RUN} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"),
    "g1_ranked": (g1_ranked, "WITH a AS (SELECT o_orderpriority, round(avg(CASE WHEN o_totalprice > 150000 THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM orders GROUP BY 1) SELECT *, CASE WHEN accuracy < 0.4 THEN 'weak' WHEN accuracy < 0.6 THEN 'fair' ELSE 'good' END AS status FROM a"),
    "g2_first_failures": (g2_first_failures, f'WITH {PRED} SELECT doc_id, config, true_ AS "true", pred FROM pr WHERE true_ <> pred ORDER BY doc_id LIMIT 20'),
    "h2_fraction": (h2_fraction, f"SELECT doc_id, lang FROM documents WHERE {_U('doc_id', 1)} < 0.3"),
    "h3_split": (h3_split, f"SELECT doc_id, CASE WHEN {_U('doc_id', 2)} < 0.1 THEN 'validation' ELSE 'train' END AS part FROM documents"),
    "h4_quota": (h4_quota, f"WITH {_QUOTA('documents', 'lang', 'doc_id', 150, 4)} SELECT doc_id, lang, copies FROM quota WHERE copies > 0"),
    "h5_relabel": (h5_relabel, f"SELECT doc_id, CASE WHEN quality = 1 AND {_U('doc_id', 9)} < 0.5 THEN 2 ELSE quality END AS quality FROM labels"),
    "h6_reweight": (h6_reweight, f"WITH {PRED} SELECT doc_id, CASE WHEN true_ <> pred THEN 4.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM pr"),
    "i1_union": (i1_union, "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1"),
    "i2_sets": (i2_sets, "SELECT c_custkey AS k, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'both' ELSE 'only' END AS part FROM customer"),
    "i3_distinct": (i3_distinct, "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem"),
    "j5_sweep": (j5_sweep, _GRID),
    "j5_best": (j5_best, f"SELECT * FROM ({_GRID}) ORDER BY correct DESC, place, scale LIMIT 1"),
}
