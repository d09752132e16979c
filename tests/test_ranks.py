"""Global ranks and what builds on them, against plain lists; plans are looked at where they matter."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from mateframe.operators import ranks as R


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    return [(i, rng.choice(["a", "a", "a", "a", "b", None, f"c{i % 7}"]), rng.randint(0, 9)) for i in range(900)]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, g string, v int").repartition(5).cache()


def first_null(x):
    return (x is not None, x if x is not None else "")


def md5(*parts):
    return hashlib.md5("|".join(str(p) for p in parts if p is not None).encode()).hexdigest()


def test_ranks(spark, frame, rows):
    got = {r["id"]: (r["rank"], r["size"]) for r in R.ranked(frame.withColumn("rank", F.lit("old")), ["v", "id"]).collect()}
    order = sorted(rows, key=lambda r: (r[2], r[0]))
    assert got == {r[0]: (i, 900) for i, r in enumerate(order)}
    within = {r["id"]: (r["rank"], r["size"]) for r in R.ranked(frame, ["v", "id"], within="g").collect()}
    for g in {r[1] for r in rows}:
        part = [r[0] for r in order if r[1] == g]
        assert [within[i] for i in part] == [(k, len(part)) for k in range(len(part))]
    same = R.ranked(spark.createDataFrame([(1, "x")] * 50, "id long, g string"), ["id"], within="g").collect()
    assert sorted(r["rank"] for r in same) == list(range(50))
    assert R.ranked(frame.where("false"), ["id"]).count() == 0 and R.ranked(frame.where("false"), ["id"], within="g").count() == 0


def test_ranks_add_up_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(R, "_BLOCK", 3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        got = R.ranked(spark.range(2000).select((F.col("id") * 7919 % 2000).alias("k")), ["k"])
        assert got.where("rank <> k").count() == 0 and got.count() == 2000
        of = R.offsets(spark.range(500).select((F.col("id") % 97).alias("s")), "s").orderBy("s").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r["first_row"] for r in of] == [sum(x["n"] for x in of[:i]) for i in range(97)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("bucket", [1, 7, 10_000])
def test_successor(frame, rows, bucket):
    found = R.successor(frame, ["v", "id"], "id", within="g", bucket=bucket)
    got = {r["id"]: r["next"] for r in found.collect()}
    for g in {r[1] for r in rows}:
        part = [r[0] for r in sorted(rows, key=lambda r: (r[2], r[0])) if r[1] == g]
        assert [got[i] for i in part] == [*part[1:], None]


def test_stitched_windows(frame, rows):
    """A moving sum over buckets is the one over all rows."""
    from pyspark.sql import Window

    numbered = R.ranked(frame, ["id"])
    parts = R.stitched(numbered, before=4, after=2, bucket=11)
    w = Window.partitionBy("__bucket").orderBy("rank").rowsBetween(-4, 2)
    got = {r["id"]: r["s"] for r in parts.withColumn("s", F.sum("v").over(w)).where("__own").collect()}
    values = [r[2] for r in sorted(rows)]
    assert got == {i: sum(values[max(i - 4, 0) : i + 3]) for i in range(900)}


@pytest.mark.parametrize("share,enough", [(0.3, 1 << 20), (0.3, 1), (0.0, 1), (1.0, 1), (0.999, 2)])
def test_exact_sample(frame, rows, share, enough):
    want = int(900 * share)
    got = sorted(r["id"] for r in R.smallest(frame, want, R.uniform("id", 1), ["id"], enough=enough).collect())
    assert got == sorted(sorted((r[0] for r in rows), key=lambda i: (int(md5(i, 1)[:15], 16), i))[:want])


def test_exact_sample_of_one_key(spark):
    same = spark.createDataFrame([(5, f"t{i:02}") for i in range(40)], "id long, t string")
    assert sorted(r["t"] for r in R.sample(same, "id", 0.25, 3, ties=["t"]).collect()) == [f"t{i:02}" for i in range(10)]
    assert R.smallest(same, 99, R.uniform("id", 1), []).count() == 40 and R.sample(same.where("false"), "id", 0.5, 1).count() == 0


def test_tail(frame):
    part = R.tail_split(frame, ["id"])
    assert {r["id"] for r in part.where("part = 'validation'").collect()} == set(range(810, 900)) and part.count() == 900


def test_shard_quota(spark, frame, rows):
    """Every shard holds the quota of every stratum; slots follow epochs in their own seeded order."""
    got = R.shard_quota(frame, "g", "id", rows=30, shards=4, seed=9).collect()
    for g in {r[1] for r in rows}:
        ids = [r[0] for r in rows if r[1] == g]
        dealt = [(e, i) for e in range(-(-120 // len(ids))) for i in sorted(ids, key=lambda i: md5(i, 9, e))][:120]
        for shard in range(4):
            assert sorted((r["epoch"], r["id"]) for r in got if r["g"] == g and r["shard"] == shard) == sorted(dealt[shard * 30 : shard * 30 + 30])
    for shard in range(4):
        inside = sorted((r["place"], md5(r["id"], 9, r["epoch"], shard)) for r in got if r["shard"] == shard)
        assert [p for p, _ in inside] == list(range(len(inside))) and [m for _, m in inside] == sorted(m for _, m in inside)
    again = R.shard_quota(frame.repartition(2), "g", "id", rows=30, shards=4, seed=9).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert R.shard_quota(frame.where("false"), "g", "id", rows=3, shards=2, seed=1).count() == 0


def test_locate(spark, rows):
    """Shards of very different sizes; numbers on, inside and beyond their borders."""
    rng = random.Random(6)
    sizes = [1] * 40 + [0, 5, 1000, 3, 64, 65, 63, 1, 2, 700]
    rng.shuffle(sizes)
    shards, at, want = [], 0, {}
    for k, n in enumerate(sizes):
        shards.append((k, n, at))
        want.update({at + i: (k, i) for i in range(n)})
        at += n
    table = spark.createDataFrame(shards, "shard int, n long, first_row long")
    points = spark.createDataFrame([(i,) for i in [*range(-3, at + 5), 17, 17, None]], "i long")
    found = R.locate(points, "i", table, "shard")
    got = [(r["i"], (r["shard"], r["local_row"])) for r in found.collect()]
    assert len(got) == at + 2 and all(want[i] == w for i, w in got) and "NestedLoop" not in plan(found)


def test_overlapping_intervals(spark):
    rng = random.Random(8)
    spans = [(k, rng.randint(0, 300), rng.choice([0, 1, 2, 7, 8, 9, 120])) for k in range(60)]
    got = R.interval_join(spark.range(320).withColumnRenamed("id", "p"), spark.createDataFrame(spans, "k int, s long, n long"), "p", "s", "n")
    assert sorted((r["p"], r["k"]) for r in got.collect()) == sorted((p, k) for p in range(320) for k, s, n in spans if s <= p < s + n)
