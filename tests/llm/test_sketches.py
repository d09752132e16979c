"""Sketches of the Jaccard join: what linked sets share, and sets around every bound of size."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mateframe.llm import jaccard


@pytest.mark.parametrize("exact", [jaccard.EXACT, None])
def test_linked_sets_keep_a_shared_hash(spark, exact):
    """Pairs at the very edge of 3/4, of all sizes, whose own hashes are rarer than the shared ones, but not theirs alone."""
    rows, pairs = [], []
    for n in range(1, 400 if exact is None else exact + 1, 3):
        for m in {math.ceil(3 * n / 4), (3 * n // 4 + n) // 2, n}:
            common = next((c for c in range(m + 1) if 100 * c >= 75 * (n + m - c)), m + 1)
            if common > m:
                continue
            shared = [(3, 10_000 + i, i) for i in range(common)]
            for side, own, size in ((0, 0, n), (1, 5_000, m)):
                rows.append((len(pairs), side, size, [(2, own + i, i) for i in range(size - common)] + shared))
            pairs.append((n, m))
    table = spark.createDataFrame(rows, "pair int, side int, n int, ts array<struct<df:int,token:bigint,pos:int>>")
    tokens = table.select("pair", "side", F.inline(jaccard.kept(F.col("n"), F.col("ts"), exact))).where("NOT wide")
    met = tokens.groupBy("pair", "token").agg(F.countDistinct("side").alias("sides")).where("sides = 2").select("pair").distinct()
    assert sorted(r["pair"] for r in met.collect()) == list(range(len(pairs)))


def test_copies_edited_too_much_keep_nothing(spark):
    """All hashes are counted, so one that shares too few with all others is in no tile; pairs across the bound are searched by sketches."""
    ts = [(2, i, i) for i in range(74)]
    table = spark.createDataFrame([(100, ts), (141, ts), (142, ts), (189, ts)], "n int, ts array<struct<df:int,token:bigint,pos:int>>")
    got = {r["n"]: [t["wide"] for t in r["kept"]] for r in table.select("n", jaccard.kept(F.col("n"), F.col("ts"), jaccard.EXACT).alias("kept")).collect()}
    sketch = [True] * (jaccard.SKETCH - jaccard.SHARED + 1)
    assert got == {100: [], 141: [], 142: sketch, 189: sketch}


@pytest.mark.parametrize("exact", [jaccard.EXACT, None])
def test_sets_of_all_sizes(spark, exact):
    """Chains of near copies of 100 to 400 shingles, some just linked and some just not, behind a line that all share."""
    rng = np.random.default_rng(8)
    line = [f"line{i}" for i in range(20)]
    texts = []
    for n in (100, 141, 150, 188, 189, 230, 400):
        base = [f"w{v}" for v in rng.integers(0, 1 << 30, n - 16)]
        for cut in (0, 1, n // 8 - 3, n // 8, n // 7, n // 5):  # a changed tail takes as many shingles away as words
            texts.append(" ".join(line + base[: len(base) - cut] + [f"x{v}" for v in rng.integers(0, 1 << 30, cut)]))
        texts += [" ".join(line + [f"u{v}" for v in rng.integers(0, 1 << 30, n - 16)]) for _ in range(3)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), exact=exact).collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    assert got == {i: (len(sets[i]), root[i]) for i in range(len(texts))}
    assert len(set(root)) < len(texts) - 12
