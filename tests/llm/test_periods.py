"""Periodic runs against all periods of all stretches, and their edges."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from mateframe.llm import periods

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def every_run(x, least, times):
    """Stretches of equal words at every distance; the least distance names a stretch."""
    found = {}
    for q in range(1, len(x) // times + 1):
        i = 0
        while i + q < len(x):
            s = i
            while i + q < len(x) and x[i] == x[i + q]:
                i += 1
            if i > s and i + q - s >= max(least, times * q):
                found.setdefault((s, i + q - s), q)
            i = max(i, s + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def test_lyndon_words():
    rng = np.random.default_rng(3)
    for _ in range(400):
        x = rng.integers(0, rng.integers(1, 4) + 1, rng.integers(1, 40))
        y = x.tolist()
        want = [next((k for k in range(i + 1, len(y)) if y[k:] < y[i:]), len(y)) - i for i in range(len(y))]
        assert periods.lyndon(x).tolist() == want


@pytest.mark.parametrize("least,times", [(6, 4), (2, 2), (5, 2), (6, 3), (10, 5)])
def test_runs(least, times):
    rng = np.random.default_rng(least)
    for _ in range(300):
        texts = []
        for _ in range(rng.integers(1, 5)):
            n = int(rng.integers(0, 80))
            x = rng.integers(0, rng.integers(1, 5) + 1, n)
            if n and rng.random() < 0.7:
                a = int(rng.integers(0, n))
                p = 1 + int(rng.integers(0, n - a))
                x = np.array([x[i] if i < a else x[a + (i - a) % p] for i in range(n)])
                x[rng.integers(0, n)] = rng.integers(0, 3)
            texts.append(x)
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
        want = {i: r for i, x in enumerate(texts) if (r := every_run(x.tolist(), least, times))}
        assert periods.runs_of(np.concatenate(texts).astype(np.int64), offsets, least, times) == want


def test_long_periods_and_few_stretches():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 1 << 20, 30_000)
    x[10_000:] = np.tile(x[10_000:14_000], 5)
    assert periods.runs_of(x, np.array([0, 30_000])) == {0: [(10_000, 20_000, 4_000)]}
    a, b = periods.stretches(x[:10_000], np.array([0, 10_000]), 6, 4)
    assert len(a) == len(b) == 0


SCHEMA = "doc_id long, text string, runs int, top string, collapsed long, kept string"


@pytest.fixture(scope="module")
def texts(spark):
    rng = np.random.default_rng(7)
    rows = [None, "", "  \t\n", "a", "to " * 90, "a b " * 4, "a b " * 3, "x\x1cy é ü\x0b" * 7 + "end", " ".join(f"w{v}" for v in rng.integers(0, 9, 40_000)), "p q r " * 30_000, "one two three four five " * 5 + "six " * 6]
    rows += [" ".join(f"w{v}" for v in rng.integers(0, 3, 60)) for _ in range(40)]
    return spark.createDataFrame([(i, t, 1, "t", 2, "k") for i, t in enumerate(rows)] + [(4, "to " * 90, 1, "t", 2, "k"), (None, "a a a a a a", 1, "t", 2, "k")], SCHEMA).repartition(3)


def collapsed(x, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(x) if i not in gone)


def test_collapse(spark, texts):
    got = periods.collapse(texts)
    assert got.columns == ["doc_id", "text", "kept", "runs", "top", "collapsed"]
    rows = got.collect()
    assert len(rows) == 53
    for r in rows:
        x = WORD.findall(r["text"] or "")
        want = every_run(x, 6, 4) if len(x) < 1000 else [(0, 90_000, 3)] if len(x) == 90_000 else [tuple(y) for y in r["runs"]]
        assert [tuple(y) for y in r["runs"]] == want and r["collapsed"] == collapsed(x, want)
        assert (r["top"] is None) == (not want) and (not want or tuple(r["top"]) == min(want, key=lambda y: (-y[1] / y[2], y[0], y[2])))
    assert periods.collapse(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_by_brute_force(spark, texts, tmp_path):
    """Planted periods, runs and digests, text by text."""
    more = texts.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, " ".join(f"v{k}" for k in range(i % 70))) for i in range(200)], "doc_id long, text string"))
    more.write.parquet(str(tmp_path / "documents.parquet"))
    rows = {(r["doc_id"], r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"], r["runs_sha256"], r["collapsed_sha256"]) for r in periods.op13_periodic_runs(spark, str(tmp_path)).collect()}
    want = set()
    for r in more.collect():
        x = WORD.findall(r["text"] or "")
        if len(x) > 1000:
            continue
        h = zlib.crc32(str(r["doc_id"]).encode()) if r["doc_id"] is not None else 1
        if h % 10 == 0 and x:
            g, n = h // 10, len(x)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            x = [x[i] if i < a else x[a + (i - a) % p] for i in range(n)]
        runs = every_run(x, 6, 4)
        top = min(runs, key=lambda y: (-y[1] / y[2], y[0], y[2]), default=(None,) * 3)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        want.add((r["doc_id"], len(runs), *top, 1000 * top[1] // top[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(x, runs).encode()).hexdigest()))
    assert want <= rows and len(rows) - len(want) == 2
