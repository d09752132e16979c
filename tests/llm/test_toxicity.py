"""The toxicity query against a plain version of the whole path, and its bounds."""

import re
import zlib

import numpy as np
import pytest

from mateframe.llm import toxicity as X

RNG = np.random.default_rng(12)
BAD, GOOD = [f"bad{c}" for c in "abcdef"], [f"word{c}" for c in "abcdefghijklmnopqrstuvwx"]


def text(i):
    if i % 17 == 0:
        return ("", None, "12 34 !")[i % 3]
    few = [GOOD[k] for k in RNG.integers(0, len(GOOD), 14)]
    return " ".join(few + ([BAD[k] for k in RNG.integers(0, len(BAD), 4)] if i % 3 == 0 else [])) + ("É Ünd" if i % 5 == 0 else "")


ROWS = [(i, text(i)) for i in range(160)]
LABELS = [(i, int(i % 3 == 0)) for i in range(0, 160, 2)] + [(6, 0), (8, None), (999, 1)]


def out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_query_by_brute_force(spark, tmp_path):
    """Sets, words, fit and scores worked out text by text; the fit's slope has a test of its own."""
    spark.createDataFrame([*ROWS, (None, "bada worda")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(LABELS, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    known = {}
    for i, toxic in LABELS:
        if toxic is not None and not out(i):
            known[i] = max(known.get(i, 0), toxic)
    words = lambda t: sorted(zlib.crc32(w.encode()) for w in set(re.findall(r"[^\W\d_]+", (t or "").lower())))
    sets = lambda ids: sorted((np.array(words(t), np.uint32) for i, t in ROWS if ids(i)), key=lambda x: x.tobytes())
    model = X.nnpu(sets(lambda i: known.get(i) == 1), sets(lambda i: not out(i)), sum(known.values()) / len(known))
    got = {r["doc_id"]: r for r in X.op9_toxicity(spark, str(tmp_path)).collect()}
    assert len(got) == 161 and got[None]["held_out"]
    for i, t in ROWS:
        score = 1 / (1 + np.exp(-(model.bias + sum(model.weights.get(w, 0.0) for w in words(t)))))
        assert got[i]["score"] == pytest.approx(score, abs=1e-9) and got[i]["predicted"] == int(score >= 0.5) and got[i]["held_out"] == out(i)
    right = [got[i]["predicted"] == int(i % 3 == 0) for i in range(160) if i % 17 and out(i)]
    assert np.mean(right) > 0.9


def test_sets_are_bounded_by_rows(spark, monkeypatch):
    """A third of all rows under one id, some of one text: neither the confirmed nor the unlabelled set outgrows its bound."""
    seen = {}
    monkeypatch.setattr(X, "nnpu", lambda p, u, prior, **k: seen.update(p=len(p), u=len(u)) or X.Model({}, 0.0))
    one = next(i for i in range(100) if not out(i))
    ids = [i for i in range(1000, 3000) if not out(i)]
    rows = [(one, f"same id {chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(600)] + [(one, "same text")] * 600 + [(i, f"other {i}") for i in ids]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(one, 1), *[(i, i % 2) for i in ids]], "doc_id long, toxic int")
    X.learn(docs, labels, positive=100, unlabelled=200)
    assert 30 < seen["p"] < 200 and 80 < seen["u"] < 400
    X.learn(docs.where(f"doc_id = {one}"), labels, positive=10_000, unlabelled=10_000)
    assert seen == {"p": 601, "u": 601}
    X.learn(docs.where("false"), labels.where("false"))
    assert seen == {"p": 0, "u": 0}
