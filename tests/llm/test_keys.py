"""Keys of texts: wide enough, and results that don't rest on 64-bit hashes of whole texts."""

import hashlib

from pyspark.sql import functions as F

from mateframe.llm import decontam, repeats, substring, suffix


def clashing(*columns):
    """A 64-bit hash under which all whole texts are the same."""
    return F.lit(7).cast("long")


def test_keys_have_128_bits(spark):
    texts = spark.createDataFrame([(1, "a"), (1, "b"), (None, None), (2, "é")], "doc_id long, text string")
    found = texts.select("text", repeats.text_key(F.col("text")).alias("k"), decontam.row_key(F.col("doc_id"), F.col("text")).alias("r")).collect()
    assert all((r["k"] is None) == (r["text"] is None) and (r["k"] is None or bytes(r["k"]) == hashlib.md5(r["text"].encode()).digest()) for r in found)
    assert len({bytes(r["r"]) for r in found}) == 4 and all(len(r["r"]) == 16 for r in found)


def test_repeats_with_clashing_hashes(spark, monkeypatch):
    """One text holds a repeat of its own, others nothing: a hash that can't tell whole texts apart changes nothing."""
    words = [f"w{i}" for i in range(120)]
    texts = [" ".join(words[:40] + ["x"] + words[:40]), " ".join(words[40:80]), " ".join(words[80:]), None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = F.xxhash64
    monkeypatch.setattr(F, "xxhash64", lambda *c: clashing() if len(c) == 1 and str(c[0]) == "Column<'text'>" else whole(*c))
    assert {r["doc_id"]: r["n_removed"] for r in substring.dedup(df).collect()} == {0: 80, 1: 0, 2: 0, 3: 0}
    removed = {r["doc_id"]: r["n_removed"] for r in suffix.dedup(spark.createDataFrame([(0, "ab" * 200), (1, "x" + "".join(map(str, range(200))))], "doc_id long, text string")).collect()}
    assert removed == {0: 400, 1: 0}


def test_decontamination_with_clashing_hashes(spark, monkeypatch):
    passage = " ".join(f"p{i}" for i in range(25))
    docs = spark.createDataFrame([(1, f"a b {passage} c"), (2, "nothing of the kind in here"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(9, passage)], "item_id long, text string")
    whole = F.xxhash64
    monkeypatch.setattr(F, "xxhash64", lambda *c: clashing() if [str(x) for x in c] == ["Column<'doc_id'>", "Column<'text'>"] else whole(*c))
    assert sorted(r["doc_id"] for r in decontam.decontaminate(docs, bench).collect()) == [2, 3]
