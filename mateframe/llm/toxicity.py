"""Toxicity scores by non-negative positive-unlabelled learning.

The classifier is linear over the words of a text (present or not). It learns from confirmed
toxic texts and from unlabelled ones, which are a mix: a share ``prior`` of them is toxic too.
With ``l+`` and ``l-`` the logistic losses of calling a text toxic or clean, the risk is

    prior * mean_P(l+) + max(0, mean_U(l-) - prior * mean_P(l-))

where the bracket estimates the loss on clean texts; when it falls below zero, the step goes
the other way, so the model does not overfit the confirmed texts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, table

#: At most about so many confirmed and unlabelled texts are used, chosen by a hash of the id.
POSITIVE, UNLABELLED = 4096, 12288
#: Words that tell the two sets apart best, by a two-proportion z.
FEATURES = 4096
#: Used where the labels hold no clean text to estimate the share of toxic ones from.
PRIOR = 0.1
STEPS, RATE, DECAY = 400, 0.05, 1e-4
LETTERS = r"[^\W\d_]+"


@dataclass
class Model:
    weights: dict[int, float]
    bias: float


def words(text: str | None) -> set[str]:
    return {m.group() for m in re.finditer(LETTERS, (text or "").lower())}


def code(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


def risk(score: np.ndarray, n_p: int, prior: float) -> tuple[float, np.ndarray]:
    """The part of the risk that a step goes down, and its derivative by each score; the first ``n_p`` are confirmed.

    That is the whole risk while the bracket is not negative, and else the bracket's negative.
    """
    n_u, is_p = len(score) - n_p, np.arange(len(score)) < n_p
    p = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    toxic, clean = np.logaddexp(0, -score), np.logaddexp(0, score)
    bracket = clean[n_p:].mean() - prior * clean[:n_p].mean()
    # derivative of each loss by the score: l+ gives p - 1, l- gives p
    if bracket >= 0:
        return prior * toxic[:n_p].mean() + bracket, np.where(is_p, prior * ((p - 1) - p) / n_p, p / n_u)
    return -bracket, np.where(is_p, prior * p / n_p, -p / n_u)


def nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, *, features: int = FEATURES, steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> Model:
    """Fit on arrays of word codes, one per text."""
    start = float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return Model({}, start)
    rows = [*positive, *unlabelled]
    n_p, n_u = len(positive), len(unlabelled)
    lengths = np.array([len(r) for r in rows])
    codes, column = np.unique(np.concatenate(rows), return_inverse=True)
    row = np.repeat(np.arange(len(rows)), lengths)
    in_p = np.bincount(column[row < n_p], minlength=len(codes))
    in_u = np.bincount(column[row >= n_p], minlength=len(codes))
    both = (in_p + in_u + 1) / (n_p + n_u + 2)
    z = (in_p / n_p - in_u / n_u) / np.sqrt(both * (1 - both) * (1 / n_p + 1 / n_u))
    chosen = np.argsort(-np.abs(z), kind="stable")[:features]
    place = np.full(len(codes), -1)
    place[chosen] = np.arange(len(chosen))
    keep = place[column] >= 0
    row, column = row[keep], place[column[keep]]

    w, b = np.zeros(len(chosen)), start
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        score = np.bincount(row, weights=w[column], minlength=len(rows)) + b
        _, g = risk(score, n_p, prior)
        gw, gb = np.bincount(column, weights=g[row], minlength=len(w)) + decay * w, g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        fix1, fix2 = 1 - 0.9**t, 1 - 0.999**t
        w -= rate * (m / fix1) / (np.sqrt(v / fix2) + 1e-8)
        b -= rate * (mb / fix1) / (np.sqrt(vb / fix2) + 1e-8)
    return Model(dict(zip(codes[chosen].tolist(), w.tolist(), strict=True)), float(b))


def learn(docs: DataFrame, labels: DataFrame, *, prior: float | None = None, positive: int = POSITIVE, unlabelled: int = UNLABELLED) -> Model:
    """Fit on ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic), held-out ids left out of both.

    A document with several labels is toxic if one says so. ``prior`` is the share of toxic
    labels unless given. The confirmed ids are a sample of bounded size, so they are broadcast. Rows of either set
    are taken by a hash of id and text, and rows equal in both count once, so what comes to the driver is bounded also where very many
    rows share an id or a text; copies under other ids count as texts of their own. Null ids are held out.
    """
    known = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = known.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0)).alias("toxic")).first()
    pool = docs.where(~held_out(F.col("doc_id")))
    if prior is None:
        prior = counts["toxic"] / counts["n"] if 0 < counts["toxic"] < counts["n"] else PRIOR
    share = lambda salt, *of: F.pmod(F.xxhash64(*of, F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
    confirmed = known.where((F.col("toxic") == 1) & (share("confirmed", F.col("doc_id").cast("string")) < positive / max(counts["toxic"], 1))).select(F.col("doc_id").alias("__id"))
    joined = pool.select(F.col("doc_id").alias("__doc"), "text").join(F.broadcast(confirmed), F.col("__doc") == F.col("__id"), "left").withColumn("p", F.col("__id").isNotNull())
    sizes = joined.agg(F.count("*").alias("n"), F.count_if("p").alias("p")).first()
    row = (F.col("__doc").cast("string"), F.col("text"))
    picked = joined.withColumns({"p": F.col("p") & (share("positive", *row) < positive / max(sizes["p"], 1)), "u": share("unlabelled", *row) < unlabelled / max(sizes["n"], 1)})
    once = picked.where("p OR u").withColumn("h", F.md5(F.col("text").cast("binary"))).dropDuplicates(["__doc", "h"])

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.fromiter({code(w) for w in words(t)}, np.uint32).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["p", "u", "codes"])

    rows = once.select("p", "u", "text").mapInArrow(features, "p boolean, u boolean, codes binary")
    p_rows, u_rows = [], []
    for r in rows.toLocalIterator(prefetchPartitions=True):  # bounded by the two sample sizes
        x = np.sort(np.frombuffer(r["codes"], np.uint32))
        if r["p"]:
            p_rows.append(x)
        if r["u"]:
            u_rows.append(x)
    by_content = lambda xs: sorted(xs, key=lambda x: x.tobytes())  # noqa: E731  reruns agree, in whatever order rows come
    return nnpu(by_content(p_rows), by_content(u_rows), prior)


class _Weights(dict):
    """Weight of a word; words seen before are kept, up to a bound."""

    def __init__(self, by_code: dict[int, float]):
        self.by_code = by_code

    def __missing__(self, word: str) -> float:
        if len(self) > 1 << 19:
            self.clear()
        self[word] = found = self.by_code.get(code(word), 0.0)
        return found


def score(docs: DataFrame, model: Model, *, columns: list[str] | None = None) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` to the ``columns`` of ``docs``.

    Only ``text`` is looked at, whole; null counts as empty, and empty texts get the score of
    the bias alone. Repeated rows stay and score alike.
    """
    columns = [c for c in (docs.columns if columns is None else columns) if c not in ("score", "predicted")]  # replaced
    kept = docs.select(*columns, F.col("text").alias("__text"))
    schema = kept.select(*columns).schema.add("score", "double").add("predicted", "integer")

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = _Weights(model.weights).__getitem__
        for batch in batches:
            total = np.array([model.bias + sum(map(weight, sorted(words(t)))) for t in batch.column(batch.num_columns - 1).to_pylist()], np.float64)
            p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*batch.schema.names[:-1], "score", "predicted"])

    return kept.mapInArrow(rows, schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return score(docs, model, columns=["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
