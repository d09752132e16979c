"""Language identification with hyperdimensional profiles.

A letter has a random vector of +1 and -1, drawn from its code point. A trigram binds (multiplies)
the vectors of its letters, the first shifted twice, the second once; a text bundles (adds) its
trigrams; a language bundles its texts, each scaled to unit length. The prediction is the
language whose prototype has the largest cosine with the text's vector.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, table

DIMENSION = 1024
#: Texts are taken in pieces of so many characters, so memory has a bound.
PIECE = 1 << 18
#: Rows encoded together.
TOGETHER = 256
#: Of each language, about so many training texts are used (all, if it has fewer).
TRAIN_PER_LANGUAGE = 20_000
#: Prototypes are shared with every task: so many languages at most, 4 kB each.
MOST_LANGUAGES = 4096
UNKNOWN = "und"


class Encoder:
    """Vectors of whole texts."""

    def __init__(self, dimension: int = DIMENSION):
        self.dimension = dimension
        self.letters: dict[int, np.ndarray] = {}
        self.is_letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.bool_, 0x110000)

    def letter(self, code: int) -> np.ndarray:
        """The vector of a letter; code 0 stands for whatever lies between words."""
        if code not in self.letters:
            bits = np.random.Generator(np.random.PCG64(code)).integers(0, 2, self.dimension, dtype=np.int8)
            self.letters[code] = 2 * bits - 1
        return self.letters[code]

    def _codes(self, before: np.ndarray, piece: str) -> np.ndarray:
        """``before`` and the letters of a piece as code points, every run of others as one 0."""
        code = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), "<u4")
        code = np.concatenate([before, np.where(self.is_letter[np.minimum(code, 0x10FFFF)], code, 0)]).astype(np.int64)
        return code[(code != 0) | np.concatenate([[True], code[:-1] != 0])]

    def _pieces(self, texts: list[str | None]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
        """Groups of (row, its letters between two gaps), of about PIECE characters."""
        rows, parts, held = [], [], 0
        for row, text in enumerate(texts):
            text, carried = text or "", np.zeros(1, np.int64)
            for at in range(0, max(len(text), 1), PIECE):
                end = " " if at + PIECE >= len(text) else ""
                codes = self._codes(carried, text[at : at + PIECE].lower() + end)
                carried = codes[-2:]  # the next piece goes on from here, so no trigram is lost or counted twice
                if codes.any():
                    rows.append(row)
                    parts.append(codes)
                    held += len(codes)
                if held >= PIECE:
                    yield rows, parts
                    rows, parts, held = [], [], 0
        if rows:
            yield rows, parts

    def vectors(self, texts: list[str | None]) -> np.ndarray:
        """One row per text; all zero where a text has no letter."""
        out = np.zeros((len(texts), self.dimension), np.float32)
        for rows, parts in self._pieces(texts):
            lengths = np.array([len(p) for p in parts])
            codes = np.concatenate(parts)
            alphabet = np.flatnonzero(np.bincount(codes, minlength=1))
            small = np.zeros(int(codes.max()) + 1, np.int64)
            small[alphabet] = np.arange(len(alphabet))
            k, s = len(alphabet), small[codes]
            gram = (s[:-2] * k + s[1:-1]) * k + s[2:]
            owner = np.repeat(np.arange(len(parts)), lengths)
            whole = owner[:-2] == owner[2:]
            gram, owner = gram[whole], owner[:-2][whole]
            if k**3 <= 1 << 22:
                used = np.flatnonzero(np.bincount(gram, minlength=1))
                place = np.zeros(k**3, np.int64)
                place[used] = np.arange(len(used))
                gram = place[gram]
            else:
                used, gram = np.unique(gram, return_inverse=True)
            base = np.stack([self.letter(int(c)) for c in alphabet])
            first, second = np.roll(base, 2, axis=1), np.roll(base, 1, axis=1)
            for at in range(0, len(used), 8192):
                u = used[at : at + 8192]
                inside = (gram >= at) & (gram < at + len(u))
                counts = np.bincount(owner[inside] * len(u) + gram[inside] - at, minlength=len(parts) * len(u)).reshape(len(parts), len(u))
                bound = first[u // (k * k)] * second[u // k % k] * base[u % k]
                np.add.at(out, rows, counts.astype(np.float32) @ bound.astype(np.float32))
        return out


def unit(vectors: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(length > 0, length, 1)


def learn(docs: DataFrame, *, per_language: int = TRAIN_PER_LANGUAGE, dimension: int = DIMENSION) -> tuple[list[str], np.ndarray]:
    """Prototypes of the languages of ``docs`` (doc_id, text, lang), from rows that aren't held out.

    Every language uses about ``per_language`` texts, chosen by a hash of the id. Tasks add
    theirs up by language first; the sums meet by (language, dimension), then L x D numbers
    come to the driver, where L is checked.
    """
    rows = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counts:
        return [], np.zeros((0, dimension), np.float32)
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, per_language / n))])
    chance = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("langid")), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.where(chance < share[F.col("lang")]).select("lang", "text")

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, total = None, {}
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                encoder = encoder or Encoder(dimension)
                part = batch.slice(at, TOGETHER)
                langs = np.array(part.column(0).to_pylist(), object)
                vectors = unit(encoder.vectors(part.column(1).to_pylist()))
                for lang in dict.fromkeys(langs):
                    total[lang] = total.get(lang, 0) + vectors[langs == lang].sum(axis=0, dtype=np.float64)
        for lang, vector in total.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang] * dimension, "place": np.arange(dimension, dtype=np.int32), "x": np.asarray(vector, np.float64)})

    summed = chosen.mapInArrow(sums, "lang string, place int, x double").groupBy("lang", "place").agg(F.sum("x").alias("x"))
    langs = sorted(counts)
    at = {lang: i for i, lang in enumerate(langs)}
    prototypes = np.zeros((len(langs), dimension), np.float64)
    for r in summed.toLocalIterator():
        prototypes[at[r["lang"]], r["place"]] = r["x"]
    return langs, unit(np.round(prototypes, 6)).astype(np.float32)


def predict(docs: DataFrame, langs: list[str], prototypes: np.ndarray, *, columns: list[str] | None = None) -> DataFrame:
    """Add ``lang_pred`` and ``score`` (cosine, at least 0) to the ``columns`` of ``docs``.

    Only ``text`` is looked at. Null and letterless texts, and all texts if nothing was learned,
    give ``und`` with score 0. Ties go to the language first in order. Texts of any length are
    read whole, in pieces. Repeated rows stay.
    """
    columns = [c for c in (docs.columns if columns is None else columns) if c not in ("lang_pred", "score")]  # replaced
    kept = docs.select(*columns, F.col("text").alias("__text"))
    schema = kept.select(*columns).schema.add("lang_pred", "string").add("score", "double")

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                encoder = encoder or Encoder(prototypes.shape[1])
                part = batch.slice(at, TOGETHER)
                vectors = encoder.vectors(part.column(part.num_columns - 1).to_pylist())
                if langs:
                    cosine = unit(vectors) @ prototypes.T
                    best = cosine.argmax(axis=1)
                    known = np.abs(vectors).max(axis=1) > 0
                    score = np.where(known, np.clip(cosine[np.arange(len(best)), best].astype(np.float64), 0, 1), 0.0)
                    names = [langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
                else:
                    score, names = np.zeros(part.num_rows), [UNKNOWN] * part.num_rows
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(names, pa.string()), pa.array(score)], [*part.schema.names[:-1], "lang_pred", "score"])

    return kept.mapInArrow(rows, schema)


def identify(docs: DataFrame, *, per_language: int = TRAIN_PER_LANGUAGE, columns: list[str] | None = None) -> DataFrame:
    """Learn from the rows of ``docs`` that aren't held out and predict every row."""
    langs, prototypes = learn(docs.select("doc_id", "text", "lang"), per_language=per_language)
    return predict(docs, langs, prototypes, columns=columns)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, columns=["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
