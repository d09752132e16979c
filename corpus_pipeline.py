"""A corpus from raw documents to token files, in five stages; each is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mateframe.llm import decontam, jaccard, langid, mixing, tokens
from mateframe.llm.common import stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Least cosine with a language, for texts of so many letters or more. On sf0.1 the least of these
#: is 0.16 (a text of one short word over and over); a text in an alphabet of none of the languages
#: stays below 0.1 in the tests.
FLOOR, LETTERS = 0.1, 60


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that are in one of the languages.

    A document without a letter is in none. One with ``LETTERS`` letters or more is rejected if its cosine with the
    language that fits best is below ``FLOOR``; shorter ones stay, as their cosines tell little. If
    no language could be learned (no row outside the held-out fold has one), letters alone decide.
    Null and empty texts go; repeated rows are judged alike and stay together; an empty table
    stays empty.
    """
    langs, prototypes = langid.learn(docs.select("doc_id", "text", "lang"))
    if not langs:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(COLUMNS)
    found = langid.predict(docs, langs, prototypes, columns=COLUMNS)
    few = F.length(F.regexp_replace("text", r"[^\p{L}]+", "")) < LETTERS
    return found.where(F.col("text").rlike(r"\p{L}") & ((F.col("score") >= FLOOR) | few)).select(COLUMNS)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, one row stays: that of the smallest id.

    Rows count one by one: of repeated rows one stays, and rows that share an id, or have none,
    stay if no row before them (by id, nulls last) is in their group. Texts without words, and
    null ones, are in no group and stay; an empty table stays empty.
    """
    rows, _ = jaccard.numbered(docs.select(COLUMNS))
    first = jaccard.join(rows.select("key", "text")).where("key = root").select("key")
    return rows.join(first.hint("merge"), "key", "left_semi").select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of the benchmark.

    Repeated rows go or stay together; texts without words, null ones and, if the benchmark is
    empty, all documents stay.
    """
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark").select("item_id", "text")).select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target weights; a document taken twice gives two rows.

    Texts without words and null ones take no part; a null source is one of its own; rows count
    one by one, also repeated ones; an empty table stays empty.
    """
    return mixing.expand(mixing.mix(docs), COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and per row where its ids stand, also for repeated rows; no rows give no file."""
    return tokens.write_and_read(docs)


#: (name, function of spark, docs and the tables' folder), in order.
STAGES = [
    ("language_id", language_id),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("mixing", mix),
    ("token_ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Language profiles and token ids are beyond SQL.
ORACLE_SQL = None
