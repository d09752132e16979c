"""Queries that sample, split, shard and locate rows by their global rank."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranks as R
from ..operators.shards import seeded
from .common import table


def f7_offsets(spark, d):
    return R.offsets(table(spark, d, "lineitem"), "l_suppkey")


def f7_locate(spark, d):
    """Global row numbers (made from orders) as shard and row inside it, shards being the suppliers' line items."""
    shards = f7_offsets(spark, d)
    numbers = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") * 4 + F.col("o_custkey") % 4 - 4).alias("row"))
    return R.locate(numbers, "row", shards, "l_suppkey").select("o_orderkey", "row", "l_suppkey", "local_row")


def g4_shuffle(spark, d):
    """The seeded global order, as each document's successor in it within its source."""
    docs = table(spark, d, "documents").select("doc_id", "source").withColumn("place", seeded("doc_id", 11))
    return R.successor(docs, ["place", "doc_id"], "doc_id", within="source", name="next_id").select("doc_id", "next_id")


def h2_exact(spark, d):
    """Exactly floor(0.3 n) documents, those of least hash."""
    return R.sample(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", 0.3, 1, ties=["lang"])


def h3_tail(spark, d):
    """The last tenth of the documents by id is for validation."""
    return R.tail_split(table(spark, d, "documents").select("doc_id"), ["doc_id"])


def h4_shards(spark, d):
    """Four shards with 90 documents of every language each; a language that runs out starts again in another order."""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return R.shard_quota(docs, "lang", "doc_id", rows=90, shards=4, seed=4)


_MD5 = lambda *parts: f"md5(concat_ws('|', {', '.join(f'CAST({p} AS VARCHAR)' for p in parts)}))"
_OFFSETS = "SELECT l_suppkey, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY l_suppkey) - count(*) AS BIGINT) AS first_row FROM lineitem GROUP BY 1"

QUERIES = {
    "f7_offsets": (f7_offsets, _OFFSETS),
    "f7_locate": (f7_locate, f'WITH s AS ({_OFFSETS}), o AS (SELECT o_orderkey, o_orderkey * 4 + o_custkey % 4 - 4 AS "row" FROM orders) SELECT o_orderkey, "row", l_suppkey, "row" - first_row AS local_row FROM o JOIN s ON "row" >= first_row AND "row" < first_row + n'),
    "g4_shuffle": (g4_shuffle, f"SELECT doc_id, lead(doc_id) OVER (PARTITION BY source ORDER BY {_MD5('doc_id', 11)}, doc_id) AS next_id FROM documents"),
    "h2_exact": (h2_exact, f"SELECT doc_id, lang FROM documents ORDER BY {_MD5('doc_id', 1)}[1:15], doc_id, lang LIMIT (SELECT CAST(floor(count(*) * 0.3) AS BIGINT) FROM documents)"),
    "h3_tail": (h3_tail, "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) <= floor(count(*) OVER () * 0.9::DOUBLE) THEN 'train' ELSE 'validation' END AS part FROM documents"),
    "h4_shards": (h4_shards, f"""
WITH z AS (SELECT doc_id, lang, count(*) OVER (PARTITION BY lang) AS size FROM documents),
e AS (SELECT doc_id, lang, unnest(range(CAST(ceil(360.0 / size) AS BIGINT))) AS epoch FROM z),
s AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY epoch, {_MD5('doc_id', 4, 'epoch')}, doc_id) - 1 AS slot FROM e),
h AS (SELECT doc_id, lang, CAST(epoch AS INTEGER) AS epoch, slot, CAST(slot // 90 AS INTEGER) AS shard FROM s WHERE slot < 360)
SELECT doc_id, lang, epoch, shard, row_number() OVER (PARTITION BY shard ORDER BY {_MD5('doc_id', 4, 'epoch', 'shard')}, lang NULLS FIRST, slot) - 1 AS place FROM h"""),
}
