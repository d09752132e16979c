"""What the registered queries share: table access and positions derived from a table."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import stored
from ..operators.ranks import sized
from ..operators.universe import placed_by_rank

#: Configurations of the derived positions, by return flag.
CONFIGS = {"A": "KQvK", "N": "KRvK", "R": "KPvK"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_id(lines: DataFrame) -> Column:
    """All keys of a line item as one number.

    A long, as in SQL, while each of the table's fits one (below some 9.22 million orders); else, where SQL raises an
    error, a decimal, so that the number stays what it is.
    """
    order, rest = F.col("l_orderkey"), F.col("l_linenumber") * 10**11 + F.col("l_partkey") * 10**6 + F.col("l_suppkey") * 100 + F.col("l_quantity").cast("long")
    fits = F.try_add(F.try_multiply(order, F.lit(10**12)), rest).isNotNull()
    if lines.where(~fits & order.isNotNull() & rest.isNotNull()).isEmpty():
        return order * 10**12 + rest
    return (order.cast("decimal(20,0)") * F.lit(Decimal(10**12)) + rest).cast("decimal(38,0)")


def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as ranks of placements: id, config, idx, turn."""
    lines = table(spark, sf_dir, "lineitem")
    idx = F.pmod(F.col("l_orderkey") * 7919 + F.col("l_partkey") * 104729 + F.col("l_linenumber") * 31, F.lit(249984))
    config = F.when(F.col("l_returnflag") == "A", "KQvK").when(F.col("l_returnflag") == "N", "KRvK").otherwise("KPvK")
    return lines.select(line_id(lines).alias("id"), config.alias("config"), idx.alias("idx"), (F.col("l_linenumber") % 2).cast("int").alias("turn"))


def placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as placements of three pieces: s, t, c, k1, k0."""
    return ranked_placements(indexed(spark, sf_dir))


def ranked_placements(ranks: DataFrame) -> DataFrame:
    """Placements of three pieces by config and idx."""
    return placed_by_rank(ranks, list(CONFIGS.values()), F.col("idx"))


def once(lines: DataFrame, of: list[str], work: Callable[[DataFrame], DataFrame], name: str, hint: Callable[[DataFrame], DataFrame] = sized) -> DataFrame:
    """What ``work`` makes of the placements that line items name by ``of``, each worked out once, joined to all that name it.

    A line item without a rank names none, as in SQL.
    """
    found = stored(work(ranked_placements(lines.select(*of).where("idx IS NOT NULL").distinct())), name)
    return lines.join(hint(found), of)


def customer_placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as placements of three pieces, some ten times fewer than line items."""
    idx = F.pmod(F.col("c_custkey") * 15485863 + F.col("c_nationkey") * 31, F.lit(249984))
    config = F.when(F.col("c_nationkey") % 3 == 0, "KQvK").when(F.col("c_nationkey") % 3 == 1, "KRvK").otherwise("KPvK")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), config.alias("config"), idx.alias("idx"), (F.col("c_custkey") % 2).cast("int").alias("turn"))
    return placed_by_rank(rows, list(CONFIGS.values()), F.col("idx"))


def csv(x: Column) -> Column:
    """A vector as text with six decimals, for comparing."""
    return F.array_join(F.transform(x, lambda v: F.floor(v * 1000000 + 0.5).cast("string")), ",")


#: The same positions in DuckDB SQL.
POS = """
ix AS (SELECT (((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey) * 100 + CAST(l_quantity AS BIGINT) AS id, CASE l_returnflag WHEN 'A' THEN 'KQvK' WHEN 'N' THEN 'KRvK' ELSE 'KPvK' END AS config,
         (l_orderkey * 7919 + l_partkey * 104729 + l_linenumber * 31) % 249984 AS idx, CAST(l_linenumber % 2 AS INTEGER) AS turn FROM lineitem),
u AS (SELECT *, CAST(idx // 3906 AS INTEGER) AS s0, CAST((idx % 3906) // 62 AS INTEGER) AS a, CAST(idx % 62 AS INTEGER) AS b FROM ix),
v AS (SELECT *, CASE WHEN a >= s0 THEN a + 1 ELSE a END AS s1 FROM u),
p AS (SELECT id, config, idx, turn, s0, s1,
        CASE WHEN b >= least(s0, s1) THEN CASE WHEN b + 1 >= greatest(s0, s1) THEN b + 2 ELSE b + 1 END ELSE b END AS s2,
        6 AS t0, CASE config WHEN 'KQvK' THEN 5 WHEN 'KRvK' THEN 4 ELSE 1 END AS t1, 6 AS t2, 1 AS c0, 1 AS c1, 0 AS c2 FROM v)
"""

CUSTOMER_POS = """
ix AS (SELECT c_custkey AS id, CASE c_nationkey % 3 WHEN 0 THEN 'KQvK' WHEN 1 THEN 'KRvK' ELSE 'KPvK' END AS config, (c_custkey * 15485863 + c_nationkey * 31) % 249984 AS idx, CAST(c_custkey % 2 AS INTEGER) AS turn FROM customer),
""" + POS[POS.index("u AS") :]


def sql_between(a: str, b: str, x: str) -> str:
    return (
        f"((({x}) % 8 - ({a}) % 8) * (({b}) // 8 - ({a}) // 8) = (({x}) // 8 - ({a}) // 8) * (({b}) % 8 - ({a}) % 8)"
        f" AND ({x}) % 8 BETWEEN least(({a}) % 8, ({b}) % 8) AND greatest(({a}) % 8, ({b}) % 8)"
        f" AND ({x}) // 8 BETWEEN least(({a}) // 8, ({b}) // 8) AND greatest(({a}) // 8, ({b}) // 8) AND ({x}) <> ({a}) AND ({x}) <> ({b}))"
    )


def sql_attack(i: int, target: str) -> str:
    """Slot i of three attacks ``target``."""
    s, t, c = f"s{i}", f"t{i}", f"c{i}"
    dx, dy = f"abs({s} % 8 - ({target}) % 8)", f"abs({s} // 8 - ({target}) // 8)"
    free = " AND ".join(f"NOT {sql_between(s, target, f's{j}')}" for j in range(3) if j != i)
    return (
        f"(({target}) <> {s} AND CASE {t} WHEN 1 THEN {dx} = 1 AND (({target}) // 8 - {s} // 8) = 2 * {c} - 1"
        f" WHEN 5 THEN ({dx} = 0 OR {dy} = 0 OR {dx} = {dy}) AND {free} WHEN 4 THEN ({dx} = 0 OR {dy} = 0) AND {free}"
        f" ELSE greatest({dx}, {dy}) = 1 END)"
    )


#: Legality of p: kings apart, nobody left in check; only slot 1 can give one.
LEGAL = f"(greatest(abs(s0 % 8 - s2 % 8), abs(s0 // 8 - s2 // 8)) > 1 AND NOT (turn = 1 AND {sql_attack(1, 's2')}) AND NOT (t1 = 1 AND s1 // 8 IN (0, 7)))"


def sql_image(s: str, image: int) -> str:
    f, r = f"({s} % 8)", f"({s} // 8)"
    f = f"(7 - {f})" if image >= 4 else f
    for _ in range(image % 4):
        f, r = r, f"(7 - {f})"
    return f"({r} * 8 + {f})"


def sql_key(image: int) -> str:
    pieces = ", ".join(f"(1 - c{i}) * 512 + t{i} * 64 + {sql_image(f's{i}', image)}" for i in range(3))
    return f"list_reduce(list_sort([{pieces}]), lambda a, x: a * 1024 + x, CAST(1 - turn AS BIGINT))"


KEYS = "[" + ", ".join(sql_key(i) for i in range(8)) + "]"
CANONICAL = f"CASE WHEN t1 = 1 THEN least({sql_key(0)}, {sql_key(4)}) ELSE list_min({KEYS}) END"

#: Influence (channel 1) and x-ray (2) edges of p: id, channel, src, dst.
_SQL_REACH = "CASE t{i} WHEN 1 THEN false WHEN 5 THEN s{i} % 8 = q % 8 OR s{i} // 8 = q // 8 OR abs(s{i} % 8 - q % 8) = abs(s{i} // 8 - q // 8) WHEN 4 THEN s{i} % 8 = q % 8 OR s{i} // 8 = q // 8 ELSE false END"
_SQL_PASSED = lambda i: " + ".join(f"CAST({sql_between(f's{i}', 'q', f's{j}')} AS INT)" for j in range(3) if j != i)
SQL_CHANNELS = " UNION ALL ".join(
    f"SELECT id, 1 AS channel, s{i} AS src, CAST(q AS INTEGER) AS dst FROM p, range(64) t(q) WHERE {sql_attack(i, 'q')} UNION ALL SELECT id, 2, s{i}, CAST(q AS INTEGER) FROM p, range(64) t(q) WHERE q <> s{i} AND {_SQL_REACH.format(i=i)} AND {_SQL_PASSED(i)} = 1"
    for i in range(3)
)
