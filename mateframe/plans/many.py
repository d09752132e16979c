"""Queries over positions of four and five pieces, named by orders and by line items."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import board as B
from ..operators import encode as E
from ..operators import universe as U
from .common import csv, line_id, sql_between, sql_image, table

FOUR = ("KQvKR", "KRRvK", "KBNvK", "KPvKP")
FIVE = ("KRPvKR", "KQRvKN", "KBBvKN", "KPPvKP", "KRRvKQ")


def _configs(names, place):
    out = F.when(place == 0, names[0])
    for k, name in enumerate(names[1:], 1):
        out = out.when(place == k, name)
    return out


def four(spark, d):
    """Orders as placements of four pieces."""
    idx = F.pmod(F.col("o_orderkey") * 15485863 + F.col("o_custkey") * 104729, F.lit(math.perm(64, 4)))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), _configs(FOUR, F.col("o_custkey") % 4).alias("config"), idx.alias("idx"), (F.col("o_orderkey") % 2).cast("int").alias("turn"))
    return U.placed_by_rank(rows, list(FOUR), F.col("idx"))


def five(spark, d):
    """Line items as placements of five pieces."""
    idx = F.pmod(F.col("l_orderkey") * 15485863 + F.col("l_partkey") * 104729 + F.col("l_linenumber") * 31337, F.lit(math.perm(64, 5)))
    lines = table(spark, d, "lineitem")
    rows = lines.select(line_id(lines).alias("id"), _configs(FIVE, F.col("l_partkey") % 5).alias("config"), idx.alias("idx"), (F.col("l_linenumber") % 2).cast("int").alias("turn"))
    return U.placed_by_rank(rows, list(FIVE), F.col("idx"))


def _of(n):
    return four if n == 4 else five


def legal(n):
    return lambda spark, d: U.positions(_of(n)(spark, d), n).select("id", "config", "turn")


def canonical(n):
    """Canonical positions of each configuration, and how many orbits the legal ones fall into."""

    def query(spark, d):
        keyed = B.with_keys(U.positions(_of(n)(spark, d), n), n, "own", "key")
        per_key = keyed.groupBy("config", "key").agg(F.count("*").alias("n"), F.count_if(F.col("own") == F.col("key")).alias("c"))
        return per_key.groupBy("config").agg(F.sum("n").alias("legal"), F.sum("c").alias("canonical"), F.count("*").alias("orbits"))

    return query


def edges(n):
    """Attacked squares per piece, and those behind exactly one piece."""

    def query(spark, d):
        e = E.attack_edges(_of(n)(spark, d), n, ["id"], xray=True)
        return e.groupBy("id").agg(F.count_if(F.col("channel") == 1).alias("attacks"), F.count_if(F.col("channel") == 2).alias("xrays"), F.sum(F.col("channel") * (F.col("src") * 64 + F.col("dst"))).alias("digest"))

    return query


def encoded(n):
    """Vectors of version 4: pieces, then pairs, from the view of the side to move."""

    def query(spark, d):
        x = E.encode(U.positions(_of(n)(spark, d), n), n, 4).select("id", "x")
        return x.select("id", F.size("x").alias("width"), F.md5(csv(F.col("x")).cast("binary")).alias("digest"))

    return query


def _men(config):
    return [(kind, white) for kind, white in U.pieces_of(config)]


def _sql_pos(n):
    """``p``: id, config, turn, s, t, c of each slot, k1 and k0; squares step over the earlier ones in ascending order."""
    configs = FOUR if n == 4 else FIVE
    place = "o_custkey % 4" if n == 4 else "l_partkey % 5"
    name = "CASE " + place + " " + " ".join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(configs)) + " END"
    source = (
        f"SELECT o_orderkey AS id, {name} AS config, (o_orderkey * 15485863 + o_custkey * 104729) % {math.perm(64, 4)} AS idx, CAST(o_orderkey % 2 AS INTEGER) AS turn FROM orders"
        if n == 4
        else f"SELECT (((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey) * 100 + CAST(l_quantity AS BIGINT) AS id, {name} AS config, (l_orderkey * 15485863 + l_partkey * 104729 + l_linenumber * 31337) % {math.perm(64, 5)} AS idx, CAST(l_linenumber % 2 AS INTEGER) AS turn FROM lineitem"
    )
    digit = lambda i: f"CAST(idx % {math.perm(64 - i, n - i)} // {math.perm(63 - i, n - i - 1)} AS INTEGER)"
    steps = ["q0 AS (SELECT *, " + digit(0) + " AS s0 FROM ix)"]
    for i in range(1, n):
        earlier = ", ".join(f"s{j}" for j in range(i))
        steps.append(f"q{i} AS (SELECT *, list_reduce(list_sort([{earlier}]), lambda a, e: a + CAST(a >= e AS INTEGER), {digit(i)}) AS s{i} FROM q{i - 1})")
    case = lambda f: "CASE config " + " ".join(f"WHEN '{c}' THEN {f(_men(c))}" for c in configs) + " END"
    men = ", ".join(f"{case(lambda m: m[i][0])} AS t{i}, {case(lambda m: m[i][1])} AS c{i}" for i in range(n))
    k0 = case(lambda m: f"s{next(i for i, (t, c) in enumerate(m) if t == 6 and not c)}")
    return f"ix AS ({source}), {', '.join(steps)}, p AS (SELECT *, {men}, s0 AS k1, {k0} AS k0 FROM q{n - 1})"


def _sql_free(n, i, target):
    return " AND ".join(f"NOT {sql_between(f's{i}', target, f's{j}')}" for j in range(n) if j != i)


def _sql_reach(i, target):
    s, t, c = f"s{i}", f"t{i}", f"c{i}"
    dx, dy = f"abs({s} % 8 - ({target}) % 8)", f"abs({s} // 8 - ({target}) // 8)"
    return f"(({target}) <> {s} AND CASE {t} WHEN 1 THEN {dx} = 1 AND (({target}) // 8 - {s} // 8) = 2 * {c} - 1 WHEN 2 THEN {dx} * {dy} = 2 WHEN 3 THEN {dx} = {dy} WHEN 4 THEN {dx} = 0 OR {dy} = 0 WHEN 5 THEN {dx} = 0 OR {dy} = 0 OR {dx} = {dy} ELSE greatest({dx}, {dy}) = 1 END)"


def _sql_attack(n, i, target):
    return f"({_sql_reach(i, target)} AND (t{i} NOT IN (3, 4, 5) OR ({_sql_free(n, i, target)})))"


def _sql_legal(n):
    """``l``: the legal rows of p; checks on either king per slot first."""
    checks = ", ".join(f"c{i} = 0 AND {_sql_attack(n, i, 'k1')} AS w{i}, c{i} = 1 AND {_sql_attack(n, i, 'k0')} AS b{i}" for i in range(n))
    line = lambda i: f"CASE WHEN s{i} % 8 = kt % 8 THEN 'f' WHEN s{i} // 8 = kt // 8 THEN 'r' WHEN s{i} % 8 - kt % 8 = s{i} // 8 - kt // 8 THEN 'd' WHEN s{i} % 8 - kt % 8 = kt // 8 - s{i} // 8 THEN 'a' ELSE '{i}' END"
    gives = lambda i: f"(CASE turn WHEN 1 THEN w{i} ELSE b{i} END)"
    total = " + ".join(f"CAST({gives(i)} AS INTEGER)" for i in range(n))
    pairs = " OR ".join(f"({gives(i)} AND {gives(j)} AND {line(i)} = {line(j)})" for i in range(n) for j in range(i))
    left = " OR ".join(f"(CASE turn WHEN 1 THEN b{i} ELSE w{i} END)" for i in range(n))
    pawns = " OR ".join(f"(t{i} = 1 AND s{i} // 8 IN (0, 7))" for i in range(n))
    twins = " OR ".join(f"(t{i} = t{j} AND c{i} = c{j} AND s{i} > s{j})" for j in range(n) for i in range(j))
    return f"h AS (SELECT *, {checks}, CASE turn WHEN 1 THEN k1 ELSE k0 END AS kt FROM p WHERE NOT ({pawns}) AND NOT ({twins}) AND greatest(abs(k1 % 8 - k0 % 8), abs(k1 // 8 - k0 // 8)) > 1), l AS (SELECT * FROM h WHERE NOT ({left}) AND ({total} < 2 OR ({total} = 2 AND NOT ({pairs}))))"


def _sql_key(n, image):
    pieces = ", ".join(f"(1 - c{i}) * 512 + t{i} * 64 + {sql_image(f's{i}', image)}" for i in range(n))
    return f"list_reduce(list_sort([{pieces}]), lambda a, x: a * 1024 + x, CAST(1 - turn AS BIGINT))"


def _sql_canonical(n):
    every = f"list_min([{', '.join(_sql_key(n, i) for i in range(8))}])"
    pawns = " OR ".join(f"t{i} = 1" for i in range(n))
    return f"WITH {_sql_pos(n)}, {_sql_legal(n)}, k AS (SELECT config, {_sql_key(n, 0)} AS own, CASE WHEN {pawns} THEN least({_sql_key(n, 0)}, {_sql_key(n, 4)}) ELSE {every} END AS key FROM l) SELECT config, count(*) AS legal, count(*) FILTER (own = key) AS canonical, count(DISTINCT key) AS orbits FROM k GROUP BY 1"


def _sql_edges(n):
    passed = lambda i: " + ".join(f"CAST({sql_between(f's{i}', 'q', f's{j}')} AS INTEGER)" for j in range(n) if j != i)
    seen = " UNION ALL ".join(f"SELECT id, s{i} AS src, q AS dst, CASE WHEN t{i} NOT IN (3, 4, 5) THEN 1 ELSE 1 + {passed(i)} END AS channel FROM p, range(64) r(q) WHERE {_sql_reach(i, 'q')}" for i in range(n))
    return f"WITH {_sql_pos(n)}, e AS ({seen}) SELECT id, count(*) FILTER (channel = 1) AS attacks, count(*) FILTER (channel = 2) AS xrays, CAST(sum(channel * (src * 64 + dst)) AS BIGINT) AS digest FROM e WHERE channel < 3 GROUP BY id"


def _sql_encoded(n):
    view = ", ".join(f"CASE WHEN turn = 0 THEN xor(s{i}, 56) ELSE s{i} END AS s{i}, t{i}, CASE WHEN turn = 0 THEN 1 - c{i} ELSE c{i} END AS c{i}" for i in range(n))
    tall = " UNION ALL ".join(f"SELECT id, s{i} AS s, t{i} AS t, c{i} AS c FROM v" for i in range(n))
    one = lambda test: f"CASE WHEN {test} THEN 1.0 ELSE 0.0 END"
    piece = ["s // 8 / 7.0", "s % 8 / 7.0", *[one(f"t = {t}") for t in range(6, 0, -1)], one("c = 1"), one("c = 0"), "CASE WHEN t <> 1 THEN 0.0 WHEN c = 1 THEN s // 8 / 7.0 ELSE (7 - s // 8) / 7.0 END"]
    dx, dy = "abs(a.s % 8 - b.s % 8)", "abs(a.s // 8 - b.s // 8)"
    pair = [f"({dx} + {dy}) / 14.0", f"greatest({dx}, {dy}) / 7.0", "(b.s % 8 - a.s % 8) / 7.0", "(b.s // 8 - a.s // 8) / 7.0"]
    vec = lambda xs: "[" + ", ".join(f"CAST({x} AS DOUBLE)" for x in xs) + "]"
    text = "array_to_string(list_transform(x, lambda v: CAST(CAST(floor(v * 1000000 + 0.5) AS BIGINT) AS VARCHAR)), ',')"
    return f"""WITH {_sql_pos(n)}, {_sql_legal(n)}, v AS (SELECT id, {view} FROM l),
o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY 1 - c, t, s) AS r FROM ({tall})),
f AS (SELECT id, list({vec(piece)} ORDER BY r) AS ps FROM o GROUP BY id),
g AS (SELECT a.id, list({vec(pair)} ORDER BY a.r, b.r) AS qs FROM o a JOIN o b ON a.id = b.id AND a.r < b.r GROUP BY a.id)
SELECT f.id, CAST(len(flatten(ps) || flatten(qs)) AS INTEGER) AS width, md5({text.replace("(x,", "(flatten(ps) || flatten(qs),")}) AS digest FROM f JOIN g ON f.id = g.id"""


QUERIES = {}
for _n, _name in ((4, "four"), (5, "five")):
    QUERIES |= {
        f"b3_legal_{_name}": (legal(_n), f"WITH {_sql_pos(_n)}, {_sql_legal(_n)} SELECT id, config, turn FROM l"),
        f"b4_canonical_{_name}": (canonical(_n), _sql_canonical(_n)),
        f"c11_encode_{_name}": (encoded(_n), _sql_encoded(_n)),
        f"c20_channels_{_name}": (edges(_n), _sql_edges(_n)),
    }
