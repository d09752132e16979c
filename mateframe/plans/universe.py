"""Queries of enumeration, filters, keys and encodings, over positions derived from line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import board as B
from ..functions.board import Slot
from ..operators import encode as E
from ..operators import universe as U
from .common import CANONICAL, CUSTOMER_POS, KEYS, LEGAL, POS, SQL_CHANNELS, csv, customer_placements, indexed, once, placements, sql_attack, sql_between, sql_image, sql_key, table



class _Slots(list):
    """The three slots, made when they are first used, as a column needs a running session."""

    def __iter__(self):
        if not len(self):
            self.extend(Slot.of(3))
        return super().__iter__()

    def __getitem__(self, i):
        return list(self)[i]


S = _Slots()


#: Offset and limit (0: none) of each configuration's slice.
SLICES = {"KQvK": (50_000, 100_000), "KRvK": (0, 0), "KPvK": (200_000, 0)}


def _legal(spark, d):
    return U.positions(placements(spark, d), 3)


def a1_unrank(spark, d):
    return placements(spark, d).select("id", "idx", "s0", "s1", "s2")


def a2_full_cycle(spark, d):
    return indexed(spark, d).select("id", U.full_cycle(F.col("idx"), 12345, 100003, 249984).alias("shuffled"))


def a3_combination(spark, d):
    rows = indexed(spark, d).select("id", U.unrank_combination(3, F.col("idx") % 41664).alias("q"))
    return rows.select("id", *[F.get("q", F.lit(i)).alias(f"s{i}") for i in range(3)])


def a4_odometer(spark, d):
    rows = indexed(spark, d).select("id", F.array(*U.unrank_odometer(3, F.col("idx"))).alias("q"))
    return rows.where(F.size(F.array_distinct("q")) == 3).select("id", *[F.get("q", F.lit(i)).alias(f"s{i}") for i in range(3)])


def a5_turns(spark, d):
    return U.both_turns(indexed(spark, d).drop("turn")).groupBy("config", "turn").agg(F.count("*").alias("n"))


def a6_slice(spark, d):
    """Resumed slices of ranks, from an offset up to a limit: what they hold, and whether that is all there is of a configuration."""
    bounds = F.create_map(*[F.lit(x) for c, (offset, limit) in SLICES.items() for x in (c, F.struct(F.lit(offset).alias("first"), F.lit(U.slice_end(3, offset, limit)).alias("stop")))])
    rows = indexed(spark, d).withColumn("b", bounds[F.col("config")])
    inside = (F.col("idx") >= F.col("b.first")) & (F.col("idx") < F.col("b.stop"))
    held = F.when(inside, F.col("idx"))
    return rows.groupBy("config").agg(F.count(held).alias("n"), F.min(held).alias("first_idx"), F.max(held).alias("last_idx"), (F.count(held) == F.count("idx")).alias("complete"))


def a7_catalogue(spark, d):
    """Four-piece configurations of the catalogue and how many parts spell each."""
    letters = "QRBNP"
    at = lambda x: F.substr(F.lit(letters), (x % 5 + 1).cast("int"), F.lit(1))
    k = F.col("p_partkey")
    spelled = table(spark, d, "part").select(F.concat(F.lit("K"), at(k), F.lit("vK"), at(F.floor(k / 5))).alias("config")).groupBy("config").agg(F.count("*").alias("n"))
    return U.config_catalogue(spark, 4).hint("merge").join(spelled.hint("merge"), "config", "left").select("config", F.coalesce("n", F.lit(0)).alias("n"))


def a8_explode_config(spark, d):
    return U.explode_config(indexed(spark, d).select("id", "config")).groupBy("config", "slot", "piece_type", "color").agg(F.count("*").alias("n"))


def a10_category(spark, d):
    k, letters = F.col("p_partkey"), F.lit("QRBNP")
    at = lambda x: F.substr(letters, (x % 5 + 1).cast("int"), F.lit(1))
    config = F.when(k % 2 == 0, F.concat(F.lit("K"), at(k), at(F.floor(k / 5)), F.lit("vK"))).otherwise(F.concat(F.lit("K"), at(k), F.lit("vK"), at(F.floor(k / 5))))
    return table(spark, d, "part").select("p_partkey", config.alias("config")).withColumn("category", U.config_category(F.col("config")))


def a20_fen(spark, d):
    """Board fields written and read back: the text, and the pieces it gives; once for all line items of a placement."""

    def fields(named):
        rows = E.with_fen_pieces(E.with_fen(E.with_board(named, 3).select("config", "idx", "board"), "board"), "fen")
        back = F.transform("pieces", lambda p: p["square"] * 100 + p["code"])
        return rows.select("config", "idx", "fen", F.array_join(back.cast("array<string>"), ",").alias("pieces"))

    return once(indexed(spark, d), ["config", "idx"], fields, "fen").select("id", "fen", "pieces")


def b1_pawn_ranks(spark, d):
    return placements(spark, d).where(U.no_edge_pawns(S)).groupBy("config").agg(F.count("*").alias("n"))


def b2_twins(spark, d):
    """Two equal rooks: only one of each two placements stays."""
    rows = placements(spark, d).withColumns({"t0": F.lit(4), "t1": F.lit(4)})
    return rows.where(U.ascending_twins(S)).groupBy("config").agg(F.count("*").alias("n"))


def b3_legal(spark, d):
    return _legal(spark, d).select("id", "config", "turn")


def b4_canonical(spark, d):
    return U.canonical(_legal(spark, d), 3).groupBy("config").agg(F.count("*").alias("n"))


def b6_material(spark, d):
    return placements(spark, d).where(U.material(S) == "KQvK").agg(F.count("*").alias("n"))


def c1_orbit(spark, d):
    return E.orbit(placements(spark, d), 3).select("id", "image", "image_key")


def c2_canonical_key(spark, d):
    return placements(spark, d).select("id", B.canonical_key(S, F.col("turn")).alias("key"))


def c3_canonical_form(spark, d):
    form = E.canonical_form(S, F.col("turn"))
    return placements(spark, d).select("id", form.alias("f")).select("id", F.col("f.key").alias("key"), (F.col("f.image") % 4).alias("rotation"), (F.col("f.image") >= 4).alias("reflected"))


def c4_flip(spark, d):
    return E.flip(placements(spark, d), 3).select("id", "s0", "s1", "s2", "c0", "c1", "c2", "turn")


def c5_material(spark, d):
    return placements(spark, d).select(U.material(S).alias("material")).groupBy("material").agg(F.count("*").alias("n"))


def c6_board_array(spark, d):
    back = E.piece_rows(placements(spark, d).select("id", E.board_array(S).alias("board")), "board")
    return back.select("id", F.col("square").cast("int").alias("square"), "code")


def c7_one_hot(spark, d):
    join = lambda x: F.array_join(x.cast("array<string>"), ",")
    return placements(spark, d).select("id", join(E.one_hot(S)).alias("compact"), join(E.one_hot(S, True)).alias("full"))


def _encoded(version, moves=False):
    """Vectors as text, made once for all line items of a position; they are too wide to be broadcast."""
    of = ["config", "idx", "turn"]

    def vectors(named):
        # from version 4 on, the view turns the side to move
        x = E.encode(named.withColumn("mover", F.col("turn")), 3, version, moves=moves)
        return x.select("config", "idx", F.col("mover").alias("turn"), F.size("x").alias("width"), csv(F.col("x")).alias("x"))

    return lambda spark, d: once(indexed(spark, d), of, vectors, "vectors", lambda found: found.hint("merge")).select("id", "width", "x")


def c9_move_distance(spark, d):
    return placements(spark, d).select("id", *[B.move_distance(F.lit(t), F.col("s0"), F.col("s1")).alias(f"d{t}") for t in range(1, 7)])


def c14_invariant(spark, d):
    return placements(spark, d).select("id", csv(E.invariant(S, F.col("turn"))).alias("x"))


def c15_rules(spark, d):
    s0, s1, s2 = (F.col(f"s{i}") for i in range(3))
    edge = F.least(B.file(s2), 7 - B.file(s2), B.rank(s2), 7 - B.rank(s2))
    return placements(spark, d).select(
        "id", (B.chebyshev(s0, s2) == 1).alias("adjacent"), B.chebyshev(s2, F.lit(27)).alias("to_centre"), edge.alias("to_edge"), ((B.file(s0) + B.rank(s0) + B.file(s1) + B.rank(s1)) % 2 == 0).alias("same_colour")
    )


def c16_attack_edges(spark, d):
    return E.attack_edges(placements(spark, d), 3, ["id"])


def c17_square_features(spark, d):
    return E.square_features(_legal(spark, d), 3, ["id"]).groupBy("id").agg(
        F.sum("white_atk").alias("white_atk"), F.sum("black_atk").alias("black_atk"), F.sum("mask").alias("mask"), F.sum(F.col("flags") * (F.col("square") + 1)).alias("flags")
    )


def c18_pinned(spark, d):
    """Black's piece in slot 1 for a change, so that a white slider in slot 0 may pin it."""
    rows = placements(spark, d).withColumns({"t0": F.lit(4), "t1": F.lit(2), "c1": F.lit(0), "k1": F.lit(None).cast("int")})
    return rows.select("id", B.pinned(S[1], S).alias("pinned"))


def c21_pack(spark, d):
    """Influence edges of boards that customers name as numbers, of a board the first 1,024, and back."""
    e = E.attack_edges(customer_placements(spark, d), 3, ["id"], xray=True).withColumnRenamed("channel", "kind")
    return E.packed_edges(e, "id").select("id", "edge", *E.unpack_edge(F.col("edge")))


def c22_edge_weights(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("user_id") % 64).cast("int").alias("src"), (F.col("event_id") % 64).cast("int").alias("dst"))
    return e.select("event_id", csv(F.array(*E.edge_weights(F.col("src"), F.col("dst")))).alias("w"))


def c23_pawn_progress(spark, d):
    s1 = F.col("s1")
    progress = F.when((F.col("t1") == 1) & (F.col("c1") == 1), B.rank(s1) / 7.0).when(F.col("t1") == 1, (7 - B.rank(s1)) / 7.0).otherwise(0.0)
    return placements(spark, d).groupBy("config").agg(F.round(F.sum(progress), 4).alias("progress"))


def c27_decode(spark, d):
    """Squares read back from version 1 vectors."""
    x = E.encode(placements(spark, d), 3, 1).select("id", "x")
    at = lambda p: (F.round(F.get("x", F.lit(p * 10)) * 7) * 8 + F.round(F.get("x", F.lit(p * 10 + 1)) * 7)).cast("int")
    return x.select("id", *[at(p).alias(f"q{p}") for p in range(3)])


def c28_mirror(spark, d):
    """A mirrored vector is the vector of the mirrored position."""
    rows = placements(spark, d)
    x = E.encode(rows, 3, 4).select("id", "x")
    return x.select("id", csv(E.mirror_vector(F.col("x"), 3)).alias("x"))


def c28_augmented(spark, d):
    """Vectors of boards that customers name, and their mirrors."""
    x = E.encode(customer_placements(spark, d), 3, 4).select("id", "x")
    return E.with_mirrors(x, 3).select("id", "mirrored", F.md5(csv(F.col("x")).cast("binary")).alias("digest"))


def e13_reduction(spark, d):
    keys = _legal(spark, d).select("config", B.packed(S, F.col("turn")).alias("own"), B.canonical_key(S, F.col("turn")).alias("key"))
    # each position once, then its orbits: one key to count after the other instead of both from one expanded table
    orbits = keys.distinct().groupBy("config", "key").agg(F.count("*").alias("n"))
    out = orbits.groupBy("config").agg(F.sum("n").alias("valid"), F.count("*").alias("unique_keys"))
    return out.withColumn("reduction", F.round(1 - F.col("unique_keys") / F.col("valid"), 6))


def e12_population(spark, d):
    """Positions in a space, estimated from a sample of its ranks."""
    hits = F.count_if(U.no_edge_pawns(S) & U.legal(S, F.col("turn")))
    return placements(spark, d).groupBy("config").agg(F.count("*").alias("attempts"), hits.alias("hits")).withColumn("estimate", F.round(F.lit(249984.0) * 2 * F.col("hits") / F.col("attempts"), 3))


def g3_priority(spark, d):
    configs = a10_category(spark, d).groupBy("config").agg(F.count("*").alias("n")).withColumn("pieces", F.length("config") - 1)
    return configs.orderBy("pieces", "config").select("config", "pieces", "n")


# the same in SQL
def _w(body):
    return f"WITH {POS} {body}"


_LETTER = lambda x: f"substr('QRBNP', CAST({x} % 5 + 1 AS INTEGER), 1)"
_PART = f"CASE WHEN p_partkey % 2 = 0 THEN 'K' || {_LETTER('p_partkey')} || {_LETTER('(p_partkey // 5)')} || 'vK' ELSE 'K' || {_LETTER('p_partkey')} || 'vK' || {_LETTER('(p_partkey // 5)')} END"
_CATEGORY = """CASE WHEN (split_part(config, 'v', 1) IN ('KB', 'KN') AND split_part(config, 'v', 2) IN ('KB', 'KN')) OR config IN ('KBBvK', 'KNNvK') THEN 'draw'
  WHEN split_part(config, 'v', 2) = 'K' AND (contains(config, 'QQ') OR contains(config, 'RR') OR contains(config, 'QR')) THEN 'easy'
  WHEN contains(config, 'P') THEN 'promotion' WHEN length(split_part(config, 'v', 1)) = length(split_part(config, 'v', 2)) THEN 'complex' ELSE 'promotion' END"""
_CODE = "CASE WHEN q = s0 THEN 6 WHEN q = s1 THEN t1 WHEN q = s2 THEN 12 ELSE 0 END"


def _dist(a, b):
    return f"abs({a} % 8 - {b} % 8)", f"abs({a} // 8 - {b} // 8)"


def _sql_move(t, a, b):
    dx, dy = _dist(a, b)
    m = f"greatest({dx}, {dy})"
    return f"""CAST(CASE {t} WHEN 6 THEN {m} WHEN 5 THEN CASE WHEN {dx} = 0 OR {dy} = 0 OR {dx} = {dy} THEN 1 ELSE 2 END
      WHEN 4 THEN CASE WHEN {dx} = 0 OR {dy} = 0 THEN 1 ELSE 2 END
      WHEN 3 THEN CASE WHEN ({dx} + {dy}) % 2 <> 0 THEN 10 WHEN {dx} = {dy} THEN 1 ELSE 2 END
      WHEN 2 THEN CASE WHEN {m} = 0 THEN 0 WHEN {dx} * {dy} = 2 THEN 1 WHEN {dx} + {dy} = 1 THEN 3 WHEN {dx} = 2 AND {dy} = 2 THEN 2 ELSE greatest(2, ({m} + 1) // 2) END
      ELSE CASE WHEN {dx} <= 1 AND {dy} > 0 THEN {dy} ELSE 10 END END AS DOUBLE)"""


def _sql_encoded(version, moves=False):
    """Vectors in SQL: slots in the version's order, by the ranks of (colour, type, square)."""
    view = "p" if version < 4 else f"(SELECT id, 1 AS turn, {', '.join(f'CASE WHEN turn = 0 THEN xor(s{i}, 56) ELSE s{i} END AS s{i}, t{i}, CASE WHEN turn = 0 THEN 1 - c{i} ELSE c{i} END AS c{i}' for i in range(3))} FROM p)"
    kind = "t" if version < 5 else "6 - t"
    tall = " UNION ALL ".join(f"SELECT id, turn, s{i} AS s, t{i} AS t, c{i} AS c FROM v{version}" for i in range(3))
    one = lambda test: f"CASE WHEN {test} THEN 1.0 ELSE 0.0 END"
    piece = ["s // 8 / 7.0", "s % 8 / 7.0", *[one(f"t = {t}") for t in range(6, 0, -1)], one("c = 1"), one("c = 0")]
    if version >= 4:
        piece.append("CASE WHEN t <> 1 THEN 0.0 WHEN c = 1 THEN s // 8 / 7.0 ELSE (7 - s // 8) / 7.0 END")
    dx, dy = _dist("a.s", "b.s")
    pair = [f"({dx} + {dy}) / 14.0", f"greatest({dx}, {dy}) / 7.0", "(b.s % 8 - a.s % 8) / 7.0", "(b.s // 8 - a.s // 8) / 7.0"]
    if moves:
        same, ka, kb = "a.c = b.c", "a.t = 6", "b.t = 6"
        weight = f"CASE WHEN {ka} AND {kb} THEN 2.0 WHEN ({ka} OR {kb}) AND NOT ({same}) THEN 1.5 WHEN NOT ({same}) THEN 1.2 ELSE 0.8 END"
        pair += [f"least(least({_sql_move('a.t', 'a.s', 'b.s')}, 10.0) / 10.0 * {weight}, 1.0)", one(same), one(f"{ka} AND {kb}"), one(f"{ka} AND NOT ({same})"), one(f"{kb} AND {same}"), one(f"{kb} AND NOT ({same})"), one("a.t = b.t")]
    vec = lambda xs: "[" + ", ".join(f"CAST({x} AS DOUBLE)" for x in xs) + "]"
    text = "array_to_string(list_transform(x, lambda v: CAST(CAST(floor(v * 1000000 + 0.5) AS BIGINT) AS VARCHAR)), ',')"
    last = "|| [CAST(turn AS DOUBLE)]" if version < 4 else ""
    return _w(f""", v{version} AS (SELECT * FROM {view}),
o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY 1 - c, {kind}, s) AS r FROM ({tall})),
f AS (SELECT id, turn, list({vec(piece)} ORDER BY r) AS ps FROM o GROUP BY id, turn),
g AS (SELECT a.id, list({vec(pair)} ORDER BY a.r, b.r) AS qs FROM o a JOIN o b ON a.id = b.id AND a.r < b.r GROUP BY a.id),
x AS (SELECT f.id, flatten(ps) || flatten(qs) {last} AS x FROM f JOIN g ON f.id = g.id)
SELECT id, CAST(len(x) AS INTEGER) AS width, {text} AS x FROM x""")


def _mirrored(sql):
    """The encoding of the file mirrors of p."""
    return sql.replace("FROM p)", f"FROM (SELECT id, turn, {', '.join(f'{sql_image(f's{i}', 4)} AS s{i}, t{i}, c{i}' for i in range(3))} FROM p))")


def _augmented():
    plain = _sql_encoded(4).replace(POS, CUSTOMER_POS)
    return f"SELECT id, false AS mirrored, md5(x) AS digest FROM ({plain}) UNION ALL SELECT id, true, md5(x) FROM ({_mirrored(plain)})"


_ATT = {i: sql_attack(i, "q") for i in range(3)}
_WHITE, _BLACK = f"CAST({_ATT[0]} AS INT) + CAST({_ATT[1]} AS INT)", f"CAST({_ATT[2]} AS INT)"

QUERIES = {
    "a1_unrank": (a1_unrank, _w("SELECT id, idx, s0, s1, s2 FROM p")),
    "a2_full_cycle": (a2_full_cycle, _w("SELECT id, (12345 + idx * 100003) % 249984 AS shuffled FROM ix")),
    "a3_combination": (a3_combination, _w(""", r0 AS (SELECT id, idx % 41664 AS r FROM ix),
r1 AS (SELECT id, r, list_max(list_filter(range(64), lambda s: s * (s - 1) * (s - 2) // 6 <= r)) AS s0 FROM r0),
r2 AS (SELECT id, r - s0 * (s0 - 1) * (s0 - 2) // 6 AS r, s0 FROM r1),
r3 AS (SELECT id, r, s0, list_max(list_filter(range(64), lambda s: s * (s - 1) // 2 <= r)) AS s1 FROM r2)
SELECT id, CAST(s0 AS INTEGER) AS s0, CAST(s1 AS INTEGER) AS s1, CAST(r - s1 * (s1 - 1) // 2 AS INTEGER) AS s2 FROM r3""")),
    "a4_odometer": (a4_odometer, _w("SELECT * FROM (SELECT id, CAST(idx // 4096 % 64 AS INTEGER) AS s0, CAST(idx // 64 % 64 AS INTEGER) AS s1, CAST(idx % 64 AS INTEGER) AS s2 FROM ix) WHERE s0 <> s1 AND s0 <> s2 AND s1 <> s2")),
    "a5_turns": (a5_turns, _w("SELECT config, t AS turn, count(*) AS n FROM ix, (VALUES (1), (0)) v(t) GROUP BY 1, 2")),
    "a6_slice": (a6_slice, _w(""", b AS (SELECT config, idx, CASE WHEN config = 'KRvK' OR (config = 'KQvK' AND idx BETWEEN 50000 AND 149999) OR (config = 'KPvK' AND idx >= 200000) THEN idx END AS h FROM ix)
SELECT config, count(h) AS n, min(h) AS first_idx, max(h) AS last_idx, count(h) = count(*) AS complete FROM b GROUP BY 1""")),
    "a7_catalogue": (a7_catalogue, f"""WITH l AS (SELECT unnest(range(1, 6)) AS i), s AS (SELECT i, substr('QRBNP', i, 1) AS x FROM l),
c AS (SELECT 'K' || a.x || b.x || 'vK' AS config FROM s a JOIN s b ON a.i <= b.i UNION SELECT 'K' || a.x || 'vK' || b.x FROM s a, s b),
n AS (SELECT 'K' || {_LETTER('p_partkey')} || 'vK' || {_LETTER('(p_partkey // 5)')} AS config, count(*) AS n FROM part GROUP BY 1)
SELECT c.config, coalesce(n, 0) AS n FROM c LEFT JOIN n ON c.config = n.config"""),
    "a8_explode_config": (a8_explode_config, _w("SELECT config, slot, CASE slot WHEN 1 THEN t1 ELSE 6 END AS piece_type, CASE slot WHEN 2 THEN 0 ELSE 1 END AS color, count(*) AS n FROM p, (VALUES (0), (1), (2)) v(slot) GROUP BY 1, 2, 3, 4")),
    "a10_category": (a10_category, f"SELECT p_partkey, config, {_CATEGORY} AS category FROM (SELECT p_partkey, {_PART} AS config FROM part)"),
    "a20_fen": (a20_fen, _w(f""", c AS (SELECT id, q, {_CODE} AS code FROM p, range(64) t(q)),
r AS (SELECT id, q // 8 AS r, string_agg(substr('.PNBRQKpnbrqk', code + 1, 1), '' ORDER BY q) AS x FROM c GROUP BY id, q // 8),
e AS (SELECT id, string_agg({"".join("replace(" for _ in range(8))}x{"".join(f", '{'.' * k}', '{k}')" for k in range(8, 0, -1))}, '/' ORDER BY r DESC) AS fen FROM r GROUP BY id),
b AS (SELECT id, string_agg(CAST(q * 100 + code AS VARCHAR), ',' ORDER BY q) AS pieces FROM c WHERE code > 0 GROUP BY id)
SELECT e.id, fen, pieces FROM e JOIN b ON e.id = b.id""")),
    "b1_pawn_ranks": (b1_pawn_ranks, _w("SELECT config, count(*) AS n FROM p WHERE NOT (t1 = 1 AND s1 // 8 IN (0, 7)) GROUP BY 1")),
    "b2_twins": (b2_twins, _w("SELECT config, count(*) AS n FROM p WHERE s0 < s1 GROUP BY 1")),
    "b3_legal": (b3_legal, _w(f"SELECT id, config, turn FROM p WHERE {LEGAL}")),
    "b4_canonical": (b4_canonical, _w(f"SELECT config, count(*) AS n FROM p WHERE {LEGAL} AND {sql_key(0)} = {CANONICAL} GROUP BY 1")),
    "b6_material": (b6_material, _w("SELECT count(*) AS n FROM p WHERE config = 'KQvK'")),
    "c1_orbit": (c1_orbit, _w(" UNION ALL ".join(f"SELECT id, {i} AS image, {sql_key(i)} AS image_key FROM p" for i in range(8)))),
    "c2_canonical_key": (c2_canonical_key, _w(f"SELECT id, {CANONICAL} AS key FROM p")),
    "c3_canonical_form": (c3_canonical_form, _w(f", k AS (SELECT id, {KEYS} AS ks FROM p), m AS (SELECT id, list_min(ks) AS key, list_position(ks, list_min(ks)) - 1 AS i FROM k) SELECT id, key, CAST(i % 4 AS INTEGER) AS rotation, i >= 4 AS reflected FROM m")),
    "c4_flip": (c4_flip, _w("SELECT id, xor(s0, 56) AS s0, xor(s1, 56) AS s1, xor(s2, 56) AS s2, 1 - c0 AS c0, 1 - c1 AS c1, 1 - c2 AS c2, 1 - turn AS turn FROM p")),
    "c5_material": (c5_material, _w("SELECT config AS material, count(*) AS n FROM p GROUP BY 1")),
    "c6_board_array": (c6_board_array, _w("SELECT id, s0 AS square, 6 AS code FROM p UNION ALL SELECT id, s1, t1 FROM p UNION ALL SELECT id, s2, 12 FROM p")),
    "c7_one_hot": (c7_one_hot, _w("SELECT id, array_to_string(list_sort([s0, 64 + s1, 128 + s2]), ',') AS compact, array_to_string(list_sort([320 + s0, (t1 - 1) * 64 + s1, 704 + s2]), ',') AS full FROM p")),
    "c8_encode_v1": (_encoded(1), _sql_encoded(1)),
    "c9_move_distance": (c9_move_distance, _w("SELECT id, " + ", ".join(f"{_sql_move(t, 's0', 's1')} AS d{t}" for t in range(1, 7)) + " FROM p")),
    "c10_encode_v2": (_encoded(1, True), _sql_encoded(1, True)),
    "c11_encode_v4": (_encoded(4), _sql_encoded(4)),
    "c11_encode_v5": (_encoded(5), _sql_encoded(5)),
    "c14_invariant": (c14_invariant, _w(f""", g AS (SELECT *, {", ".join(f"abs(s{i} % 8 - s{j} % 8) AS x{i}{j}, abs(s{i} // 8 - s{j} // 8) AS y{i}{j}" for i, j in ((0, 1), (0, 2), (1, 2)))},
  (s0 % 8 - s1 % 8) * (s2 % 8 - s1 % 8) + (s0 // 8 - s1 // 8) * (s2 // 8 - s1 // 8) AS dot FROM p)
SELECT id, array_to_string(list_transform([{", ".join(f"sqrt(x{a} * x{a} + y{a} * y{a}) / sqrt(98.0), (x{a} + y{a}) / 14.0, greatest(x{a}, y{a}) / 7.0" for a in ("01", "02", "12"))},
  acos(greatest(-1.0, least(1.0, dot / (sqrt(CAST(x01 * x01 + y01 * y01 AS DOUBLE)) * sqrt(CAST(x12 * x12 + y12 * y12 AS DOUBLE)))))) / pi(), CAST(turn AS DOUBLE)],
  lambda v: CAST(CAST(floor(v * 1000000 + 0.5) AS BIGINT) AS VARCHAR)), ',') AS x FROM g""")),
    "c15_rules": (c15_rules, _w("SELECT id, greatest(abs(s0 % 8 - s2 % 8), abs(s0 // 8 - s2 // 8)) = 1 AS adjacent, greatest(abs(s2 % 8 - 3), abs(s2 // 8 - 3)) AS to_centre, least(s2 % 8, 7 - s2 % 8, s2 // 8, 7 - s2 // 8) AS to_edge, (s0 % 8 + s0 // 8 + s1 % 8 + s1 // 8) % 2 = 0 AS same_colour FROM p")),
    "c16_attack_edges": (c16_attack_edges, _w(" UNION ALL ".join(f"SELECT id, s{i} AS src, CAST(q AS INTEGER) AS dst, c{i} AS white FROM p, range(64) t(q) WHERE {_ATT[i]}" for i in range(3)))),
    "c17_square_features": (c17_square_features, _w(f""", a AS (SELECT id, turn, q, s0, s1, s2, t1, {_WHITE} AS w, {_BLACK} AS b, CASE WHEN {_ATT[0]} OR {_ATT[2]} THEN 32 ELSE 0 END | CASE WHEN {_ATT[1]} THEN CAST(power(2, t1 - 1) AS INTEGER) ELSE 0 END AS m,
    CASE WHEN q IN (s0, s1) THEN 1 WHEN q = s2 THEN 0 ELSE turn END AS who FROM p, range(64) t(q) WHERE {LEGAL}),
f AS (SELECT *, CASE WHEN who = 1 THEN b ELSE w END AS theirs, CASE WHEN who = 1 THEN w ELSE b END AS ours FROM a)
SELECT id, CAST(sum(w) AS BIGINT) AS white_atk, CAST(sum(b) AS BIGINT) AS black_atk, CAST(sum(m) AS BIGINT) AS mask,
  CAST(sum((q + 1) * (CASE WHEN (turn = 1 AND q = s0 AND b > 0) OR (turn = 0 AND q = s2 AND w > 0) THEN 1 ELSE 0 END + CASE WHEN theirs = 0 THEN 4 ELSE 0 END
    + CASE WHEN q IN (s0, s1, s2) AND theirs > 0 AND ours = 0 THEN 8 ELSE 0 END + CASE WHEN ours > 0 THEN 16 ELSE 0 END)) AS BIGINT) AS flags FROM f GROUP BY id""")),
    "c18_pinned": (c18_pinned, _w(f"SELECT id, (s0 % 8 = s2 % 8 OR s0 // 8 = s2 // 8) AND {sql_between('s0', 's2', 's1')} AS pinned FROM p")),
    "c21_pack": (c21_pack, f"""WITH {CUSTOMER_POS}, e AS ({SQL_CHANNELS})
SELECT id, CAST(channel * 4096 + src * 64 + dst AS INTEGER) AS edge, CAST(channel AS INTEGER) AS kind, CAST(src AS INTEGER) AS src, CAST(dst AS INTEGER) AS dst FROM e QUALIFY row_number() OVER (PARTITION BY id ORDER BY channel * 4096 + src * 64 + dst) <= 1024"""),
    "c22_edge_weights": (c22_edge_weights, """WITH e AS (SELECT event_id, user_id % 64 AS a, event_id % 64 AS b FROM events)
SELECT event_id, array_to_string(list_transform([CAST((b % 8 - a % 8) / 7.0 AS DOUBLE), CAST((b // 8 - a // 8) / 7.0 AS DOUBLE), CAST((abs(b % 8 - a % 8) + abs(b // 8 - a // 8)) / 14.0 AS DOUBLE), CAST(greatest(abs(b % 8 - a % 8), abs(b // 8 - a // 8)) / 7.0 AS DOUBLE)],
  lambda v: CAST(CAST(floor(v * 1000000 + 0.5) AS BIGINT) AS VARCHAR)), ',') AS w FROM e"""),
    "c23_pawn_progress": (c23_pawn_progress, _w("SELECT config, round(sum(CASE WHEN t1 = 1 THEN CAST(s1 // 8 AS DOUBLE) / 7.0 ELSE 0.0 END), 4) AS progress FROM p GROUP BY 1")),
    "c27_decode": (c27_decode, _w(" SELECT id, CASE WHEN t1 = 6 OR t1 > 6 THEN s0 ELSE s1 END AS q0, s0 AS q1, s2 AS q2 FROM p")),
    "c28_mirror": (c28_mirror, _sql_encoded(4).replace("FROM p)", f"FROM (SELECT id, turn, {', '.join(f'{sql_image(f's{i}', 4)} AS s{i}, t{i}, c{i}' for i in range(3))} FROM p))").replace("SELECT id, CAST(len(x) AS INTEGER) AS width, ", "SELECT id, ")),
    "c28_augmented": (c28_augmented, _augmented()),
    "e12_population": (e12_population, _w(f"SELECT config, count(*) AS attempts, count(*) FILTER (WHERE {LEGAL}) AS hits, round(249984.0 * 2 * count(*) FILTER (WHERE {LEGAL}) / count(*), 3) AS estimate FROM p GROUP BY 1")),
    "e13_reduction": (e13_reduction, _w(f", k AS (SELECT config, {sql_key(0)} AS own, {CANONICAL} AS key FROM p WHERE {LEGAL}) SELECT config, count(DISTINCT own) AS valid, count(DISTINCT key) AS unique_keys, round(1 - CAST(count(DISTINCT key) AS DOUBLE) / count(DISTINCT own), 6) AS reduction FROM k GROUP BY 1")),
    "g3_priority": (g3_priority, f"SELECT config, CAST(length(config) - 1 AS INTEGER) AS pieces, count(*) AS n FROM (SELECT {_PART} AS config FROM part) GROUP BY 1"),
}
