"""N-gram Jaccard join: tiles of near sizes, bitmap bounds, exact sorted intersections.

A text's set holds the hashes of its distinct word shingles; texts link when their sets have a
Jaccard similarity of at least 3/4. The result is the connected components.

1. Texts with equal sets are one class from the start.
2. A class has a size and a bitmap of all its hashes. Up to ``exact`` hashes it is searched by all of
   them: it shares 3 n / 4 or more with any set that it links with. A pair with a larger set is searched by the
   ``SKETCH`` smallest hashes of both; the number of shared ones is then hypergeometric with a mean of 36 or more, and
   that it is below ``SHARED`` has a probability of some 5e-13 a link, like a clash of hashes. Sets that may be in
   pairs of both kinds are searched in both ways.
3. These hashes are counted over all classes. Of those that others have too, a class leaves aside the commonest,
   one fewer than it must share, and keeps the rest, which must hold a shared one. So what very many texts have in
   common is left aside, and a copy too much edited to link with anything keeps nothing.
4. A tile is a kept hash and a band of sizes. Bands overlap: a class is in the band of its size and
   in the one before, so sizes that can link meet in one band, and others mostly don't. First
   every class is compared with the least and the greatest id of its tiles, which joins large
   families in linear work. Tiles that still hold several components are cut into blocks, and
   pairs of blocks are compared; members of the largest component aren't compared with each other.
5. A pair is skipped when sizes are too far apart, or when the bits of the bitmaps already bound
   the intersection below what is needed; what is left is intersected exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .segments import Powers, mix
from .words import WordHashes, parts

SHINGLE = 5
#: Hashes in a sketch, words of 64 bits in a bitmap.
SKETCH, BITMAP = 48, 32
#: Largest set that is searched by all its hashes, unless another bound is given; least number of hashes that linked sketches of larger sets share.
EXACT, SHARED = 188, 13
#: Ratio of sizes from one band to the next; it exceeds the 4/3 between linked sets, so that rounding can't part them.
BAND = 1.35
#: Classes of a tile in one block, and rows that are compared in one group of blocks.
TILE, TOGETHER = 2048, 1 << 16


def shingle_sets(k: int = SHINGLE):
    """A reader of columns of texts as sorted distinct shingle hashes; only A-Z are lowered."""
    read, up = WordHashes(lower=True), Powers(k + 1).up

    def of(texts: pa.Array) -> list[np.ndarray]:
        offsets, x = read(texts)
        n = max(len(x) - k + 1, 0)
        h = np.full(n, k, np.uint64)
        for i in range(k):
            h += x[i : i + n] * up[i]
        h, out = mix(h), []
        for a, b in zip(offsets.tolist(), offsets[1:].tolist()):
            if b - a >= k:
                s = np.sort(h[a : b - k + 1])
                out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
            else:  # the whole sequence, or nothing
                out.append(mix((x[a:b] * up[: b - a]).sum(keepdims=True) + np.uint64(b - a)) if b > a else x[a:b])
        return out

    return of


def sketch_size(n: int, exact: int | None = EXACT) -> int:
    """Hashes by which a set of ``n`` is searched; with ``exact`` None all are, whatever the size."""
    return n if exact is None or n <= exact else SKETCH


def _sets(exact: int | None):
    names = ["key", "n", "set1", "set2", "sketch", "bits"]

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = None
        for batch in batches:
            of = of or shingle_sets()
            for part in parts(batch, 1):
                sets = of(part.column(1))
                bits = np.zeros((len(sets), BITMAP * 64), np.uint8)
                for row, s in zip(bits, sets, strict=True):
                    row[(s >> np.uint64(32)) % np.uint64(BITMAP * 64)] = 1
                packed = np.packbits(bits, axis=1)
                sums = [(s.sum(dtype=np.uint64), mix(s).sum(dtype=np.uint64)) for s in sets]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(np.array([a for a, _ in sums], np.uint64).view(np.int64)), pa.array(np.array([b for _, b in sums], np.uint64).view(np.int64)),
                    pa.array([s[: sketch_size(len(s), exact)].view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array([p.tobytes() for p in packed], pa.binary()),
                ], names)

    return rows


def _payload(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    of = None
    for batch in batches:
        of = of or shingle_sets()
        for part in parts(batch, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in of(part.column(1))], pa.binary())], ["id", "items"])


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Do two sorted arrays of distinct hashes have a Jaccard similarity of 3/4?"""
    if 4 * len(x) < 3 * len(y) or 4 * len(y) < 3 * len(x):
        return False
    both = np.concatenate([x, y])
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= 75 * (len(x) + len(y) - common)


def _verified(pairs: DataFrame, payload: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sets link: exact intersection of sorted arrays."""
    left = payload.select(F.col("id").alias("a"), F.col("items").alias("x"))
    right = payload.select(F.col("id").alias("b"), F.col("items").alias("y"))
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "x", "y")

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return both.mapInArrow(check, "a long, b long")


def components(links: DataFrame, name: str) -> DataFrame:
    """(id, root) for all ids in ``links`` (a, b): root is the smallest id that links lead to.

    Rounds of pointing every id to the smallest id known near it, and of replacing edges by
    edges between such roots; the edges shrink each round and are written to the shared folder.
    """
    edges = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        # an id points to its smallest neighbour or to itself
        points = stored(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")), f"{name}-points")
        # pointers of pointers, until they stand still (depth halves each time)
        while True:
            up = points.select(F.col("a").alias("p"), F.col("p").alias("q"))
            nearer = stored(points.join(up.hint("merge"), "p").select("a", F.col("q").alias("p"), (F.col("p") != F.col("q")).alias("moved")), f"{name}-up")
            points = nearer.select("a", "p")
            if nearer.where("moved").isEmpty():
                break
        maps.append(points)
        a, b = points.select("a", F.col("p").alias("pa")), points.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        moved = edges.join(a.hint("merge"), "a").join(b.hint("merge"), "b").where("pa != pb")
        edges = stored(moved.select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct(), f"{name}-edges")
    if not maps:
        return links.select(F.col("a").alias("id"), F.col("b").alias("root"))
    found = maps[0].select(F.col("a").alias("id"), F.col("p").alias("root"))
    for m in maps[1:]:
        up = m.select(F.col("a").alias("root"), F.col("p").alias("__up"))
        found = found.join(up.hint("merge"), "root", "left").select("id", F.coalesce("__up", "root").alias("root"))
    return stored(found, f"{name}-components")


def _near(n1: str, n2: str):
    """Sizes that a similarity of 3/4 allows."""
    return (F.col(n1) * 4 >= F.col(n2) * 3) & (F.col(n2) * 4 >= F.col(n1) * 3)


def kept(n: Column, ts: Column, exact: int | None) -> Column:
    """Array of (token, wide) that a set of ``n`` keeps of ``ts``, its (df, token, pos) in order of rarity.

    The tokens for pairs with a set above ``exact`` are ``wide``; they are hashed once more, so that tiles are of one kind.
    """
    rarest = lambda ts, need: F.slice(ts, F.lit(1), F.greatest(F.size(ts) - need + 1, F.lit(0)))
    all_ = F.transform(rarest(ts, F.ceil(n * 3 / 4).cast("int")), lambda t: F.struct(t["token"].alias("token"), F.lit(False).alias("wide")))
    if exact is None:
        return all_
    sketch = rarest(F.filter(ts, lambda t: t["pos"] < SKETCH), F.lit(SHARED))
    wide = F.transform(sketch, lambda t: F.struct(F.xxhash64(t["token"]).alias("token"), F.lit(True).alias("wide")))
    none = F.array().cast("array<struct<token:bigint,wide:boolean>>")
    return F.concat(F.when(n <= exact, all_).otherwise(none), F.when(n * 4 > exact * 3, wide).otherwise(none))


def band(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / math.log(BAND)).cast("int")


def _possible(x: dict, y: dict, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids (a, b) in two blocks whose sizes and bitmaps allow a link and whose components differ.

    Blocks are columns as arrays. Of two classes one at least must be of the tile's own band: those of the
    next one meet there. In a block with itself (``same``) each pair comes once.
    """
    for i in range(len(x["id"])):
        first = i + 1 if same else 0
        n, m = x["n"][i], y["n"][first:]
        j = np.flatnonzero((4 * m >= 3 * n) & (4 * n >= 3 * m) & (y["root"][first:] != x["root"][i]) & (y["own"][first:] | x["own"][i])) + first
        if not len(j):
            continue
        common_bits = np.bitwise_count(y["bits"][j] & x["bits"][i]).sum(axis=1, dtype=np.int64)
        # a bit of one alone is at least one shingle of it alone
        most = np.minimum(n - (x["set"][i] - common_bits), y["n"][j] - (y["set"][j] - common_bits))
        j = j[100 * most >= 75 * (n + y["n"][j] - most)]
        if len(j):
            yield np.full(len(j), x["id"][i]), y["id"][j]


def _compare(pdf: pd.DataFrame) -> pd.DataFrame:
    """Candidate pairs of a group of cells; a cell is two blocks of a tile (or one with itself)."""
    pdf = pdf.sort_values(["token", "band", "i", "j", "side"], kind="stable")
    bits = np.frombuffer(b"".join(pdf["bits"]), np.uint64).reshape(len(pdf), -1)
    columns = {c: pdf[c].to_numpy() for c in ("id", "n", "root", "own", "side")} | {"bits": bits, "set": np.bitwise_count(bits).sum(axis=1, dtype=np.int64)}
    cell = pdf[["token", "band", "i", "j"]].to_numpy()
    edges = np.flatnonzero(np.any(cell[1:] != cell[:-1], axis=1)) + 1
    got = []
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(pdf)], strict=True):
        alone = columns["side"][a] == 2
        middle = b if alone else a + int(np.searchsorted(columns["side"][a:b], 1))
        x = {c: v[a:middle] for c, v in columns.items()}
        y = x if alone else {c: v[middle:b] for c, v in columns.items()}
        got += _possible(x, y, alone)
    if not got:
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    a, b = (np.concatenate(c) for c in zip(*got, strict=True))
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()


def join(docs: DataFrame, *, exact: int | None = EXACT) -> DataFrame:
    """(key, n_shingles, root) for ``docs`` (key long, text): root is the smallest linked key.

    Texts without words, and null ones, have an empty set, link to nothing and are their own
    root. Equal sets link. Keys must be unique; every text is read whole; no pair is left out
    for the size of its group. Sets of up to ``exact`` hashes lose no link, larger ones one in 2e12; with None none does, for
    all hashes of all sets being counted and joined. An empty table gives no rows.
    """
    sets = stored(docs.select("key", "text").mapInArrow(_sets(exact), "key long, n long, set1 long, set2 long, sketch array<long>, bits binary"), "shingle-sets")
    full = sets.where("n > 0")
    # totals by a key are written before they are joined on it, so that adaptive execution can split a hot key's rows
    owners = stored(full.groupBy("n", "set1", "set2").agg(F.min("key").alias("id")), "class-owners")
    member = stored(full.select("key", "n", "set1", "set2").join(owners.hint("merge"), ["n", "set1", "set2"]).select("key", "id", "n"), "classes")
    classes = stored(full.select(F.col("key").alias("id"), "n", "sketch", "bits").join(owners.select("id").hint("merge"), "id", "left_semi"), "class-sketches")

    # hashes that two classes or more are searched by, rarest first, less the commonest of them
    tokens = classes.select("id", "n", F.posexplode("sketch").alias("pos", "token"))
    counts = stored(tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "hash-counts")
    shared = tokens.join(counts.hint("merge"), "token").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token", "pos"))).alias("ts"))
    found = shared.select("id", "n", F.inline(kept(F.col("n"), F.col("ts"), exact)))
    tiles = stored(found.select("id", "n", "token", "wide", F.explode(F.array(band(F.col("n")) - 1, band(F.col("n")))).alias("band")), "tiles")

    # large families: each class against the least and the greatest id of its tiles
    ends = tiles.groupBy("token", "band").agg(F.min(F.struct("id", "n")).alias("lo"), F.max(F.struct("id", "n")).alias("hi"), F.min("wide").alias("wide"), F.max("n").alias("most"))
    # pairs of sets that are both small meet in the tiles of all hashes
    if exact is not None:
        ends = ends.where(~F.col("wide") | (F.col("most") > exact))
    ends = stored(ends.where("lo.id != hi.id").select("token", "band", "lo", "hi"), "tile-ends")
    stars = stored(tiles.join(ends.hint("merge"), ["token", "band"]), "open-tiles")
    star = lambda end: stars.select(F.col(f"{end}.id").alias("a"), F.col("id").alias("b"), F.col(f"{end}.n").alias("m"), "n").where(_near("m", "n") & (F.col("a") != F.col("b"))).select("a", "b")
    pairs = stored(star("lo").union(star("hi")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "star-pairs")
    busy = stored(stars.select("id").distinct(), "busy-classes")
    payload = stored(docs.select(F.col("key").alias("id"), "text").join(busy.hint("merge"), "id", "left_semi").mapInArrow(_payload, "id long, items binary"), "shingle-arrays")
    links = stored(_verified(pairs, payload), "star-links")
    first = components(links, "star")

    # tiles that still hold several components, and the largest of these
    placed = stored(stars.select("id", "n", "token", "band").join(first.hint("merge"), "id", "left").withColumn("root", F.coalesce("root", "id")), "placed-classes")
    sums = [F.sum(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1 << 40))).alias(f"s{i}") for i in range(2)]
    roots = placed.groupBy("token", "band", "root").agg(F.count("*").alias("m"), *sums)
    mixed = roots.groupBy("token", "band").agg(F.max(F.struct("m", "root")).alias("home"), F.count("*").alias("roots"), F.sum("m").alias("c"), F.sum("s0").alias("s0"), F.sum("s1").alias("s1")).where("roots > 1")
    # tiles with the same members are compared once
    mixed = mixed.groupBy("c", "s0", "s1", "band").agg(F.min(F.struct("token", "home")).alias("t")).select(F.col("t.token").alias("token"), "band", "c", F.col("t.home.m").alias("h"), F.col("t.home.root").alias("home"))
    # the home component lies in blocks 0 to hs - 1, all other classes in blocks hs to all - 1
    sized = mixed.withColumn("hs", F.ceil(F.col("h") / TILE).cast("int")).withColumn("all", F.col("hs") + F.ceil((F.col("c") - F.col("h")) / TILE).cast("int"))
    sized = stored(sized, "mixed-tiles")
    seats = sized.agg(F.sum(F.col("h") * (F.col("all") - F.col("hs")) + (F.col("c") - F.col("h")) * F.col("all"))).first()[0] or 0
    at_home = F.col("root") == F.col("home")
    block = F.when(at_home, F.pmod(F.xxhash64("id"), F.col("hs"))).otherwise(F.col("hs") + F.pmod(F.xxhash64("id"), F.col("all") - F.col("hs"))).cast("int")
    cell = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    partner = lambda k: F.when(k < F.col("block"), cell(k, F.col("block"), 1)).when(k > F.col("block"), cell(F.col("block"), k, 0)).otherwise(cell(k, k, 2))
    partners = F.transform(F.sequence(F.when(at_home, F.col("hs")).otherwise(F.lit(0)), F.col("all") - 1), partner)
    open_ = placed.join(sized.hint("merge"), ["token", "band"]).withColumn("block", block).select("token", "band", "id", "n", "root", F.inline(partners))
    cells = open_.join(classes.select("id", "bits").hint("merge"), "id").withColumn("own", band(F.col("n")) == F.col("band"))
    # small cells are compared many in a group
    groups = cells.withColumn("g", F.pmod(F.xxhash64("token", "band", "i", "j"), F.lit(max(1, math.ceil(seats / TOGETHER)) * 4)))
    more = groups.groupBy("g").applyInPandas(_compare, "a long, b long").distinct()
    rest = stored(_verified(stored(more, "tile-pairs"), payload), "tile-links")
    final = components(links.union(rest), "all") if not rest.isEmpty() else first

    roots = member.join(final.hint("merge"), "id", "left").select("key", F.col("n").alias("n_shingles"), F.coalesce("root", "id").alias("root"))
    return roots.unionByName(sets.where("n = 0").select("key", F.col("n").alias("n_shingles"), F.col("key").alias("root")))


def numbered(docs: DataFrame) -> tuple[DataFrame, bool]:
    """``docs`` with a unique ``key``, and whether that is the doc_id itself.

    When ids aren't unique or some are null, a row number stands in for them, ordered by id
    (nulls last); it is stored, so that it stays the same.
    """
    rows = docs.withColumn("key", F.col("doc_id").cast("long"))
    if rows.groupBy("key").count().where("count > 1 OR key IS NULL").limit(1).isEmpty():
        return rows, True
    order = F.col("key").asc_nulls_last()
    rows = rows.repartitionByRange(order, F.xxhash64("text")).sortWithinPartitions(order)
    return stored(rows.withColumn("key", F.monotonically_increasing_id()), "numbered"), False


def near_duplicates(docs: DataFrame, *, exact: int | None = EXACT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for ``docs`` (doc_id, text); ``exact`` as in ``join``.

    Rows that share a doc_id, and rows whose id is null, each keep a row of their own: when ids
    aren't unique, a row number stands in for them, ordered by id, so that the smallest id of a
    component is still the id of its smallest row.
    """
    rows, unique = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    found = join(rows.select("key", "text"), exact=exact)
    if unique:
        return found.select(F.col("key").alias("doc_id"), "n_shingles", F.col("root").alias("component_id"))
    id_of = rows.select("key", "doc_id")
    named = found.join(id_of.hint("merge"), "key").select("key", "doc_id", "n_shingles", "root")
    return named.join(id_of.select(F.col("key").alias("root"), F.col("doc_id").alias("component_id")).hint("merge"), "root").select("doc_id", "n_shingles", "component_id")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: Connected components by recursion over all linked pairs; pairs come from a join on shingles.
SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 5], ' ') AS x
  FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = d.doc_id
"""
