"""Positions as feature vectors, graphs and keys; every function works on slots t, c, s."""

from __future__ import annotations

import functools
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.board import KING, PAWN, Slot, attack_count, attack_mask, chebyshev, distances, file, fixed, has, images, manhattan, move_distance, packed_images, pinned, rank, with_kings, with_masks, xray_mask


def flip(df: DataFrame, n: int) -> DataFrame:
    """The other side's view: ranks mirrored, colours and turn swapped."""
    slots = {f"s{i}": F.col(f"s{i}").bitwiseXOR(F.lit(56)) for i in range(n)} | {f"c{i}": 1 - F.col(f"c{i}") for i in range(n)}
    return df.withColumns(slots | {"turn": 1 - F.col("turn")})


def normalised(df: DataFrame, n: int) -> DataFrame:
    """Flip rows with black to move, so that white always moves."""
    black = F.col("turn") == 0
    slots = {f"s{i}": F.when(black, F.col(f"s{i}").bitwiseXOR(F.lit(56))).otherwise(F.col(f"s{i}")) for i in range(n)}
    return df.withColumns(slots | {f"c{i}": F.when(black, 1 - F.col(f"c{i}")).otherwise(F.col(f"c{i}")) for i in range(n)} | {"turn": F.lit(1)})


def orbit(df: DataFrame, n: int, mode: str = "dihedral") -> DataFrame:
    """One row per symmetric image: image, image_key."""
    slots = Slot.of(n)
    of = images(mode)
    keys = F.transform(packed_images(slots, F.col("turn"), of), lambda key, i: F.struct(F.get(F.array(*map(F.lit, of)), i).alias("image"), key.alias("image_key")))
    return df.select("*", F.inline(keys))


def canonical_form(slots: list[Slot], turn: Column, mode: str = "dihedral") -> Column:
    """(key, image) of the smallest image; of equal ones the first."""
    of = images(mode)
    return F.array_min(F.transform(packed_images(slots, turn, of), lambda key, i: F.struct(key.alias("key"), F.get(F.array(*map(F.lit, of)), i).alias("image"))))


def board_array(slots: list[Slot]) -> Column:
    """64 numbers: 0 empty, 1 to 6 white pieces, 7 to 12 black ones."""
    code = [F.when(s.white == 1, s.kind).otherwise(s.kind + 6) for s in slots]
    return F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(*[F.when(s.square == i, c) for s, c in zip(slots, code, strict=True)], F.lit(0)))


def piece_rows(df: DataFrame, board: str) -> DataFrame:
    """Back from a board array: one row per piece with square and code."""
    return df.select(*[c for c in df.columns if c != board], F.posexplode(board).alias("square", "code")).where("code <> 0")


def piece_code(s: Slot, version: int) -> Column:
    """Colour (white 0), type (pawns first up to version 4, kings first from 5 on) and square as one number; equal pieces go by square."""
    return (1 - s.white) * 512 + (s.kind if version < 5 else 6 - s.kind) * 64 + s.square


def _of_code(code: Column, version: int) -> dict[str, Column]:
    kind = F.shiftright(code, 6).bitwiseAND(7)
    return {"t": kind if version < 5 else 6 - kind, "c": 1 - F.shiftright(code, 9), "s": code.bitwiseAND(63)}


def _one(x: Column) -> Column:
    return F.when(x, 1.0).otherwise(0.0)


@functools.cache
def _piece_table(version: int) -> str:
    """Features of a piece by its code: rank, file, type (kings first), colour, from version 4 on how far a pawn is."""
    out = []
    for code in range(1024):
        black, kind, q = code >> 9, code >> 6 & 7, code & 63
        kind = kind if version < 5 else 6 - kind
        out += [q // 8 / 7, q % 8 / 7, *(float(kind == t) for t in range(KING, 0, -1)), float(not black), float(black)]
        if version >= 4:
            out.append(0.0 if kind != PAWN else (7 - q // 8) / 7 if black else q // 8 / 7)
    return ",".join(map(repr, out))


@functools.cache
def _pair_table() -> str:
    """Manhattan and Chebyshev distance, files and ranks from one square to another: place 112 + files + 15 * ranks."""
    return ",".join(repr(x) for r in range(-7, 8) for f in range(-7, 8) for x in ((abs(f) + abs(r)) / 14, max(abs(f), abs(r)) / 7, f / 7, r / 7))


def _row(table: str, place: Column, width: int) -> Column:
    """A row of a literal array, which the optimizer folds to a constant."""
    return F.slice(F.split(F.lit(table), ",").cast("array<double>"), place * width + 1, F.lit(width))


def pair_flags(a: Column, b: Column) -> list[Column]:
    """Same colour, king and king, king and enemy, ally and king, enemy and king, same type."""
    same, ka, kb = a["c"] == b["c"], a["t"] == KING, b["t"] == KING
    return [same, ka & kb, ka & ~same, kb & same, kb & ~same, a["t"] == b["t"]]


def weighted_distance(a: Column, b: Column) -> Column:
    """Moves to the other piece as a share of ten, weighed by what the two are to each other."""
    same, ka, kb = a["c"] == b["c"], a["t"] == KING, b["t"] == KING
    weight = F.when(ka & kb, 2.0).when((ka | kb) & ~same, 1.5).when(~same, 1.2).otherwise(0.8)
    return F.least(F.least(move_distance(a["t"], a["s"], b["s"]), F.lit(10.0)) / 10.0 * weight, F.lit(1.0))


def _pair_features(a: Column, b: Column, version: int, moves: bool) -> Column:
    """Of two pieces by their codes."""
    place = lambda code: code.bitwiseAND(63) + 7 * F.shiftright(code, 3).bitwiseAND(7)
    out = _row(_pair_table(), place(b) - place(a) + 112, 4)
    if not moves:
        return out
    a, b = _of_code(a, version), _of_code(b, version)
    return F.concat(out, F.array(*[x.cast("double") for x in (weighted_distance(a, b), *map(_one, pair_flags(a, b)))]))


def _tactics_of(s: Slot, slots: list[Slot], version: int, against: Column, for_: Column) -> Column:
    out = [_one(pinned(s, slots)), F.least(against / 3.0, F.lit(1.0)), F.least(for_ / 3.0, F.lit(1.0)), _one(against > for_)]
    if version >= 7:
        out += [F.least(safe_squares(s, slots) / 14.0, F.lit(1.0)), _one(s.kind == KING)]
    return F.array(*[x.cast("double") for x in out])


def _counts(s: Slot, slots: list[Slot]) -> tuple[Column, Column]:
    """Pieces that attack a piece, and that defend it."""
    return attack_count(slots, s.square, 1 - s.white), attack_count(slots, s.square, s.white)


def tactics(slots: list[Slot], version: int) -> Column:
    """Map from a piece's square to its version 6 and 7 features, as an array by square."""
    of = [_tactics_of(s, slots, version, *_counts(s, slots)) for s in slots]
    return F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(*[F.when(s.square == i, x) for s, x in zip(slots, of, strict=True)]))


def safe_squares(s: Slot, slots: list[Slot]) -> Column:
    """Squares a piece attacks that the other side doesn't."""
    theirs = reduce(lambda a, b: a.bitwiseOR(b), [F.when(o.white != s.white, attack_mask(o, slots)).otherwise(F.lit(0).cast("long")) for o in slots])
    return F.bit_count(attack_mask(s, slots).bitwiseAND(F.bitwise_not(theirs)))


def encode(df: DataFrame, n: int, version: int, *, moves: bool = False, name: str = "x") -> DataFrame:
    """Add the relative encoding of a version: pieces, then pairs, then (below 4) the side to move.

    From version 4 on the view is that of the side to move. ``moves`` adds the move distance and
    six relation flags to each pair. Needs k1 and k0 from version 6 on, for the normalised view.
    """
    view, rest = normalised(df, n) if version >= 4 else df, df.columns
    slots, codes = Slot.of(n), [f"__p{i}" for i in range(n)]
    if 4 <= version < 6:
        view = fixed(view, **{f"{p}{i}": F.col(f"{p}{i}") for i in range(n) for p in "sc"})
    if version >= 6:
        view = with_masks(with_kings(view, n), n, xray=True)
        slots = Slot.of(n, masks=True, xray=True)
        view = fixed(view, **{f"__{side}{i}": x for i, s in enumerate(slots) for side, x in zip("af", _counts(s, slots), strict=True)})
        for i, s in enumerate(slots):
            view = fixed(view, **{f"__e{i}": _tactics_of(s, slots, version, F.col(f"__a{i}"), F.col(f"__f{i}"))})
    view = fixed(view, **{p: piece_code(s, version) for p, s in zip(codes, slots, strict=True)})
    piece = lambda i: F.struct(F.col(codes[i]).alias("code"), *([F.col(f"__e{i}").alias("extra")] if version >= 6 else []))
    view = fixed(view, __p=F.sort_array(F.array(*map(piece, range(n))))).select(*rest, "__p")
    at = lambda i: F.get("__p", F.lit(i))
    view = fixed(view, **{p: at(i)["code"] for i, p in enumerate(codes)}, **{f"__e{i}": at(i)["extra"] for i in range(n if version >= 6 else 0)})
    own = [_row(_piece_table(version), F.col(p), 10 if version < 4 else 11) for p in codes]
    if version >= 6:
        own = [x for i, o in enumerate(own) for x in (o, F.col(f"__e{i}"))]
    view = fixed(view, __own=F.concat(*own))
    pairs = [(F.col(codes[i]), F.col(codes[j])) for i in range(n) for j in range(i + 1, n)]
    step = 1 if moves else 5
    for first in range(0, len(pairs), step):
        view = fixed(view, **{f"__d{first}": F.concat(*[_pair_features(a, b, version, moves) for a, b in pairs[first : first + step]])})
    turn = [F.array(F.col("turn").cast("double"))] if version < 4 else []
    view = fixed(view, __x=F.concat("__own", *[f"__d{first}" for first in range(0, len(pairs), step)], *turn))
    return view.withColumn(name, F.col("__x")).select(*rest, *([] if name in rest else [name]))


def invariant(slots: list[Slot], turn: Column) -> Column:
    """Three pieces without direction: three distances per pair, one angle, the side to move."""
    pairs = [(0, 1), (0, 2), (1, 2)]
    out: list[Column] = []
    for i, j in pairs:
        dx, dy = distances(slots[i].square, slots[j].square)
        out += [F.sqrt(dx * dx + dy * dy) / F.sqrt(F.lit(98.0)), (dx + dy) / 14.0, F.greatest(dx, dy) / 7.0]
    x, y = [file(s.square) for s in slots], [rank(s.square) for s in slots]
    ax, ay, cx, cy = x[0] - x[1], y[0] - y[1], x[2] - x[1], y[2] - y[1]
    long = F.sqrt((ax * ax + ay * ay).cast("double")) * F.sqrt((cx * cx + cy * cy).cast("double"))
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ax * cx + ay * cy) / long))
    return F.array(*[o.cast("double") for o in out], F.when(long > 0, F.acos(cosine) / F.pi()).otherwise(F.lit(0.0)), turn.cast("double"))


def one_hot(slots: list[Slot], full: bool = False) -> Column:
    """Places of the ones: 64 per slot, or 64 per kind of piece (768)."""
    plane = lambda i, s: F.lit(i) if not full else F.when(s.white == 1, s.kind - 1).otherwise(s.kind + 5)
    return F.array_sort(F.array(*[plane(i, s) * 64 + s.square for i, s in enumerate(slots)]))


def attack_edges(df: DataFrame, n: int, keep: list[str], xray: bool = False) -> DataFrame:
    """One row per attacked square of each piece: keep..., src, dst, white.

    ``xray`` adds ``channel``: 1 as above, 2 for squares behind exactly one piece.
    """
    df, slots = with_masks(df, n, xray), Slot.of(n, masks=True, xray=xray)
    row = lambda s, mask, channel: F.struct(s.square.alias("src"), s.white.alias("white"), F.lit(channel).alias("channel"), mask.alias("mask"))
    seen = [row(s, attack_mask(s, slots), 1) for s in slots] + ([row(s, xray_mask(s, slots), 2) for s in slots] if xray else [])
    rows = df.select(*keep, F.explode(F.array(*seen)).alias("__p")).select(*keep, "__p.*")
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("dst")).where(has(F.col("mask"), F.col("dst")))
    return rows.select(*keep, "src", "dst", "white", *(["channel"] if xray else []))


def square_features(df: DataFrame, n: int, keep: list[str]) -> DataFrame:
    """Tall node table: attack counts of both sides, attacker types as bits, flags, per square.

    Flags: 1 king to move in check, 2 pinned, 4 not attacked by the other side, 8 attacked and
    not defended, 16 defended. An empty square counts as the side to move's.
    """
    plain, slots = Slot.of(n), Slot.of(n, masks=True)
    pins = reduce(lambda a, b: a.bitwiseOR(b), [F.when(pinned(s, plain), F.expr(f"shiftleft(1L, s{i})")).otherwise(F.lit(0).cast("long")) for i, s in enumerate(plain)])
    df = fixed(with_masks(df, n), __pins=pins).select("*", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("square"))
    q = F.col("square")
    white, black = attack_count(slots, q, F.lit(1)), attack_count(slots, q, F.lit(0))
    mask = reduce(lambda a, b: a.bitwiseOR(b), [F.when(has(s.mask, q), F.pow(F.lit(2.0), s.kind - 1).cast("int")).otherwise(0) for s in slots])
    owner = F.coalesce(*[F.when(s.square == q, s.white) for s in slots])
    piece = F.coalesce(*[F.when(s.square == q, F.when(s.white == 1, s.kind).otherwise(s.kind + 6)) for s in slots], F.lit(0))
    df = df.select(*keep, "square", "turn", "k1", "k0", piece.alias("piece"), owner.alias("__owner"), white.alias("white_atk"), black.alias("black_atk"), mask.alias("mask"), has(F.col("__pins"), q).alias("__pin"))
    who = F.coalesce("__owner", "turn")
    theirs, ours = F.when(who == 1, F.col("black_atk")).otherwise(F.col("white_atk")), F.when(who == 1, F.col("white_atk")).otherwise(F.col("black_atk"))
    bit = lambda test, value: F.when(test, value).otherwise(0)
    own_king = F.when(F.col("turn") == 1, F.col("k1")).otherwise(F.col("k0"))
    flags = reduce(add, [
        bit((F.col("square") == own_king) & (F.when(F.col("turn") == 1, F.col("black_atk")).otherwise(F.col("white_atk")) > 0), 1), bit(F.col("__pin"), 2),
        bit(theirs == 0, 4), bit((F.col("piece") != 0) & (theirs > 0) & (ours == 0), 8), bit(ours > 0, 16),
    ])
    return df.select(*keep, "square", "piece", "white_atk", "black_atk", "mask", flags.alias("flags"))


def graphs(df: DataFrame, n: int, keep: list[str]) -> DataFrame:
    """Boards as graphs: keep..., p_ids (64 codes), node_tac (64 times ``square_features``' counts, mask and flags), edges (packed, ascending), edge_counts.

    ``keep`` tells boards apart. Edges are influence (kind 1) and x-rays (kind 2), at most ``EDGES``. Needs k1 and k0.
    """
    slots = Slot.of(n)
    reached = [(kind, s, mask) for kind, of in ((1, attack_mask), (2, xray_mask)) for s, mask in ((s, of(s, slots)) for s in slots)]
    df = fixed(df, **{f"__e{i}": mask for i, (_, _, mask) in enumerate(reached)})
    squares = F.sequence(F.lit(0), F.lit(63))
    of = lambda i, kind, s: F.transform(F.filter(squares, lambda q: F.getbit(F.col(f"__e{i}"), q) == 1), lambda q: pack_edge(F.lit(kind), s.square, q))
    edges = F.slice(F.array_sort(F.concat(*[of(i, kind, s) for i, (kind, s, _) in enumerate(reached)])), 1, EDGES)
    boards = df.select(*keep, board_array(slots).alias("p_ids"), edges.alias("edges")).withColumn("edge_counts", F.size("edges"))
    # one group is the 64 squares of a board
    nodes = square_features(df, n, keep).groupBy(*keep).agg(F.array_sort(F.collect_list(F.struct("square", F.array("white_atk", "black_atk", "mask", "flags").alias("f")))).alias("__n"))
    nodes = nodes.select(*[F.col(k).alias(f"__{k}") for k in keep], F.flatten(F.transform("__n", lambda x: x["f"])).alias("node_tac"))
    joined = boards.hint("merge").join(nodes.hint("merge"), [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keep])
    return joined.select(*keep, "p_ids", "node_tac", "edges", "edge_counts")


#: Most edges that a board keeps.
EDGES = 1024


def pack_edge(kind: Column, src: Column, dst: Column) -> Column:
    return F.shiftleft(kind, 12).bitwiseOR(F.shiftleft(src, 6)).bitwiseOR(dst)


def packed_edges(edges: DataFrame, board: str, most: int = EDGES) -> DataFrame:
    """Edges (board, kind, src, dst) as numbers, of each board the ``most`` smallest: board, edge."""
    order = Window.partitionBy(board).orderBy("edge")
    packed = edges.select(board, pack_edge(F.col("kind"), F.col("src"), F.col("dst")).alias("edge"))
    return packed.withColumn("__place", F.row_number().over(order)).where(F.col("__place") <= most).drop("__place")


def unpack_edge(edge: Column) -> list[Column]:
    return [F.shiftright(edge, 12).alias("kind"), F.shiftright(edge, 6).bitwiseAND(63).alias("src"), edge.bitwiseAND(63).alias("dst")]


def edge_weights(src: Column, dst: Column) -> list[Column]:
    """dx/7, dy/7, manhattan/14, chebyshev/7 of an edge."""
    return [(file(dst) - file(src)) / 7.0, (rank(dst) - rank(src)) / 7.0, manhattan(src, dst) / 14.0, chebyshev(src, dst) / 7.0]


#: Logical channels of an adjacency; geometric ones follow.
LOGICAL = 16


def adjacency(edges: DataFrame, keep: list[str]) -> DataFrame:
    """Coordinates of the 20-channel adjacency of graphs: keep..., channel, src, dst, w.

    ``edges`` is (keep..., kind, src, dst). An edge sets its kind's channel (0 to 15) to 1, and the four geometric channels
    to its weights, whatever its kind; so several kinds between two squares share these. Each coordinate stands once,
    also where edges repeat; edges of other kinds set the geometric ones alone.
    """
    weights = edge_weights(F.col("src"), F.col("dst"))
    # equal edges fall together before they are multiplied, and squares' weights are made once per pair
    kinds = edges.groupBy(*keep, "src", "dst").agg(F.collect_set(F.when(F.col("kind").between(0, LOGICAL - 1), F.col("kind").cast("int"))).alias("__kinds"))
    logical = F.transform("__kinds", lambda k: F.struct(k.alias("channel"), F.lit(1.0).alias("w")))
    geometric = F.array(*[F.struct(F.lit(LOGICAL + i).alias("channel"), w.cast("double").alias("w")) for i, w in enumerate(weights)])
    return kinds.select(*keep, "src", "dst", F.inline(F.concat(logical, geometric))).select(*keep, "channel", "src", "dst", "w")


def pad(x: Column, width: Column | int, keep_last: bool = False) -> Column:
    """Fill a vector with zeros up to a width; version 1 keeps its last entry last."""
    width = F.lit(width) if isinstance(width, int) else width
    zeros = F.array_repeat(F.lit(0.0), F.greatest(width - F.size(x), F.lit(0)))
    return F.concat(F.slice(x, F.lit(1), F.size(x) - 1), zeros, F.slice(x, F.size(x), F.lit(1))) if keep_last else F.concat(x, zeros)


def widths() -> list[tuple[int, int, str]]:
    """(width, pieces, version) of every encoding of three to five pieces."""
    out = []
    for n in (3, 4, 5):
        pairs = n * (n - 1) // 2
        of = {"v1": 10 * n + 4 * pairs + 1, "v2_old": 10 * n + 5 * pairs + 1, "v2": 10 * n + 11 * pairs + 1, "v4": 11 * n + 4 * pairs, "v5": 11 * n + 4 * pairs, "v6": 15 * n + 4 * pairs, "v7": 17 * n + 4 * pairs, "compact": 64 * n}
        out += [(w, n, v) for v, w in of.items()]
    return out


def infer(width: Column) -> Column:
    """What a vector's width says: pieces and versions (several where widths are the same), null if it is no encoding's."""
    by: dict[int, list[tuple[int, str]]] = {}
    for w, n, v in widths():
        by.setdefault(w, []).append((n, v))
    out = F.lit(None).cast("struct<pieces: array<int>, versions: array<string>>")
    for w, found in by.items():
        pieces, versions = sorted({n for n, _ in found}), sorted({v for _, v in found})
        known = F.struct(F.array(*map(F.lit, pieces)).alias("pieces"), F.array(*map(F.lit, versions)).alias("versions"))
        out = F.when(width == w, known).otherwise(out)
    return out


def mirror_vector(x: Column, n: int) -> Column:
    """File mirror of a version 4 vector: columns become 1 - column, dx changes sign."""
    pieces = 11 * n
    return F.transform(x, lambda v, i: F.when((i < pieces) & (i % 11 == 1), 1 - v).when((i >= pieces) & ((i - pieces) % 4 == 2), -v).otherwise(v))


def with_mirrors(df: DataFrame, n: int, x: str = "x") -> DataFrame:
    """Each row and its file mirror, labels and all, as rows of one pass: adds ``mirrored``. Vectors are of version 4."""
    both = F.array(F.struct(F.lit(False).alias("mirrored"), F.col(x).alias(x)), F.struct(F.lit(True).alias("mirrored"), mirror_vector(F.col(x), n).alias(x)))
    rest = [c for c in df.columns if c not in (x, "mirrored")]
    return df.select(*rest, F.inline(both)).select(*rest, x, "mirrored")


#: Board codes as letters, and as hexadecimal digits.
FEN, HEX = ".PNBRQKpnbrqk", "0123456789ABC"


def with_board(df: DataFrame, n: int, name: str = "board") -> DataFrame:
    """Add ``board_array`` in a few compiled steps: the ranks as numbers of four bits a square, then the squares."""
    slots, rest = Slot.of(n), [c for c in df.columns if c != name]
    free = lambda i: reduce(lambda a, b: a & b, [~slots[j].square.eqNullSafe(slots[i].square) for j in range(i)], F.lit(True))
    code = lambda i, s: F.coalesce(F.when(free(i), F.when(s.white == 1, s.kind).otherwise(s.kind + 6)), F.lit(0)).cast("long")
    df = fixed(df, **{f"__c{i}": F.call_function("shiftleft", code(i, s), file(s.square) * 4) for i, s in enumerate(slots)})
    row = lambda r: reduce(lambda a, b: a.bitwiseOR(b), [F.when(rank(s.square) == r, F.col(f"__c{i}")).otherwise(F.lit(0).cast("long")) for i, s in enumerate(slots)])
    df = fixed(df, **{f"__r{r}": row(r) for r in range(8)})
    squares = lambda r: F.array(*[F.shiftright(f"__r{r}", 4 * f).bitwiseAND(15).cast("int") for f in range(8)])
    for first in (0, 4):
        df = fixed(df, **{f"__r{r}": squares(r) for r in range(first, first + 4)})
    return df.withColumn(name, F.concat(*[f"__r{r}" for r in range(8)])).select(*rest, name)


def with_fen(df: DataFrame, board: str, name: str = "fen") -> DataFrame:
    """Add the board field of FEN from a board array, in a few compiled steps."""
    rest = [c for c in df.columns if c != name]
    packed_rank = lambda r: reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(F.get(board, F.lit(r * 8 + f)).cast("long"), 28 - 4 * f) for f in range(8)])
    df = fixed(df, **{board: F.col(board)})
    for first in range(0, 8, 2):
        df = fixed(df, **{f"__r{r}": packed_rank(r) for r in range(first, first + 2)})
    rows = [F.lpad(F.hex(f"__r{r}"), 8, "0") for r in range(7, -1, -1)]
    text = F.translate(F.concat(rows[0], *[x for row in rows[1:] for x in (F.lit("/"), row)]), HEX + "DEF", FEN)
    df = fixed(df, **{name: text})
    for k in range(8, 0, -1):
        text = F.replace(F.col(name) if k == 8 else text, F.lit("." * k), F.lit(str(k)))
    return fixed(df, **{name: text}).select(*rest, name)


def with_fen_pieces(df: DataFrame, fen: str, name: str = "pieces") -> DataFrame:
    """Add an array of (square, code) from the board field of FEN, by square, in a few compiled steps."""
    text, rest = F.replace(fen, F.lit("/"), F.lit("")), [c for c in df.columns if c != name]
    for k in range(8, 0, -1):
        text = F.replace(text, F.lit(str(k)), F.lit("." * k))
    df = fixed(df, __text=F.translate(F.regexp_replace(text, f"[^{FEN}]", "."), FEN, HEX))
    df = fixed(df, **{f"__r{7 - i}": F.conv(F.rpad(F.substr("__text", F.lit(i * 8 + 1), F.lit(8)), 8, "0"), 16, 10).cast("long") for i in range(8)})
    piece = lambda q: F.struct(F.lit(q).alias("square"), F.shiftright(f"__r{q // 8}", 28 - q % 8 * 4).bitwiseAND(15).cast("int").alias("code"))
    for first in range(0, 8, 2):
        df = fixed(df, **{f"__p{r}": F.array(*[piece(q) for q in range(r * 8, r * 8 + 8)]) for r in range(first, first + 2)})
    return df.withColumn(name, F.filter(F.concat(*[f"__p{r}" for r in range(8)]), lambda p: p["code"] > 0)).select(*rest, name)
