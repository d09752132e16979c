"""Board geometry as column expressions: everything stays in generated code, no joins, no UDFs.

Squares count 0 to 63 (rank * 8 + file); -1 is off the board. A slot is one piece of a position:
its type (P1 N2 B3 R4 Q5 K6), whether it is white (1) or black (0), and its square. Sets of
squares are 64-bit masks. What a piece attacks is a mask by type and square, less the squares
behind each other piece, a mask by two squares; both come from literal arrays, made by rule.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Piece letters in the order of their types 1 to 6 (fixed values).
LETTERS = "PNBRQK"
PAWN, KNIGHT, BISHOP, ROOK, QUEEN, KING = range(1, 7)


@dataclass(frozen=True)
class Slot:
    kind: Column
    white: Column
    square: Column
    #: What the piece attacks, where that is a column already (see ``with_masks``).
    mask: Column | None = None
    #: What it would attack if one piece in between were gone, where that is a column.
    xray: Column | None = None

    @staticmethod
    def of(n: int, masks: bool = False, xray: bool = False) -> list[Slot]:
        """Slots of columns t0.., c0.., s0.. (and m0.., x0..)."""
        return [Slot(F.col(f"t{i}"), F.col(f"c{i}"), F.col(f"s{i}"), F.col(f"m{i}") if masks else None, F.col(f"x{i}") if xray else None) for i in range(n)]


def rank(square: Column) -> Column:
    return F.shiftright(square, 3)


def file(square: Column) -> Column:
    return square.bitwiseAND(7)


def distances(a: Column, b: Column) -> tuple[Column, Column]:
    """Absolute differences in file and in rank."""
    return F.abs(file(a) - file(b)), F.abs(rank(a) - rank(b))


def manhattan(a: Column, b: Column) -> Column:
    return add(*distances(a, b))


def chebyshev(a: Column, b: Column) -> Column:
    return F.greatest(*distances(a, b))


def _steps(square: int, df: int, dr: int, longest: int = 7) -> list[int]:
    """Squares from ``square`` on in one direction."""
    f, r = square % 8, square // 8
    return [(r + k * dr) * 8 + f + k * df for k in range(1, longest + 1) if 0 <= f + k * df < 8 and 0 <= r + k * dr < 8]


def _signed(squares: list[int]) -> int:
    bits = sum(1 << q for q in squares)
    return bits - (1 << 64) if bits >> 63 else bits


STRAIGHT, DIAGONAL = [(1, 0), (0, 1), (-1, 0), (0, -1)], [(1, 1), (-1, 1), (-1, -1), (1, -1)]
LEAPS = [(x, y) for x in (-2, -1, 1, 2) for y in (-2, -1, 1, 2) if abs(x) != abs(y)]


@functools.cache
def _reach_table() -> str:
    """Attacks on an empty board: row 0 black pawns, rows 1 to 6 the types (1: white pawns); place square + 1."""
    rules = [([(1, -1), (-1, -1)], 1), ([(1, 1), (-1, 1)], 1), (LEAPS, 1), (DIAGONAL, 7), (STRAIGHT, 7), (STRAIGHT + DIAGONAL, 7), (STRAIGHT + DIAGONAL, 1)]
    return ",".join(str(v) for ways, far in rules for v in [0, *(_signed([t for df, dr in ways for t in _steps(q, df, dr, far)]) for q in range(64))])


@functools.cache
def _behind_table() -> str:
    """Squares behind a second square as seen from a first one: place (first + 1) * 65 + second + 1."""
    rows = [[0] * 65 for _ in range(65)]
    for q in range(64):
        for df, dr in STRAIGHT + DIAGONAL:
            ray = _steps(q, df, dr)
            for i, t in enumerate(ray):
                rows[q + 1][t + 1] = _signed(ray[i + 1 :])
    return ",".join(str(v) for row in rows for v in row)


#: Marks of checks along a file, a rank, the diagonals and by leaps; sums keep each count in four bits.
CHECKS = [1 << 4 * k for k in range(5)]


@functools.cache
def _check_table() -> str:
    """Mark of a check by its line through the king: place king * 64 + square."""
    line = lambda f, r: 0 if f == 0 else 1 if r == 0 else 2 if f == r else 3 if f == -r else 4
    return ",".join(str(CHECKS[line(q % 8 - k % 8, q // 8 - k // 8)]) for k in range(64) for q in range(64))


def check_marks(slots: list[Slot], white: Column) -> Column:
    """Sum of the marks of all checks on one side's king."""
    own = king(white)
    return reduce(add, [F.when((s.white != white) & attacks(s, own, slots), _at(_check_table(), own * 64 + s.square)).otherwise(F.lit(0).cast("long")) for s in slots])


@functools.cache
def _push_table() -> str:
    """Steps of pawns ahead: rows 0 and 1 one step (black, white), rows 2 and 3 the second step from the first rank; place square + 1."""
    one = lambda white: [0, *(_signed(_steps(q, 0, 2 * white - 1, 1)) for q in range(64))]
    two = lambda white: [0, *(_signed(_steps(q, 0, 2 * white - 1, 2)[1:] if q // 8 == (1 if white else 6) else []) for q in range(64))]
    return ",".join(str(v) for row in (one(0), one(1), two(0), two(1)) for v in row)


def _at(table: str, place: Column) -> Column:
    """An entry of a literal array, which the optimizer folds to a constant."""
    return F.get(F.split(F.lit(table), ",").cast("array<bigint>"), place)


def reach_mask(slot: Slot) -> Column:
    """Squares that the piece attacks on an otherwise empty board."""
    row = F.when((slot.kind == PAWN) & (slot.white != 1), 0).otherwise(slot.kind)
    return _at(_reach_table(), row * 65 + slot.square + 1)


def behind(first: Column, second: Column) -> Column:
    return _at(_behind_table(), first * 65 + second + 66)


def _or(masks: list[Column]) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), masks, F.lit(0).cast("long"))


def square_bit(square: Column) -> Column:
    """The mask of one square; none off the board."""
    return F.when(square >= 0, F.call_function("shiftleft", F.lit(1).cast("long"), square)).otherwise(F.lit(0).cast("long"))


def occupied(slots: list[Slot], white: Column | None = None) -> Column:
    """Squares that pieces stand on, or those of one colour."""
    bits = [square_bit(s.square) if white is None else F.when(s.white == white, square_bit(s.square)).otherwise(F.lit(0).cast("long")) for s in slots]
    return _or(bits)


def push_mask(slot: Slot, taken: Column) -> Column:
    """Squares a pawn steps to, one or two ahead, where these aren't in ``taken``."""
    white = F.when(slot.white == 1, 1).otherwise(0)
    one, two = (_at(_push_table(), (white + far) * 65 + slot.square + 1) for far in (0, 2))
    return F.when(one.bitwiseAND(taken) == 0, one.bitwiseOR(two.bitwiseAND(F.bitwise_not(taken)))).otherwise(F.lit(0).cast("long"))


def attack_mask(slot: Slot, slots: list[Slot]) -> Column:
    """Squares that the piece attacks; other pieces hide what lies behind them (for steps and leaps nothing does)."""
    if slot.mask is not None:
        return slot.mask
    return reach_mask(slot).bitwiseAND(F.bitwise_not(_or([behind(slot.square, o.square) for o in slots if o is not slot])))


def _once(masks: list[Column]) -> Column:
    """Squares that exactly one mask holds."""
    twice = _or([a.bitwiseAND(b) for i, a in enumerate(masks) for b in masks[:i]])
    return _or(masks).bitwiseAND(F.bitwise_not(twice))


def xray_mask(slot: Slot, slots: list[Slot]) -> Column:
    """Squares that a sliding piece would attack if exactly one piece in between were gone."""
    if slot.xray is not None:
        return slot.xray
    return reach_mask(slot).bitwiseAND(_once([behind(slot.square, o.square) for o in slots if o is not slot]))


def has(mask: Column, square: Column) -> Column:
    """The square is in the mask; one off the board never is."""
    return (square >= 0) & (F.getbit(mask, F.greatest(square, F.lit(0))) == 1)


def attacks(slot: Slot, target: Column, slots: list[Slot]) -> Column:
    return has(attack_mask(slot, slots), target)


def attack_count(slots: list[Slot], target: Column, white: Column) -> Column:
    """Pieces of one colour that attack ``target``."""
    return reduce(add, [F.when((s.white == white) & attacks(s, target, slots), 1).otherwise(0) for s in slots])


def with_masks(df: DataFrame, n: int, xray: bool = False) -> DataFrame:
    """Add m0.., what each piece attacks, as columns; ``Slot.of(n, masks=True)`` then uses them.

    ``xray`` adds x0.. too (see ``xray_mask``). A step is at most a dozen entries of the arrays long.
    """
    slots, rest = Slot.of(n), [c for c in df.columns if c not in {f"{p}{i}" for p in "mx" for i in range(n)}]
    done = []
    for first in range(0, n, max(1, 12 // n)):
        some = range(first, min(n, first + max(1, 12 // n)))
        if not xray:
            df = fixed(df, **{f"m{i}": attack_mask(slots[i], slots) for i in some})
            continue
        hidden = {i: [f"__h{i}_{j}" for j in range(n) if j != i] for i in some}
        df = fixed(df, **{f"__r{i}": reach_mask(slots[i]) for i in some}, **{f"__h{i}_{j}": behind(slots[i].square, slots[j].square) for i in some for j in range(n) if j != i})
        seen = {}
        for i in some:
            reach, behinds = F.col(f"__r{i}"), [F.col(h) for h in hidden[i]]
            seen |= {f"m{i}": reach.bitwiseAND(F.bitwise_not(_or(behinds))), f"x{i}": reach.bitwiseAND(_once(behinds))}
        done += seen
        df = fixed(df, **seen).select(*rest, *done)
    return df


def fixed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns as plain attributes, behind the others.

    The optimizer copies the expression behind a column into every filter that names it, which
    multiplies large ones; what comes out of a generator is only ever named. All columns pass
    through the generator, so Spark compiles each such step to a method of its own: methods of over
    8,000 bytes would be interpreted by the JVM, some fifty times slower.
    """
    rest = [c for c in df.columns if c not in columns]
    return df.select(F.inline(F.array(F.struct(*rest, *[x.alias(c) for c, x in columns.items()]))))


def with_kings(df: DataFrame, n: int) -> DataFrame:
    """Add k1 and k0, the kings' squares, and fix the slots' squares; the functions below need them."""
    slots = Slot.of(n)
    of = lambda white: F.coalesce(*[F.when((s.kind == KING) & (s.white == white), s.square) for s in slots])
    return fixed(df, **{f"s{i}": F.col(f"s{i}") for i in range(n)}, k1=of(1), k0=of(0))


def king(white: Column | int) -> Column:
    """The square of one side's king."""
    return F.col(f"k{white}") if isinstance(white, int) else F.when(white == 1, F.col("k1")).otherwise(F.col("k0"))


def in_check(slots: list[Slot], white: Column | int) -> Column:
    """The king of one side is attacked."""
    return reduce(or_, [(s.white == 1 - white) & attacks(s, king(white), slots) for s in slots])


def pinned(slot: Slot, slots: list[Slot]) -> Column:
    """A slider of the other side would attack this piece's king if the piece were gone."""
    own = king(slot.white)
    by = [(a.white != slot.white) & has(xray_mask(a, slots).bitwiseAND(behind(a.square, slot.square)), own) for a in slots if a is not slot]
    return (slot.kind != KING) & F.coalesce(reduce(or_, by, F.lit(False)), F.lit(False))


def turned(square: Column, image: int) -> Column:
    """One of the eight symmetric images: quarter turns 0 to 3, then the same after a file mirror."""
    f, r = file(square), rank(square)
    f = 7 - f if image >= 4 else f
    for _ in range(image % 4):
        f, r = r, 7 - f
    return r * 8 + f


@functools.cache
def _turn_table() -> str:
    """``turned`` of each square: place image * 64 + square."""
    out = []
    for image in range(8):
        for q in range(64):
            f, r = (7 - q % 8 if image >= 4 else q % 8), q // 8
            for _ in range(image % 4):
                f, r = r, 7 - f
            out.append(r * 8 + f)
    return ",".join(map(str, out))


def packed_images(slots: list[Slot], turn: Column, of: list[int]) -> Column:
    """Array of a position's keys, one per symmetric image.

    A key is one number: turn (0 white), then the sorted pieces, 10 bits each. A piece is colour,
    type, rank, file; white sorts first. Smaller numbers are smaller keys.
    """
    first = F.when(turn == 1, F.lit(0)).otherwise(F.lit(1)).cast("long")
    piece = lambda s, image: (1 - s.white.cast("long")) * 512 + s.kind.cast("long") * 64 + _at(_turn_table(), image * 64 + s.square)
    key = lambda image: F.aggregate(F.sort_array(F.array(*[piece(s, image) for s in slots])), first, lambda a, x: a * 1024 + x)
    return F.transform(F.array(*map(F.lit, of)), key)


@functools.cache
def _turns_table() -> str:
    """A square's eight images, six bits each, the first one lowest."""
    turned_ = list(map(int, _turn_table().split(",")))
    return ",".join(str(sum(turned_[image * 64 + q] << 6 * image for image in range(8))) for q in range(64))


def with_keys(df: DataFrame, n: int, own: str, key: str, mode: str = "auto") -> DataFrame:
    """Add a position's key as it stands and its ``canonical_key``, worked out in a few compiled steps."""
    slots, rest = Slot.of(n), [c for c in df.columns if c not in (own, key)]
    of = images("dihedral" if mode == "auto" else mode)
    df = fixed(df, **{f"__b{i}": (1 - s.white.cast("long")) * 512 + s.kind.cast("long") * 64 for i, s in enumerate(slots)}, **{f"__q{i}": _at(_turns_table(), s.square) for i, s in enumerate(slots)})
    piece = lambda i, image: F.col(f"__b{i}") + F.shiftright(F.col(f"__q{i}"), 6 * image).bitwiseAND(63)
    first = F.when(F.col("turn") == 1, F.lit(0)).otherwise(F.lit(1)).cast("long")
    df = fixed(df, **{f"__i{image}": F.sort_array(F.array(*[piece(i, image) for i in range(n)])) for image in of})
    for some in (of[:4], of[4:]):
        keys = {f"__i{image}": reduce(lambda a, k, image=image: a * 1024 + F.get(f"__i{image}", F.lit(k)), range(n), first) for image in some}
        df = fixed(df, **keys) if keys else df
    least = lambda these: F.least(*[F.col(f"__i{image}") for image in these]) if len(these) > 1 else F.col(f"__i{these[0]}")
    found = least(of)
    if mode == "auto":
        found = F.when(reduce(or_, [s.kind == PAWN for s in slots]), least(images("file_mirror"))).otherwise(found)
    return fixed(df, **{own: F.col("__i0"), key: found}).select(*rest, own, key)


def packed(slots: list[Slot], turn: Column, image: int = 0) -> Column:
    """A position's key, as it stands or as one of its images."""
    return F.get(packed_images(slots, turn, [image]), F.lit(0))


def images(mode: str) -> list[int]:
    """Symmetries of a mode: all eight, the file mirror only, or none."""
    return {"dihedral": list(range(8)), "file_mirror": [0, 4], "none": [0]}[mode]


def canonical_key(slots: list[Slot], turn: Column, mode: str = "auto") -> Column:
    """The smallest key over a position's images; ``auto`` keeps ranks where there are pawns."""
    least = lambda m: F.array_min(packed_images(slots, turn, images(m)))
    if mode != "auto":
        return least(mode)
    pawns = reduce(or_, [s.kind == PAWN for s in slots])
    return F.when(pawns, least("file_mirror")).otherwise(least("dihedral"))


def move_distance(kind: Column, a: Column, b: Column) -> Column:
    """Moves that a piece needs from a to b, roughly; 10 where it can't get there."""
    dx, dy = distances(a, b)
    longer = F.greatest(dx, dy)
    line, far = F.lit(1.0), F.lit(2.0)
    return (
        F.when(kind == KING, longer.cast("double"))
        .when(kind == QUEEN, F.when((dx == 0) | (dy == 0) | (dx == dy), line).otherwise(far))
        .when(kind == ROOK, F.when((dx == 0) | (dy == 0), line).otherwise(far))
        .when(kind == BISHOP, F.when((dx + dy) % 2 != 0, F.lit(10.0)).when(dx == dy, line).otherwise(far))
        .when(kind == KNIGHT, F.when(longer == 0, F.lit(0.0)).when(dx * dy == 2, line).when(dx + dy == 1, F.lit(3.0)).when((dx == 2) & (dy == 2), far)
              .otherwise(F.greatest(F.lit(2.0), F.floor((longer + 1) / 2).cast("double"))))
        .otherwise(F.when((dx <= 1) & (dy > 0), dy.cast("double")).otherwise(F.lit(10.0)))
    )
