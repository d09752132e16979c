"""Periodic runs of words, found by their Lyndon roots.

Every run has, under one of two opposite orders of the words, a root that is the longest Lyndon
word at its start. The first phase of a grouping suffix sorter yields these words: positions are
grouped by first word; groups are taken from the greatest down, and each member is absorbed by the
position that stands before it. A position that has absorbed k members grows by k times their
length, and moves to a new group just above those of its own group that absorbed fewer. What a
position has absorbed when its own group is taken is its longest Lyndon word, so no second
phase is needed. Each word is then stretched to both sides as far as words one period apart are
equal (longest common extensions of two places), which gives the run.

Only stretches that can hold a run are grouped: in a run of period q all short word sequences
recur at a distance of q or less, but for those at its end. Stretches too short for
any period of their distances' magnitude hold no run. This leaves nothing out, whatever the text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table
from .conversations import BLANKS, crc32_sql
from .segments import mix
from .words import parts, split

#: A run has at least so many words, and so many times its period.
LEAST, TIMES = 6, 4
RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


def lyndon(codes: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word at each position; the end of the sequence is the least symbol."""
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    first = np.flatnonzero(np.diff(codes[order], prepend=codes[order[:1]] - 1))
    begin = np.repeat(first, np.diff(first, append=n))
    group = np.empty(n, np.int64)
    group[order] = begin
    where = np.empty(n, np.int64)
    where[order] = np.arange(n)
    size = np.zeros(n + 1, np.int64)
    size[first] = np.diff(first, append=n)
    # positions in plain lists, one up, so that 0 stands before the first; a group is named by its first place in ``at``
    at, group, where, size = (order + 1).tolist(), [-1, *group.tolist()], [-1, *where.tolist()], size.tolist()
    length, left, right = [1] * (n + 2), list(range(-1, n + 1)), list(range(1, n + 3))
    top = n - 1
    while top >= 0:
        low = group[at[top]]
        members = at[low : top + 1]
        if low < top:
            members.sort()
        grown: dict[int, int] = {}
        for i in members:
            p, r = left[i], right[i]
            right[p], left[r] = r, p
            grown[p] = grown.get(p, 0) + 1
        grown.pop(0, None)
        step = length[members[0]]
        moves: dict[int, dict[int, list[int]]] = {}
        for p, k in grown.items():
            length[p] += k * step
            if size[group[p]] > 1:
                moves.setdefault(group[p], {}).setdefault(k, []).append(p)
        for home, by_times in moves.items():
            for k in sorted(by_times, reverse=True):
                end = home + size[home]
                size[home] -= len(by_times[k])
                start = home + size[home]
                for p in by_times[k]:
                    end -= 1
                    other, place = at[end], where[p]
                    at[place], at[end], where[other], where[p] = other, p, place, end
                    group[p] = start
                size[start] = len(by_times[k])
        top = low - 1
    return np.array(length[1 : n + 1], np.int64)


def _extend(x: np.ndarray, a: int, b: int, low: int, high: int, step: int) -> int:
    """How many symbols from ``a`` and ``b`` on are equal, going up or down within low to high (exclusive)."""
    done, width = 0, 16
    most = min(high - a, high - b) if step > 0 else min(a, b) - low + 1
    while done < most:
        width = min(width * 2, most - done)
        i, j = a + step * done, b + step * done
        same = x[i : i + width] == x[j : j + width] if step > 0 else (x[i - width + 1 : i + 1] == x[j - width + 1 : j + 1])[::-1]
        if not same.all():
            return done + int(np.argmin(same))
        done += width
    return done


def stretches(codes: np.ndarray, offsets: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of stretches, inside texts and apart from each other, that hold all runs."""
    n = len(codes)
    gram = max(1, min(4, *(max(least, times * q) - q for q in range(1, least + 1))))
    if n < gram + 1:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    h = np.zeros(n - gram + 1, np.uint64)
    for k in range(gram):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k : n - gram + 1 + k].astype(np.uint64) + np.uint64(1)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    ends = offsets[1:][text]
    # sorted by leading bits of the hash, then position; sequences that clash only widen the stretches
    bits = np.uint64(n.bit_length())
    keys = np.sort((mix(h) >> bits << bits) | np.arange(len(h), dtype=np.uint64))
    place = (keys & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    again = (keys[1:] >> bits == keys[:-1] >> bits) & (text[place[1:]] == text[place[:-1]]) & (place[1:] + gram <= ends[place[1:]])
    here, gap = place[:-1][again], (place[1:] - place[:-1])[again]
    o = np.argsort(here)
    here, gap = here[o], gap[o]
    longest, scale, marks = int(np.diff(offsets).max(initial=0)), 0, np.zeros(n + 1, np.int32)
    while times << scale <= longest and len(here):
        q = 1 << scale  # periods from q to 2q - 1
        fit = here[gap < 2 * q]
        need = max((times - 1) * q - gram + 1, least - 2 * q + 1 - gram + 1, 1)
        opens = np.flatnonzero(np.diff(fit, prepend=-2) != 1)
        # a step from text to text is a new stretch
        opens = np.union1d(opens, np.flatnonzero(np.diff(text[fit], prepend=-1) != 0)) if len(fit) else opens
        width = np.diff(opens, append=len(fit))
        a = fit[opens[width >= need]]
        b = np.minimum(a + width[width >= need] + 2 * q + gram, ends[a]) if len(a) else a
        np.add.at(marks, a, 1)
        np.add.at(marks, b, -1)
        scale += 1
    inside = np.cumsum(marks)[:n] > 0
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before, after = np.concatenate([[False], inside[:-1]]), np.concatenate([inside[1:], [False]])
    return np.flatnonzero(inside & (~before | cut[:n])), np.flatnonzero(inside & (~after | cut[1:])) + 1


def runs_of(codes: np.ndarray, offsets: np.ndarray, least: int = LEAST, times: int = TIMES) -> dict[int, list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each text that has any; text i is ``codes[offsets[i]:offsets[i + 1]]``."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    for a, b in zip(*(e.tolist() for e in stretches(codes, offsets, least, times)), strict=True):
        owner = int(np.searchsorted(offsets, a, side="right")) - 1
        low, high = int(offsets[owner]), int(offsets[owner + 1])
        part = np.unique(codes[a:b], return_inverse=True)[1]
        roots = set()
        for x in (part, -part):
            q, i = lyndon(x), np.arange(len(x))
            # of a run some root has times - 2 periods behind itself
            deep = i + (times - 1) * q <= len(x)
            i, q = i[deep], q[deep]
            equal = (part[i] == part[np.minimum(i + q, len(x) - 1)]) & (part[i + (times - 2) * q - 1] == part[i + (times - 1) * q - 1]) if times > 2 else np.ones(len(i), bool)
            roots |= set(zip(q[equal].tolist(), i[equal].tolist(), strict=True))
        period, end = 0, 0
        for q, i in sorted(roots):
            if q == period and a + i + q <= end:
                continue  # inside the stretch that the last root gave
            i += a
            start = i - _extend(codes, i - 1, i + q - 1, low, high, -1)
            period, end = q, i + q + _extend(codes, i, i + q, low, high, 1)
            if end - start >= max(least, times * q):
                out.setdefault(owner, []).append((start - low, end - start, q))
    return {k: sorted(set(v), key=lambda r: (r[0], r[2])) for k, v in out.items()}


def collapse(docs: DataFrame, *, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """Find all runs of words, and drop the words of each after its first period.

    ``docs`` is (doc_id, text, any others). A run is a stretch with smallest period q, of ``least``
    words and ``times`` q at least, that can't be made longer. Adds ``runs`` (start, length, period, by start, then
    period; words are numbered from 0), ``top`` (the run of greatest length / period; ties go to the
    smaller start, then period; null without a run) and ``collapsed``, the words that are left, joined by
    one space; columns of these names are replaced. Null and empty texts have no words and no
    runs. One narrow pass: repeated rows and ids, ties and other columns don't matter. A text is read whole by one task.
    """
    names = [c for c in docs.columns if c not in ("runs", "top", "collapsed")]
    schema = docs.select(*names).schema.add("runs", T.ArrayType(RUN)).add("top", RUN).add("collapsed", "string")
    run = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
    as_dict = lambda r: dict(zip(("start", "length", "period"), r, strict=True))

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, len(names)):
                offsets, codes, words = split(part.column(len(names)))
                found = runs_of(codes, offsets, least, times)
                keep = np.ones(len(codes), bool)
                for owner, runs in found.items():
                    for start, length, period in runs:
                        keep[offsets[owner] + start + period : offsets[owner] + start + length] = False
                left = np.concatenate([[0], np.cumsum(keep)])[offsets].astype(np.int32)
                kept = pa.ListArray.from_arrays(pa.array(left), words.take(pa.array(codes[keep])))
                runs = pa.array([[as_dict(r) for r in found.get(i, ())] for i in range(part.num_rows)], pa.list_(run))
                top = pa.array([as_dict(max(found[i], key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))) if i in found else None for i in range(part.num_rows)], run)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], runs, top, pc.binary_join(kept, " ").cast(pa.string())], [*names, "runs", "top", "collapsed"])

    return docs.select(*names, F.col("text").alias("__text")).mapInArrow(find, schema)


def planted(docs: DataFrame) -> DataFrame:
    """The test's periods: in a tenth of the texts, by crc32 of the id, words from a place on repeat a period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    shut = F.btrim("text", F.lit(BLANKS))
    here = F.when((h % 10 == 0) & (F.length(shut) > 0), F.split(shut, r"[\x20\x09-\x0D]+"))
    df = docs.withColumns({"__w": here, "__g": F.floor(h / 10)})
    df = df.withColumns({"__n": F.size("__w"), "__a": F.expr("try_mod(__g, size(__w))").cast("int")})
    df = df.withColumn("__p", (1 + F.floor((F.col("__n") - F.col("__a")) / (3 + F.col("__g") % 8))).cast("int"))
    rest = F.col("__n") - F.col("__a")
    again = F.flatten(F.array_repeat(F.slice("__w", F.col("__a") + 1, F.col("__p")), F.ceil(rest / F.col("__p")).cast("int")))
    text = F.concat_ws(" ", F.slice("__w", F.lit(1), F.col("__a")), F.slice(again, F.lit(1), rest))
    return df.withColumn("text", F.when(F.col("__w").isNotNull(), text).otherwise(F.col("text"))).select(docs.columns)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collapse(planted(table(spark, sf_dir, "documents").select("doc_id", "text"))).drop("text")
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))))
    milli = F.expr("1000 * top.length div top.period").cast("long").alias("exponent_milli")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period", milli, F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


#: Periods by pairs of equal word sequences, without Lyndon words.
SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {crc32_sql("CAST(doc_id AS VARCHAR)")} AS h FROM documents),
a AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM t),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
d AS (SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[if(i < a, i, a + (i - a) % p) + 1]) END AS w FROM p),
grams AS (SELECT r, n, i, md5(w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4]) AS k FROM (SELECT r, n, w, unnest(range(n - 3)) AS i FROM d WHERE n >= {LEAST})),
pairs AS (SELECT x.r, x.i, y.i - x.i AS q FROM grams x JOIN grams y ON x.r = y.r AND x.k = y.k AND y.i > x.i AND {TIMES} * (y.i - x.i) <= x.n),
isle AS (SELECT r, q, min(i) AS s, count(*) + 3 + q AS l FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS b FROM pairs) GROUP BY r, q, b),
run AS (SELECT r, s, l, min(q) AS q FROM isle WHERE l >= greatest({LEAST}, {TIMES} * q) GROUP BY r, s, l),
every AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM run GROUP BY r),
best AS (SELECT r, s, l, q FROM run x QUALIFY row_number() OVER (PARTITION BY r ORDER BY CAST(l AS DOUBLE) / q DESC, s, q) = 1),
word AS (SELECT r, unnest(w) AS x, unnest(range(n)) AS i FROM d),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + l)) AS i FROM run),
kept AS (SELECT word.r, string_agg(x, ' ' ORDER BY word.i) AS kept FROM word ANTI JOIN gone ON word.r = gone.r AND word.i = gone.i GROUP BY word.r)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(s AS BIGINT) AS start, CAST(l AS BIGINT) AS length, CAST(q AS BIGINT) AS period,
       CAST(1000 * l // q AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN every ON d.r = every.r LEFT JOIN best ON d.r = best.r LEFT JOIN kept ON d.r = kept.r
"""
