"""Secrets in texts: known shapes, and strings whose entropy is that of random ones.

Runs of word-like characters of some length are candidates. In each, a window slides over the
stretches of one character class (hexadecimal digits, then base-64 characters); the counts of
its characters are kept up by taking one in and letting one go, and with them the
window's Shannon entropy. Windows that reach the class's bound and hold the kinds of characters
that words don't mix are joined into spans. An allow list takes candidates away: shapes and words that mark
something else (a UUID, a placeholder, the alphabet in order), and what stands before (a URL, the name of a checksum).
Spans of known shapes stay whatever the list says; others are added where nothing was found before.

Entropy is counted in whole units of 2 ** -20 bits, so sums don't depend on their order.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pii
from .common import table
from .words import parts

_ASSIGN = r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
#: Kind, pattern, what tells texts that may hold it (for a whole column at once), least length of the group that counts, that group.
BASE = (
    ("assign", re.compile(_ASSIGN + "([A-Za-z0-9+/_.=-]+)", re.I | re.A), "(?i)" + _ASSIGN, 12, 1),
    ("access", re.compile("AKIA[A-Z0-9]+"), "AKIA", 18, 0),
    # 16 or more from the start: the run a shorter pattern would find, without its many short matches
    ("hex", re.compile("[0-9a-f]{16,}"), "[0-9a-f]{16}", 16, 0),
)
UNIT = 1 << 20
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("base", T.BooleanType())]))


@dataclass(frozen=True)
class CharClass:
    """A character class: windows of ``window`` characters count from ``bits`` of entropy on, if they hold one of each of ``needs``."""

    name: str
    chars: str
    window: int
    bits: float
    needs: tuple[str, ...]

    def most(self) -> int:
        """The greatest sum of n log2 n over character counts that still gives the entropy."""
        return math.floor((math.log2(self.window) - self.bits) * self.window * UNIT)

    def weights(self) -> list[int]:
        return [0] + [round(n * math.log2(n) * UNIT) for n in range(1, self.window + 1)]


CLASSES = (
    CharClass("entropy_hex", "0-9A-Fa-f", 20, 3.0, ("0-9", "A-Fa-f")),
    CharClass("entropy_base64", "A-Za-z0-9+/_-", 24, 3.9, ("0-9", "A-Z", "a-z")),
)
CANDIDATE = "[A-Za-z0-9+/_-]{20,}"
#: Candidates that match are no secrets.
ALLOW = (
    "^[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}$",
    "(?i)example|sample|dummy|placeholder|changeme|xxxx",
    "(?i)0123456789|abcdefghij",
)
#: Nor are those behind such words, within so many characters.
ALLOW_BEFORE, BEFORE = (r"://[^\x20\x09-\x0D]*$", r"(?i)(?:sha-?(?:1|224|256|384|512)|md5|checksum|commit|integrity)[\"']?[:=-]?\x20?[\"']?$"), 64
KINDS = tuple(b[0] for b in BASE) + tuple(c.name for c in CLASSES)


def entropy(x: str) -> float:
    return math.log2(len(x)) - sum(n * math.log2(n) for n in (x.count(c) for c in set(x))) / len(x)


def windows(x: str, kind: CharClass) -> Iterator[tuple[int, int, float]]:
    """(start, end, greatest entropy) of joined windows of a string of one class."""
    w, weights, most = kind.window, kind.weights(), kind.most()
    needs = [re.compile(f"[{n}]") for n in kind.needs]
    marks = [sum(1 << k for k, n in enumerate(needs) if n.match(c)) for c in x]
    held = [0] * len(needs)
    counts: dict[str, int] = {}
    total, start, end, least = 0, -1, -1, 0
    for i, c in enumerate(x):
        if i >= w:
            gone = x[i - w]
            n = counts[gone]
            total += weights[n - 1] - weights[n]
            counts[gone] = n - 1
            for k in range(len(needs)):
                held[k] -= marks[i - w] >> k & 1
        n = counts.get(c, 0)
        total += weights[n + 1] - weights[n]
        counts[c] = n + 1
        for k in range(len(needs)):
            held[k] += marks[i] >> k & 1
        if i >= w - 1 and total <= most and all(held):
            if start >= 0 and i - w + 1 > end:
                yield start, end, math.log2(w) - least / UNIT / w
                start = -1
            if start < 0:
                start, least = i - w + 1, total
            end, least = i + 1, min(least, total)
    if start >= 0:
        yield start, end, math.log2(w) - least / UNIT / w


class Finder:
    def __init__(self, allow: Iterable[str] = ALLOW, allow_before: Iterable[str] = ALLOW_BEFORE):
        self.allow, self.before = [re.compile(a) for a in allow], [re.compile(a) for a in allow_before]
        self.candidate, self.classes = re.compile(CANDIDATE), [(c, re.compile(f"[{c.chars}]{{{c.window},}}")) for c in CLASSES]

    def base(self, text: str, maybe: list[bool]) -> list[tuple]:
        spans = []
        for rank, (kind, pattern, _, least, group) in enumerate(BASE):
            if maybe[rank]:
                spans += [(*m.span(), rank, kind, entropy(m[group])) for m in pattern.finditer(text) if len(m[group]) >= least]
        return spans

    def dense(self, text: str, taken: list[tuple]) -> list[tuple]:
        """Spans of high entropy that overlap none of ``taken``, nor each other."""
        found: list[tuple] = []
        for m in self.candidate.finditer(text):
            x, at = m[0], m.start()
            # every class needs a digit
            if not any("0" <= c <= "9" for c in x) or any(a.search(x) for a in self.allow) or any(b.search(text[max(at - BEFORE, 0) : at]) for b in self.before):
                continue
            near = [t for t in taken if t[0] < m.end() and t[1] > at]
            for rank, (kind, pattern) in enumerate(self.classes, len(BASE)):
                for part in pattern.finditer(x):
                    for a, b, bits in windows(part[0], kind):
                        a, b = a + at + part.start(), b + at + part.start()
                        if all(b <= t[0] or a >= t[1] for t in near):
                            span = (a, b, rank, kind.name, bits)
                            found.append(span)
                            near.append(span)
        return found


def find(docs: DataFrame, text: str = "text", *, allow: Iterable[str] = ALLOW, allow_before: Iterable[str] = ALLOW_BEFORE) -> DataFrame:
    """Add ``secrets``: array of (kind, start, end, score, base), by start, then kind as in ``KINDS``.

    Positions count code points, ends are exclusive. ``base`` spans are those of known shapes, whole
    matches; ``score`` is their value's entropy in bits, or the greatest one of a span's windows. Null
    counts as empty text; a column named ``secrets`` is replaced. One narrow pass: repeated rows, ties and
    other columns don't matter, and a task holds some MB of text, or the longest text.
    """
    names = [c for c in docs.columns if c != "secrets"]
    schema = docs.select(*names).schema.add("secrets", SPANS)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("base", pa.bool_())]))
    rules = (tuple(allow), tuple(allow_before))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(*rules)
        for batch in batches:
            for part in parts(batch, len(names)):
                texts = pc.fill_null(part.column(len(names)), "")
                guards = [pc.match_substring_regex(texts, g).to_pylist() for _, _, g, _, _ in BASE]
                random = pc.match_substring_regex(texts, CANDIDATE).to_pylist()
                out: list[list[dict]] = []
                for i, maybe in enumerate(zip(*guards, strict=True)):
                    if not random[i] and not any(maybe):
                        out.append([])
                        continue
                    x = texts[i].as_py()
                    spans = finder.base(x, maybe)
                    spans += finder.dense(x, spans) if random[i] else []
                    spans.sort(key=lambda s: (s[0], s[2], s[1]))
                    out.append([{"kind": s[3], "start": s[0], "end": s[1], "score": s[4], "base": s[2] < len(BASE)} for s in spans])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(out, kind)], [*names, "secrets"])

    return docs.select(*names, F.col(text).cast("string").alias("__text")).mapInArrow(scan, schema)


def redact(found: DataFrame, text: str = "text") -> DataFrame:
    """Replace every span of ``secrets`` by its kind in angle brackets; of overlapping ones the first stays. A column named ``pii`` is lost."""
    return pii.redact(found.withColumn("pii", F.col("secrets")), text).drop("pii")


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, then the number of all spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs).drop("text")
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    counts = [F.size(F.filter("secrets", lambda x: x["kind"] == name)).cast("long").alias(f"n_{name}") for name, *_ in BASE]  # noqa: B023
    return found.select("doc_id", *counts, F.sha2(joined(F.filter("secrets", lambda x: x["base"])), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"), F.size("secrets").cast("long").alias("n_spans"))


def _sql() -> str:
    quoted = lambda p: p.replace("'", "''")
    # a pattern's matches with their places: lengths of the pieces between them and of the matches, added up
    placed = lambda source, column, pattern: f"""
  (SELECT *, m[i] AS x, CAST(coalesce(list_sum(list_transform(p[1:i], lambda y: length(y))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda y: length(y))), 0) AS BIGINT) AS s
   FROM (SELECT *, string_split_regex({column}, '{quoted(pattern)}') AS p, unnest(range(1, len(m) + 1)) AS i
         FROM (SELECT *, regexp_extract_all({column}, '{quoted(pattern)}') AS m FROM {source}) WHERE len(m) > 0))"""  # noqa: E731
    shapes = (("assign", f"(?i){_ASSIGN}[A-Za-z0-9+/_.=-]+", f"length(regexp_replace(x, '^(?i){quoted(_ASSIGN)}', '')) >= 12"), ("access", "AKIA[A-Z0-9]+", "length(x) >= 18"), ("hex", "[0-9a-f]+", "length(x) >= 16"))
    base = " UNION ALL ".join(f"SELECT r, '{k}' AS kind, {rank} AS rank, s, s + length(x) AS e FROM {placed('t', 'text', p)} WHERE {ok}" for rank, (k, p, ok) in enumerate(shapes))
    steps, taken = [], "base"
    for rank, c in enumerate(CLASSES, len(BASE)):
        weights = "[" + ", ".join(map(str, c.weights()[1:])) + "]"
        needs = " AND ".join(f"regexp_matches(v, '[{n}]')" for n in c.needs)
        steps.append(f"""
sub{rank} AS (SELECT r, place, place + s AS sub_place, x AS sub FROM {placed('(SELECT r, s AS place, x AS cand FROM cand)', 'cand', f'[{c.chars}]{{{c.window},}}')}),
win{rank} AS (SELECT r, place, sub_place, sub_place + o AS s FROM (SELECT *, sub[o + 1 : o + {c.window}] AS v FROM (SELECT *, unnest(range(length(sub) - {c.window - 1})) AS o FROM sub{rank}))
        WHERE {needs} AND list_sum(list_transform(map_values(histogram_of(v)), lambda n: {weights}[CAST(n AS BIGINT)])) <= {c.most()}),
isle{rank} AS (SELECT r, place, min(s) AS s, max(s) + {c.window} AS e FROM (SELECT *, sum(fresh) OVER (PARTITION BY r, sub_place ORDER BY s) AS b FROM (
        SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY r, sub_place ORDER BY s) <= {c.window} THEN 0 ELSE 1 END AS fresh FROM win{rank})) GROUP BY r, place, sub_place, b),
all{rank} AS (SELECT * FROM {taken} UNION ALL SELECT r, '{c.name}' AS kind, {rank} AS rank, s, e FROM isle{rank} y WHERE NOT EXISTS (SELECT 1 FROM {taken} z WHERE z.r = y.r AND z.s < y.e AND z.e > y.s))""".replace("histogram_of(v)", "list_histogram(string_split(v, ''))"))
        taken = f"all{rank}"
    allowed = " OR ".join(f"regexp_matches(x, '{quoted(a)}')" for a in ALLOW)
    before = " OR ".join(f"regexp_matches(before, '{quoted(b)}')" for b in ALLOW_BEFORE)
    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
base AS ({base}),
cand AS (SELECT r, s, x FROM (SELECT *, substring(text, greatest(s - {BEFORE}, 0) + 1, least(s, {BEFORE})) AS before FROM {placed('t', 'text', CANDIDATE)}) WHERE NOT ({allowed}) AND NOT ({before})),{",".join(steps)},
g AS (SELECT r, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k, *_ in BASE)}, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < {len(BASE)}) AS base,
        string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans, count(*) AS n_spans FROM {taken} GROUP BY r)
SELECT doc_id, {", ".join(f"CAST(coalesce(n_{k}, 0) AS BIGINT) AS n_{k}" for k, *_ in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans
FROM t LEFT JOIN g ON t.r = g.r
"""


SQL = _sql()
