"""Personal data, with SQL functions only.

Regular expressions propose spans, checksums confirm them (Luhn for cards, mod-97 for IBANs), and
words nearby adjust the score: those of the kind shortly before or after a span raise it, words of
something else just before lower it (a version number, an order number). Base spans stay
whatever their score; a national id or a secret needs the context that lifts it over ``least``.

Spans need positions. ``split`` and ``regexp_extract_all`` with one pattern give the pieces
between matches and the matches; their lengths, added up in turn, are the positions in code
points. Patterns are written so that a failed attempt never rescans a run: where the plain
pattern would try every start in a run, a look-behind skips to the run's first character, and
``\\G`` keeps the start just after the last match.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


#: Characters before and after a span in which context words count, and what a word against it takes off.
NEAR, AFTER, DROP = 32, 16, 20


@dataclass(frozen=True)
class Kind:
    """A kind of personal data. ``guard`` cheaply tells texts that can't hold it.

    Scores are in hundredths: ``score``, plus ``lift`` where ``context`` is near, less ``DROP``
    where ``against`` stands before; spans below ``least`` go.
    """

    name: str
    pattern: str
    guard: Callable[[Column], Column]
    valid: Callable[[Column], Column]
    score: int
    context: str
    against: str | None = None
    lift: int = 20
    least: int = 0
    after: bool = True


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _mod97(x: Column) -> Column:
    """The remainder of an IBAN: its first four characters go last, letters count 10 to 35."""
    values = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    turned = F.concat(F.substr(x, F.lit(5)), F.substr(x, F.lit(1), F.lit(4)))
    step = lambda a, c: F.when(F.instr(F.lit(values), c) <= 10, (a * 10 + F.instr(F.lit(values), c) - 1) % 97).otherwise((a * 100 + F.instr(F.lit(values), c) - 1) % 97)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(step(a, c)))


#: A name such as token or api_key, and a sign that assigns, right before the span.
SECRET = r"(?:token|secret|passw(?:or)?d|pwd|key|credential)[a-z_-]{0,8}[\"']?\x20{0,3}[=:]\x20{0,3}[\"']?$"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: In this order where spans start together; the first four are the base kinds.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         lambda t: F.contains(t, F.lit("@")), lambda x: F.lit(True), 70, "mail|contact|write|kontakt|correo|courriel"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
         lambda t: F.rlike(t, F.lit(r"[0-9]\.[0-9]")), lambda x: F.rlike(x, F.lit(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")), 50, "ip|address|host|server", "version|release|section|chapter|build"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++",
         lambda t: F.rlike(t, F.lit(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]")),
         lambda x: F.length(_digits(x)).between(12, 19) & F.call_function("luhn_check", _digits(x)), 60, "card|visa|credit|payment|karte|carte|tarjeta", "order|tracking|serial|isbn|invoice"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]",
         lambda t: F.contains(t, F.lit("+")), lambda x: F.length(_digits(x)).between(9, 15), 60, "phone|call|tel|mobile|fax|anruf"),
    Kind("iban", r"[A-Za-z0-9]{15,}+",
         lambda t: F.rlike(t, F.lit("[A-Z][A-Z][0-9][0-9]")),
         lambda x: (F.length(x) <= 34) & F.rlike(x, F.lit("^[A-Z]{2}[0-9]{2}[A-Z0-9]+$")) & (_mod97(x) == 1), 70, "iban|account|bank|konto|compte|cuenta"),
    Kind("ssn", r"[0-9][0-9-]++",
         lambda t: F.rlike(t, F.lit("[0-9]-[0-9][0-9]-[0-9]")), lambda x: F.rlike(x, F.lit("^[0-9]{3}-[0-9]{2}-[0-9]{4}$")), 30, "ssn|social security", "part|order|model", 40, 50),
    Kind("secret", r"[A-Za-z0-9_-]{20,}+",
         lambda t: F.rlike(t, F.lit(r"[=:]\x20{0,3}[\"']?[A-Za-z0-9_-]{20}")), lambda x: F.rlike(x, F.lit("[0-9]")) & F.rlike(x, F.lit("[A-Za-z]")),
         30, SECRET, None, 40, 50, False),
)
BASE = 4


def _with_spans(df: DataFrame, text: str, at: int) -> DataFrame:
    """Add ``__spans<at>``: array of (start, rank, end, score) of one kind."""
    kind, m, p, s = KINDS[at], f"__m{at}", f"__p{at}", f"__s{at}"
    t = F.col(text)
    here = kind.guard(t)
    none = F.array().cast("array<string>")
    df = df.withColumns({
        m: F.when(here, F.regexp_extract_all(t, F.lit(kind.pattern), F.lit(0))).otherwise(none),
    }).withColumn(p, F.when(F.size(m) > 0, F.transform(F.split(t, kind.pattern, -1), F.length)).otherwise(F.array().cast("array<int>")))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, i: Column) -> Column:
        start = acc["at"] + F.element_at(F.col(p), i)
        return F.struct((start + F.length(F.element_at(F.col(m), i))).alias("at"), F.concat(acc["out"], F.array(start)).alias("out"))

    # the pieces are named twice, or the optimizer would put the split inside the lambda
    starts = F.when((F.size(m) > 0) & (F.size(p) > F.size(m)), F.aggregate(F.sequence(F.lit(1), F.size(m)), begin, step, lambda a: a["out"])).otherwise(F.array().cast("array<int>"))
    df = df.withColumn(s, starts)

    def span(x: Column, start: Column) -> Column:
        before = F.lower(F.substr(t, F.greatest(start - NEAR, F.lit(0)) + 1, F.least(start, F.lit(NEAR))))
        near = F.rlike(before, F.lit(kind.context))
        if kind.after:
            near |= F.rlike(F.lower(F.substr(t, start + F.length(x) + 1, F.lit(AFTER))), F.lit(kind.context))
        score = F.lit(kind.score) + F.when(near, kind.lift).otherwise(0)
        if kind.against:
            score -= F.when(F.rlike(before, F.lit(kind.against)), DROP).otherwise(0)
        return F.struct(start.alias("start"), F.lit(at).alias("rank"), (start + F.length(x)).alias("end"), score.alias("score"), kind.valid(x).alias("ok"))

    found = F.filter(F.zip_with(F.col(m), F.col(s), span), lambda x: x["ok"] & (x["score"] >= kind.least))
    spans = F.when(F.size(m) > 0, F.transform(found, lambda x: F.struct(x["start"], x["rank"], x["end"], (x["score"] / 100).alias("score"))))
    return df.withColumn(f"__spans{at}", F.coalesce(spans, F.array().cast("array<struct<start:int,rank:int,end:int,score:double>>"))).drop(m, p, s)


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``pii``: array of (kind, start, end, score, base), by start, then kind; scores are 0 to 1.

    Positions count code points, ends are exclusive. Base spans are those of the first four
    kinds; the rest is what checksums and context words add. Null counts as empty text. One
    narrow pass per row: no shuffle, and repeated rows, ties and other columns don't matter.
    """
    df = docs.withColumn("__text", F.coalesce(F.col(text).cast("string"), F.lit("")))
    for at in range(len(KINDS)):
        df = _with_spans(df, "__text", at)
    names = F.array(*[F.lit(k.name) for k in KINDS])
    every = F.array_sort(F.concat(*[F.col(f"__spans{at}") for at in range(len(KINDS))]))
    pii = F.transform(every, lambda x: F.struct(F.element_at(names, x["rank"] + 1).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["score"].alias("score"), (x["rank"] < BASE).alias("base")))
    return df.withColumn("pii", pii).drop("__text", *[f"__spans{at}" for at in range(len(KINDS))])


def redact(found: DataFrame, text: str = "text") -> DataFrame:
    """Replace every span of ``pii`` by its kind in angle brackets; of overlapping ones the first stays."""
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        kept = F.substr(F.col(text), acc["at"] + 1, x["start"] - acc["at"])
        done = F.struct(x["end"].alias("at"), F.concat(acc["out"], kept, F.lit("<"), x["kind"], F.lit(">")).alias("out"))
        return F.when(x["start"] < acc["at"], acc).otherwise(done)

    clean = F.aggregate("pii", begin, step, lambda a: F.concat(a["out"], F.substr(F.col(text), a["at"] + 1)))
    return found.withColumn(text, clean)


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, then the number of all spans and the highest score in hundredths (0 without a span)."""
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("pii", lambda x: x["base"])
    count = lambda name: F.size(F.filter("pii", lambda x: x["kind"] == name)).cast("long").alias(f"n_{name}")
    counts = [count(k.name) for k in KINDS[:BASE]]
    top = F.coalesce(F.round(F.array_max(F.transform("pii", lambda x: x["score"])) * 100), F.lit(0)).cast("long").alias("top_score")
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("pii")).alias("spans"), F.size("pii").cast("long").alias("n_spans"), top)


#: Name, pattern and test of each kind for SQL; scores and context words are the operator's.
_SQL_KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "len(list_filter(string_split(x, '.'), lambda p: NOT regexp_full_match(p, '0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])'))) = 0"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+", "length(d) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(d[length(d) + 1 - i] AS INT) ELSE (CAST(d[length(d) + 1 - i] AS INT) * 2) // 10 + (CAST(d[length(d) + 1 - i] AS INT) * 2) % 10 END)) % 10 = 0"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "length(d) BETWEEN 9 AND 15"),
    ("iban", r"[A-Za-z0-9]{15,}", "length(x) <= 34 AND regexp_full_match(x, '[A-Z]{2}[0-9]{2}[A-Z0-9]+') AND list_reduce(list_transform(string_split(x[5:] || x[1:4], ''), lambda c: instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', c) - 1), lambda a, v: CASE WHEN v < 10 THEN (a * 10 + v) % 97 ELSE (a * 100 + v) % 97 END, CAST(0 AS BIGINT)) = 1"),
    ("ssn", r"[0-9][0-9-]+", "regexp_full_match(x, '[0-9]{3}-[0-9]{2}-[0-9]{4}')"),
    ("secret", r"[A-Za-z0-9_-]{20,}", "regexp_matches(x, '[0-9]') AND regexp_matches(x, '[A-Za-z]')"),
)


def _sql() -> str:
    parts = []
    for rank, ((name, pattern, valid), kind) in enumerate(zip(_SQL_KINDS, KINDS, strict=True)):
        has = lambda place, words: f"regexp_matches({place}, '{words.replace(chr(39), chr(39) * 2)}')"
        near = has("before", kind.context) + (f" OR {has('behind', kind.context)}" if kind.after else "")
        less = f"- CASE WHEN {has('before', kind.against)} THEN {DROP} ELSE 0 END" if kind.against else ""
        parts.append(f"""
  SELECT doc_id, '{name}' AS kind, {rank} AS rank, s, e, score FROM (
    SELECT *, {kind.score} + CASE WHEN {near} THEN {kind.lift} ELSE 0 END {less} AS score FROM (
      SELECT *, s + length(x) AS e, lower(substring(text, greatest(s - {NEAR}, 0) + 1, least(s, {NEAR}))) AS before,
             lower(substring(text, s + length(x) + 1, {AFTER})) AS behind FROM (
        SELECT doc_id, text, m[i] AS x, regexp_replace(m[i], '[^0-9]', '', 'g') AS d,
               CAST(list_sum(list_transform(p[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i-1], lambda y: length(y))), 0) AS BIGINT) AS s
        FROM (SELECT doc_id, text, m, string_split_regex(text, '{pattern}') AS p, unnest(range(1, len(m) + 1)) AS i
              FROM (SELECT doc_id, text, regexp_extract_all(text, '{pattern}') AS m FROM t) WHERE len(m) > 0)))
    WHERE {valid})
  WHERE score >= {kind.least}""")
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS ({" UNION ALL ".join(parts)}),
g AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k[0]}') AS n_{k[0]}" for k in _SQL_KINDS[:BASE])},
        string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < {BASE}) AS base,
        string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans, count(*) AS n_spans, max(score) AS top_score FROM f GROUP BY doc_id)
SELECT t.doc_id, {", ".join(f"CAST(coalesce(n_{k[0]}, 0) AS BIGINT) AS n_{k[0]}" for k in _SQL_KINDS[:BASE])},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, CAST(coalesce(top_score, 0) AS BIGINT) AS top_score
FROM t LEFT JOIN g ON t.doc_id = g.doc_id
"""


SQL = _sql()
