"""Repair of conversation structure: the cheapest edits that give every conversation its grammar.

A conversation's rows become letters, one a row, that say what the edits may do with it: its role
and its fault. Cost to go and the next edit depend on the letters that are left and on the state of
the grammar, not on the conversation, so they are kept in an automaton whose nodes are
suffixes of these letter strings. Spark makes the strings distinct and sorts them by their end;
strings that share a suffix then follow each other, and each task goes through its range with the
path of one string at hand: what the next string shares with it stays, the rest is built anew.
So a suffix is solved once for all conversations, and at most one path a task is built twice. A
node holds four costs and four edits, and an edit leads to the next node; an audit is read off by
walking, no node holds a string.

Rows are moved twice: narrow ones (a digest in place of the text) to make the letters, whole ones
to write the repaired turns. A conversation is read in order by one task, sorted by Spark (which
spills) and never gathered: the task holds its letters and its audit, a byte a row each. Texts
count as equal if their SHA-256 digests are.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

BLANKS = " \t\n\x0b\x0c\r"
#: Costs of the edits; an undeleted truncated row costs one more.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. What initials lead to,
#: and the one role that may be written in each state by inserting or by a new role.
AFTER = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
WRITTEN = ("user", "user", "assistant", "user")
WRITE = tuple(AFTER[g][role[0]] for g, role in enumerate(WRITTEN))
#: States in which a conversation may end.
ENDS = (0, 3)
EDITS = "DIKR"
_NEVER = 1 << 60


class Suffixes:
    """The automaton along one path: node k stands for the last k letters; node 0 is the end."""

    def __init__(self):
        self.path, self.costs, self.edits = "", array("q"), bytearray()
        self._node([0 if g in ENDS else _NEVER for g in range(4)], [255] * 4)

    def _node(self, cost: list[int], edit: list[int]) -> None:
        """Add a node, given what its states cost unless a turn is inserted first. Two insertions in a row lead back to where they began, or to a state that one leads to."""
        plain = [(c, e) for c, e in zip(cost, edit, strict=True)]
        found = list(plain)
        for g in (2, 3, 0, 1):  # the first two look at plain costs, the others at whole ones
            onward = (plain if g > 1 else found)[WRITE[g]][0]
            found[g] = min(plain[g], (onward + INSERT, EDITS.index("I") * 4 + WRITE[g]))
        self.costs.extend(min(c, _NEVER) for c, _ in found)
        self.edits.extend(e for _, e in found)

    def _step(self, letter: str) -> None:
        """The node before the last: ``letter`` is d (to be deleted), or a role's initial, in capitals if truncated."""
        onward, more = self.costs[-4:], TRUNCATED if letter.isupper() else 0
        cost, edit = [], []
        for g in range(4):
            options = [(DELETE + onward[g], EDITS.index("D") * 4 + g)]
            if letter != "d":
                kept = AFTER[g].get(letter.lower())
                if kept is not None:
                    options.append((more + onward[kept], EDITS.index("K") * 4 + kept))
                options.append((REROLE + more + onward[WRITE[g]], EDITS.index("R") * 4 + WRITE[g]))
            best = min(options)
            cost.append(best[0])
            edit.append(best[1])
        self._node(cost, edit)

    def solve(self, letters: str) -> tuple[int, str]:
        """Least cost and ASCII-least audit of a conversation; cheap if its end is that of the one before."""
        turned = letters[::-1]
        same, top = 0, min(len(turned), len(self.path))
        if turned[:top] == self.path[:top]:
            same = top
        while same < top and turned[same] == self.path[same]:
            same += 1
        del self.costs[4 * (same + 1) :], self.edits[4 * (same + 1) :]
        for letter in turned[same:]:
            self._step(letter)
        self.path = turned
        k, g, audit = len(turned), 0, bytearray()
        total = self.costs[4 * k]
        while (edit := self.edits[4 * k + g]) != 255:
            name, g = EDITS[edit // 4], edit % 4
            audit.append(ord(name))
            k -= name != "I"
        return total, audit.decode()


def _faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, present, initial, blank, again, cut) of rows, dealt by conversation."""
    text, shut = F.col("text"), F.rtrim("text", F.lit(BLANKS))
    narrow = rows.select("conv_id", "turn", "role", F.unhex(F.sha2(text, 256)).alias("digest"), "present", F.substring("role", 1, 1).alias("initial"), (F.length(shut) == 0).alias("blank"), (~F.right(shut, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    seen = Window.partitionBy("conv_id", "present", "role", "digest").orderBy(F.asc_nulls_first("turn"))
    return narrow.repartition("conv_id").withColumn("again", F.row_number().over(seen) > 1)


def diagnose(rows: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, letters, gaps, blank, duplicate, truncated, illegal."""
    fault = F.when(F.col("blank"), "b").when(F.col("again"), "d").when(F.col("cut"), "t").otherwise("o")
    found = _faults(rows).withColumn("fault", fault)
    found = found.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "digest").select("conv_id", "turn", "initial", "fault", "present")
    kind = found.select("conv_id").schema.add("letters", "string")
    for name in ("gaps", "blank", "duplicate", "truncated", "illegal"):
        kind = kind.add(name, "long")

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        at = begun = None
        letters, low, high, turns, counts, illegal, last = bytearray(), None, None, 0, {}, 0, None

        def close():
            gaps = 0 if low is None else high - low + 1 - turns
            out.append((at, letters.decode(), gaps, counts.get("b", 0), counts.get("d", 0), counts.get("t", 0), illegal))

        for batch in batches:
            schema = batch.schema
            for conv, turn, initial, fault, present in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun or conv != at:
                    if begun:
                        close()
                    at, begun = conv, True
                    letters, low, high, turns, counts, illegal, last = bytearray(), None, None, 0, {}, 0, None
                if not present:
                    continue
                if turn is not None and turn != high:
                    low, high, turns = turn if low is None else low, turn, turns + 1
                if last is not None and last + initial not in ("su", "ua", "au"):
                    illegal += 1
                last = initial
                counts[fault] = counts.get(fault, 0) + 1
                letter = "d" if fault in "bd" else initial if initial in ("s", "u", "a") else "x"
                letters += (letter.upper() if fault == "t" else letter).encode()
            if out:
                yield _batch(out, schema.field(0).type)
                out = []
        if begun:
            close()
            yield _batch(out, schema.field(0).type)

    def _batch(out: list[tuple], key: pa.DataType) -> pa.RecordBatch:
        kinds = [key, pa.string()] + [pa.int64()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], kind.names)

    return found.mapInArrow(read, kind)


def audits(reports: DataFrame) -> DataFrame:
    """(letters, cost, audit) of every different letter string, by the automaton of suffixes."""

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = Suffixes()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                letters = batch.column(0).slice(at, 1024)
                costs, found = zip(*(nodes.solve(x) for x in letters.to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([letters, pa.array(costs, pa.int64()), pa.array(found, pa.string())], ["letters", "cost", "audit"])

    different = stored(reports.select("letters").distinct(), "letters")
    ends = F.reverse("letters")
    return different.repartitionByRange(ends).sortWithinPartitions(ends).mapInArrow(walk, "letters string, cost long, audit string")


def repair(conversations: DataFrame, present: Column | None = None) -> DataFrame:
    """The cheapest edits that bring each conversation's roles into the form system? (user assistant)*.

    ``conversations`` is (conv_id, turn, role, text, any others, which are dropped). Rows stand by
    turn (null first), rows of one turn by role, then by SHA-256 of the text. Keeping a row is free; a new role
    (user or assistant) costs 2, deleting 3, inserting an empty turn 2, a truncated row that stays 1. Blank rows and
    repeats of a row (role and text) must go. Of equally cheap ways the one whose audit is ASCII-least is taken.

    Returns, per conversation, a row of place 0 with ``report`` (gaps, blank, duplicate, truncated,
    illegal, cost, audit) and no edit, then one row per edit: place, edit (K, R, D or I), role and text
    as they are afterwards (of a deleted row: as they were). Rows of a conversation stand together,
    in order. Null roles and texts count as one blank; a null conv_id is an id like any other. A role
    that is empty fits nowhere. Rows where ``present`` is false only name their conversation,
    which has a report also if no row is left. An empty table gives an empty one.
    """
    blank = F.lit(" ")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), F.coalesce(F.lit(True) if present is None else present, F.lit(False)).alias("present"))
    reports = stored(diagnose(rows), "reports")
    solved = stored(audits(reports), "audits").withColumnRenamed("letters", "__letters")
    headed = reports.hint("merge").join(solved.hint("merge"), F.col("letters") == F.col("__letters"))
    report = F.struct("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    heads = headed.select("conv_id", F.lit(0).alias("__kind"), report.alias("report"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"))
    turns = rows.where("present").select("conv_id", F.lit(1).alias("__kind"), F.lit(None).cast(heads.schema["report"].dataType).alias("report"), "role", "text", "turn")
    both = heads.unionByName(turns).repartition("conv_id").sortWithinPartitions("conv_id", "__kind", F.asc_nulls_first("turn"), "role", F.unhex(F.sha2("text", 256)))
    out = both.select("conv_id", F.lit(0).cast("long").alias("place"), F.lit("").alias("edit"), "role", "text", "report")
    names, schema = out.columns, out.schema
    for field in schema.fields[1:]:
        field.nullable = True

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, k, g, place, conv, types = "", 0, 0, 0, None, None
        rows: list[tuple] = []

        def inserts() -> None:
            nonlocal k, g, place
            while k < len(audit) and audit[k] == "I":
                k, place = k + 1, place + 1
                rows.append((conv, place, "I", WRITTEN[g], "", None))
                g = WRITE[g]

        def flush() -> pa.RecordBatch:
            arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            types = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string(), batch.schema.field(4).type]
            size = 0
            for owner, kind, role, text, report in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not kind:
                    inserts()
                    conv, audit, k, g, place = owner, report["audit"], 0, 0, 0
                    rows.append((conv, 0, None, None, None, report))
                    continue
                inserts()
                edit = audit[k]
                if edit == "R":
                    role, g = WRITTEN[g], WRITE[g]
                elif edit == "K":
                    g = AFTER[g][role[0]]
                k, place, size = k + 1, place + 1, size + len(text)
                rows.append((conv, place, edit, role, text, None))
                if size > 4 << 20:
                    yield flush()
                    size = 0
            if rows:
                yield flush()
        inserts()
        if rows:
            yield flush()

    return both.select("conv_id", "__kind", "role", "text", "report").mapInArrow(lambda b: write(_ordered(b)), schema)


def _ordered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches as slices of a bounded number of rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            yield batch.slice(at, 1024)


def damaged(conversations: DataFrame) -> DataFrame:
    """The test's damage by crc32 of ``conv_id:turn``: (conv_id, turn, role, text, present)."""
    blank = F.lit(" ")
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")])
    rows = conversations.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("k"))
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("k") != 0).alias("present"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("k") == 3, 2).otherwise(1))).alias("copy"))
    return rows.drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reports, and per conversation the digest of its repaired turns, taken turn by turn."""
    repaired = repair(damaged(table(spark, sf_dir, "conversations")), F.col("present"))
    schema = repaired.select("conv_id", "report").schema.add("repaired_sha256", "string")

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, sha, first, types = None, None, True, None
        out: list[tuple] = []
        for batch in batches:
            types = [batch.schema.field(0).type, batch.schema.field(4).type, pa.string()]
            for conv, edit, role, text, report in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if edit is None:
                    if head is not None:
                        out.append((*head, sha.hexdigest()))
                    head, sha, first = (conv, report), hashlib.sha256(), True
                elif edit != "D":
                    sha.update(f"{'' if first else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
                    first = False
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], schema.names)
                out = []
        if head is not None:
            out.append((*head, sha.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], schema.names)

    # both steps are narrow, so a conversation's rows stay together and in order
    found = repaired.select("conv_id", "edit", "role", "text", "report").mapInArrow(digest, schema)
    return found.select("conv_id", *[f"report.{c}" for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")], "repaired_sha256")


def crc32_sql(text: str) -> str:
    """CRC-32 of a short ASCII string in DuckDB SQL, bit by bit."""
    shift = "list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, xor(acc, b))"
    codes = f"list_transform(string_split({text}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))"
    return f"xor(list_reduce({codes}, lambda acc, b: {shift}, 4294967295), 4294967295)"


def _sql() -> str:
    # a state's best way is text: ten digits of cost, then the audit, so that the least text is the best way
    add = lambda way, cost, edit: f"lpad(CAST(CAST(left({way}, 10) AS BIGINT) + {cost} AS VARCHAR), 10, '0') || '{edit}' || substr({way}, 11)"
    write = (3, 3, 4, 3)  # the state after the role that may be written, from 1

    def plain(g: int) -> str:
        kept = "".join(f" WHEN lower(x[1]) = '{c}' THEN {add(f'acc[{to + 1}]', 'if(x[1] = upper(x[1]), 1, 0)', 'K')}" for c, to in AFTER[g].items())
        return f"CASE WHEN x[1] = 'd' THEN {add(f'acc[{g + 1}]', 3, 'D')} ELSE least({add(f'acc[{g + 1}]', 3, 'D')}, {add(f'acc[{write[g]}]', 'if(x[1] = upper(x[1]), 3, 2)', 'R')}, CASE{kept} ELSE '9' END) END"

    fold = f"list_transform([[{', '.join(plain(g) for g in range(4))}]], lambda p: [least(p[1], {add('p[3]', 2, 'I')}, {add('p[4]', 4, 'II')}), least(p[2], {add('p[3]', 2, 'I')}, {add('p[4]', 4, 'II')}), least(p[3], {add('p[4]', 2, 'I')}), least(p[4], {add('p[3]', 2, 'I')})])[1]"
    begin = "['0000000000', '0000000004II', '0000000002I', '0000000000']"
    role = "CASE y[1] WHEN 'K' THEN list_rows[CAST(st[1] AS BIGINT)].role ELSE if(st[2] = '3', 'assistant', 'user') END"
    text = "CASE y[1] WHEN 'I' THEN '' ELSE list_rows[CAST(st[1] AS BIGINT)].text END"
    initial = f"left({role}, 1)"
    step = f"CASE y[1] WHEN 'D' THEN [CAST(CAST(st[1] AS BIGINT) + 1 AS VARCHAR), st[2], st[3]] ELSE [CAST(CAST(st[1] AS BIGINT) + if(y[1] = 'I', 0, 1) AS VARCHAR), CASE {initial} WHEN 's' THEN '2' WHEN 'u' THEN '3' ELSE '4' END, st[3] || chr(10) || {role} || ':' || {text}] END"
    blank, shut = r"NOT regexp_matches(text, '[^\x20\x09-\x0D]')", r"regexp_matches(text, '[.!?][\x20\x09-\x0D]*$')"
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             {crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS k FROM conversations),
d AS (SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS i FROM t),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), i) AS pos,
        row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, i) AS nth FROM d),
f AS (SELECT *, CASE WHEN {blank} THEN 'b' WHEN nth > 1 THEN 'd' WHEN {shut} THEN 'o' ELSE 't' END AS fault,
        lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) || left(role, 1) AS pair FROM o),
l AS (SELECT *, CASE WHEN fault IN ('b', 'd') THEN 'd' WHEN fault = 't' THEN upper(CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END) WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END AS letter FROM f),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
        count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
        list([letter] ORDER BY pos DESC) AS letters, list({{'role': role, 'text': text}} ORDER BY pos) AS list_rows FROM l GROUP BY conv_id),
b AS (SELECT *, list_reduce(letters, lambda acc, x: {fold}, {begin})[1] AS way FROM g),
r AS (SELECT *, list_reduce(list_transform(string_split(substr(way, 11), ''), lambda c: [c]), lambda st, y: {step}, ['1', '1', '']) AS st FROM b),
c AS (SELECT DISTINCT conv_id FROM conversations)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, coalesce(CAST(left(way, 10) AS BIGINT), 0) AS cost,
       coalesce(substr(way, 11), '') AS audit, sha256(coalesce(substr(st[3], 2), '')) AS repaired_sha256
FROM c LEFT JOIN r ON c.conv_id IS NOT DISTINCT FROM r.conv_id
"""


SQL = _sql()
