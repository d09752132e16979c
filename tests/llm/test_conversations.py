"""Conversation repair against a search over all edit sequences, and its edges."""

import hashlib
import itertools
import re
import zlib

import pytest
from pyspark.sql import functions as F

from mateframe.llm import conversations as cv

FORM = re.compile(r"(s?(ua)+)?")


def cheapest(letters, limit=3):
    """Least (cost, audit) by trying every edit sequence, with up to ``limit`` insertions before each row and at the end."""
    best = (10**9, "")
    legal = {"s": "s", "u": "u", "a": "a"}

    def options(letter):
        if letter == "d":
            return [(3, "D", "")]
        more = 1 if letter.isupper() else 0
        kept = [(more, "K", legal[letter.lower()])] if letter.lower() in legal else []
        return [(3, "D", ""), *kept, (2 + more, "R", "u"), (2 + more, "R", "a")]

    inserts = [(2 * n, "I" * n, "".join(roles)) for n in range(limit + 1) for roles in itertools.product("ua", repeat=n)]
    parts = [p for letter in letters for p in (inserts, options(letter))] + [inserts]

    def go(k, cost, audit, roles):
        nonlocal best
        if cost > best[0] or not any(re.match("(s?(ua)*u?)?$", roles) for _ in "x"):
            return
        if k == len(parts):
            if FORM.fullmatch(roles):
                best = min(best, (cost, audit))
            return
        for c, e, r in parts[k]:
            go(k + 1, cost + c, audit + e, roles + r)

    go(0, 0, "", "")
    return best


def test_automaton_against_all_edits():
    """Every letter string of up to three rows, in the order the tasks see them and in another."""
    alphabet = "dsuaxSUAX"
    every = ["".join(p) for n in range(4) for p in itertools.product(alphabet, repeat=n)]
    want = {letters: cheapest(letters, 2) for letters in every if len(letters) < 3 or hash(letters) is not None and zlib.crc32(letters.encode()) % 4 == 0}
    for order in (sorted(want, key=lambda x: x[::-1]), sorted(want)):
        nodes = cv.Suffixes()
        for letters in order:
            assert nodes.solve(letters) == want[letters], letters
    nodes = cv.Suffixes()
    assert nodes.solve("ua" * 20_000) == (0, "K" * 40_000) and nodes.solve("")[1] == ""


def test_shared_suffixes_are_solved_once(monkeypatch):
    built = []
    step = cv.Suffixes._step
    monkeypatch.setattr(cv.Suffixes, "_step", lambda self, letter: (built.append(letter), step(self, letter))[1])
    nodes = cv.Suffixes()
    strings = sorted((p + "uaUAua" for p in ("", "s", "a", "ua", "uu")), key=lambda x: x[::-1])
    for s in strings:
        nodes.solve(s)
    assert len(built) == len({s[k:] for s in strings for k in range(len(s))})


SCHEMA = "conv_id long, turn long, role string, text string, report string, edit int"


@pytest.fixture(scope="module")
def talks(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (2, None, "system", "Be kind."), (2, 3, None, "odd."), (2, 1, "user", None), (2, 7, "", "empty role."), (None, 0, "user", "Who."), (None, 0, "user", "Who."),
            (3, None, None, None), (4, 5, "assistant", "cut"), (4, 5, "assistant", "cut"), (4, 6, "tool", "\t\n"), (5, 0, "user", "x" * 300_000 + "!"), (5, 1, "assistant", "ünd")]
    rows += [(6, t, "user" if t % 2 else "assistant", f"{t}.") for t in range(3000)]
    return spark.createDataFrame([(*r, "r", 9) for r in rows], SCHEMA).repartition(3)


def by_hand(rows):
    """Reports and repaired turns of one conversation, row by row."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    seen, letters, faults, illegal = set(), "", {"b": 0, "d": 0, "t": 0, "o": 0}, 0
    for i, (_, role, text) in enumerate(rows):
        shut = text.strip(" \t\n\x0b\x0c\r")
        fault = "b" if not shut else "d" if (role, text) in seen else "o" if shut[-1] in ".!?" else "t"
        seen.add((role, text))
        faults[fault] += 1
        letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
        letters += "d" if fault in "bd" else letter.upper() if fault == "t" else letter
        illegal += i > 0 and rows[i - 1][1][:1] + role[:1] not in ("su", "ua", "au")
    turns = {t for t, _, _ in rows if t is not None}
    return rows, letters, (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults["b"], faults["d"], faults["t"], illegal)


def test_repair_with_odd_rows(talks):
    found = cv.repair(talks).collect()
    groups = {}
    for r in talks.collect():
        groups.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
    assert {r["conv_id"] for r in found} == set(groups)
    for conv, rows in groups.items():
        rows, letters, want = by_hand(rows)
        head = [r["report"] for r in found if r["conv_id"] == conv and r["place"] == 0]
        edits = sorted((r for r in found if r["conv_id"] == conv and r["place"] > 0), key=lambda r: r["place"])
        assert len(head) == 1 and tuple(head[0])[:5] == want
        assert (head[0]["cost"], head[0]["audit"]) == (cheapest(letters) if len(letters) < 6 else (4, "I" + "K" * 3000 + "I")), conv
        assert "".join(e["edit"] for e in edits) == head[0]["audit"]
        assert FORM.fullmatch("".join(e["role"][0] for e in edits if e["edit"] != "D"))
        assert [e["text"] for e in edits if e["edit"] != "I"] == [x for _, _, x in rows] and all(e["text"] == "" for e in edits if e["edit"] == "I")
        assert all(e["role"] == r for e, (_, r, _) in zip([e for e in edits if e["edit"] != "I"], rows) if e["edit"] in "KD")


def test_repair_of_nothing_and_of_dropped_rows(spark, talks):
    none = spark.createDataFrame([], SCHEMA)
    assert cv.repair(none).count() == 0
    gone = cv.repair(talks, F.col("conv_id") != 4).where("conv_id = 4 OR conv_id IS NULL").collect()
    assert sorted(tuple(r["report"]) for r in gone) == [(0, 0, 0, 0, 0, 0, "")] * 2 and all(r["place"] == 0 for r in gone)


def test_damage(spark):
    rows = [(i, t, ("user", "assistant", None)[t % 3], f"One. {i}! {t}?" if t % 5 else None) for i in range(40) for t in range(10)]
    got = sorted((r["conv_id"], r["turn"], r["role"], r["text"], r["present"]) for r in cv.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect())
    want = []
    for i, t, role, text in rows:
        role, text, k = role or " ", text if text is not None else " ", zlib.crc32(f"{i}:{t}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        want += [(i, t, "user" if k == 4 else role, text, k != 0)] * (2 if k == 3 else 1)
    assert got == sorted(want)
