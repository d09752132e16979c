"""The ten operators against brute force, with nulls, empties, ties, repeated rows and odd columns."""

import collections
import hashlib
import io
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

import corpus_pipeline
from mateframe import llm
from mateframe.llm import decontam, fmindex, jaccard, langid, mixing, pii, repeats, substring, suffix, tokens, topk, toxicity

BLANKS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key long, token string, size long, target double, score string, kept int"


def words(n, seed, size=50):
    rng = np.random.default_rng(seed)
    return [f"w{v}" for v in rng.integers(0, size, n)]


@pytest.fixture(scope="module")
def docs(spark):
    """Copies, near copies, shared passages, periods, a long text, nulls, empties, repeated rows."""
    base, passage = words(120, 1, 10_000), " ".join(words(45, 2, 10_000))
    near = base.copy()
    near[60] = "changed"
    texts = [
        " ".join(base), " ".join(base), " ".join(near), None, "", "   \t\n", "one", "One two", "one two", "to " * 90, "é" * 450, passage,
        " ".join(words(30, 3, 10_000)) + " " + passage + "\n" + " ".join(words(30, 4, 10_000)), " ".join(words(10, 5, 10_000)) + "  " + passage, "\x1c\x85 \xa0x", " ".join(words(9000, 6, 10_000)),
    ]
    rows = [(i * 3, t, "en" if i % 2 else None, f"s{i % 3}" if i % 5 else None, None, i, "x", 1, 0.5, "y", 2) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[0]], DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_oracles(spark, sf, oracle, name):
    assert rows_of(llm.queries()[name](spark, sf).toPandas()) == rows_of(oracle.execute(llm.oracle_sql()[name]).df())


def test_language(spark, sf, docs, none):
    found = llm.queries()["op1_language_id"](spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    assert (found[found.held_out].lang == found[found.held_out].lang_pred).mean() > 0.9
    odd = langid.identify(docs, columns=["doc_id"]).toPandas()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in odd.itertuples():
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in texts[r.doc_id] or "")) and 0 <= r.score <= 1
    assert langid.identify(none).count() == 0
    assert {r["lang_pred"] for r in langid.predict(docs, [], np.zeros((0, 64), np.float32)).collect()} == {"und"}


def test_language_vectors_by_hand():
    """Each trigram bound and added one by one; a gap stands before, between and behind words."""
    encoder, texts = langid.Encoder(64), ["Ab, c-é 12 x", "", "zz", "ÀB ab ab"]
    for text, got in zip(texts, encoder.vectors(texts)):
        codes, want = [0], np.zeros(64)
        for c in text.lower() + " ":
            code = ord(c) if c.isalpha() else 0
            codes += [code] if code or codes[-1] else []
        for a, b, c in zip(codes, codes[1:], codes[2:]):
            want += np.roll(encoder.letter(a), 2).astype(int) * np.roll(encoder.letter(b), 1) * encoder.letter(c)
        assert np.allclose(got, want)


def test_language_query_by_brute_force(spark):
    """Prototypes and cosines worked out text by text; ties go to the first language."""
    rng = np.random.default_rng(1)
    rows = [(i, " ".join("".join(rng.choice(list("abcdef" if i % 2 else "defghi"), 4)) for _ in range(12)) if i % 11 else None, "xy"[i % 2] if i % 7 else None) for i in range(60)]
    df = spark.createDataFrame([*rows, rows[3]], "doc_id long, text string, lang string")
    encoder, sums = langid.Encoder(), collections.defaultdict(lambda: np.zeros(langid.DIMENSION))
    vector = lambda text: langid.unit(encoder.vectors([text]))[0].astype(np.float64)
    for i, text, lang in [*rows, rows[3]]:
        if lang and zlib.crc32(str(i).encode()) % 5:
            sums[lang] += vector(text)
    for r in langid.identify(df).collect():
        cosine = {lang: vector(r["text"]) @ v / np.linalg.norm(v) for lang, v in sums.items()}
        best = min(cosine, key=lambda lang: (-cosine[lang], lang)) if r["text"] else "und"
        assert r["lang_pred"] == best and r["score"] == pytest.approx(max(cosine[best], 0) if r["text"] else 0, abs=1e-5)


def test_language_pieces_agree(monkeypatch):
    text = "alpha beta, gamma " * 40
    whole = langid.Encoder(128).vectors([text])
    monkeypatch.setattr(langid, "PIECE", 64)
    assert np.allclose(whole, langid.Encoder(128).vectors([text]))


def brute_covered(sequences, window):
    seen = collections.Counter(tuple(s[i : i + window]) for s in sequences for i in range(len(s) - window + 1))
    out = []
    for s in sequences:
        gone = [False] * len(s)
        for i in range(len(s) - window + 1):
            if seen[tuple(s[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append(gone)
    return out


@pytest.mark.parametrize("hot, hotter", [(1000, 200_000), (0, 200_000), (0, 0)])
def test_word_repeats(docs, monkeypatch, hot, hotter):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "HOTTER", hotter)
    rows = docs.collect()
    split = [BLANKS.findall(r["text"] or "") for r in rows]
    want = sorted((r["doc_id"], len(w), sum(g), hashlib.sha256(" ".join(x for x, out in zip(w, g) if not out).encode()).hexdigest()) for r, w, g in zip(rows, split, brute_covered(split, 35)))
    got = substring.dedup(docs).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in got) == want
    assert any(0 < r["n_removed"] < r["n_words"] for r in got)


@pytest.mark.parametrize("hot, hotter", [(1000, 200_000), (0, 200_000), (0, 0)])
def test_byte_repeats(docs, none, monkeypatch, hot, hotter):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "HOTTER", hotter)
    rows = docs.where("length(text) < 3000 OR text IS NULL")
    rows = rows.collect()
    raw = [(r["text"] or "").encode() for r in rows]
    want = sorted((r["doc_id"], len(b), bytes(x for x, out in zip(b, g) if not out), sum(1 for i, out in enumerate(g) if out and not (i and g[i - 1]))) for r, b, g in zip(rows, raw, brute_covered(raw, 200)))
    got = suffix.dedup(docs.where("length(text) < 3000 OR text IS NULL")).collect()
    assert sorted((r["doc_id"], r["n_bytes"], bytes(r["kept"]), len(r["removed"])) for r in got) == want
    if hot:
        assert suffix.dedup(none).count() == 0


@pytest.mark.parametrize("dedup, n", [(substring.dedup, "n_words"), (suffix.dedup, "n_bytes")])
def test_repeated_rows_cost_what_they_hold(spark, dedup, n):
    """4,000 copies of a row, and a text that holds it: marks of equal texts are gathered once."""
    text = " ".join(words(400, 21, 10_000))
    rows = spark.range(4000).select((F.col("id") % 7).alias("doc_id"), F.lit(text).alias("text")).unionByName(spark.createDataFrame([(9, "before " + text + " behind")], "doc_id long, text string"))
    found = dedup(rows.repartition(8)).groupBy("doc_id").agg(F.sum(n).alias("n"), F.sum("n_removed").alias("gone")).collect()
    assert all(r["n"] == r["gone"] for r in found if r["doc_id"] != 9) and sum(r["n"] > 0 for r in found) == 8
    assert [r["n"] - r["gone"] for r in found if r["doc_id"] == 9] == [2 if n == "n_words" else len("before ") + len(" behind")]


def test_segments_over_chunks(monkeypatch):
    """Every window has the same minimizer, whether or not its text is cut into chunks."""
    from mateframe.llm import segments

    x = np.random.default_rng(2).integers(0, 4, 2000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    of = lambda: {int(s) + k: int(m) for o, ss, ns, ms, _ in segments.Segmenter(35, 8).segments([x[:20], x, x[:50]]) for i, s, n, m in zip(o, ss, ns, ms) if i == 1 for k in range(n)}
    whole = of()
    monkeypatch.setattr(segments, "CHUNK", 128)
    assert of() == whole and whole.keys() == set(range(2000 - 34))


def test_suffix_query_by_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    raw = [(r["text"] or "").encode() for r in rows]
    seen = collections.Counter(b[i : i + 200] for b in raw for i in range(len(b) - 199))
    want = []
    for r, b in zip(rows, raw):
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        left = np.frombuffer(b, np.uint8)[~gone[:-1]].tobytes()
        want.append((r["doc_id"], len(b), int(gone.sum()), int(np.count_nonzero(np.diff(gone.astype(int), prepend=0) == 1)), hashlib.sha256(left).hexdigest()))
    assert sorted(map(tuple, llm.queries()["op5_suffix_dedup"](spark, sf).collect())) == sorted(want)


def test_fm_index_counts():
    rng = np.random.default_rng(7)
    for _ in range(100):
        window, sequences = int(rng.integers(2, 6)), [rng.integers(1, 4, rng.integers(0, 30)).tolist() for _ in range(4)]
        x = np.array([v for s in sequences for v in [*s, 0]])
        ends = np.cumsum([len(s) + 1 for s in sequences]) - 1
        begin = ends - [len(s) for s in sequences]
        got = fmindex.repeated(x, begin, ends, window)
        seen = collections.Counter(tuple(s[i : i + window]) for s in sequences for i in range(len(s) - window + 1))
        for s, b in zip(sequences, begin):
            assert got[b : b + max(len(s) - window + 1, 0)].tolist() == [seen[tuple(s[i : i + window])] > 1 for i in range(len(s) - window + 1)]


def brute_components(rows):
    sets = []
    for r in rows:
        w = BLANKS.findall((r["text"] or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), math.inf), r["doc_id"])
    return sorted((r["doc_id"], len(s), least[find(i)]) for i, (r, s) in enumerate(zip(rows, sets)))


def test_jaccard(spark, docs, none, monkeypatch):
    assert sorted(map(tuple, jaccard.near_duplicates(docs).collect())) == brute_components(docs.collect())
    assert jaccard.near_duplicates(none).count() == 0
    # a family of edited copies, dealt over many small blocks
    monkeypatch.setattr(jaccard, "TILE", 4)
    rng, base = np.random.default_rng(3), words(300, 8, 10_000)
    family = []
    for i in range(60):
        w = base.copy()
        for p in rng.integers(0, 300, rng.integers(0, 14)):
            w[p] = f"e{rng.integers(0, 30)}"
        family.append((i, " ".join(w)))
    df = spark.createDataFrame(family, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.near_duplicates(df).collect())) == brute_components(df.collect())


def test_jaccard_of_short_texts_after_a_common_line(spark, monkeypatch):
    """Texts around a common line, linked by chance or not; sizes on both sides of a band's edge."""
    monkeypatch.setattr(jaccard, "TILE", 8)
    rng, line = np.random.default_rng(12), words(12, 1, 10_000)
    rows = []
    for i in range(120):
        own = words(int(rng.integers(2, 40)), 900 + i % 70, 10_000)
        for p in rng.integers(0, len(own), i // 70 * rng.integers(0, 4)):
            own[p] = f"e{rng.integers(0, 99)}"
        rows.append((i, " ".join([*line, *own[: len(own) - int(rng.integers(0, 2))]])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(df.collect())
    assert sorted(map(tuple, jaccard.near_duplicates(df).collect())) == want and any(r[0] != r[2] for r in want)


def test_top_k(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.normal(size=8)]) for i in range(300)] + [(300 + i, [0.5] * 8) for i in range(30)]
    rows += [(400, None), (420, [float("nan")] * 8), (440, [1.0, None]), (460, [float("inf")]), (480, []), (500, [0.25, 0.5])]
    rows += [(7, [0.5] * 8), (7, [0.5] * 8), (60, [0.5] * 8)]  # repeated ids: candidates each, a query once
    df = topk.quantize(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {}
    for r in topk.top_k(df, df.where("vec_id % 20 = 0"), block=16, query_block=4, first=2).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    fine = [(i, [math.floor(64 * v) for v in x]) for i, x in rows if x is not None and all(v is not None and math.isfinite(v) for v in x)]
    for q in {i for i, _ in fine if i % 20 == 0}:
        own = min(x for i, x in fine if i == q)
        best = sorted((-sum(a * b for a, b in zip(own, x)), i) for i, x in fine if i != q)[:20]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert topk.top_k(df.limit(0), df).count() == 0


def test_top_k_splits_rows_of_one_id(spark, monkeypatch):
    """Many rows with one id and one vector are dealt over blocks, and are candidates each."""
    sizes, kept = [], topk.stored

    def seen(df, name):
        out = kept(df, name)
        if name == "topk-blocks":
            sizes.extend(r[0] // 8 for r in out.select(F.length("ids")).collect())
        return out

    monkeypatch.setattr(topk, "stored", seen)
    df = topk.quantize(spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(64)] + [(7, [9.0, 9.0])] * 600, "vec_id long, embedding array<double>"))
    got = topk.top_k(df, df.where("vec_id % 20 = 0"), block=64, query_block=4, first=2).collect()
    assert sum(sizes) == 664 and max(sizes) < 200
    assert len(got) == 4 * 20 and {r["vec_id"] for r in got} == {7}


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_pii(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "card" and not (12 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), k, kind, m.end()))
    return [(kind, s, e) for s, _, kind, e in sorted(out)]


def test_pii(spark, docs):
    rng = np.random.default_rng(5)
    pieces = ["a@b.co", "@", ".", "x_y@c-d.e.f", "a@b.c_d@e.f", "1.2.3.4", "999.1.1.1", "01.002.3.255", "1.2.3.4.5", "4111 1111 1111 1111", "4111-1111", "+1 (555) 555-0100", "+", "12", " ", "é", "\U0001f600", "-", "5", "0", "...", "+12", "a" * 30]
    texts = ["".join(rng.choice(pieces, 12)) for _ in range(400)] + [None, "", "a" * 50_000 + "@", "1" * 20_000, "a@" + "b." * 9000 + "c", "iban DE89370400440532013000 x", "my ssn is 123-45-6789", "123-45-6789"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in pii.find(df).collect():
        assert [(p["kind"], p["start"], p["end"]) for p in r["pii"] if p["base"]] == brute_pii(r["text"] or ""), r["text"]
    extra = [[(p["kind"], p["start"], p["end"]) for p in r["pii"] if not p["base"]] for r in pii.find(df.where("doc_id >= 405")).orderBy("doc_id").collect()]
    assert extra == [[("iban", 5, 27)], [("ssn", 10, 21)], []]
    secret = "0a" * 12
    scored = {  # the text, the only span's kind and score
        "1.2.3.4": ("ip", 0.5), "host 1.2.3.4": ("ip", 0.7), "1.2.3.4 is my host": ("ip", 0.7), "version 1.2.3.4": ("ip", 0.3), "1.2.3.4 and far behind is the host": ("ip", 0.5),
        "order 4111111111111111": ("card", 0.4), "card, order 4111111111111111": ("card", 0.6), "ssn 123-45-6789": ("ssn", 0.7), "123-45-6789 (SSN)": ("ssn", 0.7), "part 123-45-6789 ssn": ("ssn", 0.5),
        f"API_KEY='{secret}'": ("secret", 0.7), f'token = "{secret}"': ("secret", 0.7), f"the token {secret}": None, f"page = {secret}": None, "token = " + "a" * 30: None, "token = 0a": None,
    }
    found = pii.find(spark.createDataFrame([(t,) for t in scored], "text string")).collect()
    assert {r["text"]: tuple((p["kind"], p["score"]) for p in r["pii"]) for r in found} == {t: (s,) if s else () for t, s in scored.items()}
    clean = pii.redact(pii.find(spark.createDataFrame([("write a@b.co or call +1 555 555 0100 now",)], "text string"))).first()["text"]
    assert clean == "write <email> or call <phone> now"


def test_mixing_without_ids(spark):
    """Rows without an id, and rows that repeat, count one by one."""
    rows = [(None, " ".join(words(n, n, 9)), "a") for n in (3, 5, 9, 9)] + [(1, "x y", "b"), (1, "x y", "b"), (1, None, "b")]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for source in "ab":
        mine = [r for r in found if r["source"] == source]
        assert len(mine) == (4 if source == "a" else 3) and sum(r["taken"] for r in mine) == math.floor(mine[0]["target"]) and all(0 <= r["taken"] <= 2 * r["size"] for r in mine)


def test_mixing_ranges(spark):
    """Rows without an id are spread over ranges, and how many there are makes no difference."""
    df = spark.createDataFrame([(None, f"w{i} x", "a") for i in range(3000)] + [(1, " ".join(["w"] * (i % 7)), "b") for i in range(300)], "doc_id long, text string, source string")
    rows = mixing.mix(df).collect()
    assert sorted(map(str, mixing.mix(df.repartition(5), range_rows=0.01).collect())) == sorted(map(str, rows))
    taken = [r["taken"] for r in rows if r["source"] == "a"]
    assert len(set(taken)) > 1 and sum(taken) == math.floor(next(r["target"] for r in rows if r["source"] == "a"))


def test_mixing(docs, none):
    rows = mixing.mix(docs).collect()
    total = sum(r["size"] for r in rows)
    by = collections.defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    for source in by.values():
        assert sum(r["taken"] for r in source) == math.floor(source[0]["target"]) and all(0 <= r["taken"] <= 2 * r["size"] for r in source)
    assert abs(sum(s[0]["target"] for s in by.values()) - 1.5 * total) < 1e-6 * total
    assert sorted(map(str, mixing.mix(docs.repartition(7)).collect())) == sorted(map(str, rows))
    assert mixing.mix(none).count() == 0 and mixing.mix(docs.where("text IS NULL")).agg({"taken": "sum"}).first()[0] == 0
    assert mixing.expand(mixing.mix(docs), ["doc_id", "text"]).columns == ["doc_id", "text"]


def test_decontamination(spark, docs, none):
    item, rng = words(30, 9, 10_000), np.random.default_rng(6)
    other = item.copy()
    other[7] = other[19] = "other"
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, ""), (4, "too short")], "item_id long, text string")
    texts = [" ".join(words(40, 10, 10_000) + item), "X, ".join(other) + ".", " ".join(item[:22]), " ".join(item[:9]), None, "", " ".join(rng.permutation(item))]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(0, texts[0], 0), (None, texts[0], 0)], "doc_id long, text string, item_id int")
    hit = {r["doc_id"] for r in decontam.contaminated(df, bench).collect()}
    assert {0, 2, None} <= hit and not hit & {3, 4, 5, 6}
    left = decontam.decontaminate(df, bench)
    assert left.columns == df.columns and {3, 4, 5, 6} <= {r["doc_id"] for r in left.collect()}
    assert decontam.decontaminate(docs, bench).count() == docs.count() and decontam.contaminated(none, bench).count() == 0


def test_decontamination_tolerates_substitutions(spark):
    item = words(40, 9, 10_000)
    other = item.copy()
    other[7] = other[19] = other[33] = "other"
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    df = spark.createDataFrame([(1, " ".join(other))], "doc_id long, text string")
    assert decontam.contaminated(df, bench).count() == 1


def brute_contaminated(texts, items):
    """All diagonals of all pairs, without seeds."""
    split, out = (lambda t: re.findall(r"\w+", (t or "").lower())), set()
    for d, text in texts:
        h = split(text)
        for b, it in items:
            item = split(it)
            wide, best = min(len(item), 20), 0
            for g in range(-len(item), len(h) + 1):
                same = [0 <= q + g < len(h) and h[q + g] == w for q, w in enumerate(item)]
                best = max([best, *(sum(same[s : s + wide]) for s in range(len(item) - wide + 1))])
            if wide and best >= math.ceil(0.75 * wide):
                out.add((d, b, wide, best))
    return out


def test_decontamination_finds_all_that_the_rule_accepts(spark):
    rng, items, texts = np.random.default_rng(11), [], []
    for b, n in enumerate([*range(1, 25), 30, 33]):
        item = words(n, 100 + b, 10_000)
        items.append((b, " ".join(item)))
        for changed in range(min(n, 20) // 4 + 2):
            for _ in range(6):
                w = item.copy()
                for at in rng.choice(n, min(changed, n), replace=False):
                    w[at] = f"x{rng.integers(0, 10_000)}"
                around = words(int(rng.integers(0, 8)), len(texts) + 500, 10_000)
                texts.append((len(texts), " ".join([*around, *w, *around])))
    # every fourth word changed: only runs of three are left
    texts.append((len(texts), " ".join("x" if q % 4 == 3 else w for q, w in enumerate(items[19][1].split()))))
    texts += [(len(texts), items[0][1] + " " + items[0][1]), (len(texts) + 1, items[8][1][: items[8][1].rindex(" ")])]
    found = decontam.contaminated(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = brute_contaminated(texts, items)
    assert {(r["doc_id"], r["item_id"], r["width"], r["matched"]) for r in found.collect()} == want
    assert any(m < w for _, _, w, m in want) and {w for _, _, w, _ in want} == set(range(1, 21))


def test_masks_lose_no_pattern():
    """Every set of words that may differ leaves one mask clear, for windows of up to 20 words."""
    cases = [(w, w - math.ceil(0.75 * w)) for w in range(1, 21)]
    for group in [tuple(c for c in cases if c[0] >= decontam.LONG), *[(c,) for c in cases], ((30, 15),)]:
        family = decontam.masks(group)
        assert 1 <= len(family) <= decontam.MASKS and all(m[0] == 0 for m in family)
        for w, m in group if math.comb(*group[0]) <= decontam.SETS else ():
            sets = decontam.differing_sets(w, m)
            assert not np.all([decontam.missed(mask, w, sets) for mask in family], axis=0).any()
    assert all(len(m) == 5 for m in decontam.masks(tuple(c for c in cases if c[0] >= decontam.LONG)))


def test_decontamination_of_long_and_even_texts(spark):
    """One text with very many items, and texts and items of one repeated word."""
    items = [(i, " ".join(words(25, 3000 + i, 10_000))) for i in range(200)] + [(900, "to " * 30), (901, "go")]
    texts = [(1, " ".join(t for _, t in items[:200])), (2, "to " * 5000), (3, "to " * 12), (4, "go to go"), (5, " ".join(words(20_000, 1, 10_000)))]
    found = decontam.contaminated(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r["doc_id"], r["item_id"], r["width"], r["matched"]) for r in found}
    assert got == {(1, i, 20, 20) for i in range(200)} | {(2, 900, 20, 20), (4, 901, 1, 1)}


def test_toxicity(spark, docs, none):
    rng = np.random.default_rng(7)
    rows = [(i, " ".join([*words(60, i, 500), *(["slur", "insult"] if i % 8 == 0 else [])]), int(i % 8 == 0)) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = df.select("doc_id", "toxic").where("doc_id % 2 = 0")
    model = toxicity.learn(df.select("doc_id", "text"), labels)
    found = toxicity.score(df, model).toPandas()
    assert (found.predicted == found.toxic).mean() > 0.97 and found.score.between(0, 1).all()
    odd = toxicity.score(docs, model).toPandas()
    assert len(odd) == docs.count() and odd.score.between(0, 1).all() and odd.score.notna().all()
    assert toxicity.learn(none, labels.limit(0)).weights == {} and toxicity.score(none, model).count() == 0
    assert rng is not None


def test_risk_by_differences():
    """The derivative of the risk against finite differences, on both sides of the turn."""
    rng = np.random.default_rng(3)
    for shift in (-2.0, 2.0):
        score = rng.normal(size=12)
        score[:5] -= shift
        score[5:] += shift
        value, slope = toxicity.risk(score, 5, 0.4)
        for i in range(12):
            step = np.zeros(12)
            step[i] = 1e-6
            up, down = toxicity.risk(score + step, 5, 0.4)[0], toxicity.risk(score - step, 5, 0.4)[0]
            assert slope[i] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_toxicity_query(spark, sf):
    """Every row once; on held-out rows the toxic ones score higher."""
    found = llm.queries()["op9_toxicity"](spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(found) == docs.count() and found.score.between(0, 1).all() and ((found.score >= 0.5) == (found.predicted == 1)).all()
    assert (found.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in found.doc_id]).all()
    both = found.merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    assert both[both.toxic == 1].score.mean() > both[both.toxic == 0].score.mean() + 0.3


def test_token_files(spark, docs, none):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokens.vocabulary_path())
    rows = sorted(docs.collect(), key=lambda r: r["doc_id"])
    at, want = 0, []
    for r in rows:
        ids = np.array([*plain.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((r["doc_id"], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, tokens.write_and_read(docs).collect())) == want
    assert tokens.write_and_read(none).count() == 0


class Source(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_token_frames():
    sink = Source()
    writer = tokens.Writer(sink, frame_ids=10)
    for i in range(50):
        writer.add(i if i else None, np.arange(i % 7, dtype="<u4"))
    assert writer.close() == (50, sum(i % 7 for i in range(50)))
    reader = tokens.Reader(sink)
    assert [(i, len(x)) for i, x in reader.all()] == [(i or None, i % 7) for i in range(50)] and len(reader.frames) > 5
    assert [(i, x.tolist()) for i, x in reader.wanted([13, 48, 99])] == [(13, list(range(6))), (48, list(range(6)))]
    broken = bytearray(sink.getvalue())
    broken[3] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        list(tokens.Reader(Source(bytes(broken))).all())


def test_word_encoder_is_exact():
    from tokenizers import Tokenizer

    plain, own = Tokenizer.from_file(tokens.vocabulary_path()), tokens.WordEncoder(tokens.vocabulary_path())
    rng = np.random.default_rng(8)
    texts = ["", "a | b", "<|endoftext|> x<|startoftext|>", "it's 's |"] + ["".join(rng.choice(list("ab'sŞ́ \t\n <|endoftext|>1!é가"), 30)) for _ in range(500)]
    for text, ids in zip(texts, own.encode(pa.array(texts))):
        assert plain.encode(text, add_special_tokens=False).ids == ids.tolist()


def test_word_encoder_forgets(monkeypatch):
    """A cache that overflows at every column, and one text of more words than it holds, change nothing."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens.WordEncoder, "KEPT", 20)
    plain, own = Tokenizer.from_file(tokens.vocabulary_path()), tokens.WordEncoder(tokens.vocabulary_path())
    for seed in range(4):
        texts = [" ".join(words(300, seed, 1000)) + " (Ümlaut), 3.5 l'eau", None, "a-b|c <x>"]
        for text, ids in zip(texts, own.encode(pa.array(texts))):
            assert plain.encode(text or "", add_special_tokens=False).ids == ids.tolist()


def test_pipeline_rejects_what_is_like_no_language(spark, sf):
    known = [(i, " ".join(words(40, i, 30)).replace("w", "the quick ") + " and so on it goes", "en", "s", 1) for i in range(40)]
    odd = [(100, "щука лежит под мостом и ждёт пока рыбак уйдёт домой " * 4, None, "s", 1), (101, "щука", None, "s", 1), (102, "12 34", "en", "s", 1), (103, None, "en", "s", 1)]
    docs = spark.createDataFrame(known + odd + known[:1], "doc_id long, text string, lang string, source string, n_chars long")
    left = [r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, sf).collect()]
    assert sorted(left) == sorted([*range(40), 0, 101])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0


@pytest.mark.parametrize("lang", [None, "und"])
def test_pipeline_language_needs_no_labels(spark, sf, lang):
    docs = spark.createDataFrame([(i, t, lang, "s", 1) for i, t in enumerate(["some words here", "é", "12 34", "", None] * 4)], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.language_id(spark, docs, sf).collect()
    assert sorted(r["doc_id"] for r in left) == [i for i in range(20) if i % 5 < 2]


def test_pipeline_keeps_one_row_of_each_group(spark, sf):
    base, near = words(120, 1, 10_000), words(120, 1, 10_000)
    near[60] = "changed"
    a, b, c, d, e = " ".join(base), " ".join(near), *(" ".join(words(60, i, 10_000)) for i in (2, 3, 4))
    # repeated rows; a near copy under an id that stands for another group too; null ids, alone and with copies
    rows = [(1, a), (1, a), (2, b), (2, c), (None, a), (None, d), (None, d), (None, e), (3, e)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.jaccard_join(spark, docs, sf).collect()
    assert collections.Counter((r["doc_id"], r["text"]) for r in left) == collections.Counter([(1, a), (2, c), (None, d), (3, e)])


def test_pipeline(spark, sf):
    names = ["language_id", "jaccard_join", "decontamination", "mixing", "token_ids"]
    assert [n for n, _ in corpus_pipeline.STAGES] == names
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == corpus_pipeline.COLUMNS
        counts.append(docs.count())
    assert counts[0] >= counts[1] >= counts[2]
    plain = spark.read.parquet(f"{sf}/documents.parquet")
    assert counts[0] == plain.where("text rlike '\\\\p{L}'").count()  # no clean document is below the floor
    assert corpus_pipeline.run(spark, sf).count() == counts[3]
