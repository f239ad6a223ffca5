"""The filter audit, periodic runs and language identification against plain Python, and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillsift.llm import audit, language, periods
from quillsift.llm.queries import QUERIES, repeated_tail

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}" for i in range(40_000))
ROWS = [
    (1, "alpha beta " * 60, "en"),
    (2, None, "en"),
    (3, "", None),
    (4, "alpha beta " * 60, "de"),
    (4, "alpha beta " * 60, "de"),
    (4, "ALPHA | BETA", "de"),
    (None, "alpha beta " * 60, "en"),
    (None, None, None),
    (5, "  odd \t é ü 漢 \n", ""),
    (6, LONG, "en"),
    (7, "12 34 !!", "de"),
    (1, "alpha beta " * 60, "fr"),
]
MARKS = [(1, True, None), (1, None, True), (4, True, False), (99, True, True), (None, True, True), (2, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    """Further columns have names that the operators use inside."""
    frame = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    clashing = "part digest pattern good toxic n cells _words runs gram size score before total".split()
    return frame.withColumns({c: F.lit("x") for c in clashing})


@pytest.fixture(scope="module")
def marks(spark):
    return spark.createDataFrame(MARKS, "doc_id long, good boolean, toxic boolean").withColumn("part", F.lit(1))


def plain_audit(rows, marks):
    """Every order run over the rows, one filter after the other."""
    good = {i for i, g, _ in marks if g and i is not None}
    toxic = {i for i, _, t in marks if t and i is not None}
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    judged = []
    for i, text, part in rows:
        t = text or ""
        w = WORDS.findall(t)
        fails = {
            "A": len(w) < 100,
            "B": 100 * len(set(w)) < 80 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": i is not None and i > least[t],
        }
        judged.append((part or "", fails, i in good, i in toxic))
    out = {}
    shapley = Counter()
    for part in {p for p, *_ in judged}:
        for order in permutations("ABCDE"):
            left = [r for r in judged if r[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                lost = [r for r in left if r[1][f]]
                figures = (
                    len(left) - len(lost),
                    len(lost),
                    sum(r[1][f] for r in gone),
                    sum(r[1][f] and sum(r[1].values()) == 1 for r in judged if r[0] == part),
                    sum(r[2] for r in lost),
                    sum(r[3] for r in lost),
                )
                out[part, "".join(order), step] = figures
                shapley[part, f] += len(lost)
                left = [r for r in left if not r[1][f]]
                gone += lost
    return {key: (*v, shapley[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


def as_figures(frame):
    rows = frame.collect()
    got = {(r[0], r[1], r[2]): tuple(r)[3:] for r in rows}
    assert len(got) == len(rows)
    return got


def test_audit_of_odd_rows(docs, marks):
    assert as_figures(audit.audit_filters(docs, marks)) == plain_audit(ROWS, MARKS)


def test_audit_of_random_rows(spark):
    rng = random.Random(3)
    pieces = ["short", "A B C D", "x # y", "same words " * 80, "own " + " ".join(map(str, range(120)))]
    rows = [(rng.choice([None, *range(30)]), rng.choice(pieces), rng.choice(["a", "b", None])) for _ in range(150)]
    marks = [(i, rng.random() < 0.5, rng.random() < 0.3) for i in range(0, 40, 2)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    found = audit.audit_filters(frame, spark.createDataFrame(marks, "doc_id long, good boolean, toxic boolean"))
    assert as_figures(found) == plain_audit(rows, marks)


def test_audit_takes_other_checks(docs, marks):
    found = as_figures(audit.audit_filters(docs, marks, [F.col("text").contains("odd"), F.col("text") == ""], "XYE"))
    assert len(found) == 4 * 6 * 3
    assert found["", "XYE", 1][:2] == (2, 1) and found["", "XYE", 2][:2] == (0, 2)
    with pytest.raises(ValueError):
        audit.audit_filters(docs, marks, [F.lit(True)], "ABC")


def test_contraction_is_the_sum_over_patterns():
    tensors = np.random.default_rng(1).integers(0, 50, (3, 3, 2, 2, 2))
    orders, got = audit.contract(tensors, 3)
    for o, order in enumerate(orders):
        for s, f in enumerate(order):
            cells = [c for c in np.ndindex(2, 2, 2) if c[f] and not any(c[e] for e in order[:s])]
            assert (got["removed"][:, :, o, s] == sum(tensors[(slice(None), slice(None), *c)] for c in cells)).all()


def plain_runs(words):
    """All periods of a text tried one by one."""
    n, found = len(words), []
    for q in range(1, n // 3 + 1):
        i = q
        while i < n:
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            start, length = i - q, j - i + q
            if j > i and length >= max(24, 3 * q):
                stretch = words[start : start + length]
                if not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                    found.append((start, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_row(words):
    runs = plain_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    return runs, best, " ".join(w for i, w in enumerate(words) if i not in gone)


_piece = st.lists(st.sampled_from("abc"), min_size=1, max_size=12)
_text = st.lists(st.tuples(_piece, st.integers(1, 30)), max_size=4).map(lambda parts: [w for p, n in parts for w in p * n])


@settings(max_examples=150, deadline=None)
@given(st.lists(_text, min_size=1, max_size=4))
def test_runs_of_any_texts(texts):
    codes = np.array([ord(w) for t in texts for w in t], dtype=np.int64)
    ends = np.cumsum([len(t) for t in texts])
    found = periods.find_runs(codes, ends)
    assert [tuple(r) for r in found.tolist()] == [(i, *r) for i, t in enumerate(texts) for r in plain_runs(t)]


def test_runs_with_periods_inside_periods():
    """Runs of runs, a period that holds a repeated stretch, and Fibonacci words."""
    inner = list("abcabcabcx")
    fib = ["a", "b"]
    for _ in range(14):
        fib.append(fib[-1] + fib[-2])
    for words in (inner * 8, list("aab" * 3 + "ab") * 9 + list("b" * 40), list(fib[-1][:700]), ["z"] * 500):
        codes = np.array([ord(w) for w in words], dtype=np.int64)
        found = periods.find_runs(codes, np.array([len(words)]))
        assert [tuple(r[1:]) for r in found.tolist()] == plain_runs(words)


def test_one_word_very_often_stays_cheap():
    codes = np.zeros(400_000, dtype=np.int64)
    assert periods.find_runs(codes, np.array([400_000])).tolist() == [[0, 0, 400_000, 1]]


def test_periodic_runs_of_odd_rows(docs):
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.strongest, r.collapsed) for r in periods.periodic_runs(docs).collect()), key=repr)
    want = []
    for doc_id, text, _ in ROWS:
        words = WORDS.findall(text or "")
        if text == LONG:
            runs, best, left = [(0, 40_000, 977)], (0, 40_000, 977), " ".join(words[:977])
        else:
            runs, best, left = plain_row(words)
        want.append((doc_id, len(words), runs, best, left))
    assert got == sorted(want, key=repr)


def test_periodic_runs_query(spark, sf_dir):
    got = {r.doc_id: r for r in QUERIES["op12_periodic_runs"](spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    with_runs = 0
    for doc_id, text in rows:
        words = WORDS.findall(text or "")
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and words:
            a, n, g = (h // 10) % len(words), len(words), h // 10
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if len(words) > 2500:  # too slow in plain Python
            continue
        runs, best, left = plain_row(words)
        r = got[doc_id]
        with_runs += bool(runs)
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period) == (best or (None,) * 3)
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        spelt = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        assert r.runs_sha256 == hashlib.sha256(spelt.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(left.encode()).hexdigest()
    assert with_runs > 5
    assert repeated_tail(None, 5) is None


def plain_symbols(text, order):
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    return "\x01" * (order - 1) + re.sub(" +", " ", letters + " ").removeprefix(" ")


def plain_model(texts, order):
    """p(c | h) by the recursion, from dictionaries."""
    counts = {order: Counter()}
    for text in texts:
        s = plain_symbols(text, order)
        counts[order].update(s[i - order + 1 : i + 1] for i in range(order - 1, len(s)))
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    total, kinds, discount = defaultdict(Counter), defaultdict(Counter), {}
    for n, table in counts.items():
        once, twice = (sum(v == k for v in table.values()) for k in (1, 2))
        share = once / (once + 2 * twice) if once + twice else 0.5
        discount[n] = share if 0 < share < 1 else 0.5
        for g, v in table.items():
            total[n][g[:-1]] += v
            kinds[n][g[:-1]] += 1

    def p(gram, characters):
        n = len(gram)
        if not n:
            return 1 / (characters + 1)
        below = p(gram[1:], characters)
        head = gram[:-1]
        if head not in total[n]:
            return below
        # max(v - D, 0) = v - D for v >= 1, so a context gives away D for each kind
        first = max(counts[n][gram] - discount[n], 0) / total[n][head]
        return first + discount[n] * kinds[n][head] / total[n][head] * below

    return p, {g for g in counts[1]}


TRAIN = [("the cat sat on the mat. The hat!", "en"), ("on the other hand 42 cats", "en"), ("der Hund und die Katze, über", "de"), ("ÜBER uns", "de")]


@pytest.mark.parametrize("order", [1, 2, 4])
def test_probabilities_are_those_of_the_recursion(spark, order):
    model = language.fit_counts(spark.createDataFrame(TRAIN, "text string, lang string"), order)
    assert model.languages == ["de", "en"]
    plain = {lang: plain_model([t for t, l in TRAIN if l == lang], order) for lang in model.languages}
    characters = len(plain["de"][1] | plain["en"][1])
    assert model.characters == characters
    texts = ["the hut", "Katze  12 über", "漢 zz", "x"]
    n, bits = model.entropies(texts)
    for i, text in enumerate(texts):
        s = plain_symbols(text, order)
        assert n[i] == len(s) - order + 1
        for j, lang in enumerate(model.languages):
            p = plain[lang][0]
            want = -sum(math.log2(p(s[k - order + 1 : k + 1], characters)) for k in range(order - 1, len(s))) / n[i]
            assert bits[i, j] == pytest.approx(want, rel=1e-9)


def test_numbers_of_grams_by_table_and_by_sorting(monkeypatch):
    points = language.symbols(["the cat on the mat", "", "über den Hut, the"], 4)[0]
    tables = language.gram_numbers(points, 4)
    monkeypatch.setattr(language, "_CELLS", 1)
    assert (language.gram_numbers(points, 4)[0] == tables[0]).all()
    grams = [tuple(points[i - 3 : i + 1]) for i in range(3, len(points))]
    assert len(set(zip(grams, tables[0][3:].tolist()))) == len(set(grams))


@pytest.mark.parametrize("max_grams", [1 << 19, 40, 1])
def test_every_context_sums_to_one(spark, max_grams):
    """Also where the tables hold few n-grams only."""
    model = language.fit_counts(spark.createDataFrame(TRAIN, "text string, lang string"), 3, max_grams)
    assert all(len(t.hashes) <= max_grams for t in model.grams)
    alphabet = sorted({c for t, _ in TRAIN for c in plain_symbols(t, 1)})
    for head in ("\x01\x01", "th", "r ", "qq"):
        for j in range(2):
            # all characters seen, and one that stands for all others
            total = 0.0
            for c in [*alphabet, "漢"]:
                points = np.array([ord(x) for x in head + c], dtype=np.uint32)
                shorter, longer = (language.gram_hashes(points, np.array([place]), 3) for place in (1, 2))
                total += model.probabilities(shorter, longer, j)[0]
            assert total == pytest.approx(1.0, rel=1e-9)


def test_languages_of_odd_rows(spark, docs):
    train = spark.createDataFrame([(i, t, l) for i, (t, l) in enumerate(TRAIN * 30)], "doc_id long, text string, lang string")
    model = language.fit_languages(train)
    got = language.identify(docs, model, reject=False).collect()
    assert len(got) == len(ROWS)
    assert all(0 <= r.score <= 1 for r in got)
    by_id = defaultdict(list)
    for r in got:
        by_id[r.doc_id].append(r)
    for doc_id, text, _ in ROWS:
        known = text is not None and any(map(str.isalpha, text))
        if not known:
            assert any(r.lang_pred == "und" and r.score == 0 and r.bits is None and not r.accepted for r in by_id[doc_id])
    assert {r.lang_pred for i in (1, 4, 5, 6) for r in by_id[i]} <= {"de", "en"}
    assert {r.lang_pred for r in language.identify(docs, model).collect() if not r.accepted} == {"und"}


def test_texts_unlike_all_languages_are_rejected(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language.fit_languages(docs)
    odd = spark.createDataFrame([(1, "xqzj wvkq zzxq jjqx vvkz " * 40)], "doc_id long, text string")
    assert language.identify(odd, model).head().lang_pred == "und"
    assert language.identify(odd, model, reject=False).head().lang_pred != "und"
    assert language.identify(docs, model).where("accepted").count() >= 0.95 * docs.count()


def test_held_out_languages_are_found_and_not_learnt(spark, sf_dir, tmp_path):
    got = QUERIES["op13_language_id"](spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    true = dict(docs.select("doc_id", "lang").collect())
    held = [r for r in got if r.held_out]
    assert len(got) == len(true)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(true[r.doc_id] == r.lang_pred for r in held) >= 0.98 * len(held)
    outside = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    docs.withColumn("lang", F.when(outside, F.lit("xx")).otherwise(F.col("lang"))).write.parquet(f"{tmp_path}/documents.parquet")
    again = QUERIES["op13_language_id"](spark, str(tmp_path)).collect()
    key = lambda rows: sorted((r.doc_id, r.lang_pred, round(r.score, 9)) for r in rows)
    assert key(again) == key(got)


def test_empty_tables(spark, docs, marks):
    none = docs.where("false")
    assert audit.audit_filters(none, marks).count() == 0
    assert audit.audit_filters(docs, marks.where("false")).count() == 4 * 600
    assert periods.periodic_runs(none).count() == 0
    model = language.fit_languages(none)
    assert model.languages == []
    assert language.identify(none, model).count() == 0
    assert {(r.lang_pred, r.score) for r in language.identify(docs, model).collect()} == {("und", 0.0)}
