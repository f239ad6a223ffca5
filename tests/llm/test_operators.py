"""Every operator against brute force and on nulls, empty and repeated rows, and empty tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillsift.llm import fingerprints, jaccard, katz, lines, packing, pieces, quality, shingles, substrings, topk, urls
from quillsift.llm.queries import CHECKS, QUERIES
from tests.checking import compare, connect

P = pytest.importorskip("public_tokenizers")

BASE = "one two three four five six seven eight nine ten eleven twelve"
ROWS = [
    (1, BASE, 7),
    (2, None, 7),
    (3, "", 7),
    (4, BASE, 7),
    (5, BASE + " thirteen", 7),
    (6, "word " * 3000 + "end", 7),
    (7, "Short.\nShort.\n" + BASE + "\n", 7),
    (None, "no id here", 7),
    (8, "  spaces  \t odd é ü 漢 ", 7),
    (8, "  spaces  \t odd é ü 漢 ", 7),
]


@pytest.fixture(scope="module")
def docs(spark):
    """``slice``, ``name``, ``node`` and ``score`` clash with names that operators use inside."""
    frame = spark.createDataFrame(ROWS, "doc_id long, text string, slice int")
    return frame.withColumns({c: F.lit("x") for c in ("name", "node", "score", "line", "kept")})


def bpe():
    return P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_same_rows_as_sql(name, spark, sf_dir):
    difference = compare(QUERIES[name](spark, sf_dir), connect(sf_dir), CHECKS[name])
    assert difference is None, difference


def test_packing_covers_every_id_once(docs):
    from tokenizers import Tokenizer

    rows = packing.pack(docs, *bpe()).collect()
    tokenizer = Tokenizer.from_file(bpe()[0])
    sequences, pieces_of = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces_of.setdefault(r.doc_id, []).append(r)
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024
    for doc_id, text, _ in ROWS:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        own = [r for r in pieces_of[doc_id] if r.doc_tokens == len(ids)]
        copies = sum(1 for d, t, _ in ROWS if (d, t) == (doc_id, text))
        assert sum(r.length for r in own) == len(ids) * copies
        for r in own:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())


def test_differencing_is_near_equal():
    sizes = np.random.default_rng(1).integers(1, 65, 600).tolist()
    subsets = packing.deal(sizes, 1024)
    loads = [sum(sizes[i] for i in s) for s in subsets]
    assert sorted(i for s in subsets for i in s) == list(range(600))
    assert max(loads) <= 1024 and max(loads) - min(loads) <= 8
    assert packing.deal([1024, 1024, 1], 1024) and max(map(len, packing.deal([700, 700, 700], 1024))) == 1


@pytest.mark.parametrize("limits", [{}, {"slice_bytes": 2000, "range_names": 50, "range_strings": 20}])
def test_repeated_strings(docs, limits):
    got = {r.doc_id: r for r in substrings.remove_repeats(docs.where("doc_id <> 8 or doc_id is null"), **limits).collect()}
    seen, expected = set(), {}
    order = sorted((r for r in ROWS if r[0] != 8), key=lambda r: (r[0] is not None, r[0] or 0))
    for doc_id, text, _ in order:
        raw = (text or "").encode()
        gone, own = np.zeros(len(raw), bool), set()
        for i in range(len(raw) - 49):
            if raw[i : i + 50] in seen:
                gone[i : i + 50] = True
            own.add(raw[i : i + 50])
        seen |= own
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        expected[doc_id] = (len(raw), int(gone.sum()), hashlib.sha256(kept).digest())
    assert {d: (r.n_bytes, r.n_removed, bytes(r.kept)) for d, r in got.items()} == expected
    assert got[4].n_spans == 1 and got[4].n_removed == len(BASE)


def test_a_copy_beside_another_text_of_its_id(spark):
    rows = spark.createDataFrame([(1, BASE), (2, BASE), (2, "quite another text " * 5)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in substrings.remove_repeats(rows).collect())
    assert got == [(1, len(BASE), 0), (2, len(BASE), len(BASE)), (2, 95, 0)]


def test_difference_cover_reaches_every_distance():
    differences = {(a - b) % substrings.PERIOD for a in substrings.COVER for b in substrings.COVER}
    assert differences == set(range(substrings.PERIOD))


def test_lines_keep_the_first_copy(docs):
    rows = lines.without_copies(docs).collect()
    assert len(rows) == len(ROWS)
    kept = {r.doc_id: r.kept_text for r in rows}
    assert kept[1] == BASE and kept[4] == "" and kept[2] == ""
    assert kept[7] == "Short.\nShort.\n"


def _groups(rows, n, threshold):
    sets = []
    for _, text, _ in rows:
        words = (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\t", " ").replace("\n", " ").split(" ")
        words = [w for w in words if w]
        sets.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set()))
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            shared, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if sets[i] and sets[j] and 100 * shared >= threshold * either:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return sets, label


@pytest.mark.parametrize("few", [64, 1])
def test_jaccard_groups(docs, few):
    rows = jaccard.similar_groups(docs, 4, jaccard.Threshold(85, 100), few=few, block=2).collect()
    sets, label = _groups(ROWS, 4, 85)
    expected = []
    for (doc_id, _, _), own, mine in zip(ROWS, sets, label):
        ids = [r[0] for r, other in zip(ROWS, label) if other == mine and r[0] is not None]
        expected.append((doc_id, len(own), min(ids) if ids else None))
    key = lambda r: (r[0] or 0, r[1])
    assert sorted(map(tuple, rows), key=key) == sorted(expected, key=key)


@pytest.mark.parametrize("few", [1, 64])
def test_jaccard_takes_sets_by_their_text(spark, few):
    """Rows of one id with other texts keep their own links, and a text without an id bridges two groups."""

    def text(name, *changed):
        return " ".join(f"{name}{i}" + ("x" if i in changed else "") for i in range(100))

    rows = [(1, text("a")), (None, text("a", 30)), (3, text("a", 30, 60))]
    rows += [(5, text("p")), (5, text("q")), (6, text("p", 40)), (7, text("q", 40)), (9, text("z"))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = jaccard.similar_groups(frame, 4, jaccard.Threshold(85, 100), few=few, block=2).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in found) == [
        (0, 1), (1, 1), (3, 1), (5, 5), (5, 5), (6, 5), (7, 5), (9, 9)
    ]


def test_shingles_of_few_words():
    sets = shingles.shingle_sets(["one two", "", "one"], 5)
    assert [len(x) for x in sets] == [1, 0, 1]
    assert [len(x) for x in shingles.shingle_sets(["a b c d e f"], 5)] == [2]


def test_jaccard_blocks_by_their_ngrams(docs, monkeypatch):
    """Blocks and cells that few n-grams fill change nothing."""
    key = lambda r: (r.doc_id or 0, r.n_shingles, r.component_id or 0)
    whole = sorted(map(key, jaccard.similar_groups(docs, 5, jaccard.Threshold(80, 100), few=1).collect()))
    monkeypatch.setattr(jaccard, "BLOCK_GRAMS", 3)
    monkeypatch.setattr(jaccard, "CELLS", 1)
    assert sorted(map(key, jaccard.similar_groups(docs, 5, jaccard.Threshold(80, 100), few=1).collect())) == whole


def test_jaccard_finds_links_in_a_large_near_group(spark):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for at in rng.choice(120, int(rng.integers(0, 6)), replace=False):
            words[at] = f"x{rng.integers(10**6)}"
        rows.append((i, " ".join(words), 0))
    frame = spark.createDataFrame(rows, "doc_id long, text string, slice int").repartition(5)
    got = {r.doc_id: r.component_id for r in jaccard.similar_groups(frame, 4, jaccard.Threshold(85, 100), block=32).collect()}
    _, label = _groups(rows, 4, 85)
    assert got == {i: min(j for j in range(150) if label[j] == label[i]) for i in range(150)}


def test_rules_and_odd_urls(spark):
    pages = spark.createDataFrame(
        [(1, "http://A.example.net/en/x?q"), (2, "http://net/"), (3, "http://a.net"), (4, None), (5, "no scheme"), (6, "http://b.org/fr/")],
        "page_id long, url string",
    ).withColumn("html", F.lit("fine"))
    rules = [urls.Rule("block", "net/"), urls.Rule("allow", "example.net/en/"), urls.Rule("allow", "org/fr/")]
    got = {r.page_id: r for r in urls.judge_urls(pages, F.col("html") == "bad", rules).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[2].verdict == "block" and got[3].rule is None and got[6].rule == "org/fr/"
    assert (got[4].host, got[5].path) == ("", "") and len(got) == 6


def test_hosts_in_parts_change_nothing(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    bad = F.col("html").rlike("#{3}")
    a = sorted(map(tuple, urls.judge_urls(pages, bad, parts=1).collect()))
    b = sorted(map(tuple, urls.judge_urls(pages, bad, parts=4096).collect()))
    assert len(a) == pages.count() and [x[:7] for x in a] == [x[:7] for x in b]
    assert all(math.isclose(x[7], y[7]) for x, y in zip(a, b))


def test_top_k_with_ties_and_bad_vectors(spark):
    rows = [(i, [1.0, 0.5]) for i in range(50)] + [(50, None), (51, [float("nan"), 1.0]), (52, [None, 1.0]), (53, [2.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors = frame.select("vec_id", topk.quantized(F.col("embedding")).alias("vector"), F.lit(1).alias("row"))
    got = topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), 3, query_block=2, vector_block=10).collect()
    assert [(r.rank, r.vec_id) for r in sorted(got) if r.query_id == 20] == [(1, 53), (2, 0), (3, 1)]
    assert {r.query_id for r in got} == {0, 20, 40}


def test_top_k_with_repeated_ids(spark):
    rows = [(0, [2, 0]), (0, [1, 0]), (1, [5, 1]), (1, [5, 1]), (2, [3, 9]), (None, [9, 9])]
    vectors = spark.createDataFrame(rows, "vec_id long, vector array<long>").repartition(4)
    got = sorted(tuple(r) for r in topk.top_k(vectors, vectors.where("vec_id in (0, 2)"), 4).collect())
    assert got == [(0, 1, 1, 5), (0, 2, 1, 5), (0, 3, 2, 3), (2, 1, 1, 24), (2, 2, 1, 24), (2, 3, 0, 6), (2, 4, 0, 3)]


def test_top_k_ranks_the_pairs_of_every_query_row(spark):
    rows = [(0, [2, 0]), (0, [1, 0]), (0, [1, 0]), (1, [5, 1]), (1, [5, 1]), (2, [3, 9]), (3, [0, 0])]
    vectors = spark.createDataFrame(rows, "vec_id long, vector array<long>").repartition(4)
    for k in (3, 9, 30):
        pairs = [(-sum(a * b for a, b in zip(q, c)), i) for n, q in rows if n == 0 for i, c in rows if i != 0]
        want = [(0, rank, i, -score) for rank, (score, i) in enumerate(sorted(pairs)[:k], 1)]
        found = topk.top_k(vectors, vectors.where("vec_id = 0"), k, query_block=1, vector_block=2, every_row=True)
        assert sorted(tuple(r) for r in found.collect()) == want


def test_quality_learns_and_scores_every_row(spark, docs, sf_dir):
    labels = spark.createDataFrame([(1, 1), (3, 0), (6, 0), (7, None)], "doc_id long, label int")
    rows = quality.quality_scores(docs, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 4)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # only the pair tells
    model = quality.fit(x[:1500], y[:1500])
    assert ((model.score(x[1500:]) > 0.5) == y[1500:]).mean() > 0.9


def test_quality_score_is_the_sum_of_its_tables(spark, sf_dir):
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    model = quality.fit_on_texts(texts, labels)
    assert any(t.any() for t in model.tables)
    rows = quality.feature_table(texts).collect()
    scores = dict(quality.score_table(quality.feature_table(texts), model).collect())
    for r in rows:
        bins = [sum(v >= edge for edge in edges) for v, edges in zip(r.x, model.edges)]
        margin = model.intercept + sum(t[b] for t, b in zip(model.tables, bins))
        margin += sum(t[model.coarse[i][bins[i]], model.coarse[j][bins[j]]] for (i, j), t in zip(model.pairs, model.pair_tables))
        assert scores[r.doc_id] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, margin)))))


def test_held_out_quality_labels_are_not_learnt(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/documents.parquet").write.parquet(f"{tmp_path}/documents.parquet")
    outside = quality.held_out(F.col("doc_id"), 5, 0)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert labels.where(outside).count() > 5
    turned = F.when(outside, 1 - F.col("quality")).otherwise(F.col("quality"))
    labels.withColumn("quality", turned).write.parquet(f"{tmp_path}/labels.parquet")
    key = lambda d: sorted(tuple(r) for r in QUERIES["op7_quality_classifier"](spark, d).collect())
    rows = key(sf_dir)
    assert key(str(tmp_path)) == rows
    assert all(held == (zlib.crc32(str(i).encode()) % 5 == 0) for i, held, *_ in rows)


def _factors(table):
    """Good-Turing factors of counts 1..5 from the numbers of types, 1 where they are not sound."""
    n = [0, *(sum(c == r for c in table.values()) for r in range(1, 7))]
    common = 6 * n[6] / n[1] if n[1] else 1
    out = {}
    for r in range(1, 6):
        f = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else 1
        out[r] = f if 0 < f <= 1 else 1
    return out


def test_katz_scores_are_those_of_a_plain_model(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    lower = {c: c + 32 for c in range(65, 91)}
    docs = {i: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)), None] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    one, two = Counter(), Counter()
    for i, words in docs.items():
        if not held[i]:
            one.update(words)
            two.update(zip(["", *words], words))
    n, f1, f2 = sum(one.values()), _factors(one), _factors(two)
    seen = sum(c * f1.get(c, 1) for c in one.values())
    unknown = max(n - seen, 1)
    p1 = lambda w: one[w] * f1.get(one[w], 1) / (seen + unknown) if one[w] else unknown / (seen + unknown)
    total, mass, covered = Counter(), Counter(), Counter()
    for (h, w), c in two.items():
        total[h] += c
        mass[h] += c * f2.get(c, 1)
        covered[h] += p1(w)

    def p2(h, w):
        if not total[h]:
            return p1(w)
        whole = total[h] + 1 if total[h] - mass[h] < 1e-9 else total[h]
        if two[h, w]:
            return two[h, w] * f2.get(two[h, w], 1) / whole
        return (whole - mass[h]) / whole / (1 - covered[h]) * p1(w)

    got = QUERIES["op8_katz_lm"](spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        words = docs[r.doc_id]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r.doc_id], len(words), n)
        assert r.n_known == sum(one[w] > 0 for w in words)
        assert r.base_score == pytest.approx(sum(math.log10((one[w] + 1) / (n + len(one) + 1)) for w in words))
        assert r.score == pytest.approx(sum(math.log10(p2(h, w)) for h, w in zip(["", *words], words)))
    outside = [r for r in got if r.held_out]
    assert sum(r.score for r in outside) > sum(r.base_score for r in outside)


def test_katz_contexts_sum_to_one():
    rng = np.random.default_rng(4)
    counts = rng.zipf(1.5, 200).clip(0, 50)
    stats = np.concatenate([[counts.sum(), len(counts)], [(counts == r).sum() for r in range(1, 7)]]).astype(float)
    unigrams = katz.Unigrams(stats)
    lower = unigrams.probability(counts)
    assert math.isclose(lower.sum() + unigrams.unknown, 1)
    seen = np.where(rng.random(200) < 0.3, rng.integers(1, 9, 200), 0)
    d = katz.discounts(np.array([30, 12, 6, 4, 3, 2]))
    denominator, weight = katz.contexts(np.array([0]), seen, lower, d)
    total = (katz._discounted(seen, d)[seen > 0] / denominator[0]).sum() + weight[0] * (lower[seen == 0].sum() + unigrams.unknown)
    assert math.isclose(total, 1)


def test_katz_is_the_same_in_any_slices(docs):
    held = quality.held_out(F.col("doc_id"), 7, 2)
    key = lambda r: (r.doc_id or 0, r.n_tokens)
    a = sorted(katz.katz_scores(docs, held).collect(), key=key)
    b = sorted(katz.katz_scores(docs, held, slice_bytes=500, range_tokens=20).collect(), key=key)
    assert len(a) == len(ROWS)
    assert all(math.isclose(x.score, y.score) and x.n_known == y.n_known for x, y in zip(a, b))


def test_katz_split_contexts_change_nothing(spark, sf_dir):
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = quality.held_out(F.col("doc_id"), 7, 2)
    whole = {r.doc_id: r.score for r in katz.katz_scores(texts, held).collect()}
    small = katz.katz_scores(texts, held, slice_bytes=100_000, range_tokens=400)
    split = {r.doc_id: r.score for r in small.collect()}
    assert whole.keys() == split.keys()
    assert all(math.isclose(x, split[d], rel_tol=1e-9) for d, x in whole.items())


def test_katz_sums_of_parts_give_the_weights_of_the_whole():
    rng = np.random.default_rng(5)
    counts, unigram = rng.integers(0, 12, 300), rng.zipf(1.5, 300).clip(1, 90)
    stats = np.concatenate([[unigram.sum(), 300], [(unigram == r).sum() for r in range(1, 7)]]).astype(float)
    unigrams, d = katz.Unigrams(stats), katz.discounts(np.array([30, 12, 6, 4, 3, 2]))
    whole = katz.contexts(np.array([0]), counts, unigrams.probability(unigram), d)
    parts = katz.hot_sums(np.array([0, 70, 110]), counts, unigram).sum(axis=0, keepdims=True)
    assert np.allclose(whole, katz.hot_weights(parts, d, unigrams))


def test_pieces_match_and_come_back(docs):
    path = P.path("piece_bpe_32k.model")
    encoded = pieces.encode_table(docs, path)
    assert all(r.parity and r.round_trip for r in encoded.collect())
    back = sorted((r.doc_id or 0, r.text) for r in pieces.decode_table(encoded, path).collect())
    assert back == sorted((d or 0, t or "") for d, t, _ in ROWS)


def test_piece_digests_are_those_of_the_library(spark, sf_dir):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = [(-1, None), (-2, ""), (-3, "  two  spaces "), (-4, "▁marked ▁ text"), (-5, "tab\t\r\n 漢字 😀"), (-6, "word " * 20_000)]
    docs = rows.union(spark.createDataFrame(odd, rows.schema))
    texts = dict(docs.collect())
    for r in pieces.digests(docs, P.path("piece_bpe_32k.model")).collect():
        ids = np.array(library.encode(texts[r.doc_id] or ""), dtype="<u4")
        assert (r.n_tokens, r.ids_crc32, r.parity, r.round_trip) == (len(ids), zlib.crc32(ids.tobytes()), True, True)


def test_piece_flags_tell_of_faults(monkeypatch):
    encoder = pieces.PieceEncoder(P.path("piece_bpe_32k.model"))
    decode, encode = encoder.decode, encoder.encode
    monkeypatch.setattr(encoder, "decode", lambda ids: [t.replace("three", "four") for t in decode(ids)])
    monkeypatch.setattr(encoder, "encode", lambda texts: [x[:-1] if "end" in t else x for x, t in zip(encode(texts), texts)])
    got = [(parity, back) for _, parity, back in encoder(["one two", "three", "the end"])]
    assert got == [(True, True), (True, False), (False, False)]


@pytest.mark.parametrize("slice_rows", [2, 2000])
def test_fingerprints(docs, slice_rows):
    rows = fingerprints.edited_with_next(docs, slice_rows).collect()
    order = sorted(ROWS, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    expected = set()
    for i, (doc_id, text, _) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        expected.add((doc_id, len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()))
    assert {(r.doc_id, r.n_chars, r.edited_sha256) for r in rows} == expected and len(rows) == len(ROWS)
    by_id = {r.doc_id: r.fingerprint for r in rows}
    assert by_id[1] == by_id[4] != by_id[5]
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)


def _fingerprint(text):
    """Sums over the paragraphs of bits and parts of their digests."""
    x = lambda b, seed=42: xxhash.xxh64_intdigest(b, seed=seed)
    lanes = [0] * (64 + 4 + 1)
    for p in re.split(r"\n+|(?<=[.!?])\s+", text, flags=re.ASCII):
        if p:
            a, b, c = (x(p.encode()), *(x(p.encode(), x(name)) for name in (b"b", b"c")))
            for i in range(64):
                lanes[i] += a >> i & 1
            for i, part in enumerate((b & 0xFFFFFFFF, b >> 32, c & 0xFFFFFFFF, c >> 32)):
                lanes[64 + i] += part
            lanes[68] += 1
    return [v % 2**32 for v in lanes]


def _likeness(a, b):
    if a == b:
        return 1.0
    u, v = ([2 * x - f[68] for x in f[:64]] for f in (a, b))
    size = math.sqrt(sum(x * x for x in u) * sum(x * x for x in v))
    return min(1.0, max(0.0, sum(x * y for x, y in zip(u, v)) / size)) if size else 0.0


def test_fingerprints_are_sums_of_paragraphs(spark, sf_dir):
    rows = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect(), reverse=True)
    texts = [t or "" for _, t in rows]
    got = {r.doc_id: r for r in QUERIES["op10_fingerprints"](spark, sf_dir).collect()}
    spell = lambda f: "".join(f"{v:08x}" for v in f)
    for k, (doc_id, _) in enumerate(rows):
        text, after = texts[k], texts[(k + 1) % len(texts)]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, other, following = _fingerprint(text), _fingerprint(edited), _fingerprint(after)
        r = got[doc_id]
        assert (r.fingerprint, r.edited_fingerprint) == (spell(own), spell(other))
        assert r.near_edited == pytest.approx(_likeness(own, other)) and r.near_next == pytest.approx(_likeness(own, following))


def test_fingerprint_vectors_add_and_subtract(spark):
    one = spark.range(1).select(
        F.array(F.lit(4294967295), F.lit(1)).alias("a"), F.array(F.lit(2), F.lit(3)).alias("b")
    )
    row = one.select(fingerprints.add(F.col("a"), F.col("b")), fingerprints.subtract(F.col("b"), F.col("a"))).first()
    assert row[0] == [1, 4] and row[1] == [3, 2]


def test_empty_tables(spark, docs):
    none = docs.where("false")
    no_labels = spark.createDataFrame([], "doc_id long, label int")
    for frame in (
        packing.pack(none, *bpe()),
        substrings.remove_repeats(none),
        lines.without_copies(none),
        jaccard.similar_groups(none),
        quality.quality_scores(none, no_labels),
        katz.katz_scores(none, F.lit(False)),
        pieces.encode_table(none, P.path("piece_bpe_32k.model")),
        fingerprints.edited_with_next(none),
        urls.judge_urls(none.selectExpr("doc_id as page_id", "text as url"), F.lit(True)),
        topk.top_k(none.selectExpr("doc_id as vec_id", "array(1L) as vector"), none.selectExpr("doc_id as vec_id", "array(1L) as vector")),
    ):
        assert frame.collect() == []


def test_common_ngrams_are_counted_in_all_documents(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TOGETHER", 40)
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in np.minimum(rng.geometric(0.25, 30), 12)) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    sets = jaccard.shingle_sets(texts, 2)
    grams, counts = np.unique(np.concatenate(sets), return_counts=True)
    for share, least, most in ((0.1, 3, 1000), (0.001, 3, 1000), (0.3, 3, 1000), (0.01, 3, 5)):
        need = max(least, share * len(texts))
        kept = sorted(((-c, int(np.uint64(g).astype(np.int64)), g) for g, c in zip(grams, counts) if c >= need))[:most]
        got = jaccard._common(docs, len(texts), 2, share, least, most)
        assert len(kept) and got.tolist() == sorted(int(g) for *_, g in kept)


def test_jaccard_marks_few_ngrams_in_small_tasks(spark):
    """A task with few documents must not mark all its n-grams as frequent, or all of them are counted."""
    texts = [f"common words here {' '.join(f'w{i}x{j}' for j in range(30))}" for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(100)
    need = 0.1
    counts = jaccard._counts_of_marked(docs, len(texts), 3, need)
    assert counts.count() < 100
    common = counts.groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= need * len(texts)).collect()
    assert [r.n for r in common] == [400]
