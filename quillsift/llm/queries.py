"""The queries of this package and, where SQL can express them, their checks."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.llm import audit, fingerprints, jaccard, katz, language, lines, packing, periods, pieces, quality, substrings, topk, urls
from quillsift.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    def register(run):
        QUERIES[name] = run
        if check:
            CHECKS[name] = check
        return run

    return register


@query("op1_packing")
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences of at most 1024 ids."""
    import public_tokenizers

    return packing.pack(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )


RULES = [
    urls.Rule("block", "net/"),
    urls.Rule("allow", "example.net/en/"),
    urls.Rule("block", "example.com/de/"),
    urls.Rule("allow", "org/fr/"),
]

#: Marks of spoilt text: three equal symbols after a word.
JUNK = r"#{3}|%{3}|[*]{3}|[$]{3}"


@query("op5_url_filter", """
WITH urls AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path,
    regexp_matches(html, '#{3}|%{3}|[*]{3}|[$]{3}') AS outcome
  FROM pages),
counted AS (
  SELECT host, count(outcome) AS n, count(CASE WHEN outcome THEN 1 END) AS bad,
    regexp_replace(host, ':[0-9]*\\z', '') AS plain
  FROM urls GROUP BY host),
parts AS (
  SELECT *, regexp_extract(plain, '([^.]*\\.[^.]*)\\z', 1) AS two,
    regexp_extract(plain, '([^.]*\\.[^.]*\\.[^.]*)\\z', 1) AS three,
    regexp_extract(plain, '([^.]*\\.[^.]*)\\z', 1) IN ('co.uk', 'org.uk', 'com.au', 'co.jp', 'com.br') AS long
  FROM counted),
hosts AS (
  SELECT host, n, bad,
    CASE WHEN long AND three <> '' THEN three WHEN two <> '' THEN two ELSE plain END AS domain,
    CASE WHEN long THEN two ELSE regexp_extract(plain, '([^.]*)\\z', 1) END AS suffix
  FROM parts),
root AS (SELECT (coalesce(sum(bad), 0) + 0.5::DOUBLE) / (coalesce(sum(n), 0) + 1) AS above FROM hosts),
suffix0 AS (
  SELECT h.suffix, h.n, h.bad, r.above
  FROM (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY suffix) h CROSS JOIN root r),
suffix_s AS (
  SELECT 1 / least(greatest(coalesce((sum(n * power(bad / n - above, 2)) - sum(above * (1 - above)))
      / nullif(sum((n - 1) * above * (1 - above)), 0), 1e-4), 1e-4), 1 - 1e-4) - 1 AS s FROM suffix0 WHERE n > 0),
domain0 AS (
  SELECT h.domain, h.n, h.bad, (p.bad + s * p.above) / (p.n + s) AS above
  FROM (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY domain, suffix) h
  JOIN suffix0 p USING (suffix) CROSS JOIN suffix_s),
domain_s AS (
  SELECT 1 / least(greatest(coalesce((sum(n * power(bad / n - above, 2)) - sum(above * (1 - above)))
      / nullif(sum((n - 1) * above * (1 - above)), 0), 1e-4), 1e-4), 1 - 1e-4) - 1 AS s FROM domain0 WHERE n > 0),
host0 AS (
  SELECT h.host, h.n, h.bad, (p.bad + s * p.above) / (p.n + s) AS above
  FROM hosts h JOIN domain0 p USING (domain) CROSS JOIN domain_s),
host_s AS (
  SELECT 1 / least(greatest(coalesce((sum(n * power(bad / n - above, 2)) - sum(above * (1 - above)))
      / nullif(sum((n - 1) * above * (1 - above)), 0), 1e-4), 1e-4), 1 - 1e-4) - 1 AS s FROM host0 WHERE n > 0),
post AS (SELECT host, n, bad, bad + s * above AS a, n - bad + s * (1 - above) AS b FROM host0 CROSS JOIN host_s),
reputation AS (
  SELECT host, n, bad, a / (a + b) AS rate,
    greatest(a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 0) AS lower FROM post),
judged AS (
  SELECT u.page_id, u.host, u.path, n, bad, rate, lower,
    CASE WHEN (u.host = 'example.net' OR suffix(u.host, '.example.net')) AND prefix(u.path, '/en/') THEN 'example.net/en/'
         WHEN (u.host = 'example.com' OR suffix(u.host, '.example.com')) AND prefix(u.path, '/de/') THEN 'example.com/de/'
         WHEN (u.host = 'org' OR suffix(u.host, '.org')) AND prefix(u.path, '/fr/') THEN 'org/fr/'
         WHEN (u.host = 'net' OR suffix(u.host, '.net')) AND prefix(u.path, '/') THEN 'net/' END AS rule
  FROM urls u JOIN reputation r ON u.host = r.host)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN lower > 0.3 THEN 'block' ELSE 'allow' END AS verdict,
  n AS host_pages, bad AS host_bad, round(rate, 6) AS rate, round(lower, 6) AS lower
FROM judged
""")
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged; a labelled outcome is whether the page shows spoilt text."""
    pages = table(spark, sf_dir, "pages")
    judged = urls.judge_urls(pages, F.col("html").rlike(JUNK), RULES, limit=0.3)
    return judged.withColumns({c: F.round(c, 6) for c in ("rate", "lower")})


@query("op6_exact_top_k", """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (
  SELECT query_id, vec_id, score,
    CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
""")
def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all vectors for each query vector."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", topk.quantized(F.col("embedding")).alias("vector"))
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), 20, every_row=True)


@query("op7_quality_classifier")
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    scores = quality.quality_scores(table(spark, sf_dir, "documents"), labels)
    return scores.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query("op3_line_dedup", """
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM docs),
w AS (
  SELECT *, line || chr(10) || lead(line, 1) OVER along || chr(10) || lead(line, 2) OVER along AS run
  FROM l WINDOW along AS (PARTITION BY doc_id ORDER BY pos)),
c AS (
  SELECT *, CASE
      WHEN run IS NOT NULL AND row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) > 1 THEN 3
      WHEN length(line) >= 50 AND row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) > 1 THEN 1
      ELSE 0 END AS covers
  FROM w),
m AS (
  SELECT doc_id, pos, line,
    max(pos + covers) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) > pos AS goes
  FROM c),
s AS (SELECT *, goes AND NOT coalesce(lag(goes) OVER (PARTITION BY doc_id ORDER BY pos), false) AS starts FROM m)
SELECT doc_id, CAST(count(*) AS INTEGER) AS n_lines, CAST(count(CASE WHEN goes THEN 1 END) AS INTEGER) AS n_removed,
  count(CASE WHEN starts THEN 1 END) AS n_runs,
  sha256(coalesce(string_agg(CASE WHEN NOT goes THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM s GROUP BY doc_id
""")
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later copies of line runs taken out of every document."""
    kept = lines.without_copies(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op10_fingerprints")
def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprints.edited_with_next(table(spark, sf_dir, "documents"))


@query("op9_sentencepiece")
def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, with parity to the reference encoder and the round trip."""
    import public_tokenizers

    return pieces.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op4_ngram_jaccard", """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN []
    WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 2),
           lambda i: array_to_string(words[i : i + 3], ' '))) END AS grams
  FROM w),
g AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
linked AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id AND 100 * b.n >= 85 * a.n AND 100 * a.n >= 85 * b.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(a, b) AS (
  SELECT a, b FROM linked UNION SELECT r.a, l.b FROM reach r JOIN linked l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(grams) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(l.b, s.doc_id)) AS component_id
FROM s LEFT JOIN least l ON l.a = s.doc_id
""")
def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked by four-word shingles at 0.85."""
    return jaccard.similar_groups(table(spark, sf_dir, "documents"), 4, jaccard.Threshold(85, 100))


@query("op2_suffix_dedup")
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without byte strings that a smaller one has."""
    left = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.lower(F.hex("kept")).alias("kept_sha256"))


@query("op8_katz_lm")
def op8_katz_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a bigram model learnt from six sevenths of them."""
    outside = quality.held_out(F.col("doc_id"), 7, 2)
    return katz.katz_scores(table(spark, sf_dir, "documents"), outside)


@query("op11_filter_audit", r"""
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM docs),
f AS (
  SELECT doc_id, part,
    CASE WHEN len(words) < 100 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 10 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails
  FROM w),
marks AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
cells AS (
  SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM f LEFT JOIN marks USING (doc_id) GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, CAST(step AS INTEGER) AS step FROM orders, range(1, 6) AS s(step)),
judged AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS own, n, good, toxic, length(fails) AS failing,
    contains(fails, substr(filter_order, step, 1)) AS fails_here,
    length(translate(substr(filter_order, 1, step - 1), fails, '')) = step - 1 AS reached
  FROM cells, steps),
audit AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN reached AND NOT fails_here THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN reached AND fails_here THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN NOT reached AND fails_here THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails_here AND failing = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN reached AND fails_here THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN reached AND fails_here THEN toxic ELSE 0 END) AS toxic_lost
  FROM judged GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM audit
""")
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters in all orders, per language."""
    labels = table(spark, sf_dir, "labels")
    marks = labels.select("doc_id", (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    return audit.audit_filters(table(spark, sf_dir, "documents"), marks)


def repeated_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """In one document of ten: from a word on, a stretch of words again and again."""
    if doc_id is None:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    at = g % n
    period = 1 + (n - at) // (3 + g % 8)
    words = np.arange(n)
    words[at:] = at + (words[at:] - at) % period
    return words


@query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, a tenth of which is given one first."""
    found = periods.periodic_runs(table(spark, sf_dir, "documents"), order=repeated_tail)
    spelt = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "strongest.*",
        F.floor(F.try_divide(1000 * F.col("strongest.length"), F.col("strongest.period"))).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(spelt, lambda line: F.concat(line, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query("op13_language_id")
def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from three quarters of them."""
    docs = table(spark, sf_dir, "documents")
    outside = quality.held_out(F.col("doc_id"), 4, 2)
    model = language.fit_languages(docs.where(~outside))
    return language.identify(docs, model, reject=False).withColumn("held_out", outside)
