"""Queries over text cleaning and word counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillsift.functions import text as X
from quillsift.functions.columns import char_length, full_text
from quillsift.functions.entities import html_unescape
from quillsift.operators import words as W
from quillsift.operators.aggregates import length_boxstats
from quillsift.plans.catalog.tables import labelled
from quillsift.plans.registry import query, rounded, view
from quillsift.session import spread
from quillsift.sources.tables import table, timed_reviews


def _sub(inner: str, pattern: str, replacement: str) -> str:
    """SQL of one global replacement."""
    quoted = pattern.replace("'", "''"), replacement.replace("'", "''")
    return f"regexp_replace({inner}, '{quoted[0]}', '{quoted[1]}', 'g')"


def _sub_all(inner: str, rules) -> str:
    for pattern, replacement in rules:
        inner = _sub(inner, pattern, replacement)
    return inner


_SPACES = r"[\s\x0b\x1c-\x1f\x85\x{a0}]+"
_URLS = r"https?://[^\s\x0b\x1c-\x1f\x{a0}]+|www\.[^\s\x0b\x1c-\x1f\x{a0}]+"

# The entities that the tables hold; the ampersand last, so that nothing is decoded twice.
_ENTITIES = [("&quot;?", '"'), ("&copy;?", "©"), ("&middot;?", "·"), ("&amp;?", "&")]


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _without(tokens: str, words: list[str], shortest: int) -> str:
    return f"list_filter({tokens}, lambda w: length(w) >= {shortest} AND NOT list_contains({_list(words)}, w))"


view("joined", "SELECT *, coalesce(title, '') || '. ' || coalesce(text, '') AS full_text FROM labelled")
view("lowered", f"SELECT *, lower({_sub_all('full_text', _ENTITIES)}) AS low FROM joined")
view(
    "expanded",
    f"SELECT *, {_sub(_sub_all('low', X.SPECIAL_CONTRACTIONS + X.SUFFIX_CONTRACTIONS), chr(39) + 's' + chr(92) + 'b', '')} AS long FROM lowered",
)
view(
    "cleaned",
    f"""SELECT *, trim({_sub(_sub(_sub(_sub('long', _URLS, ' '), '<[^>]+>', ' '), '[^a-z0-9]', ' '), ' +', ' ')}) AS clean_text FROM expanded""",
)
view(
    "stripped",
    f"SELECT *, array_to_string({_without('string_split(clean_text, chr(32))', X.STOP_WORDS, 2)}, ' ') AS clean_text_no_stopwords FROM cleaned",
)


def pages(spark, sf_dir):
    return spread(table(spark, sf_dir, "pages"), "page_id")


def joined(spark, sf_dir):
    return labelled(spark, sf_dir, heavy=True).withColumn("full_text", full_text())


def lowered(spark, sf_dir):
    return joined(spark, sf_dir).withColumn("low", F.lower(html_unescape(F.col("full_text"))))


def cleaned(spark, sf_dir):
    return X.add_clean_columns(labelled(spark, sf_dir, heavy=True))


@query("text_null_to_empty", "SELECT review_id, coalesce(title, '') AS title FROM reviews")
def _(spark, sf_dir):
    return timed_reviews(spark, sf_dir).select("review_id", X.text_null_to_empty(F.col("title")).alias("title"))


@query("html_unescape", f"SELECT page_id, {_sub_all('html', _ENTITIES)} AS html FROM pages")
def _(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", html_unescape(F.col("html")).alias("html"))


@query("lowercase", "SELECT review_id, low FROM lowered")
def _(spark, sf_dir):
    return lowered(spark, sf_dir).select("review_id", "low")


@query("expand_special", f"SELECT review_id, {_sub_all('low', X.SPECIAL_CONTRACTIONS)} AS text FROM lowered")
def _(spark, sf_dir):
    return lowered(spark, sf_dir).select("review_id", X.expand_special(F.col("low")).alias("text"))


@query("expand_suffix", f"SELECT review_id, {_sub_all('low', X.SUFFIX_CONTRACTIONS)} AS text FROM lowered")
def _(spark, sf_dir):
    return lowered(spark, sf_dir).select("review_id", X.expand_suffix(F.col("low")).alias("text"))


@query("strip_possessive", r"SELECT review_id, regexp_replace(low, '''s\b', '', 'g') AS text FROM lowered")
def _(spark, sf_dir):
    return lowered(spark, sf_dir).select("review_id", X.strip_possessive(F.col("low")).alias("text"))


@query("strip_urls", f"SELECT review_id, {_sub('low', _URLS, ' ')} AS text FROM lowered")
def _(spark, sf_dir):
    return lowered(spark, sf_dir).select("review_id", X.strip_urls(F.col("low")).alias("text"))


@query("strip_tags", "SELECT page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') AS text FROM pages")
def _(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", X.strip_tags(F.col("html")).alias("text"))


@query("strip_punct", r"SELECT review_id, regexp_replace(low, '[^a-z0-9\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]', ' ', 'g') AS text FROM lowered")
def _(spark, sf_dir):
    return lowered(spark, sf_dir).select("review_id", X.strip_punct(F.col("low")).alias("text"))


@query("squeeze_space", r"SELECT review_id, trim(regexp_replace(low, '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) AS text FROM lowered")
def _(spark, sf_dir):
    return lowered(spark, sf_dir).select("review_id", X.squeeze_space(F.col("low")).alias("text"))


@query("clean_text", "SELECT review_id, clean_text FROM cleaned")
def _(spark, sf_dir):
    return joined(spark, sf_dir).select("review_id", X.clean_text(F.col("full_text")).alias("clean_text"))


@query("remove_stopwords", "SELECT review_id, clean_text_no_stopwords FROM stripped")
def _(spark, sf_dir):
    return cleaned(spark, sf_dir).select("review_id", "clean_text_no_stopwords")


@query(
    "light_clean",
    r"""SELECT page_id, trim(regexp_replace(regexp_replace(""" + _sub_all("html", _ENTITIES) + r""", '<[^>]+>', ' ', 'g'),
    '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) AS light_text FROM pages""",
)
def _(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", X.light_clean(F.col("html")).alias("light_text"))


@query("char_length", "SELECT review_id, CAST(length(clean_text) AS INT) AS clean_text_length FROM cleaned")
def _(spark, sf_dir):
    return cleaned(spark, sf_dir).select("review_id", char_length("clean_text").alias("clean_text_length"))


@query("tokenize_words", "SELECT review_id, array_to_string(list_filter(string_split(clean_text, ' '), lambda w: length(w) >= 2), '|') AS words FROM cleaned")
def _(spark, sf_dir):
    tokens = X.tokenize_words(F.col("clean_text"))
    return cleaned(spark, sf_dir).select("review_id", F.array_join(tokens, "|").alias("words"))


def _top_words(column):
    return f"""SELECT word, count(*) AS count FROM (SELECT unnest(string_split({column}, ' ')) AS word FROM stripped)
    WHERE word <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30"""


@query("word_counts", _top_words("clean_text"))
def _(spark, sf_dir):
    return W.word_counts(cleaned(spark, sf_dir))


@query("word_counts_nostop", _top_words("clean_text_no_stopwords"))
def _(spark, sf_dir):
    return W.word_counts(cleaned(spark, sf_dir), "clean_text_no_stopwords")


@query(
    "top_words_by_class",
    """SELECT sentiment_label, word, count(*) AS count, CAST(row_number() OVER (PARTITION BY sentiment_label ORDER BY count(*) DESC, word) AS INT) AS rank
    FROM (SELECT sentiment_label, unnest(string_split(clean_text_no_stopwords, ' ')) AS word FROM stripped)
    WHERE word <> '' GROUP BY 1, 2 QUALIFY rank <= 20""",
)
def _(spark, sf_dir):
    return W.top_words_by_class(cleaned(spark, sf_dir))


view(
    "paired",
    f"""SELECT sentiment_label, unnest(list_transform(range(1, greatest(len(t), 1)), lambda i: t[i] || ' ' || t[i + 1])) AS bigram
    FROM (SELECT sentiment_label, {_without("string_split(clean_text, ' ')", X.ENGLISH_STOP_WORDS, 2)} AS t FROM cleaned)""",
)


@query("bigram_counts", "SELECT bigram, count(*) AS count FROM paired GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30")
def _(spark, sf_dir):
    return W.bigram_counts(cleaned(spark, sf_dir))


@query(
    "bigrams_by_class",
    """SELECT sentiment_label, bigram, count(*) AS count,
    CAST(row_number() OVER (PARTITION BY sentiment_label ORDER BY count(*) DESC, bigram) AS INT) AS rank
    FROM paired GROUP BY 1, 2 QUALIFY rank <= 20""",
)
def _(spark, sf_dir):
    return W.bigrams_by_class(cleaned(spark, sf_dir))


view("sized", "SELECT CAST(len(list_filter(string_split(clean_text, ' '), lambda w: w <> '')) AS DOUBLE) AS n FROM cleaned")


@query(
    "token_length_stats",
    """SELECT round(avg(CASE WHEN n > 128 THEN 100.0::DOUBLE ELSE 0 END), 6) AS pct_over, round(quantile_cont(n, 0.5), 6) AS median,
    round(quantile_cont(n, 0.95), 6) AS p95 FROM sized""",
)
def _(spark, sf_dir):
    stats = W.token_length_stats(cleaned(spark, sf_dir), X.words(F.col("clean_text")))
    return rounded(stats, "pct_over", "median", "p95")


@query("truncate_tokens", "SELECT review_id, array_to_string(list_filter(string_split(clean_text, ' '), lambda w: w <> '')[1:128], ' ') AS seen FROM cleaned")
def _(spark, sf_dir):
    seen = X.truncate_tokens(X.words(F.col("clean_text")), 128)
    return cleaned(spark, sf_dir).select("review_id", F.array_join(seen, " ").alias("seen"))


@query(
    "clean_length_boxstats",
    """WITH lens AS (SELECT sentiment_label, CAST(length(clean_text) AS DOUBLE) AS len FROM cleaned),
    box AS (SELECT sentiment_label, quantile_cont(len, 0.25) AS q1, quantile_cont(len, 0.5) AS median, quantile_cont(len, 0.75) AS q3
      FROM lens GROUP BY 1)
    SELECT sentiment_label, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
      min(len) AS whisker_low, max(len) AS whisker_high FROM lens JOIN box USING (sentiment_label)
    WHERE len BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1) GROUP BY sentiment_label, q1, median, q3""",
)
def _(spark, sf_dir):
    sized = cleaned(spark, sf_dir).withColumn("clean_text_length", char_length("clean_text"))
    return rounded(length_boxstats(sized), "q1", "median", "q3")
