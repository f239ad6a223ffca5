"""Text cleaning as column expressions. Each step is one function; ``clean_text`` runs them all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.functions.arrays import let
from quillsift.functions.columns import full_text
from quillsift.functions.entities import html_unescape

# Contractions with their own reading, applied in this order.
SPECIAL_CONTRACTIONS = [
    (r"\bcan't\b", "can not"),
    (r"\bwon't\b", "will not"),
    (r"\bit's\b", "it is"),
    (r"\bthat's\b", "that is"),
    (r"\bthere's\b", "there is"),
    (r"\bhere's\b", "here is"),
    (r"\bwhat's\b", "what is"),
]

# Contraction endings, applied after the ones above.
SUFFIX_CONTRACTIONS = [
    (r"n't\b", " not"),
    (r"'re\b", " are"),
    (r"'d\b", " would"),
    (r"'ll\b", " will"),
    (r"'ve\b", " have"),
    (r"'m\b", " am"),
]

# White space as Unicode defines it plus the four ASCII separators, (?U) turns the former on.
_SPACE = r"\s\x1c-\x1f"

# Patterns that are replaced by a space.
URL = rf"(?U)https?://[^{_SPACE}]+|www\.[^{_SPACE}]+"
TAG = r"<[^>]+>"
PUNCTUATION = rf"(?U)[^a-z0-9{_SPACE}]"
SPACES = rf"(?U)[{_SPACE}]+"

# Leftovers of contractions, dropped with the stop words.
EXTRA_STOP_WORDS = ["t", "s", "m", "don", "ve", "ll", "re", "d"]

# Default English stop words: those of Spark's own list that cleaned text can contain. "not" is a
# member here and taken out where sentiment matters. Every function takes another list instead.
ENGLISH_STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her
hers herself it its itself they them their theirs themselves what which who whom this that these
those am is are was were be been being have has had having do does did doing a an the and but if or
because as until while of at by for with about against between into through during before after
above below to from up down in out on off over under again further then once here there when where
why how all any both each few more most other some such no nor not only own same so than too very s
t can will just don should now cannot could ought would
""".split()

STOP_WORDS = [w for w in ENGLISH_STOP_WORDS if w != "not"] + [
    w for w in EXTRA_STOP_WORDS if w not in ENGLISH_STOP_WORDS
]


def _replace_all(text: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def text_null_to_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def expand_special(text: Column) -> Column:
    return _replace_all(text, SPECIAL_CONTRACTIONS)


def expand_suffix(text: Column) -> Column:
    return _replace_all(text, SUFFIX_CONTRACTIONS)


def strip_possessive(text: Column) -> Column:
    return F.regexp_replace(text, r"'s\b", "")


def strip_urls(text: Column) -> Column:
    return F.regexp_replace(text, URL, " ")


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, TAG, " ")


def strip_punct(text: Column) -> Column:
    return F.regexp_replace(text, PUNCTUATION, " ")


def squeeze_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACES, " "))


def _where(condition: Callable[[Column], Column], step: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A step that is skipped where the text has nothing for it."""
    return lambda text: let(text, lambda t: F.when(condition(t), step(t)).otherwise(t))


def clean_text(text: Column) -> Column:
    """The whole cleaning chain. Most texts lack some of the characters, so steps are guarded."""
    step = F.lower(html_unescape(text_null_to_empty(text)))
    step = _where(lambda t: t.contains("'"), lambda t: strip_possessive(expand_suffix(expand_special(t))))(step)
    step = _where(lambda t: t.contains("http") | t.contains("www."), strip_urls)(step)
    step = _where(lambda t: t.contains("<"), strip_tags)(step)
    # Blanking punctuation and then collapsing spaces equals collapsing all that is not a-z 0-9.
    return F.trim(F.regexp_replace(step, "[^a-z0-9]+", " "))


def light_clean(text: Column) -> Column:
    """Decode, strip tags and squeeze spaces; case and punctuation stay."""
    return squeeze_space(strip_tags(html_unescape(text_null_to_empty(text))))


def words(text: Column) -> Column:
    """Words of a cleaned text; none for an empty one."""
    return F.filter(F.split(text, " "), lambda w: w != "")


def remove_stopwords(text: Column, stop_words: list[str] = STOP_WORDS) -> Column:
    """Drop stop words and one-character words from a cleaned text.

    A long literal list becomes a hash set, so the cost per word does not grow with the list.
    """
    kept = F.filter(F.split(text, " "), lambda w: (F.char_length(w) > 1) & ~w.isin(*stop_words))
    return F.array_join(kept, " ")


def tokenize_words(text: Column) -> Column:
    """Words of at least two characters of a cleaned text."""
    return F.filter(F.split(text, " "), lambda w: F.char_length(w) >= 2)


def without(tokens: Column, stop_words: list[str]) -> Column:
    return F.filter(tokens, lambda w: ~w.isin(*stop_words))


def _pairs(tokens: Column) -> Column:
    pairs = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.zip_with(
        F.slice(tokens, F.lit(1), pairs), F.slice(tokens, F.lit(2), pairs), lambda a, b: F.concat_ws(" ", a, b)
    )


def bigrams(tokens: Column) -> Column:
    """Neighbouring words joined by a space."""
    return let(tokens, _pairs)


def terms(tokens: Column) -> Column:
    """Words and bigrams."""
    return let(tokens, lambda t: F.concat(t, _pairs(t)))


def truncate_tokens(tokens: Column, limit: int = 128) -> Column:
    return F.slice(tokens, 1, limit)


def add_clean_columns(df: DataFrame, stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """``full_text``, ``clean_text`` and ``clean_text_no_stopwords``."""
    cleaned = df.withColumn("full_text", full_text()).withColumn("clean_text", clean_text(F.col("full_text")))
    return cleaned.withColumn("clean_text_no_stopwords", remove_stopwords(F.col("clean_text"), stop_words))
