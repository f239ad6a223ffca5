"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A text is the multiset of its paragraphs: lines, cut again after a sentence end so that a text of one
line has more than one. Each paragraph is hashed to a wide vector, and the fingerprint is the sum of the
vectors modulo 2^32 per lane. So the order of paragraphs does not matter, and a paragraph is added to or
taken from a fingerprint by adding or subtracting its vector. ``SIGNS`` lanes count set bits of a digest
and give a likeness (the cosine of the counts taken as signs); ``STRONG`` lanes add 32-bit parts of two
more digests and tell different multisets apart.

DataFrame expressions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIGNS, STRONG = 64, 4
MODULUS = 1 << 32
_LOW, _BOTH = 0xFFFFFFFF, 0x100000001

#: Line ends, and white space after a sentence end.
PARAGRAPH_END = r"\n+|(?<=[.!?])\s+"


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, PARAGRAPH_END), lambda p: p != "")


def _digests(text: Column) -> Column:
    return F.transform(
        paragraphs(text),
        lambda p: F.struct(
            F.xxhash64(p).alias("a"), F.xxhash64(F.lit("b"), p).alias("b"), F.xxhash64(F.lit("c"), p).alias("c")
        ),
    )


def _sums(prefix: str, digest: str, chosen: Column) -> list[Column]:
    """Aggregates over exploded paragraphs: their number, two bit counts to a sum, and the strong lanes."""

    def part(value: Column) -> Column:
        return F.coalesce(F.sum(F.when(chosen, value)), F.lit(0))

    a = F.col(f"{digest}.a")
    bits = [
        part(F.shiftrightunsigned(a, i).bitwiseAND(F.lit(_BOTH))).alias(f"{prefix}_{i}") for i in range(SIGNS // 2)
    ]
    strong = [
        part(half).alias(f"{prefix}_s{2 * i + j}")
        for i, name in enumerate("bc")
        for j, half in enumerate(
            (
                F.col(f"{digest}.{name}").bitwiseAND(F.lit(_LOW)),
                F.shiftrightunsigned(F.col(f"{digest}.{name}"), 32),
            )
        )
    ]
    return [F.count(F.when(chosen, 1)).alias(f"{prefix}_n"), *bits, *strong]


def _vector(prefix: str) -> Column:
    """The lanes in order: bit counts, strong lanes, the number of paragraphs."""
    halves = [F.col(f"{prefix}_{i}") for i in range(SIGNS // 2)]
    lanes = [h.bitwiseAND(F.lit(_LOW)) for h in halves] + [F.shiftrightunsigned(h, 32) for h in halves]
    strong = [F.col(f"{prefix}_s{i}") % MODULUS for i in range(STRONG)]
    return F.array(*lanes, *strong, F.col(f"{prefix}_n") % MODULUS)


def add(left: Column, right: Column) -> Column:
    """The fingerprint vector of both multisets together."""
    return F.zip_with(left, right, lambda x, y: (x + y) % MODULUS)


def subtract(left: Column, right: Column) -> Column:
    """The fingerprint vector after the right multiset is taken out of the left."""
    return F.zip_with(left, right, lambda x, y: (x - y + MODULUS) % MODULUS)


def as_text(vector: Column) -> Column:
    return F.array_join(F.transform(vector, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(left: Column, right: Column) -> Column:
    """1 for equal vectors, else the cosine of the signed counts, no lower than 0."""

    def signed(v: Column) -> Column:
        return F.transform(F.slice(v, 1, SIGNS), lambda x: (2 * x - v[SIGNS + STRONG]).cast("double"))

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)

    a, b = signed(left), signed(right)
    product = total(F.zip_with(a, b, lambda x, y: x * y))
    size = F.sqrt(total(F.transform(a, lambda x: x * x)) * total(F.transform(b, lambda x: x * x)))
    cosine = F.when(size > 0, F.least(F.greatest(product / size, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return F.when(left == right, 1.0).otherwise(cosine)


def _position(bounds: list[int], value: Column) -> Column:
    """How many of the sorted ``bounds`` lie below ``value``, by two short searches."""
    width = max(1, math.isqrt(len(bounds)))
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    heads = F.array(*(F.lit(g[-1]) for g in groups[:-1])) if len(groups) > 1 else F.array().cast("array<bigint>")
    group = F.size(F.filter(heads, lambda b: b < value))
    inner = F.array(*(F.array(*(F.lit(b) for b in g)) for g in groups))
    return group * width + F.size(F.filter(F.get(inner, group), lambda b: b < value))


def edited_with_next(docs: DataFrame, slice_rows: int = 2000, most_slices: int = 32_768) -> DataFrame:
    """Per row: its fingerprint, that of its edited text, and their likeness to each other and to the next row's.

    ``docs`` has doc_id and text. In the edited text the last half of the code points is replaced by the
    first as many of the next document by descending id; after the last comes the first. Returns
    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. A null
    text is empty; an empty multiset is like only itself. Rows of equal id follow each other in the order
    of their text, rows without an id come last, other columns are not read, an empty table gives no rows.

    The table is cut into slices at quantiles of the id; a quantile is an id of the table, so no slice is
    empty and its first row is also handed to the slice above, as the one that comes after its last.
    """
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"))
    rows = docs.count()
    count = min(most_slices, max(1, -(-rows // slice_rows)))
    found = docs.agg(
        F.percentile_approx("doc_id", [i / count for i in range(1, count + 1)], max(10_000, 10 * count)).alias("at")
    ).first()["at"]
    bounds = sorted(set(found or [])) or [0]
    own = F.when(F.col("doc_id").isNull(), 0).otherwise(F.least(_position(bounds, F.col("doc_id")), F.lit(len(bounds) - 1)))
    placed = docs.withColumn("own", own.cast("int"))
    edge = F.get(F.array(*(F.lit(b) for b in bounds)), F.col("own")) == F.col("doc_id")
    places = F.array(
        F.struct(F.col("own").alias("slice"), F.lit(0).alias("guest")),
        F.struct(((F.col("own") + 1) % len(bounds)).cast("int").alias("slice"), F.lit(1).alias("guest")),
    )
    dealt = placed.withColumn("places", F.when(edge, places).otherwise(F.slice(places, 1, 1))).select(
        F.explode("places").alias("at"), "doc_id", "text"
    )
    dealt = dealt.select("at.slice", "at.guest", "doc_id", "text")
    along = Window.partitionBy("slice").orderBy("guest", F.desc_nulls_last("doc_id"), "text")
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(
        F.substr("text", F.lit(1), F.char_length("text") - half),
        F.when(half > 0, F.substr(F.coalesce(F.col("after"), F.lit("")), F.lit(1), half)).otherwise(""),
    )
    pairs = (
        dealt.withColumns({"after": F.lead("text").over(along), "place": F.row_number().over(along)})
        .withColumn("edited", edited)
        .select(
            "slice",
            "place",
            "guest",
            "doc_id",
            F.char_length("text").cast("long").alias("n_chars"),
            F.sha2("edited", 256).alias("edited_sha256"),
            F.concat(
                F.transform(_digests(F.col("text")), lambda d: F.struct(F.lit(0).alias("kind"), d.alias("d"))),
                F.transform(_digests(F.col("edited")), lambda d: F.struct(F.lit(1).alias("kind"), d.alias("d"))),
            ).alias("all"),
        )
    )
    keys = ["slice", "place", "guest", "doc_id", "n_chars", "edited_sha256"]
    each = pairs.select(*keys, F.explode_outer("all").alias("p")).select(*keys, "p.kind", "p.d")
    sums = each.groupBy(*keys).agg(*_sums("t", "d", F.col("kind") == 0), *_sums("e", "d", F.col("kind") == 1))
    vectors = sums.select(*keys, _vector("t").alias("t"), _vector("e").alias("e"))
    following = Window.partitionBy("slice").orderBy("place")
    # A guest is there to be the next of the row before it; its own row stands in its own slice.
    return (
        vectors.withColumn("next", F.lead("t").over(following))
        .where("guest = 0")
        .select(
            "doc_id",
            "n_chars",
            "edited_sha256",
            as_text(F.col("t")).alias("fingerprint"),
            as_text(F.col("e")).alias("edited_fingerprint"),
            likeness(F.col("t"), F.col("e")).alias("near_edited"),
            likeness(F.col("t"), F.coalesce("next", "t")).alias("near_next"),
        )
    )
