"""Language identification by interpolated Kneser-Ney character models, one per language.

A text is its letters in lower case, every stretch of other characters as one space, and ``order - 1`` marks in
front. Counting: a task counts the n-grams of the highest order of all its texts; Spark adds them up, and each
lower order counts the distinct characters seen in front of an n-gram, so it follows from the order above by an
aggregate. With the discount D of an order (n1 / (n1 + 2 n2), from the n-grams seen once and twice),

    p(c | h) = max(n(hc) - D, 0) / n(h) + b(h) p(c | shorter h),      b(h) = 1 - sum of the first terms of h

down to the uniform distribution over the known characters and one for all others. An unknown h passes on to
the shorter one, so every p( . | h) sums to one.

The model is two sorted arrays of 64-bit hashes per order, one of n-grams with their first terms and one of
contexts with b, for all languages together; the language is part of the hash. An order holds ``max_grams``
n-grams at most: where there are more, the least count that is kept rises, for all n-grams alike, and b takes
the rest. So its size has a bound however large the corpus; the counts are of the whole corpus always.

The language with the lowest cross-entropy per character wins. One training document in ten is not counted but
used to calibrate: the steepness of the score over the languages, and per language how far above its own mean
a cross-entropy may lie (in units that allow for the length) before the text is not taken as that language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.llm.common import batch_texts, cut_lineage, slices
from quillsift.llm.shingles import mixed

UNDETERMINED = "und"

#: The mark in front of a text; the character does not count as a letter.
_MARK = "\x01"
# Not the constant that `mixed` adds per language: their multiples would meet.
_R = 0xD6E8FEB86659FD93
_STEEP = np.geomspace(0.5, 256, 19)

#: Characters that one slice of texts has at most, unless a single text has more; n-grams a task holds before it sends them.
SLICE, HELD = 2_000_000, 1_000_000


def symbols(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts with their marks; which of them are characters to predict; the end of each text."""
    lowered = [t.lower().replace(_MARK, " ") for t in texts]
    points = np.frombuffer((_MARK * (order - 1)).join(["", *[t + "\n" for t in lowered]]).encode("utf-32-le", "surrogatepass"), "<u4")
    used = np.flatnonzero(np.bincount(points)) if len(points) else np.empty(0, dtype=np.int64)
    letter = np.zeros(int(used.max(initial=0)) + 1, dtype=bool)
    letter[used] = [chr(c).isalpha() for c in used.tolist()]
    is_letter = letter[points]
    mark = points == ord(_MARK)
    keep = is_letter | mark
    keep[1:] |= is_letter[:-1]  # the first of a stretch of others stays, as a space
    ends = np.cumsum([order - 1 + len(t) + 1 for t in lowered])
    return np.where(is_letter | mark, points, 32)[keep].astype(np.uint32), ~mark[keep], np.concatenate([[0], np.cumsum(keep)])[ends]


#: Cells of a table that numbers keys by looking them up; more are numbered by sorting.
_CELLS = 1 << 23


def _numbered(keys: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """Keys below ``size`` as 0, 1, ... in their order, and how many there are."""
    if size > _CELLS:
        known, numbers = np.unique(keys, return_inverse=True)
        return numbers, len(known)
    seen = np.zeros(size, dtype=bool)
    seen[keys] = True
    numbers = np.cumsum(seen, dtype=np.int64) - 1
    return numbers[keys], int(seen.sum())


def gram_numbers(points: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place the number of the n-gram that ends there, and for each number a place that has it."""
    single, letters = _numbered(points.astype(np.int64), int(points.max(initial=0)) + 1)
    numbers, count = single, letters
    for _ in range(order - 1):
        keys = single.copy()
        keys[1:] += numbers[:-1] * letters
        numbers, count = _numbered(keys, count * letters)
    places = np.zeros(count, dtype=np.int64)
    places[numbers] = np.arange(len(points))
    return numbers, places


def gram_hashes(points: np.ndarray, places: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 0, 1, ..., order: the hash of the n characters that end at each of the places, without the language."""
    out = [np.zeros(len(places), dtype=np.uint64)]
    for n in range(1, order + 1):
        own = points[np.maximum(0, places - n + 1)].astype(np.uint64) + np.uint64(1)
        out.append(out[-1] + own * np.uint64(pow(_R, n, 1 << 64)))
    return out


def _of_language(hashes: np.ndarray, language: int) -> np.ndarray:
    return mixed(hashes, language + 1)


@dataclass
class _Table:
    """Values by hash: a sorted array and its values."""

    hashes: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, hashes: np.ndarray, values: np.ndarray) -> _Table:
        order = np.argsort(hashes)
        return cls(hashes[order], values[order])

    def find(self, hashes: np.ndarray, missing: float) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(hashes), missing)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.values[at], missing)


@dataclass
class LanguageModel:
    languages: list[str]
    order: int
    characters: int
    grams: list[_Table]
    contexts: list[_Table]
    steep: float = 8.0
    mean: np.ndarray | None = None
    limit: np.ndarray | None = None

    def probabilities(self, shorter: list[np.ndarray], longer: list[np.ndarray], language: int) -> np.ndarray:
        """p of n-grams, from the hashes of their contexts by length and of themselves by length."""
        p = np.full(len(longer[0]), 1.0 / (self.characters + 1))
        for n in range(1, self.order + 1):
            first = self.grams[n - 1].find(_of_language(longer[n], language), 0.0)
            rest = self.contexts[n - 1].find(_of_language(shorter[n - 1], language), 1.0)
            p = first + rest * p
        return p

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per text the number of characters, and per language the bits per character."""
        points, real, ends = symbols(texts, self.order)
        numbers, some = gram_numbers(points, self.order)
        longer, shorter = (gram_hashes(points, at, self.order) for at in (some, some - 1))
        logs = [-np.log2(self.probabilities(shorter, longer, i)) for i in range(len(self.languages))]
        starts = np.concatenate([[0], ends[:-1]])
        cuts = np.concatenate([[0], np.cumsum(real)])
        n = cuts[ends] - cuts[starts]
        # Every text has its marks, so no stretch is empty; marks count nothing.
        each = np.where(real[:, None], np.column_stack(logs)[numbers], 0.0)
        bits = np.add.reduceat(each, starts, axis=0) if len(texts) else np.empty((0, len(logs)))
        return n, bits / np.maximum(1, n)[:, None]

    def shares(self, bits: np.ndarray, steep: float | None = None) -> np.ndarray:
        """Scores over the languages that add up to one."""
        power = -(self.steep if steep is None else steep) * (bits - bits.min(axis=1, keepdims=True))
        share = np.exp(power)
        return share / share.sum(axis=1, keepdims=True)


def _own(docs: DataFrame, *more: Column) -> DataFrame:
    """Id and text under fixed names; other columns cannot clash."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), *more)


def count_top(train: DataFrame, order: int) -> DataFrame:
    """(lang, gram, n): all n-grams of the highest order in ``train`` (text, lang), added up within tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0
        for batch in batches:
            texts, names = batch_texts(batch.column(0)), batch.column(1).to_pylist()
            for at, to in slices(map(len, texts), SLICE):
                _count(texts[at:to], names[at:to], order, held)
            size = sum(len(counts[0]) for counts in held.values())
            if size > HELD:
                yield from _sent(held, order)
                held, size = {}, 0
        yield from _sent(held, order)

    counted = train.select("text", "lang").mapInArrow(run, "lang string, gram string, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _count(texts: list[str], names: list[str], order: int, held: dict[str, list]) -> None:
    """Add the n-grams of some texts to what is held: per language sorted hashes, counts and the characters."""
    points, real, ends = symbols(texts, order)
    numbers, some = gram_numbers(points, order)
    known = {name: i for i, name in enumerate(dict.fromkeys(names))}
    owner = np.repeat([known[name] for name in names], np.diff(np.concatenate([[0], ends])))
    tally = np.bincount((owner * len(some) + numbers)[real], minlength=len(known) * len(some)).reshape(len(known), -1)
    hashes = gram_hashes(points, some, order)[-1]
    for name, i in known.items():
        own = np.flatnonzero(tally[i])
        own = own[np.argsort(hashes[own])]
        values, counts, at = hashes[own], tally[i][own], some[own]
        spelt = np.column_stack([points[at - j] for j in range(order - 1, -1, -1)]) if len(at) else np.empty((0, order), np.uint32)
        if name in held:
            old_values, old_counts, old_spelt = held[name]
            values, some_of, where = np.unique(np.concatenate([old_values, values]), return_index=True, return_inverse=True)
            counts = np.bincount(where, weights=np.concatenate([old_counts, counts])).astype(np.int64)
            spelt = np.concatenate([old_spelt, spelt])[some_of]
        held[name] = [values, counts, spelt]


def _sent(held: dict[str, list], order: int) -> Iterator[pa.RecordBatch]:
    for name, (values, counts, spelt) in held.items():
        raw = spelt.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        grams = [raw[i : i + order] for i in range(0, len(raw), order)]
        for at in range(0, len(grams), 100_000):
            part = grams[at : at + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(part), pa.string()), pa.array(part, pa.string()), pa.array(counts[at : at + 100_000])],
                names=["lang", "gram", "n"],
            )


def gram_table(train: DataFrame, order: int) -> DataFrame:
    """(size, lang, gram, n): counts of the highest order, and of distinct characters in front below it."""
    step = cut_lineage(count_top(train, order).select(F.lit(order).alias("size"), "lang", "gram", "n"))
    tables = [step]
    for n in range(order - 1, 0, -1):
        step = step.groupBy("lang", F.substring("gram", 2, n).alias("gram")).agg(F.count("*").alias("n"))
        step = step.select(F.lit(n).alias("size"), "lang", "gram", "n")
        tables.append(step)
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return cut_lineage(out)


def _least_counts(table: DataFrame, max_grams: int) -> dict[int, int]:
    """Per order the least count with at most ``max_grams`` n-grams of that count or more; distinct counts are few."""
    least: dict[int, int] = {}
    sums: dict[int, int] = {}
    for row in table.groupBy("size", "n").agg(F.count("*").alias("k")).orderBy("size", F.desc("n")).toLocalIterator():
        sums[row["size"]] = sums.get(row["size"], 0) + row["k"]
        if sums[row["size"]] <= max_grams:
            least[row["size"]] = row["n"]
        else:
            least.setdefault(row["size"], row["n"] + 1)
    return least


def fit_counts(train: DataFrame, order: int = 4, max_grams: int = 1 << 19) -> LanguageModel:
    """The models of all languages in ``train`` (text, lang), both not null."""
    table = gram_table(train, order)
    languages = sorted(r["lang"] for r in train.select("lang").distinct().collect())
    least = _least_counts(table, max_grams)
    once, twice = F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
    share = F.coalesce(F.try_divide(once, once + 2 * twice), F.lit(0.5))
    discount = table.groupBy("size", "lang").agg(F.when((share > 0) & (share < 1), share).otherwise(0.5).alias("discount"))
    parted = table.withColumn("before", F.expr("substring(gram, 1, size - 1)"))
    totals = parted.groupBy("size", "lang", "before").agg(F.sum("n").alias("total"))
    enough = F.coalesce(*[F.when(F.col("size") == size, F.col("n") >= n) for size, n in least.items()], F.lit(False))
    first = F.greatest(F.col("n") - F.col("discount"), F.lit(0.0)) / F.col("total")
    kept = parted.where(enough).join(totals, ["size", "lang", "before"]).join(discount, ["size", "lang"])
    rows = kept.select("size", "lang", "gram", first.alias("first")).toArrow()  # at most order * max_grams rows
    known = {name: i for i, name in enumerate(languages)}
    size = rows.column("size").to_numpy()
    language = np.array([known[name] for name in rows.column("lang").to_pylist()], dtype=np.int64)
    values = rows.column("first").to_numpy()
    spelt = rows.column("gram").to_pylist()
    grams, contexts = [], []
    characters = table.where("size = 1").select("gram").distinct().count()
    for n in range(1, order + 1):
        at = np.flatnonzero(size == n)
        points = np.frombuffer("".join(spelt[i] for i in at.tolist()).encode("utf-32-le", "surrogatepass"), "<u4")
        last = np.arange(n - 1, len(points), n)
        hashes = gram_hashes(points, last, n)
        own, before = hashes[n].copy(), gram_hashes(points, last - 1, n - 1)[-1]
        for i in range(len(languages)):
            mine = language[at] == i
            own[mine], before[mine] = _of_language(own[mine], i), _of_language(before[mine], i)
        grams.append(_Table.of(own, values[at]))
        heads, where = np.unique(before, return_inverse=True)
        contexts.append(_Table(heads, 1.0 - np.bincount(where, weights=values[at], minlength=len(heads))))
    return LanguageModel(languages, order, characters, grams, contexts)


def _calibrate(model: LanguageModel, docs: DataFrame, wrong: float) -> None:
    """Set the steepness with the best mean log score, and per language mean and limit of the cross-entropy."""
    known = {name: i for i, name in enumerate(model.languages)}
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts, names = batch_texts(batch.column(0)), batch.column(1).to_pylist()
            for at, to in slices(map(len, texts), SLICE):
                n, bits = own.entropies(texts[at:to])
                language = np.array([known.get(name, -1) for name in names[at:to]])
                use = (n > 0) & (language >= 0)
                n, bits, language = n[use], bits[use], language[use]
                mine = np.arange(len(n))
                logs = [np.log(np.maximum(own.shares(bits, s)[mine, language], 1e-300)) for s in _STEEP]
                lists = pa.array(list(np.column_stack(logs)), pa.list_(pa.float64())) if len(n) else pa.array([], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(language.astype(np.int32)), pa.array(n.astype(np.int64)), pa.array(bits[mine, language]), lists],
                    names=["language", "n", "bits", "logs"],
                )

    seen = cut_lineage(docs.select("text", "lang").mapInArrow(run, "language int, n long, bits double, logs array<double>"))
    summed = seen.agg(*[F.sum(F.col("logs")[i]) for i in range(len(_STEEP))]).head()
    if summed[0] is not None:
        model.steep = float(_STEEP[int(np.argmax(summed))])
    model.mean, model.limit = np.zeros(len(known)), np.full(len(known), np.inf)
    for row in seen.groupBy("language").agg(F.sum(F.col("bits") * F.col("n")), F.sum("n")).collect():  # a row per language
        model.mean[row[0]] = row[1] / row[2]
    # The means are values of the expression, so that no row moves before the tasks have their sketches.
    own_mean = F.array(*map(F.lit, model.mean.tolist()))[F.col("language")]
    above = (F.col("bits") - own_mean) * F.sqrt("n")
    for row in seen.groupBy("language").agg(F.percentile_approx(above, 1.0 - wrong, 10_000)).collect():
        model.limit[row[0]] = row[1]


def fit_languages(
    docs: DataFrame, order: int = 4, max_grams: int = 1 << 19, calibrate: int = 10, wrong: float = 0.005
) -> LanguageModel:
    """A model of every language in ``docs`` (doc_id, text, lang); rows without text or lang are not learnt from.

    One document in ``calibrate`` by a digest of its id is not counted but calibrates; ``wrong`` is the share of
    a language's own texts that its limit turns away. Without rows the model has no language.
    """
    rows = _own(docs, docs["lang"].cast("string").alias("lang")).where("text is not null and lang is not null")
    aside = F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(calibrate)) == 0
    model = fit_counts(rows.where(~aside), order, max_grams)
    if model.languages:
        _calibrate(model, rows.where(aside), wrong)
    return model


def identify(docs: DataFrame, model: LanguageModel, reject: bool = True) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): ``doc_id, lang_pred, score, bits, accepted``.

    ``bits`` is the cross-entropy per character under the language that wins (ties: the first by name), ``score``
    its share from 0 to 1, ``accepted`` whether the text is as likely as texts of that language are. With
    ``reject`` a text that is not accepted is ``und``. Null and empty texts, texts without a letter, and all texts
    if the model has no language are ``und`` with score 0, null ``bits`` and not accepted. Whole texts are read;
    repeated rows and null ids give a row each; an empty table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        names = np.array([*own.languages, UNDETERMINED], dtype=object)
        for batch in batches:
            texts = batch_texts(batch.column(1))
            for at, to in slices(map(len, texts), SLICE):
                best, score, bits, accepted = _judged(own, texts[at:to])
                if reject:
                    best = np.where(accepted, best, len(own.languages))
                columns = [
                    batch.column(0).slice(at, to - at),
                    pa.array(names[best], pa.string()),
                    pa.array(score),
                    pa.array(bits, mask=np.isnan(bits)),
                    pa.array(accepted),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", "bits", "accepted"])

    return _own(docs).mapInArrow(run, "doc_id long, lang_pred string, score double, bits double, accepted boolean")


def _judged(model: LanguageModel, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    count = len(texts)
    if not model.languages:
        return np.zeros(count, dtype=np.int64), np.zeros(count), np.full(count, np.nan), np.zeros(count, dtype=bool)
    n, bits = model.entropies(texts)
    known = n > 0  # a text has characters to predict only if it has a letter
    best = bits.argmin(axis=1)
    mine = np.arange(count)
    lowest = bits[mine, best]
    accepted = known.copy()
    if model.limit is not None:
        accepted &= (lowest - model.mean[best]) * np.sqrt(n) <= model.limit[best]
    score = np.where(known, model.shares(bits)[mine, best], 0.0)
    return np.where(known, best, len(model.languages)), score, np.where(known, lowest, np.nan), accepted
