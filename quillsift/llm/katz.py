"""Katz back-off bigram model: Good-Turing discounts, exactly normalised back-off weights.

A token is a word or the end of a document; its context is the token before, or the start. A seen bigram
has its discounted relative frequency, ``d(c) c(hw) / c(h)``; any other goes back to the unigram with the
context's weight, which is the mass left by the seen bigrams over the unigram mass of the unseen ones, so
every context sums to one over the vocabulary and the unknown word. Unigrams are discounted likewise and
leave their rest to the unknown word.

Documents are dealt to slices. A slice sends its distinct words with their training counts to ranges of
the word digest, which add up the counts of the corpus and send them back; then its distinct bigrams, with
the unigram count of the second word, to ranges of the context digest. A range holds all bigrams of its
contexts: it is a partition of the model's table, adds up counts, finds the back-off weights and answers.
A context with more than a range's tokens is split by its second words over several ranges; what its weight
needs are plain sums, which travel with the statistics. At most ``hot`` contexts are split.
A message is a sorted array, so what moves is a few bytes per distinct bigram of a slice, and a very
frequent word is one entry per slice. Digests are 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.llm.common import PACKED, differences, from_differences, pack_slices, slices, unpack_slices
from quillsift.llm.shingles import mixed, words

START, END = np.uint64(0x5354415254), np.uint64(0x454E44)

#: Counts up to this are discounted.
MOST_DISCOUNTED = 5

MESSAGE = "slice int, range long, kind int, a binary, b binary, c binary, d binary"
WORDS, BIGRAMS, UNIGRAM_STATS, BIGRAM_STATS = 0, 1, 2, 3
_COLUMNS = ("slice", "range", "kind", "a", "b", "c", "d")


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers by byte position, compressed: bytes that are zero in all of them take no room."""
    raw = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()
    return np.int64(len(raw)).tobytes() + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def _from_planes(coded: bytes) -> np.ndarray:
    size = int(np.frombuffer(coded[:8], "<i8")[0])
    raw = pa.decompress(coded[8:], decompressed_size=size, codec="zstd", asbytes=True) if size else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _with_counts(names: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted digests, and a number for each."""
    planes = _planes(counts)
    return np.int64(len(planes)).tobytes() + planes + differences(names)


def _from_with_counts(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    end = 8 + int(np.frombuffer(raw[:8], "<i8")[0])
    return from_differences(raw[end:]), _from_planes(raw[8:end]).astype(np.int64)


def _messages(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4)
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.table({n: pa.array(list(c), t) for n, c, t in zip(_COLUMNS, columns, kinds)})


def _range_of(digest: np.ndarray, ranges: int) -> np.ndarray:
    return ((digest >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where runs of equal values start, and the end."""
    if not len(sorted_values):
        return np.zeros(1, dtype=np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, [len(sorted_values)]])


def discounts(counts_of_counts: np.ndarray) -> np.ndarray:
    """d(0..k): Good-Turing factors from the numbers of types seen 1..k+1 times; 1 where they are not sound."""
    n = np.concatenate([[0.0], np.asarray(counts_of_counts, dtype=float)])
    k = len(n) - 2
    out = np.ones(k + 1)
    common = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    if common < 1:
        for r in range(1, k + 1):
            if n[r]:
                d = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
                out[r] = d if 0 < d <= 1 else 1.0
    return out


def _discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return counts * d[np.where(counts < len(d), counts, 0).astype(np.int64)]


class Unigrams:
    """Unigram probabilities by training count, from the sums (tokens, types, types seen 1..k+1 times)."""

    def __init__(self, stats: np.ndarray):
        self.tokens, self.types = int(stats[0]), int(stats[1])
        self.d = discounts(stats[2:])
        r = np.arange(1, len(self.d))
        seen = self.tokens - float((r * stats[2:-1] * (1 - self.d[1:])).sum())
        # What the discounts leave is the unknown word's; it has the weight of one token at least.
        unknown = max(self.tokens - seen, 1.0)
        self.total, self.unknown = seen + unknown, unknown / (seen + unknown)

    def probability(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, _discounted(counts, self.d) / self.total, self.unknown)


def contexts(
    starts: np.ndarray, counts: np.ndarray, lower: np.ndarray, d: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Denominator and back-off weight of each context.

    ``starts`` cuts the bigrams into contexts, ``counts`` are their training counts (0: not seen) and
    ``lower`` the unigram probabilities of their second words. A context that was never seen has weight 1
    and denominator 0; one whose discounts leave nothing counts one token more.
    """
    total = np.add.reduceat(counts, starts).astype(float)
    mass = np.add.reduceat(_discounted(counts, d), starts)
    covered = np.add.reduceat(np.where(counts > 0, lower, 0.0), starts)
    return weights(total, mass, covered)


def weights(total: np.ndarray, mass: np.ndarray, covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Denominator and back-off weight from the sums of contexts: counts, discounted counts, covered unigram mass."""
    denominator = np.where((total > 0) & (total - mass < 1e-9), total + 1, total)
    rest = np.divide(denominator - mass, denominator, out=np.ones_like(total), where=total > 0)
    return denominator, rest / np.maximum(1 - covered, 1e-300)


def hot_sums(starts: np.ndarray, counts: np.ndarray, unigram: np.ndarray) -> np.ndarray:
    """Per context the sums from which ``hot_weights`` follows: they add up over the parts of a context.

    All counts; bigrams seen 1..k times; those whose second word was seen 1..k times; counts of the other words.
    """
    seen, r = counts > 0, np.arange(1, MOST_DISCOUNTED + 1)[:, None]
    rows = [counts, *(counts == r), *(seen & (unigram == r)), np.where(seen & (unigram > MOST_DISCOUNTED), unigram, 0)]
    return np.stack([np.add.reduceat(x.astype(float), starts) for x in rows], axis=1)


def hot_weights(sums: np.ndarray, d: np.ndarray, unigrams: Unigrams) -> tuple[np.ndarray, np.ndarray]:
    r, k = np.arange(1, MOST_DISCOUNTED + 1), MOST_DISCOUNTED
    mass = sums[:, 0] - sums[:, 1 : k + 1] @ (r * (1 - d[1:]))
    covered = (sums[:, k + 1 : 2 * k + 1] @ (r * unigrams.d[1:]) + sums[:, -1]) / unigrams.total
    return weights(sums[:, 0], mass, covered)


class Slice:
    """Tokens of the documents of a slice as numbers of its distinct words."""

    def __init__(self, table: pa.Table):
        table = unpack_slices(table)
        self.ids = table.column("doc_id").to_pylist()
        self.held_out = np.array(table.column("held_out").to_pylist(), dtype=bool)
        texts = table.column("text").to_pylist()
        digests, sizes = [], []
        for at, to in slices(map(len, texts), 500_000):
            part, ends = words(texts[at:to])
            digests.append(part)
            sizes.append(np.diff(np.concatenate([[0], ends])))
        word, self.sizes = np.concatenate(digests), np.concatenate(sizes) + 1
        del table, texts, digests
        ends = np.cumsum(self.sizes) - 1
        tokens = np.empty(len(word) + len(self.ids), dtype=np.uint64)
        inner = np.ones(len(tokens), dtype=bool)
        inner[ends] = False
        tokens[inner], tokens[ends] = word, END
        self.vocabulary, number = np.unique(np.append(tokens, START), return_inverse=True)
        self.token, start = number[:-1], number[-1]
        self.start, self.end = start, number[ends[0]]
        self.context = np.concatenate([[start], self.token[:-1]])
        self.context[ends[:-1] + 1] = start
        self.learnt = np.repeat(~self.held_out, self.sizes)

    def counts(self) -> np.ndarray:
        return np.bincount(self.token[self.learnt], minlength=len(self.vocabulary))

    def bigrams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct bigrams as context * size + word, which of them each token is, and their training counts."""
        code = self.context * len(self.vocabulary) + self.token
        distinct, which = np.unique(code, return_inverse=True)
        return distinct, which, np.bincount(which[self.learnt], minlength=len(distinct))

    def places(
        self, context: np.ndarray, word: np.ndarray, corpus: np.ndarray, limit: int, ranges: int
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An order of the bigrams by range, and in that order the ranges and whether a context is split.

        The counts of the corpus say which contexts are split, so every slice decides alike.
        """
        times = corpus.copy()
        times[self.start] = corpus[self.end]  # as many starts as ends
        parts = -(-times // limit)[context]
        digest = self.vocabulary[context]
        part = mixed(self.vocabulary[word], 7) % np.maximum(parts, 1).astype(np.uint64)
        number = _range_of(np.where(parts > 1, mixed(digest + part, 8), digest), ranges)
        order = np.argsort(number, kind="stable")
        return order, number[order], parts[order] > 1


def _word_messages(ranges: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        own = Slice(table)
        counts, number = own.counts(), _range_of(own.vocabulary, ranges)
        cuts = _runs(number)
        return _messages(
            [
                (key[0].as_py(), int(number[a]), WORDS, _with_counts(own.vocabulary[a:b], counts[a:b]), b"", b"", b"")
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())
                if b > a
            ]
        )

    return run


def _add_up(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    """The counts over the corpus of the distinct words of a range, and of the words of each message."""
    parts = [_from_with_counts(x) for x in table.column("a").to_pylist()]
    distinct, which = np.unique(np.concatenate([w for w, _ in parts]), return_inverse=True)
    counts = np.zeros(len(distinct), dtype=np.int64)
    np.add.at(counts, which, np.concatenate([c for _, c in parts]))
    return counts, np.split(counts[which], np.cumsum([len(w) for w, _ in parts])[:-1])


def _stats(counts: np.ndarray) -> bytes:
    of_counts = np.bincount(counts[counts <= MOST_DISCOUNTED + 1], minlength=MOST_DISCOUNTED + 2)[1:]
    return np.concatenate([[counts.sum(), (counts > 0).sum()], of_counts]).astype("<f8").tobytes()


def _word_stats(key: tuple, table: pa.Table) -> pa.Table:
    return _messages([(0, key[0].as_py(), UNIGRAM_STATS, _stats(_add_up(table)[0]), b"", b"", b"")])


def _word_counts(key: tuple, table: pa.Table) -> pa.Table:
    _, back = _add_up(table)
    return _messages(
        [(s, key[0].as_py(), WORDS, _planes(c), b"", b"", b"") for s, c in zip(table.column("slice").to_pylist(), back)]
    )


def _answers(replies: pa.Table, kind: int) -> list[dict]:
    """Answers of a kind in the order of their ranges, which is the order of the slice's own arrays."""
    rows = replies.filter(pc.equal(replies.column("kind"), kind)).to_pylist()
    return sorted(rows, key=lambda r: r["range"])


def _read_stats(replies: pa.Table, kind: int) -> np.ndarray:
    return np.frombuffer(_answers(replies, kind)[0]["a"], "<f8")


def _read_sums(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Split contexts and their sums."""
    return np.frombuffer(row["b"], np.uint64), np.frombuffer(row["c"], "<f8").reshape(-1, 2 * MOST_DISCOUNTED + 2)


def _corpus_counts(replies: pa.Table) -> np.ndarray:
    return np.concatenate([_from_planes(r["a"]) for r in _answers(replies, WORDS)]).astype(np.int64)


def _limit(unigrams: Unigrams, range_tokens: int, hot: int) -> int:
    """The most tokens of a context that stay together."""
    return max(range_tokens, unigrams.tokens // hot)


def _bigram_messages(ranges: int, range_tokens: int, hot: int):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _messages([])
        own = Slice(left)
        corpus = _corpus_counts(right)
        distinct, _, counts = own.bigrams()
        context, word = np.divmod(distinct, len(own.vocabulary))
        limit = _limit(Unigrams(_read_stats(right, UNIGRAM_STATS)), range_tokens, hot)
        order, number, split = own.places(context, word, corpus, limit, ranges)
        context, word, counts = context[order], word[order], counts[order]
        digest = own.vocabulary[context]
        cuts = _runs(number)
        rows = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            starts = _runs(context[a:b])
            rows.append(
                (
                    key[0].as_py(),
                    int(number[a]),
                    BIGRAMS,
                    _with_counts(digest[a:b][starts[:-1]], 2 * np.diff(starts) + split[a:b][starts[:-1]]),
                    own.vocabulary[word[a:b]].tobytes(),
                    _planes(corpus[word[a:b]]),
                    _planes(counts[a:b]),
                )
            )
        return _messages(rows)

    return run


class Range:
    """All bigrams of the contexts of a range (of a split context: its part), in the order of context and word."""

    def __init__(self, table: pa.Table):
        #: Per message: its contexts, and how many of its bigrams each has.
        heads = [_from_with_counts(x) for x in table.column("a").to_pylist()]
        self.heads = [(h, n >> 1) for h, n in heads]
        self.sizes = [int(n.sum()) for _, n in self.heads]
        context = np.concatenate([np.repeat(h, n) for h, n in self.heads])
        word = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("b").to_pylist()])
        order = np.lexsort((word, context))
        c, w = context[order], word[order]
        new = np.concatenate([[True], (c[1:] != c[:-1]) | (w[1:] != w[:-1])])
        first = np.flatnonzero(new)
        self.which = np.empty(len(order), dtype=np.int64)
        self.which[order] = np.cumsum(new) - 1
        trained = np.concatenate([_from_planes(x) for x in table.column("d").to_pylist()]).astype(np.int64)
        self.counts = np.add.reduceat(trained[order], first)
        unigram = np.concatenate([_from_planes(x) for x in table.column("c").to_pylist()]).astype(np.int64)
        self.unigram = unigram[order][first]
        self.starts = _runs(c[first])[:-1]
        self.context = c[first][self.starts]
        #: Which contexts are split.
        self.split = np.isin(self.context, np.concatenate([h[n & 1 == 1] for h, n in heads]))


def _bigram_stats(key: tuple, table: pa.Table) -> pa.Table:
    own = Range(table)
    names, sums = own.context[own.split], hot_sums(own.starts, own.counts, own.unigram)[own.split]
    return _messages([(0, key[0].as_py(), BIGRAM_STATS, _stats(own.counts), names.tobytes(), sums.tobytes(), b"")])


def _bigram_answers(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    if not left.num_rows:
        return _messages([])
    own = Range(left)
    unigrams = Unigrams(_read_stats(right, UNIGRAM_STATS))
    d = discounts(_read_stats(right, BIGRAM_STATS)[2:])
    denominator, weight = contexts(own.starts, own.counts, unigrams.probability(own.unigram), d)
    names, sums = _read_sums(_answers(right, BIGRAM_STATS)[0])
    at = np.searchsorted(names, own.context[own.split])
    denominator[own.split], weight[own.split] = hot_weights(sums[at], d, unigrams)
    counts = np.split(own.counts[own.which], np.cumsum(own.sizes)[:-1])
    rows = []
    for slice_id, c, (heads, lengths) in zip(left.column("slice").to_pylist(), counts, own.heads):
        at = np.searchsorted(own.context, heads)
        backs_off = np.minimum.reduceat(c, np.cumsum(lengths) - lengths) == 0  # else no weight is asked for
        rows.append(
            (slice_id, key[0].as_py(), BIGRAMS, _planes(c), _planes(denominator[at]), weight[at[backs_off]].tobytes(), b"")
        )
    return _messages(rows)


def _scores(ranges: int, range_tokens: int, hot: int):
    return lambda key, left, right: _scored(left, right, ranges, range_tokens, hot)


def _scored(left: pa.Table, right: pa.Table, ranges: int, range_tokens: int, hot: int) -> pa.Table:
    names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
    if not left.num_rows:
        return pa.table({n: pa.array([], t) for n, t in zip(names, kinds)})
    own = Slice(left)
    unigrams = Unigrams(_read_stats(right, UNIGRAM_STATS))
    d = discounts(_read_stats(right, BIGRAM_STATS)[2:])
    corpus = _corpus_counts(right)
    distinct, which, _ = own.bigrams()
    context, word = np.divmod(distinct, len(own.vocabulary))
    order, number, _ = own.places(context, word, corpus, _limit(unigrams, range_tokens, hot), ranges)
    context, word = context[order], word[order]
    answers = _answers(right, BIGRAMS)
    counts = np.concatenate([_from_planes(r["a"]) for r in answers]).astype(np.int64)
    denominator = np.concatenate([_from_planes(r["b"]) for r in answers]).astype(float)
    new = np.concatenate([[True], (context[1:] != context[:-1]) | (number[1:] != number[:-1])])
    head = np.cumsum(new) - 1  # which context of the slice, or part of one
    weight = np.ones(len(denominator))
    weight[np.minimum.reduceat(counts, np.flatnonzero(new)) == 0] = np.concatenate(
        [np.frombuffer(r["c"], "<f8") for r in answers]
    )
    seen = np.divide(_discounted(counts, d), denominator[head], out=np.zeros(len(counts)), where=counts > 0)
    probability = np.empty(len(counts))
    probability[order] = np.where(counts > 0, seen, weight[head] * unigrams.probability(corpus[word]))
    starts = np.cumsum(own.sizes) - own.sizes
    token_counts = corpus[own.token]
    base = np.log10((token_counts + 1) / (unigrams.tokens + unigrams.types + 1))
    columns = (
        own.ids,
        own.held_out,
        own.sizes,
        np.add.reduceat((token_counts > 0).astype(np.int64), starts),
        np.full(len(own.ids), unigrams.tokens),
        np.add.reduceat(base, starts),
        np.add.reduceat(np.log10(probability)[which], starts),
    )
    return pa.table({n: pa.array(c, t) for n, c, t in zip(names, columns, kinds)})


def _total(stats: DataFrame, width: int) -> DataFrame:
    """The sums of statistics over all ranges, and of each split context over its parts, as one message."""

    def run(batches):
        total, names, sums, kind = np.zeros(width), [], [], None
        for batch in batches:
            for row in batch.to_pylist():
                total, kind = total + np.frombuffer(row["a"], "<f8"), row["kind"]
                for found, part in zip((names, sums), _read_sums(row)):
                    found.append(part)
        if kind is not None:
            distinct, which = np.unique(np.concatenate(names), return_inverse=True)
            added = np.zeros((len(distinct), 2 * MOST_DISCOUNTED + 2))
            np.add.at(added, which, np.concatenate(sums))
            yield _messages([(0, 0, kind, total.tobytes(), distinct.tobytes(), added.tobytes(), b"")]).to_batches()[0]

    # Two levels: per task first, then one row per task is left for one task.
    return stats.mapInArrow(run, MESSAGE).repartition(1).mapInArrow(run, MESSAGE)


def _to_each(message: DataFrame, column: str, count: int) -> DataFrame:
    """One message repeated for every slice or range."""
    kind = dict(message.dtypes)[column]
    return message.withColumn(column, F.explode(F.sequence(F.lit(0).cast(kind), F.lit(count - 1).cast(kind)))).select(
        *_COLUMNS
    )


def katz_scores(
    docs: DataFrame,
    held_out: Column,
    slice_bytes: int = 5_000_000,
    range_tokens: int = 500_000,
    hot: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    The model learns from all rows for which ``held_out`` is false and scores every whole text. ``score``
    is its log10 probability, ``base_score`` that of unigrams with one added to every count. A null or
    empty text is its end alone. Repeated rows and null ids are scored, and learnt from, like any other; a
    null ``held_out`` is false; other columns are not read; an empty table gives no rows. Without training
    rows every word is unknown. ``range_tokens`` or one ``hot``-th of all tokens, whichever is more, is what a
    context may have before it is split.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    read = docs.select(
        docs[id_col].cast("long").alias("doc_id"), text.alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out")
    )
    size = read.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0)).alias("n")).first()["n"]
    count = max(1, -(-size // slice_bytes))
    ranges = max(1, size // 6 // range_tokens)  # a word takes some six bytes
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(count)).cast("int")
    texts = read.select(place.alias("slice"), *read.columns).mapInArrow(pack_slices, PACKED).repartition("slice")
    by_slice = texts.groupBy("slice")
    width = MOST_DISCOUNTED + 3
    word_messages = by_slice.applyInArrow(_word_messages(ranges), MESSAGE)
    word_stats = _total(word_messages.groupBy("range").applyInArrow(_word_stats, MESSAGE), width)
    word_counts = word_messages.groupBy("range").applyInArrow(_word_counts, MESSAGE)
    counted = word_counts.union(_to_each(word_stats, "slice", count))
    bigram_messages = by_slice.cogroup(counted.groupBy("slice")).applyInArrow(
        _bigram_messages(ranges, range_tokens, hot), MESSAGE
    )
    bigram_stats = _total(bigram_messages.groupBy("range").applyInArrow(_bigram_stats, MESSAGE), width)
    stats = word_stats.union(bigram_stats)
    answers = bigram_messages.groupBy("range").cogroup(_to_each(stats, "range", ranges).groupBy("range")).applyInArrow(
        _bigram_answers, MESSAGE
    )
    replies = word_counts.union(answers).union(_to_each(stats, "slice", count))
    return by_slice.cogroup(replies.groupBy("slice")).applyInArrow(
        _scores(ranges, range_tokens, hot),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
