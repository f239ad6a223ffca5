"""Periodic runs in word sequences, by a sparse dynamic program over the diagonals of equal words.

Two equal words q apart lie on the diagonal q. Going through a text, an occurrence lengthens the match on the
diagonal of each earlier occurrence of the same word; a diagonal that is not lengthened ends, and if its match is
long enough it is emitted as a run with period q. Only a few of all diagonals can end so. A run of three periods
is looked for by word groups of k words, k the power of two from q up: the first word of a period cannot come
back earlier inside a run, so on such a group only its *latest* earlier occurrence counts, and at most one diagonal
is active at a word. The groups are named by doubling from the names of their halves; a group that occurs once
in its text leaves the program for good. Work and memory grow with the words times the levels reached, also for
a text of one word repeated; an ordinary text ends after a few levels.

A batch of texts is one sequence; a group belongs to its text, so no match crosses texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quillsift.llm.common import batch_texts, own_columns, slices

#: Given an id and a number of words: which word of the text stands at each place, or None for the text as it is.
Order = Callable[[int | None, int], np.ndarray | None]

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RESULT = """doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>,
strongest struct<start: long, length: long, period: long>, collapsed string"""


def split_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Codes of all words, the end of each text among them, and the word of each code."""
    lists = pc.ascii_split_whitespace(pa.array(texts, type=pa.large_string()))
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    real = np.asarray(pc.binary_length(coded.dictionary), dtype=np.int64)[codes] > 0  # white space at an end gives an empty word
    ends = np.concatenate([[0], np.cumsum(real)])[lists.offsets.to_numpy()[1:]]
    return codes[real], ends, coded.dictionary


def _latest(names: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by name and place: the places, the distance to the latest earlier one (0: none), and whether a name repeats."""
    again = names[1:] == names[:-1]
    lag = np.zeros(len(names), dtype=np.int64)
    lag[1:][again] = (places[1:] - places[:-1])[again]
    repeats = np.zeros(len(names), dtype=bool)
    repeats[1:] |= again
    repeats[:-1] |= again
    return places, lag, repeats


def _ended(places: np.ndarray, lag: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonals of groups of ``k`` words, for the distances that belong to k: first place, distance, and matching words."""
    own = (lag > k // 2) & (lag <= k)
    order = np.argsort(places[own], kind="stable")
    at, d = places[own][order], lag[own][order]
    if not len(at):
        return at, d, at
    breaks = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(d) != 0)])
    first = np.flatnonzero(breaks)
    steps = np.diff(np.concatenate([first, [len(at)]]))
    return at[first], d[first], steps + k - 1


def find_runs(codes: np.ndarray, ends: np.ndarray, min_length: int = 24, min_periods: int = 3) -> np.ndarray:
    """Rows of (text, start, length, period) by text, start and period; starts count words from 0 in the text.

    A run is a stretch of words with smallest period q, at least ``min_length`` words and ``min_periods`` (3 or
    more) periods long, that cannot be extended on either side.
    """
    if min_periods < 3:
        raise ValueError("the search by the latest occurrence needs three periods")
    total = len(codes)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    text = np.repeat(np.arange(len(ends)), ends - starts)
    longest = int((ends - starts).max(initial=0))
    places = np.arange(total)
    keys = text * (int(codes.max(initial=0)) + 1) + codes
    found = []
    k = 1
    while len(places):
        order = np.argsort(keys, kind="stable")
        keys, places = keys[order], places[order]
        places, lag, repeats = _latest(keys, places)
        at, d, match = _ended(places, lag, k)
        enough = (match + d >= min_length) & (match + d >= min_periods * d)
        found.append(np.column_stack([at - d, match + d, d])[enough])
        if k * min_periods >= longest:  # longer periods do not fit
            break
        name = np.full(total + k, -1, dtype=np.int64)
        name[places[repeats]] = (np.cumsum(np.concatenate([[True], keys[1:] != keys[:-1]])) - 1)[repeats]
        places = np.sort(places[repeats])
        places = places[(places + 2 * k <= ends[text[places]]) & (name[places + k] >= 0)]
        keys = name[places] * total + name[places + k]
        k *= 2
    runs = np.concatenate(found) if found else np.empty((0, 3), dtype=np.int64)
    owner = text[runs[:, 0]] if len(runs) else np.empty(0, dtype=np.int64)
    runs = np.column_stack([owner, runs[:, 0] - starts[owner], runs[:, 1], runs[:, 2]]) if len(runs) else np.empty((0, 4), dtype=np.int64)
    return runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]


def _strongest(runs: np.ndarray) -> dict[str, int]:
    best = max(runs.tolist(), key=lambda r: (Fraction(r[2], r[3]), -r[1], -r[3]))
    return {"start": best[1], "length": best[2], "period": best[3]}


def _batch(ids: pa.Array, texts: list[str], order: Order | None, min_length: int, min_periods: int) -> pa.RecordBatch:
    codes, ends, spelt = split_words(texts)
    sizes = np.diff(np.concatenate([[0], ends]))
    if order is not None:
        for i, (doc_id, n) in enumerate(zip(ids.to_pylist(), sizes.tolist())):
            taken = order(doc_id, n) if n else None
            if taken is not None:
                own = slice(int(ends[i]) - n, int(ends[i]))
                codes[own] = codes[own][taken]
    runs = find_runs(codes, ends, min_length, min_periods)
    # +1 where the words after the first period of a run begin, -1 behind the run
    base = (ends - sizes)[runs[:, 0]]
    edge = np.zeros(len(codes) + 1, dtype=np.int64)
    np.add.at(edge, base + runs[:, 1] + runs[:, 3], 1)
    np.add.at(edge, base + runs[:, 1] + runs[:, 2], -1)
    kept = np.cumsum(edge[:-1]) == 0
    left = np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], ends])]
    lists = pa.LargeListArray.from_arrays(pa.array(left), spelt.take(pa.array(codes[kept])))
    cuts = np.searchsorted(runs[:, 0], np.arange(len(ends) + 1))
    parts = pa.StructArray.from_arrays([pa.array(runs[:, c]) for c in (1, 2, 3)], fields=list(_RUN))
    best = [_strongest(runs[a:b]) if b > a else None for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
    return pa.RecordBatch.from_arrays(
        [
            ids,
            pa.array(sizes),
            pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), parts),
            pa.array(best, _RUN),
            pc.binary_join(lists, pa.scalar(" ", spelt.type)).cast(pa.string()),
        ],
        names=["doc_id", "n_words", "runs", "strongest", "collapsed"],
    )


def periodic_runs(
    docs: DataFrame,
    min_length: int = 24,
    min_periods: int = 3,
    order: Order | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, runs, strongest, collapsed``.

    ``runs`` has all runs by start and period; ``strongest`` is the one with most periods (ties: the first, then
    the shortest period), null without runs; ``collapsed`` is the text with one period of each run, words joined
    by one space. ``order`` may rearrange the words of a text first. Words are cut at ASCII white space, and
    equal if their bytes are. A null text is empty: no words, no runs, an empty ``collapsed``. Rows are judged
    one by one, so repeated rows and null ids give a row each; an empty table gives no rows; other columns are
    ignored. A text is held by one task as a whole, whatever its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch_texts(batch.column(1))
            for at, to in slices(map(len, texts), 1_000_000):
                yield _batch(batch.column(0).slice(at, to - at), texts[at:to], order, min_length, min_periods)

    return own_columns(docs, id_col, text_col).mapInArrow(run, RESULT)
