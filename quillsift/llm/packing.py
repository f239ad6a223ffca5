"""Packing documents into sequences of equal length by multiway differencing (Karmarkar-Karp).

Documents become token ids with an end id. Whole windows of a document fill sequences of their own; the
rest of each document is cut into parts of at most ``part`` ids. The parts of a bounded group are dealt to
``k`` sequences by differencing: the two partial partitions with the largest spread are merged with their
loads opposed, largest onto smallest, until one is left. Where a sequence would exceed its capacity, ``k``
rises by one. Groups are filled in scan order within a task, so nothing is shuffled, no task holds more
than one group, and a task that runs again packs its rows the same way.
"""

from __future__ import annotations

import base64
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quillsift.llm.common import batch_texts, own_columns, slices

#: White space next to white space; a lone space between two other characters does not match.
ADJACENT_SPACES = re.compile(r"\s\s")

PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
    ]
)
PIECES_DDL = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


class BpeEncoder:
    """Token ids of texts as little-endian unsigned 32-bit arrays, those of a ``tokenizers`` file.

    The byte-level pre-tokenizer never lets a token run across a lone space, so the ids of a text are those
    of its words with the space before them. The distinct words of a slice of texts are encoded together, by
    the same vocabulary as ranks, and cut apart by the byte lengths of their tokens. Texts with other runs
    of white space at a space, or that may hold the name of a special token, are encoded whole.
    """

    def __init__(self, path: str, ranks_path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.token_bytes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.token_bytes[rank] = len(token)

    @staticmethod
    def _is_odd(text: str) -> bool:
        return (
            text[0] == " "
            or text[-1] == " "
            or "<|" in text
            or "\0" in text
            or ADJACENT_SPACES.search(text) is not None
        )

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words one after the other, and where each ends. A zero marks the first word of a text."""
        ids: list[int] = []
        later = [w for w in words if w[:1] != "\0"]
        ends = np.zeros(len(words), dtype=np.int64)
        if later:
            ids = self.encoding.encode_ordinary(" " + " ".join(later))
            token_ends = np.cumsum(self.token_bytes[np.array(ids, dtype=np.int64)])
            word_ends = np.cumsum([len(w.encode()) + 1 for w in later])
            later_ends = iter((np.searchsorted(token_ends, word_ends) + 1).tolist())
        lengths, last = [], 0
        parts = []
        for i, w in enumerate(words):
            if w[:1] == "\0":
                parts.append((i, self.encoding.encode_ordinary(w[1:])))
                lengths.append(len(parts[-1][1]))
            else:
                end = next(later_ends)
                lengths.append(end - last)
                last = end
        ends = np.cumsum(lengths)
        flat = np.empty(int(ends[-1]) if len(ends) else 0, dtype="<u4")
        first = np.zeros(len(flat), dtype=bool)
        for i, own in parts:
            at = int(ends[i]) - len(own)
            flat[at : at + len(own)] = own
            first[at : at + len(own)] = True
        flat[~first] = ids
        return flat, ends

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        none = np.empty(0, dtype="<u4")
        out: list[np.ndarray] = [none] * len(texts)
        plain = []
        for i, text in enumerate(texts):
            if text and self._is_odd(text):
                out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
            elif text:
                plain.append(i)
        if not plain:
            return out
        split = pc.split_pattern(pa.array(["\0" + texts[i] for i in plain], type=pa.large_string()), " ")
        coded = split.flatten().dictionary_encode()
        flat, ends = self._words(coded.dictionary.to_pylist())
        starts = np.concatenate([[0], ends[:-1]])
        which = coded.indices.to_numpy()
        lengths = (ends - starts)[which]
        place = np.cumsum(lengths)
        ids = flat[np.repeat(starts[which] - (place - lengths), lengths) + np.arange(int(place[-1]))]
        text_ends = place[split.offsets.to_numpy()[1:] - 1].tolist()
        start = 0
        for i, end in zip(plain, text_ends):
            out[i] = ids[start:end]
            start = end
        return out


def difference(sizes: list[int], ways: int) -> list[list[int]]:
    """Deal ``sizes`` to ``ways`` subsets of near-equal sums; returns the positions in each.

    Every number starts as a partial partition with one filled subset. The two with the largest spread
    are merged so that the fullest subset of one meets the emptiest of the other. Subsets that are still
    empty are not stored, so a merge costs as much as its smaller, filled part needs.
    """
    # A partial partition: loads above its base, descending, beside the members; `ways` minus its length are at the base.
    heap = [(-size, i, [(size, [i])]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    count = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        free = ways - len(a)
        merged = a + b[:free]  # the largest of b onto the empty ones of a
        if len(b) > free:
            rest = b[free:]  # descending; the largest goes onto the smallest filled subset of a
            for j, (load, members) in enumerate(rest):
                at = len(a) - 1 - j
                merged[at] = (a[at][0] + load, a[at][1] + members)
        merged.sort(key=lambda x: -x[0])
        if len(merged) == ways and merged[-1][0]:
            low = merged[-1][0]
            # Only differences count for the order of merging; the common part is taken off.
            merged = [(load - low, members) for load, members in merged]
        spread = merged[0][0] - (merged[-1][0] if len(merged) == ways else 0)
        count += 1
        heapq.heappush(heap, (-spread, count, merged))
    return [members for _, members in heap[0][2]] if heap else []


def deal(sizes: list[int], capacity: int) -> list[list[int]]:
    """Subsets of at most ``capacity``, as few as differencing finds when counting up from the least."""
    ways = max(1, -(-sum(sizes) // capacity))
    while True:
        subsets = difference(sizes, ways)
        if all(sum(sizes[i] for i in s) <= capacity for s in subsets):
            return subsets
        ways += 1


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    ranks_path: str,
    pattern: str,
    capacity: int = 1024,
    end_id: int = 0,
    part: int = 64,
    group_parts: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of documents and their places in sequences of at most ``capacity`` ids.

    One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``. Every id of
    every document lies in exactly one piece; the pieces of a sequence follow each other from offset 0.
    A null or empty text is its end id alone. Rows are packed as they stand: equal ids or texts are
    separate documents, a null id stays null, other columns are not read, and an empty table gives no rows.
    ``tokenizer_path`` gives the ids; ``ranks_path`` and ``pattern`` are the same vocabulary as byte ranks.
    ``sequence_id`` is unique, not dense: the number of the task and a count within it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = BpeEncoder(tokenizer_path, ranks_path, pattern)
        end = np.array([end_id], dtype="<u4")
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 40
        parts: list[tuple[int, int, int, int, int]] = []  # doc_id, start, length, crc, doc_tokens
        rows: list[tuple] = []

        def flush() -> None:
            nonlocal sequence, parts
            for members in deal([p[2] for p in parts], capacity):
                offset = 0
                for i in members:
                    rows.append((*parts[i], sequence, offset))
                    offset += parts[i][2]
                sequence += 1
            parts = []

        def give() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [[]] * len(PIECES)
            rows.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(columns, PIECES)], schema=PIECES
            )

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch_texts(batch.column(1))
            for at, to in slices(map(len, texts), 8_000_000):
                for doc, own in zip(ids[at:to], encode(texts[at:to])):
                    view, total = memoryview(np.append(own, end).tobytes()), len(own) + 1
                    start = 0
                    while total - start >= capacity:
                        crc = zlib.crc32(view[4 * start : 4 * (start + capacity)])
                        rows.append((doc, start, capacity, crc, total, sequence, 0))
                        sequence += 1
                        start += capacity
                    while start < total:
                        length = min(part, total - start)
                        crc = zlib.crc32(view[4 * start : 4 * (start + length)])
                        parts.append((doc, start, length, crc, total))
                        start += length
                        if len(parts) == group_parts:
                            flush()
                    if len(rows) >= 20_000:
                        yield give()
        flush()
        yield give()

    return own_columns(docs, id_col, text_col).mapInArrow(run, PIECES_DDL)
