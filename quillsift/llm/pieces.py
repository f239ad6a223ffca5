"""SentencePiece encoding and decoding on the ``tokenizers`` library.

The model file is parsed here: pieces with their scores and kinds, and the settings of trainer and
normaliser. From these the normaliser, the space marker, the byte fallback and the model itself (unigram
scores, or merges in the order of their scores) are set up again in ``tokenizers``, which encodes batches
on several threads. Parity with ``sentencepiece`` is checked on the way, and whole texts are decoded again.

A lone space never joins two words in a piece, so the distinct words of a slice of texts are encoded once
each. Texts with other white space at a space, or with the marker itself, are encoded whole.
"""

from __future__ import annotations

import itertools
import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quillsift.llm.common import batch_texts, own_columns, slices

MARKER = "▁"

#: Numbers of the published message format (fixed values): kinds of pieces, kinds of models.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = raw[at]
        value |= (byte & 127) << shift
        at += 1
        shift += 7
        if byte < 128:
            return value, at


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a message."""
    at = 0
    while at < len(raw):
        key, at = _varint(raw, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(raw, at)
        else:
            if kind == 2:
                size, at = _varint(raw, at)
            else:
                size = {1: 8, 5: 4}[kind]
            value = raw[at : at + size]
            at += size
        yield key >> 3, value


@dataclass(frozen=True)
class Model:
    pieces: list[tuple[str, float, int]]
    kind: int
    byte_fallback: bool
    unknown_id: int
    charsmap: bytes
    dummy_prefix: bool
    squeeze_spaces: bool
    escape_spaces: bool


def read_model(path: str) -> Model:
    """The parts of a model file that encoding needs."""
    with open(path, "rb") as file:
        message = list(_fields(file.read()))
    pieces = []
    for number, raw in message:
        if number == 1:
            piece = dict(_fields(raw))
            pieces.append((piece[1].decode(), struct.unpack("<f", piece.get(2, b"\0" * 4))[0], piece.get(3, NORMAL)))
    trainer = dict(_fields(next((raw for number, raw in message if number == 2), b"")))
    normalizer = dict(_fields(next((raw for number, raw in message if number == 3), b"")))
    return Model(
        pieces,
        trainer.get(3, UNIGRAM),
        bool(trainer.get(35, 0)),
        next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0),
        normalizer.get(2, b""),
        bool(normalizer.get(3, 1)),
        bool(normalizer.get(4, 1)),
        bool(normalizer.get(5, 1)),
    )


def _merges(vocabulary: dict[str, int], scores: dict[str, float]) -> list[tuple[str, str]]:
    """Every way to make a piece of two others; best score first, as encoding joins the best pair first."""
    found = []
    for piece, number in vocabulary.items():
        for cut in range(1, len(piece)):
            left, right = piece[:cut], piece[cut:]
            if left in vocabulary and right in vocabulary:
                found.append((-scores[piece], number, cut, left, right))
    return [(left, right) for *_, left, right in sorted(found)]


def build(model: Model):
    """A ``tokenizers`` tokenizer that encodes and decodes like the model."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    unknown = model.pieces[model.unknown_id][0]
    if model.kind == UNIGRAM:
        core = models.Unigram(
            [(p, s) for p, s, _ in model.pieces], unk_id=model.unknown_id, byte_fallback=model.byte_fallback
        )
    elif model.kind == BPE:
        usable = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER_DEFINED)}
        core = models.BPE(
            vocab={p: i for i, (p, _, _) in enumerate(model.pieces)},
            merges=_merges(usable, {p: s for p, s, _ in model.pieces}),
            unk_token=unknown,
            fuse_unk=True,
            byte_fallback=model.byte_fallback,
        )
    else:
        raise ValueError(f"model kind {model.kind} has no pieces to merge or score")
    steps = []
    if model.charsmap:
        steps.append(normalizers.Precompiled(model.charsmap))
    if model.squeeze_spaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARKER if model.escape_spaces else " "))
    if model.escape_spaces:
        steps.append(normalizers.Replace(" ", MARKER))
    tokenizer = Tokenizer(core)
    tokenizer.normalizer = normalizers.Sequence(steps)
    back = [decoders.Replace(MARKER, " "), decoders.ByteFallback(), decoders.Fuse()]
    if model.dummy_prefix:
        back.append(decoders.Strip(" ", 1, 0))
    tokenizer.decoder = decoders.Sequence(back)
    return tokenizer


class PieceEncoder:
    """Ids of texts, with whether each is the same in ``sentencepiece`` and comes back when decoded."""

    def __init__(self, path: str, threads: int = 2):
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ["RAYON_NUM_THREADS"] = str(threads)  # read when the library starts its threads
        import sentencepiece

        self.model = read_model(path)
        self.tokenizer = build(self.model)
        self.reference = sentencepiece.SentencePieceProcessor(model_file=path)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Whole texts, by the library alone; an empty text has no ids."""
        return [e.ids if t else [] for t, e in zip(texts, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False))]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)

    def _checked(self, texts: list[str], chunk: int = 40_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of texts one after the other, how many each has, and whether ``sentencepiece`` gives the same."""
        flat, lengths, same = [], [], []
        for at in range(0, len(texts), chunk):
            part = texts[at : at + chunk]
            ids = self.encode(part)
            same.append(np.array([a == b for a, b in zip(ids, self.reference.encode(part, num_threads=1))], dtype=bool))
            lengths.append(np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)))
            flat.append(np.fromiter(itertools.chain.from_iterable(ids), dtype="<u4", count=int(lengths[-1].sum())))
        return np.concatenate(flat), np.concatenate(lengths), np.concatenate(same)

    def normalised(self, text: str) -> str:
        """What decoding must give: the text after the model's own changes to it, with spaces for markers."""
        if not self.model.charsmap and not self.model.squeeze_spaces:
            return text.replace(MARKER, " ") if self.model.escape_spaces else text
        spaced = self.tokenizer.normalizer.normalize_str(text).replace(MARKER, " ")
        return spaced[1:] if self.model.dummy_prefix and spaced.startswith(" ") else spaced

    def _comes_back(self, texts: list[str], ids: list[np.ndarray]) -> list[bool]:
        """Whether the ids of each whole text, decoded by the library, give its normalised text."""
        out = []
        for at, to in slices(map(len, texts), 1_000_000):
            came = self.decode([x.tolist() for x in ids[at:to]])
            out += [back == self.normalised(text) for back, text in zip(came, texts[at:to])]
        return out

    def _splits(self, text: str) -> bool:
        """Whether the words of the text can be encoded one by one."""
        return not (text[0] == " " or text[-1] == " " or "  " in text or MARKER in text)

    def __call__(self, texts: list[str]) -> list[tuple[np.ndarray, bool, bool]]:
        ids, parity = self._encoded(texts)
        return list(zip(ids, parity, self._comes_back(texts, ids)))

    def _encoded(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        """The ids of each text, and whether ``sentencepiece`` gives the same."""
        out, parity = [np.empty(0, dtype="<u4")] * len(texts), [True] * len(texts)
        simple = self.model.dummy_prefix and self.model.escape_spaces and not self.model.charsmap
        plain = [i for i, t in enumerate(texts) if t and simple and self._splits(t)]
        whole = [i for i, t in enumerate(texts) if t and not (simple and self._splits(t))]
        if whole:
            ids, sizes, same = self._checked([texts[i] for i in whole], 256)
            for i, own, s in zip(whole, np.split(ids, np.cumsum(sizes)[:-1]), same.tolist()):
                out[i], parity[i] = own, s
        if not plain:
            return out, parity
        split = pc.split_pattern(pa.array([texts[i] for i in plain], type=pa.large_string()), " ")
        coded = split.flatten().dictionary_encode()
        flat, lengths, same = self._checked(coded.dictionary.to_pylist())
        starts = np.cumsum(lengths) - lengths
        which = coded.indices.to_numpy()
        per_word = lengths[which]
        place = np.cumsum(per_word)
        spread = flat[np.repeat(starts[which] - (place - per_word), per_word) + np.arange(int(place[-1]))]
        offsets = split.offsets.to_numpy()
        ends = place[offsets[1:] - 1].tolist()
        all_same = np.minimum.reduceat(same[which], offsets[:-1])
        start = 0
        for i, end, s in zip(plain, ends, all_same.tolist()):
            out[i], parity[i] = spread[start:end], s
            start = end
        return out, parity


def encode_table(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, parity, round_trip) of every whole text.

    ``parity``: the ids are those of ``sentencepiece``; ``round_trip``: the ids of the whole text, decoded, give the
    normalised text back. A null or empty text has no ids and both flags. Repeated rows and null ids are encoded like any other, other
    columns are not read, an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = PieceEncoder(model_path)
        for batch in batches:
            texts = batch_texts(batch.column(1))
            for at, to in slices(map(len, texts), 16_000_000):
                done = encode(texts[at:to])
                offsets = np.concatenate([[0], np.cumsum([len(x[0]) for x in done])]).astype(np.int32)
                values = np.concatenate([x[0] for x in done]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, to - at),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
                        pa.array([x[1] for x in done], pa.bool_()),
                        pa.array([x[2] for x in done], pa.bool_()),
                    ],
                    names=["doc_id", "ids", "parity", "round_trip"],
                )

    return own_columns(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, ids array<int>, parity boolean, round_trip boolean"
    )


def decode_table(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = build(read_model(model_path))
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ids = [x or [] for x in part.column(1).to_pylist()]
                texts = tokenizer.decode_batch(ids, skip_special_tokens=False)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, parity, round_trip): like ``encode_table``, the ids as number and checksum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = PieceEncoder(model_path)
        for batch in batches:
            texts = batch_texts(batch.column(1))
            for at, to in slices(map(len, texts), 16_000_000):
                done = encode(texts[at:to])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, to - at),
                        pa.array([len(x[0]) for x in done], pa.int64()),
                        pa.array([zlib.crc32(x[0].tobytes()) for x in done], pa.int64()),
                        pa.array([x[1] for x in done], pa.bool_()),
                        pa.array([x[2] for x in done], pa.bool_()),
                    ],
                    names=["doc_id", "n_tokens", "ids_crc32", "parity", "round_trip"],
                )

    return own_columns(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_tokens long, ids_crc32 long, parity boolean, round_trip boolean"
    )
