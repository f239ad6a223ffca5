"""Sets of word n-grams as sorted 64-bit digests, computed over many texts at once."""

from __future__ import annotations

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

# An odd multiplier and its inverse modulo 2**64: digests of any stretch of bytes from one running sum.
_R = 0x9E3779B97F4A7C15
_R_INVERSE = pow(_R, -1, 1 << 64)


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Spread every bit of 64-bit words over all bits (the finaliser of splitmix64)."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Exponents are split into steps of this many, so that no table grows with the texts.
_STEP = 1 << 12


def _table(base: int, count: int) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64, by doubling: the next stretch is the last times base**done."""
    out = np.ones(count, dtype=np.uint64)
    done, step = 1, base
    while done < count:
        out[done : 2 * done] = out[: min(done, count - done)] * np.uint64(step)
        done, step = 2 * done, step * step % (1 << 64)
    return out


def _tables(base: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers within a step, and of whole steps, for exponents below ``count``."""
    return _table(base, _STEP), _table(pow(base, _STEP, 1 << 64), max(1, -(-count // _STEP)))


def powers(base: int, count: int) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64."""
    low, high = _tables(base, count)
    return (high[:, None] * low).ravel()[:count]


def powers_at(base: int, exponents: np.ndarray, count: int) -> np.ndarray:
    """base**exponents modulo 2**64; exponents are below ``count``."""
    low, high = _tables(base, count)
    return low[exponents & (_STEP - 1)] * high[exponents >> 12]


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by sorting."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def running(raw: np.ndarray) -> np.ndarray:
    """Sums whose differences give digests of stretches; one longer than the bytes."""
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(_R, len(raw)), out=sums[1:])
    return sums


def stretches(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Digests of raw[start:end], the same wherever the bytes stand."""
    return mixed((sums[ends] - sums[starts]) * powers_at(_R_INVERSE, starts, len(sums)) + (ends - starts).astype(np.uint64))


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the words of all texts (A-Z lower-cased, cut at ASCII white space), and the end of each text in them."""
    raw_texts = [t.encode("utf-8", "surrogatepass") for t in texts]
    raw = _LOWER[np.frombuffer(b"\n".join([*raw_texts, b""]), dtype=np.uint8)] if texts else np.empty(0, np.uint8)
    inside = ~_SPACE[raw]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside]).astype(np.int8)))
    starts, ends = edges[0::2], edges[1::2]  # every text ends in white space
    text_ends = np.cumsum([len(t) + 1 for t in raw_texts])
    return stretches(running(raw), starts, ends), np.searchsorted(starts, text_ends)


def shingle_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """The sorted distinct n-grams of each text; a shorter text is one n-gram, one without words none."""
    digests, ends = words(texts)
    count = max(0, len(digests) - n + 1)
    grams = np.zeros(count, dtype=np.uint64)
    for i in range(n):
        grams += digests[i : i + count] * np.uint64(2 * i + 3) * np.uint64(_R)
    grams = mixed(grams, n)
    out, start = [], 0
    for end in ends.tolist():
        if end - start >= n:
            out.append(distinct(grams[start : end - n + 1]))
        elif end > start:
            own = digests[start:end] * (2 * np.arange(end - start, dtype=np.uint64) + np.uint64(3)) * np.uint64(_R)
            out.append(mixed(own.sum(keepdims=True, dtype=np.uint64), end - start))
        else:
            out.append(np.empty(0, dtype=np.uint64))
        start = end
    return out
