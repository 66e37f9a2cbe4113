"""Words, shingles and hashes of many texts at once, on numpy arrays of their bytes.

A word is a run of ASCII letters, digits and non-ASCII characters of the lower-cased text.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_GOLD = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 (public domain): a bijection that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit constants from a seed."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * _GOLD + U(seed)) | U(1)


_BYTE_VALUE = constants(256, 11)
_BASE = int(constants(1, 12)[0])
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}

_bytes = np.arange(256)
_letter = ((_bytes >= 97) & (_bytes <= 122)) | ((_bytes >= 65) & (_bytes <= 90)) | (_bytes >= 128)
WORD = _letter | ((_bytes >= 48) & (_bytes <= 57))
SPACE = np.isin(_bytes, [9, 10, 11, 12, 13, 32])


def _power(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, grown on demand and kept for the worker's next batch."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        steps = np.full(size, U(base))
        steps[0] = U(1)
        with np.errstate(over="ignore"):
            got = _powers[base] = np.multiply.accumulate(steps)
    return got


def to_bytes(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased texts, each followed by a line break, as bytes; where each begins."""
    parts = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    starts = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=starts[1:])
    return np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8), starts


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of True begin and end (exclusive). ``flags`` ends with False."""
    edges = np.flatnonzero(flags[1:] != flags[:-1]) + 1
    if flags[0]:
        edges = np.concatenate([[0], edges])
    return edges[0::2], edges[1::2]


def hash_spans(buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span (polynomial with random byte values, mixed)."""
    if not len(begin):
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUE[buf] * _power(_BASE, len(buf))[: len(buf)], out=total[1:])
        return mix((total[end] - total[begin]) * _power(_BASE_INVERSE, len(buf))[begin])


def words_of(texts: list) -> tuple[np.ndarray, np.ndarray, int]:
    """Hash of each word and the number of the text it is in, in order; the number of texts."""
    buf, starts = to_bytes(texts)
    begin, end = runs(WORD[buf])
    doc = np.searchsorted(starts, begin, side="right") - 1
    return hash_spans(buf, begin, end), doc, len(texts)


def hash_of(words: list[str]) -> np.ndarray:
    """The hashes that ``words_of`` gives to these words."""
    return words_of([" ".join(words)])[0] if words else np.zeros(0, dtype=np.uint64)


def shingles(h: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each run of ``width`` words; a shorter text is one shingle."""
    n = len(h)
    if not n:
        return h, doc
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    count = np.diff(np.concatenate([first, [n]]))
    left = np.repeat(first + count, count) - np.arange(n)  # words from here to the text's end
    starts = left >= width
    starts[first[count < width]] = True
    at = np.flatnonzero(starts)
    out = np.zeros(len(at), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j, c in enumerate(constants(width, 21)):
            here = np.minimum(at + j, n - 1)
            out += np.where(left[at] > j, h[here] * c, U(0))
        return mix(out), doc[at]


def counted(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of each text (44 bits of the hash), their text and how often they occur."""
    if not len(keys):
        return keys, doc, np.zeros(0, dtype=np.int64)
    packed = np.sort((doc.astype(np.uint64) << U(44)) | (keys >> U(20)))
    first = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]]))
    counts = np.diff(np.concatenate([first, [len(packed)]]))
    packed = packed[first]
    return packed & U((1 << 44) - 1), (packed >> U(44)).astype(np.int64), counts


def unit(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1] from 64-bit hashes."""
    return ((x >> U(11)).astype(np.float64) + 1.0) * (1.0 / (1 << 53))


def text_digest(h: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each text's whole sequence of words, and its number of words."""
    count = np.bincount(doc, minlength=n_docs)
    out = np.zeros((2, n_docs), dtype=np.uint64)
    if len(h):
        first = np.concatenate([[0], np.cumsum(count)[:-1]])
        order = (np.arange(len(h)) - np.repeat(first, count)).astype(np.uint64)
        some = np.flatnonzero(count)
        with np.errstate(over="ignore"):
            for row, seed in enumerate((31, 32)):
                term = mix(h + mix(order * _GOLD + U(seed)))
                out[row, some] = mix(np.add.reduceat(term, first[some]) + count[some].astype(np.uint64))
    return out, count
