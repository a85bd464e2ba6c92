"""Word and shingle hashing over batches of whole texts, vectorised with numpy.

A word is a maximal run of characters other than space and ``\\x09-\\x0D``.
All of these are single bytes in UTF-8, so words are found on the encoded
bytes.  Memory is bounded by ``SEGMENT_BYTES`` of text (or by one word, when a
word is longer) plus eight bytes per word.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

SEGMENT_BYTES = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_CODE = np.random.default_rng(20240607).integers(1, 1 << 64, 256, dtype=np.uint64)
_BYTE_CODE[_WHITE] = 0
_LOWER_CODE = _BYTE_CODE[_LOWER]

_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        steps = np.full(max(n, SEGMENT_BYTES + 1), _BASE if kind == "up" else _BASE_INV, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if n <= 4 * SEGMENT_BYTES:
            _powers[kind] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


def _segments(data: np.ndarray, white: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts at white space, so that no word crosses a segment."""
    start, n = 0, len(data)
    while start < n:
        end = min(n, start + SEGMENT_BYTES)
        while end < n and not white[end]:
            ahead = white[end:end + SEGMENT_BYTES]
            step = int(ahead.argmax()) if ahead.any() else len(ahead)
            end += step
        yield start, end
        start = end


def word_spans(data: np.ndarray, white: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.flatnonzero(white[1:] != white[:-1]) + 1
    if not white[0]:
        edge = np.concatenate(([0], edge))
    if len(edge) % 2:
        edge = np.concatenate((edge, [len(data)]))
    return edge[0::2], edge[1::2]


def words(text: bytes, lower: bool = False, breaks: np.ndarray = _WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(hash, start, end)`` of every word of one or more joined texts.

    ``breaks`` marks the bytes that end a word, white space by default.
    """
    data = np.frombuffer(text, np.uint8)
    white = breaks[data]
    starts, ends = word_spans(data, white)
    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out, starts, ends
    code = _LOWER_CODE if lower else _BYTE_CODE
    if breaks is not _WHITE:
        code = np.where(breaks, np.uint64(0), code)
    for a, b in _segments(data, white):
        lo, hi = np.searchsorted(starts, (a, b))
        if lo == hi:
            continue
        terms = code[data[a:b]]
        terms *= _power("up", b - a)
        s = starts[lo:hi] - a
        sums = np.add.reduceat(terms, s)  # white space adds nothing
        sums *= _power("down", b - a)[s]
        sums += (ends[lo:hi] - starts[lo:hi]).astype(np.uint64)
        out[lo:hi] = mix(sums)
    return out, starts, ends


def windows(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive words."""
    n = len(word_hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    weight = k
    for j in range(k):
        weight = weight * 0x9E3779B97F4A7C15 + 0xD1B54A32D192ED03 & (1 << 64) - 1
        total += word_hashes[j:j + n] * np.uint64(weight | 1)
    return mix(total)


def sorted_distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    keep = np.empty(len(values), bool)
    keep[:1] = True
    np.not_equal(values[1:], values[:-1], out=keep[1:])
    return values[keep]


def shingle_set(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct ``k``-word shingles; the whole sequence when it is shorter."""
    n = len(word_hashes)
    return sorted_distinct(windows(word_hashes, min(n, k))) if n else np.zeros(0, np.uint64)


def batches(texts: Sequence[bytes | None]) -> Iterator[list[bytes]]:
    """UTF-8 texts in runs of about ``SEGMENT_BYTES``; nulls become empty."""
    run: list[bytes] = []
    size = 0
    for raw in texts:
        raw = raw or b""
        if run and size + len(raw) > SEGMENT_BYTES:
            yield run
            run, size = [], 0
        run.append(raw)
        size += len(raw) + 1
    if run:
        yield run


def joined(run: list[bytes], lower: bool = False) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer for a run of texts: ``(buffer, word hash, start, end, cuts)``.

    Text ``i`` owns the words ``cuts[i]:cuts[i + 1]``.
    """
    buffer = b" ".join(run)
    hashes, starts, ends = words(buffer, lower)
    edges = np.zeros(len(run) + 1, np.int64)
    np.cumsum(np.fromiter((len(r) + 1 for r in run), np.int64, len(run)), out=edges[1:])
    return buffer, hashes, starts, ends, np.searchsorted(starts, edges)


def shingle_sets(texts: Sequence[bytes | None], k: int, lower: bool = True) -> Iterator[np.ndarray]:
    """The shingle set of each text, in order."""
    for run in batches(texts):
        _, hashes, _, _, cuts = joined(run, lower)
        grams = windows(hashes, k)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield sorted_distinct(grams[a:b - k + 1]) if b - a >= k else shingle_set(hashes[a:b], k)
