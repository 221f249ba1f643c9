"""Words of whole texts as arrays, for the operators on word windows.

A batch of texts is one array of UTF-8 bytes. Words are runs between separator bytes; a word's hash is a polynomial in a
random table of byte values, taken from running sums, so neither words nor windows are looped over in Python.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(0x5EED)
_TABLE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + _rng.integers(0, 2, 256, dtype=np.uint64)
_LOWER = _TABLE.copy()
_LOWER[65:91] = _TABLE[97:123]
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE, _INVERSE = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, np.ndarray] = {}
#: Bytes that are summed at once.
PIECE_BYTES = 1 << 20


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. n - 1 modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = _powers[base] = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _ODD
    return h ^ (h >> np.uint64(29))


def run_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray = _TABLE) -> np.ndarray:
    """Hash of each run of bytes; runs rise and do not overlap. Sums are taken piece by piece, so a long text needs no long sums."""
    out, i = np.empty(len(start), np.uint64), 0
    while i < len(start):
        base = start[i]
        j = max(i + 1, int(np.searchsorted(end, base + PIECE_BYTES, "right")))
        part = data[base : end[j - 1]]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(table[part] * _power(_BASE, len(part)), dtype=np.uint64, out=sums[1:])
        s = start[i:j] - base
        out[i:j] = mix((sums[end[i:j] - base] - sums[s]) * _power(_INVERSE, len(part) + 1)[s])
        i = j
    return out


class Words:
    """All words of a batch: ``hash``, byte places ``start`` and ``end`` in ``data``, and ``offset`` of each text's words."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = texts.fill_null("") if texts.null_count else texts
        n = len(texts)
        width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        off = np.frombuffer(texts.buffers()[1], width)[texts.offset : texts.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
        off = off - off[0]
        inside = ~_SEPARATOR[data]
        before = np.empty(len(data), bool)
        if len(data):
            before[0] = False
            before[1:] = inside[:-1]
            first = off[:-1][off[:-1] < len(data)]
            before[first] = False  # a text's first byte follows nothing
        self.start = np.flatnonzero(inside & ~before)
        ends = np.zeros(len(data) + 1, bool)
        ends[1:] |= inside
        ends[:-1] &= ~(inside & before)
        ends[0] = False
        self.end = np.flatnonzero(ends)
        self.data = data
        self.offset = np.searchsorted(self.start, off)
        self.hash = run_hashes(data, self.start, self.end, _LOWER if lower else _TABLE)

    def grams(self, k: int) -> np.ndarray:
        """Order-sensitive hash of every k words in a row, text borders ignored."""
        return grams(self.hash, k)

    def text(self, i: int, j: int) -> bytes:
        """The text from word i up to word j."""
        return self.data[self.start[i] : self.end[j - 1]].tobytes()


def grams(words: np.ndarray, k: int) -> np.ndarray:
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * _power(_BASE, len(words)), dtype=np.uint64, out=sums[1:])
    return mix((sums[k:] - sums[:n]) * _power(_INVERSE, n))


def sliding_argmin(g: np.ndarray, w: int) -> np.ndarray:
    """Place of the leftmost smallest value in every w in a row."""
    best, size = np.arange(len(g)), 1
    while size < w:
        step = min(size, w - size)
        if len(best) <= step:
            return best[:0]
        a, b = best[: len(best) - step], best[step:]
        best, size = np.where(g[a] <= g[b], a, b), size + step
    return best


def batches_of(batch: pa.RecordBatch, text_col: int, most_bytes: int = 1 << 20):
    """Slices of a record batch whose texts hold about ``most_bytes`` together; one long text is a slice of its own."""
    col = batch.column(text_col)
    size = np.diff(np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]).astype(np.int64) if len(col) else np.zeros(0, np.int64)
    at, done = 0, np.cumsum(size)
    while at < batch.num_rows:
        base = done[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(done, base + most_bytes, "right")))
        yield batch.slice(at, to - at)
        at = to


def span_hash(words: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the words of each span, its length included."""
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(mix(words) * _power(_BASE, len(words)), dtype=np.uint64, out=sums[1:])
    return mix((sums[end] - sums[start]) * _power(_INVERSE, len(words) + 1)[start] + (end - start).astype(np.uint64) * _ODD)
