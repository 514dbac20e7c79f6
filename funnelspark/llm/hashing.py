"""Hashes of words and of runs of words, for whole Arrow columns at a time.

Words are found in the UTF-8 bytes. A word's hash is the sum of its eight-byte pieces, each mixed with its place
before it is added; so words of up to eight bytes never share one. A run's hash is a polynomial of its words'
hashes, read off prefix sums and mixed again. All sums are modulo 2**64. Runs are meant to be short: bases of
5 modulo 8 lose 14 of 64 bits to the powers of two in runs of 20 words, and all of them in runs of 1,024.
"""

from __future__ import annotations

import functools

import numpy as np

BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
# 5 modulo 8: powers minus one then have few factors of two.
WORD_BASES = (0xD6E8FEB86659FD95 & ~7 | 5, 0xA0761D6478BD642F & ~7 | 5)
# Bytes hashed in one go.
SPAN = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit number over all others."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@functools.lru_cache(maxsize=8)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse modulo 2**64, ``size`` of each."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        steps = np.full(size, b, dtype=np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def _room(n: int) -> int:
    return max(SPAN, 1 << max(0, n - 1).bit_length())


def runs(values: np.ndarray, begin: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of ``values[begin:end]`` for each pair, the same wherever it stands."""
    power, inverse = _powers(base, _room(len(values) + 1))
    sums = np.empty(len(values) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(values * power[: len(values)], out=sums[1:])
    return mix((sums[end] - sums[begin]) * inverse[begin])


def word_pieces(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pieces of all words, place of each in its word, pieces per word) for words ``data[start:stop]``, none empty.

    A piece is eight bytes as a number; the last one of a word is filled up with zero bytes.
    """
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    # The eight bytes from each position on, read where they are needed.
    eight = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
    size = stop - start
    count = (size + 7) >> 3
    last = np.cumsum(count) - 1
    place = np.arange(int(last[-1]) + 1) - np.repeat(last + 1 - count, count)
    piece = eight[np.repeat(start, count) + 8 * place]
    # Bytes beyond the word are in last pieces only.
    piece[last] &= ~np.uint64(0) >> (np.uint64(64) - np.uint64(8) * (size - 8 * (count - 1)).astype(np.uint64))
    return piece, place, count


def word_hashes(
    data: np.ndarray, start: np.ndarray, stop: np.ndarray, base: int,
    pieces: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None,
) -> np.ndarray:
    """Hash of each word ``data[start:stop]``, none of them empty; ``pieces`` as by word_pieces, if known."""
    if not len(start):
        return np.zeros(0, np.uint64)
    piece, place, count = pieces or word_pieces(data, start, stop)
    piece = mix(piece ^ (np.uint64(base) * (place + 1).astype(np.uint64)))
    return mix(np.add.reduceat(piece, np.cumsum(count) - count) + np.uint64(base) * (stop - start).astype(np.uint64))


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets) of an Arrow string column; a null text is empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)
    offsets = offsets[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _spans(offsets: np.ndarray):
    """Ranges of documents with about SPAN bytes each."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + SPAN, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def window_hashes(
    data: np.ndarray, offsets: np.ndarray, size: int, planes: int, lower: bool = False,
    short: bool = False,
) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(hashes per plane, windows per document, words per document).

    A window is ``size`` consecutive words of one document, in order of documents and
    positions. With ``short``, a document with fewer words, but one at least, has one window of all.
    """
    hashes, windows, words = [[] for _ in range(planes)], [], []
    for i, j in _spans(offsets):
        b = data[offsets[i] : offsets[j]]
        edges = offsets[i : j + 1] - offsets[i]
        if lower:
            b = _LOWER[b]
        inside = ~_BLANK[b]
        first = np.zeros(len(b) + 1, dtype=bool)
        first[edges] = True
        before = np.zeros(len(b), dtype=bool)
        before[1:] = inside[:-1]
        start = np.flatnonzero(inside & (~before | first[:-1]))
        after = np.zeros(len(b), dtype=bool)
        after[:-1] = inside[1:]
        stop = np.flatnonzero(inside & (~after | first[1:])) + 1
        at = np.searchsorted(start, edges)
        n = np.diff(at)
        count = np.maximum(n - size + 1, 0)
        if short:
            count[(n > 0) & (n < size)] = 1
        total = int(count.sum())
        # Window k of a document starts at its k-th word.
        begin = np.repeat(at[:-1] - (np.cumsum(count) - count), count) + np.arange(total)
        end = begin + np.repeat(np.minimum(n, size), count)
        for p in range(planes):
            word = word_hashes(b, start, stop, BASES[p])
            hashes[p].append(runs(word, begin, end, WORD_BASES[p]))
        windows.append(count)
        words.append(n)
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return [join(h, np.uint64) for h in hashes], join(windows, np.int64), join(words, np.int64)
