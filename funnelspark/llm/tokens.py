"""Token ids of texts, by a table of the words seen so far.

Whole groups of texts are cut at once: the classes of their characters say where the pre-split
pattern of byte-level BPE starts a word, a hash of its characters finds the word's ids in a table, where its
characters are compared, and only new words are encoded. Texts with characters beyond Latin are pre-split one by one.
"""

from __future__ import annotations

import functools
import json
import os
import unicodedata
import re
from array import array
from collections.abc import Callable

import numpy as np

from .hashing import BASES, word_hashes, word_pieces

# Words kept per worker, about 100 bytes each; a full table drops those met once, which costs time only.
TABLE_WORDS = 400_000
# Characters cut at once.
GROUP_CHARS = 1 << 18
# Bytes of text taken out of an Arrow batch at once.
RUN_BYTES = 1 << 20
TOP = 0x250
NONE, LETTER, NUMBER, SPACE, BLANK, OTHER, BEYOND = range(7)


@functools.cache
def _classes() -> np.ndarray:
    """Class of each character below TOP; the last entry stands for all others."""
    out = np.full(TOP + 1, OTHER, dtype=np.uint8)
    for c in range(TOP):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            out[c] = LETTER if kind == "L" else NUMBER
    out[[*range(0x09, 0x0E), 0x85, 0xA0]] = BLANK
    out[0x20] = SPACE
    # Control characters, on which notions of white space differ.
    out[[*range(0x00, 0x09), *range(0x0E, 0x20), *range(0x7F, 0x85), *range(0x86, 0xA0), TOP]] = BEYOND
    return out


def word_starts(points: np.ndarray, kinds: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where a word of the pre-split pattern starts, for texts laid end to end.

    ``points`` are characters, ``kinds`` their classes, ``first`` the positions where texts begin.
    A word is a run of one class with at most one space before it. Of a run of white space the last
    character is a word of its own, or the space before the next word. After a letter, number or
    blank, ``'s`` and its like are words.
    """
    n = len(points)
    before = np.empty(n, dtype=np.uint8)
    before[1:] = kinds[:-1]
    before[first] = NONE
    after = np.empty(n, dtype=np.uint8)
    after[:-1] = kinds[1:]
    after[-1] = NONE
    after[first[1:] - 1] = NONE
    blank = (kinds == SPACE) | (kinds == BLANK)
    blank_before = (before == SPACE) | (before == BLANK)
    blank_after = (after == SPACE) | (after == BLANK) | (after == NONE)
    start = np.where(
        blank,
        ~blank_before | ~blank_after,
        (before == BLANK) | (~blank_before & (before != kinds)),
    )
    quote = np.flatnonzero((points == ord("'")) & (before != SPACE) & (before != OTHER) & (after == LETTER))
    if len(quote):
        padded = np.append(points, [0, 0])
        one, two = padded[quote + 1], padded[quote + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        same = np.append(after, NONE)[quote + 1] == LETTER
        long = same & (
            ((one == ord("r")) & (two == ord("e")))
            | ((one == ord("v")) & (two == ord("e")))
            | ((one == ord("l")) & (two == ord("l")))
        )
        end = quote[short | long] + np.where(short, 2, 3)[short | long]
        start[quote[short | long] + 1] = False
        inside = end[end < n]
        inside = inside[(before[inside] != NONE) & ~blank[inside]]
        start[inside] = True
    return start


def _gathered(values: np.ndarray, ends: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values of all entries in a row, number of values of each); entry k's end at ``ends[k]``."""
    end = ends[entries]
    sizes = end - np.where(entries > 0, ends[entries - 1], 0)
    upto = np.cumsum(sizes)
    total = int(upto[-1]) if len(upto) else 0
    return values[np.repeat(end - upto, sizes) + np.arange(total)], sizes


class _Lists:
    """Growing list of arrays, end to end."""

    def __init__(self, dtype: np.dtype):
        self.count, self.ends, self.values = 0, np.zeros(1 << 12, np.int64), np.zeros(1 << 14, dtype)

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        n = self.count + len(sizes)
        base = int(self.ends[self.count - 1]) if self.count else 0
        if n > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros(max(n, len(self.ends)), np.int64)])
        while base + len(flat) > len(self.values):
            self.values = np.concatenate([self.values, np.zeros(len(self.values), self.values.dtype)])
        self.ends[self.count : n] = base + np.cumsum(sizes)
        self.values[base : base + len(flat)] = flat
        self.count = n

    def of(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values of all entries in a row, number of values of each)."""
        return _gathered(self.values, self.ends, entries)


class WordTable:
    """Hash table from the 64-bit hash of a word to its eight-byte pieces and ids, in arrays.

    No word that is entered holds a zero byte, so words with equal pieces are equal.
    """

    def __init__(self, dtype: np.dtype, bits: int = 16):
        self.dtype, self.bits, self.count = dtype, bits, 0
        self._keys = np.zeros(1 << bits, np.uint64)
        self._entry = np.zeros(1 << bits, np.int32)
        self._ids, self._pieces = _Lists(dtype), _Lists(np.dtype(np.uint64))
        self._again = np.zeros(1 << bits, bool)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Entry of each key, -1 if it has none. Keys are never 0."""
        mask = (1 << self.bits) - 1
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        while len(left):
            there = self._keys[slot]
            hit = there == keys[left]
            out[left[hit]] = self._entry[slot[hit]]
            go = ~hit & (there != 0)
            left, slot = left[go], (slot[go] + 1) & mask
        return out

    def _place(self, keys: np.ndarray, entries: np.ndarray) -> None:
        mask = (1 << self.bits) - 1
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(keys):
            free = self._keys[slot] == 0
            # Of several new keys for a slot, the one that is written last gets it.
            self._keys[slot[free]] = keys[free]
            got = self._keys[slot] == keys
            self._entry[slot[got]] = entries[got]
            keys, entries, slot = keys[~got], entries[~got], (slot[~got] + 1) & mask

    def add(self, keys: np.ndarray, ids: list[bytes], pieces: np.ndarray, counts: np.ndarray) -> None:
        """Enter different keys that are not there yet, with the words' pieces end to end."""
        sizes = np.array([len(x) for x in ids], np.int64) // self.dtype.itemsize
        self._enter(keys, np.frombuffer(b"".join(ids), self.dtype), sizes, pieces, counts)

    def _enter(
        self, keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray, pieces: np.ndarray, counts: np.ndarray
    ) -> None:
        n = self.count + len(keys)
        while 2 * n > 1 << self.bits:
            held = np.flatnonzero(self._keys)
            old, entries = self._keys[held], self._entry[held]
            self.bits += 1
            self._keys = np.zeros(1 << self.bits, np.uint64)
            self._entry = np.zeros(1 << self.bits, np.int32)
            self._place(old, entries)
        if n > len(self._again):
            self._again = np.concatenate([self._again, np.zeros(max(n, len(self._again)), bool)])
        self._ids.add(ids, sizes)
        self._pieces.add(pieces, counts)
        self._place(keys, np.arange(self.count, n, dtype=np.int32))
        self.count = n

    def met(self, entries: np.ndarray) -> None:
        """Note that these entries were found again."""
        self._again[entries] = True

    def thinned(self, limit: int) -> WordTable:
        """A new table of the words found again since they were entered or kept, the ``limit`` longest known at most."""
        out = WordTable(self.dtype)
        entries = np.flatnonzero(self._again[: self.count])[:limit]
        keys = np.empty(self.count, np.uint64)
        held = np.flatnonzero(self._keys)
        keys[self._entry[held]] = self._keys[held]
        if len(entries):
            out._enter(keys[entries], *self._ids.of(entries), *self._pieces.of(entries))
        return out

    def wrong(self, entries: np.ndarray, pieces: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Which words (pieces end to end, ``counts`` of each, none 0) are not those of their entries."""
        own, own_counts = self._pieces.of(entries)
        differ = own_counts != counts
        if differ.any():
            # Compare those of as many pieces only.
            same = ~differ
            own, _ = self._pieces.of(entries[same])
            pieces = pieces[np.repeat(same, counts)]
            where = np.repeat(np.flatnonzero(same), counts[same])
        elif np.array_equal(own, pieces):
            return differ
        else:
            where = np.repeat(np.arange(len(counts)), counts)
        differ[where[own != pieces]] = True
        return differ

    def gather(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all entries in a row, number of ids of each)."""
        return self._ids.of(entries)


class PieceEncoder:
    """Ids of whole texts from a function that encodes a list of pre-split words.

    ``encode_words`` returns the ids of each word as little-endian bytes of ``dtype``;
    ``pre_split`` cuts texts with characters beyond Latin; ``special`` maps strings that
    stand for one id wherever they occur.
    """

    def __init__(
        self,
        encode_words: Callable[[list[str]], list[bytes]],
        pre_split: Callable[[str], list[str]],
        special: dict[str, int],
        dtype: str,
        limit: int = TABLE_WORDS,
    ):
        self._words, self._pre_split, self._limit = encode_words, pre_split, limit
        self.dtype = np.dtype(dtype)
        self._special = {s: np.array([i], dtype).tobytes() for s, i in special.items()}
        names = sorted(map(re.escape, special), key=len, reverse=True)
        self._marks = re.compile(f"({'|'.join(names)})") if names else None
        self._table = WordTable(self.dtype)

    def _latin(self, texts: list[str]) -> list[bytes | None]:
        """Ids of texts laid end to end; None for those with characters beyond Latin."""
        whole = "".join(texts)
        if not whole:
            return [b""] * len(texts)
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
        kinds = _classes().take(points, mode="clip")
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes)
        first = (ends - sizes)[sizes > 0]
        start = np.flatnonzero(word_starts(points, kinds, first))
        stop = np.append(start[1:], len(points))
        raw = np.frombuffer(whole.encode("utf-8", "surrogatepass"), np.uint8)
        # Words follow each other without a gap, in characters and in bytes.
        edges = np.append(start, len(points))
        if len(raw) > len(points):
            edges = np.flatnonzero(np.append((raw & 0xC0) != 0x80, True))[edges]
        pieces = word_pieces(raw, edges[:-1], edges[1:])
        keys = word_hashes(raw, edges[:-1], edges[1:], BASES[0], pieces) | np.uint64(1)
        odd = np.flatnonzero(kinds == BEYOND)
        bad = np.zeros(len(texts), dtype=bool)
        bad[np.searchsorted(ends, odd, side="right")] = True
        cut = np.searchsorted(start, ends)
        words = np.diff(cut, prepend=0)
        if self._table.count > self._limit:
            self._table = self._table.thinned(self._limit // 2)
        entry = self._table.find(keys)
        self._table.met(entry[entry >= 0])
        missing = np.flatnonzero((entry < 0) & ~np.repeat(bad, words))
        if len(missing):
            new, at = np.unique(keys[missing], return_index=True)
            at = missing[at]
            said = [whole[a:b] for a, b in zip(start[at].tolist(), stop[at].tolist())]
            self._table.add(new, self._words(said), *_gathered(pieces[0], np.cumsum(pieces[2]), at))
            entry[missing] = self._table.find(keys[missing])
        known = entry >= 0
        entry[~known] = 0
        if not self._table.count:
            ids, counts = np.zeros(0, self.dtype), entry * 0
        else:
            # A text with a word that only shares another one's hash is encoded without the table.
            wrong = np.flatnonzero(known & self._table.wrong(entry, pieces[0], pieces[2]))
            bad[np.searchsorted(cut, wrong, side="right")] = True
            ids, counts = self._table.gather(entry)
        upto = np.concatenate([[0], np.cumsum(counts)])[cut].tolist()
        data = memoryview(ids.tobytes())
        width = self.dtype.itemsize
        return [
            None if b else bytes(data[width * lo : width * hi])
            for b, lo, hi in zip(bad.tolist(), [0, *upto[:-1]], upto)
        ]

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without special strings."""
        out, held, size = [], [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= GROUP_CHARS:
                out += self._latin(held)
                held, size = [], 0
        if held:
            out += self._latin(held)
        for i, text in enumerate(texts):
            if out[i] is None:
                out[i] = b"".join(self._words(self._pre_split(text)))
        return out

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian bytes; none for a null or empty text."""
        texts = [t or "" for t in texts]
        if self._marks is None:
            return self._plain(texts)
        # Odd parts are special strings.
        split = [self._marks.split(t) for t in texts]
        plain = iter(self._plain([p for parts in split for p in parts[::2]]))
        return [
            next(plain) if len(parts) == 1 else b"".join(
                [self._special[p] if k % 2 else next(plain) for k, p in enumerate(parts)]
            )
            for parts in split
        ]

    def encode(self, text: str | None) -> bytes:
        """Ids of one text."""
        return self.encode_many([text])[0]


def text_runs(batch, text: str = "text", size: int = RUN_BYTES):
    """The rows of an Arrow batch in runs of about ``size`` bytes of text, so that few are Python strings at once."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    upto = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + size, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def read_vocabulary(path: str) -> dict:
    """The parts of a byte-level BPE file that matter here; other kinds are refused."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    pre = said.get("pre_tokenizer") or {}
    flags = ("single_word", "lstrip", "rstrip", "normalized")
    if (
        said["model"]["type"] != "BPE"
        or pre.get("type") != "ByteLevel"
        or pre.get("add_prefix_space")
        or not pre.get("use_regex", True)
        or said.get("normalizer")
        or any(t.get(f) for t in said["added_tokens"] for f in flags)
    ):
        raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
    return said


def byte_of_symbol() -> dict[str, int]:
    """Byte for each printable stand-in of a byte-level vocabulary.

    Visible Latin-1 characters stand for themselves, the other bytes for U+0100 and on, in order.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def id_type(said: dict) -> str:
    """Smallest unsigned type that holds every id."""
    ids = [*said["model"]["vocab"].values(), *[t["id"] for t in said["added_tokens"]]]
    return "<u2" if max(ids) < 1 << 16 else "<u4"


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    """The library's tokenizer, one per worker and file."""
    # Spark runs one worker per core; threads of the library would only compete with them.
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def library_splitter(path: str) -> Callable[[str], list[str]]:
    """Pre-split by the tokenizers library itself."""
    pre = _tokenizer(path).pre_tokenizer

    def split(text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in pre.pre_tokenize_str(text)]

    return split


@functools.lru_cache(maxsize=2)
def library_encoder(path: str) -> PieceEncoder:
    """Encoder whose ids come from the tokenizers library; one per worker and file."""
    said, tokenizer = read_vocabulary(path), _tokenizer(path)
    dtype = id_type(said)
    dtype_code = "H" if dtype == "<u2" else "I"
    model = tokenizer.model
    symbols = {b: s for s, b in byte_of_symbol().items()}

    def encode_words(words: list[str]) -> list[bytes]:
        # Pre-split words need the model alone. It reads a stand-in per byte; no UTF-8 has the byte FF.
        spelled = b"\xff".join([w.encode() for w in words]).decode("latin-1").translate(symbols)
        tokenize = model.tokenize
        return [array(dtype_code, [t.id for t in tokenize(w)]).tobytes() for w in spelled.split(symbols[0xFF])]

    special = {t["content"]: t["id"] for t in said["added_tokens"]}
    return PieceEncoder(encode_words, library_splitter(path), special, dtype)
