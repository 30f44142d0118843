"""Hashes of words, and of runs of words or bytes; the key is drawn once a run, so no text can be made to collide.

A word's hash is keyed BLAKE2 of its bytes or, for arrays of texts, tabulated: random values drawn by the key for each place
and byte are added without carry and mixed, so two words are equal with a probability of 2^-64. A run's hash is built by doubling: that of 2 n items mixes those of its halves,
and any other length is covered by two runs of the power of two below it. Unlike a polynomial, whose differences cancel on
sequences such as Thue and Morse's, the mix is not linear.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np

#: Bytes with blanks (tab to carriage return) as spaces; CASELESS has A-Z in lower case too.
PLAIN = bytes(32 if 9 <= b <= 13 else b for b in range(256))
CASELESS = bytes(b + 32 if 65 <= b <= 90 else b for b in PLAIN)
STEP = 1 << 22
BLANK = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
#: The longest words, in bytes, that are hashed by tables.
TABLED = 32
#: Words whose hashes a worker remembers.
REMEMBERED = 400_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that makes hashes look random in all bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def joined(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """A hash of two hashes in this order; salt tells lengths apart."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)
    x ^= x >> np.uint64(32)
    x += b
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def doubled(items: np.ndarray, width: int, have: int = 1) -> np.ndarray:
    """A hash of each run of as many items as the largest power of two up to width; items may be such hashes of runs of `have`."""
    out = items
    while 2 * have <= width:
        out = joined(out[: max(0, len(out) - have)], out[have:], have)
        have *= 2
    return out


def power_below(width: int) -> int:
    return 1 << (width.bit_length() - 1)


def at_places(halves: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    """Hashes of the runs of `width` items that begin at the places; halves: what doubled() gives for that width."""
    return joined(halves[at], halves[at + width - power_below(width)], width)


def windows(items: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` items; empty if there are fewer."""
    n = len(items) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    halves = doubled(items, width)
    return joined(halves[:n], halves[width - power_below(width) :][:n], width)


class Words(dict):
    """Word to hash, remembering what it has seen."""

    def __init__(self, key: bytes):
        super().__init__()
        self.key = key

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        found = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=self.key).digest(), "little")
        return found


class Hashes:
    """The hashes of one run: a key that the driver draws and the tasks are sent."""

    def __init__(self, key: bytes | None = None):
        self.key = key or secrets.token_bytes(16)
        self._words = self._values = self._tables = None

    def __getstate__(self):
        return self.key

    def __setstate__(self, key: bytes):
        self.__init__(key)

    @property
    def values(self) -> np.ndarray:
        """What each byte counts as."""
        if self._values is None:
            self._values = np.frombuffer(b"".join(hashlib.blake2b(bytes([b]), digest_size=8, key=self.key).digest() for b in range(256)), np.uint64)
        return self._values

    def of_bytes(self, text: str) -> np.ndarray:
        return self.values[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]

    def of_words(self, text: str | None, caseless: bool = False) -> np.ndarray:
        """A hash of each word of the text, in order; only space and tab to carriage return part words. Long texts are taken in
        steps that end between words."""
        if self._words is None:
            self._words = Words(self.key)
        out = [np.fromiter(map(self._words.__getitem__, words), np.uint64, len(words)) for words in in_steps((text or "").encode("utf-8", "surrogatepass"), CASELESS if caseless else PLAIN)]
        return np.concatenate(out) if out else np.empty(0, np.uint64)

    @property
    def tables(self) -> np.ndarray:
        """What a byte counts as at each place of a word; the last row is for lengths."""
        if self._tables is None:
            self._tables = np.frombuffer(hashlib.shake_256(b"words" + self.key).digest((TABLED + 1) * 256 * 8), np.uint64)
        return self._tables

    def of_texts_words(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """A hash of each word of each text of an Arrow array, one text after another, and how many words each has. Not the
        hashes of of_words(): these are tabulated. Only a text alone may be longer than STEP; it is taken in steps."""
        raw, sizes = bytes_of_texts(texts)
        ends = np.cumsum(sizes)
        borders = ends[:-1][ends[:-1] < len(raw)]
        out, starts, at = [], [], 0
        while at < len(raw):
            part = raw[at : at + STEP]
            if at + STEP < len(raw):  # up to a blank
                to, wide = at + STEP, 1 << 16
                while to < len(raw) and not len(blank := np.flatnonzero(BLANK[raw[to : to + wide]])):
                    to += wide
                part = raw[at : min(len(raw), to + int(blank[0]) if to < len(raw) else to)]
            solid = ~BLANK[part]
            begins = solid.copy()
            begins[1:] &= ~solid[:-1]
            if not at:
                begins[borders] = solid[borders]
            of_part = np.flatnonzero(begins)
            starts.append(of_part + at)
            out.append(self._tabled(part[solid], np.flatnonzero(begins[solid])))
            at += len(part)
        where = np.concatenate(starts) if starts else np.empty(0, np.int64)
        counts = np.diff(np.searchsorted(where, np.concatenate([[0], ends])))
        return np.concatenate(out) if out else np.empty(0, np.uint64), counts

    def _tabled(self, solid: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Hashes of the words that begin at `first` of their bytes put together."""
        if not len(first):
            return np.empty(0, np.uint64)
        lengths = np.diff(first, append=len(solid))
        place = np.arange(len(solid)) - np.repeat(first, lengths)
        values = self.tables[(np.minimum(place, TABLED - 1) << 8) + solid]
        found = mixed(np.bitwise_xor.reduceat(values, first) ^ self.tables[TABLED * 256 + np.minimum(lengths, 255)])
        for i in np.flatnonzero(lengths > TABLED):
            word = solid[first[i] : first[i] + lengths[i]].tobytes()
            found[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=self.key).digest(), "little")
        return found

    def of_texts_bytes(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """of_bytes() of each text of an Arrow array, one after another, and how many bytes each has."""
        raw, counts = bytes_of_texts(texts)
        return self.values[raw], counts

    def shingle_set(self, text: str | None, width: int = 5) -> np.ndarray:
        """Sorted distinct hashes of the text's word shingles, A-Z lower-cased; a shorter text is one shingle, an empty one none."""
        words = self.of_words(text, caseless=True)
        if not len(words):
            return np.empty(0, np.int64)
        return np.unique(windows(words, min(width, len(words))).view(np.int64))


def bytes_of_texts(texts) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of each text of an Arrow array, one after another, and how many each has."""
    import pyarrow.compute as pc

    raw = b"".join(texts.cast("binary").to_pylist())
    return np.frombuffer(raw, np.uint8), pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)


def in_steps(raw: bytes, table: bytes) -> Iterator[list[bytes]]:
    """Words of the translated bytes, some megabytes at a time; steps end between words."""
    plain = raw.translate(table)
    at = 0
    while at < len(plain):
        to = plain.find(b" ", at + STEP)
        to = len(plain) if to < 0 else to
        yield plain[at:to].split()
        at = to
