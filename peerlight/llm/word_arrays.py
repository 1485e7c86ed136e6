"""Words of many texts as slices of one byte array, and their hashes, without a Python loop."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from xxhash import xxh64_intdigest

#: Bytes of text handled at a time (one text at least).
PIECE_BYTES = 1 << 21

# A-Z become lower case; what parts words becomes a blank. A line feed parts texts.
#: Words of digits, letters and all beyond ASCII.
ALPHANUMERIC = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 0x20
    for c in range(256)
)
#: Words of all but ASCII white space.
UNBROKEN = bytes(
    c + 32 if 65 <= c <= 90 else 0x20 if c == 0x20 or 9 <= c <= 13 else c for c in range(256)
)

# The five primes of XXH64.
_P1 = np.uint64(0x9E3779B185EBCA87)
_P2 = np.uint64(0xC2B2AE3D27D4EB4F)
_P3 = np.uint64(0x165667B19E3779F9)
_P4 = np.uint64(0x85EBCA77C2B2AE63)
_P5 = np.uint64(0x27D4EB2F165667C5)


def folded(text: str | None, table: bytes = ALPHANUMERIC) -> bytes:
    """UTF-8 bytes of a text with A-Z lowered and a blank for every byte outside words."""
    return (text or "").encode("utf-8", "surrogatepass").translate(table)


def pieces(texts: list[str | None], table: bytes = ALPHANUMERIC) -> Iterator[tuple[int, list[bytes]]]:
    """Folded texts in consecutive lists of about ``PIECE_BYTES``, with the first one's place."""
    first, held, size = 0, [], 0
    for at, text in enumerate(texts):
        own = folded(text, table)
        if held and size + len(own) > PIECE_BYTES:
            yield first, held
            first, held, size = at, [], 0
        held.append(own)
        size += len(own)
    if held:
        yield first, held


@dataclass
class Slices:
    """Slices ``flat[start:start + length]`` and the text that each belongs to.

    ``flat`` has the words of a text joined by single blanks, and some bytes of padding.
    """

    flat: np.ndarray
    start: np.ndarray
    length: np.ndarray
    text: np.ndarray

    def bytes_of(self, at: int) -> bytes:
        return self.flat[self.start[at] : self.start[at] + self.length[at]].tobytes()

    def _lanes(self, width: int) -> np.ndarray:
        """The ``width`` bytes from every place on, as a little-endian number."""
        return np.ndarray((len(self.flat) - width + 1,), f"<u{width}", self.flat, strides=(1,))

    def hashes(self) -> np.ndarray:
        """XXH64 (seed 0) of every slice."""
        out = np.empty(len(self.start), dtype=np.uint64)
        order = np.argsort(self.length, kind="stable")
        sizes, first = np.unique(self.length[order], return_index=True)
        for size, low, high in zip(sizes.tolist(), first, np.append(first[1:], len(order))):
            rows = order[low:high]
            if size < 32:
                out[rows] = self._short(self.start[rows], size)
            else:
                out[rows] = [xxh64_intdigest(self.bytes_of(i)) for i in rows.tolist()]
        return out

    def _short(self, start: np.ndarray, size: int) -> np.ndarray:
        eight, four = self._lanes(8), self._lanes(4)
        acc = np.full(len(start), _P5 + np.uint64(size))
        at = 0
        while at + 8 <= size:
            acc ^= _turn(eight[start + at] * _P2, 31) * _P1
            acc = _turn(acc, 27) * _P1 + _P4
            at += 8
        if at + 4 <= size:
            acc ^= four[start + at].astype(np.uint64) * _P1
            acc = _turn(acc, 23) * _P2 + _P3
            at += 4
        while at < size:
            acc ^= self.flat[start + at].astype(np.uint64) * _P5
            acc = _turn(acc, 11) * _P1
            at += 1
        acc = (acc ^ (acc >> np.uint64(33))) * _P2
        acc = (acc ^ (acc >> np.uint64(29))) * _P3
        return acc ^ (acc >> np.uint64(32))

    def equal(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the bytes of two slices are equal, for rows of slice numbers."""
        same = self.length[left] == self.length[right]
        eight = self._lanes(8)
        at, open_ = 0, np.flatnonzero(same)
        while open_.size:
            rest = self.length[left[open_]] - at
            open_ = open_[rest > 0]
            rest = np.minimum(rest[rest > 0], 8).astype(np.uint64)
            a = eight[self.start[left[open_]] + at]
            b = eight[self.start[right[open_]] + at]
            differ = (a ^ b) << (np.uint64(64) - np.uint64(8) * rest) != 0
            same[open_[differ]] = False
            open_, at = open_[~differ], at + 8
        return same


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def word_runs(texts: list[bytes], least: int = 1, most: int = 1) -> tuple[Slices, np.ndarray]:
    """All runs of ``least`` to ``most`` words of folded texts, and each text's word count."""
    raw = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
    word = (raw != 0x20) & (raw != 0x0A)
    # The first byte behind a word stays as the blank between two words.
    kept = word.copy()
    kept[1:] |= word[:-1]
    line = np.cumsum(raw == 0x0A)[kept]  # a word lies before its own line feed
    inside = word[kept]
    flat = np.where(inside, raw[kept], np.uint8(0x20))
    edge = np.diff(np.r_[False, inside, False].astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    text = line[start] if len(start) else np.zeros(0, dtype=np.int64)
    starts, lengths, owners = [], [], []
    for n in range(least, most + 1):
        count = max(0, len(start) - n + 1)
        whole = text[:count] == text[n - 1 : n - 1 + count]
        starts.append(start[:count][whole])
        lengths.append((end[n - 1 : n - 1 + count] - start[:count])[whole])
        owners.append(text[:count][whole])
    flat = np.concatenate([flat, np.full(8, 0x20, dtype=np.uint8)])
    slices = Slices(flat, np.concatenate(starts), np.concatenate(lengths), np.concatenate(owners))
    return slices, np.bincount(text, minlength=len(texts))


def shingle_hashes(texts: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all runs of ``shingle`` words of folded texts, and how many each text has.

    A text of fewer words has one, of all its words; one without words has none.
    """
    slices, n_words = word_runs(texts)
    word, text = slices.hashes(), slices.text
    count = max(0, len(word) - shingle + 1)
    whole = np.flatnonzero(text[:count] == text[shingle - 1 : shingle - 1 + count])
    hashes, owners = [_mixed(word, whole, shingle)], [text[whole]]
    first = np.r_[0, np.cumsum(n_words)[:-1]] if len(n_words) else n_words
    for few in range(1, shingle):
        mine = np.flatnonzero(n_words == few)
        hashes.append(_mixed(word, first[mine], few))
        owners.append(mine)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(hashes)[order], np.bincount(owner, minlength=len(texts))


def _mixed(word: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    acc = np.full(len(at), _P5 + np.uint64(size))
    for i in range(size):
        acc ^= _turn(word[at + i] * _P2, 31) * _P1
        acc = _turn(acc, 27) * _P1 + _P4
    acc = (acc ^ (acc >> np.uint64(33))) * _P2
    acc = (acc ^ (acc >> np.uint64(29))) * _P3
    return acc ^ (acc >> np.uint64(32))
