"""Word splitting and hashing over blocks of texts, with numpy.

A word is a run of bytes outside 0x20 and 0x09-0x0D. Words are hashed by XXH64, all short ones of a block together. Hashes of windows of words are
polynomials modulo 2**64 over those, read off one running sum; with such a modulus a polynomial over bytes would collide for long regular words, so it is taken over hashes alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

from . import memory  # noqa: F401

U = np.uint64
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
SUB_BYTES = 1 << 20  # texts hashed at once; bounds the temporary arrays


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _odd(seed: int) -> int:
    return int(mix(np.array([seed], U))[0]) | 1


P1, P2, P3, P4, P5 = (U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))  # fixed values of XXH64
PADDING = 8  # bytes that stand behind the last range, so that eight can be read from any place


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << U(by)) | (x >> U(64 - by))


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number; the last PADDING places have none."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,))


def xxh64(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """XXH64 of each range of bytes. Ranges under 32 bytes are hashed together, longer ones one by one by the library; PADDING bytes follow the last range."""
    size, eight = end - start, eights(data)
    h = (U(seed) + P5) + size.astype(U)
    for k in range(3):
        m = np.flatnonzero((size >= 8 * k + 8) & (size < 32))
        if not len(m):
            break
        h[m] = _turn(h[m] ^ (_turn(eight[start[m] + 8 * k] * P2, 31) * P1), 27) * P1 + P4
    at, left = start + (size & ~7), size & 7
    rest = np.zeros(len(h), U)
    m = np.flatnonzero(left)
    rest[m] = eight[at[m]]
    m = np.flatnonzero(left >= 4)
    h[m] = _turn(h[m] ^ ((rest[m] & U(0xFFFFFFFF)) * P1), 23) * P2 + P3
    rest[m] >>= U(32)
    left = left & 3
    for k in range(3):
        m = np.flatnonzero(left > k)
        h[m] = _turn(h[m] ^ ((rest[m] & U(255)) * P5), 11) * P1
        rest[m] >>= U(8)
    h = (h ^ (h >> U(33))) * P2
    h = (h ^ (h >> U(29))) * P3
    h ^= h >> U(32)
    for i in np.flatnonzero(size >= 32).tolist():
        h[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]], seed)
    return h


def same_bytes(data: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray, start_2: np.ndarray, end_2: np.ndarray) -> np.ndarray:
    """Whether each range of data holds the bytes of its range of the other; PADDING bytes follow the last ranges."""
    size, eight, eight_2 = end - start, eights(data), eights(other)
    same = size == end_2 - start_2
    live, done = np.flatnonzero(same & (size > 0)), 0
    while len(live):
        left = size[live] - done
        keep = np.where(left >= 8, U(0xFFFFFFFFFFFFFFFF), (U(1) << (U(8) * np.minimum(left, 7).astype(U))) - U(1))
        bad = ((eight[start[live] + done] ^ eight_2[start_2[live] + done]) & keep) != 0
        same[live[bad]] = False
        done += 8
        live = live[~bad & (left > 8)]
    return same


class Interned:
    """Byte ranges interned by value in an open-addressed table: a slot for each distinct range, probed in a row from its XXH64, where equal hashes
    stand for equal ranges only if their bytes are equal.

    place: the slot of each range. first: the range that a slot stands for, -1: free.
    """

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray | None = None):
        h = xxh64(data, start, end) if hashes is None else hashes
        slots = 1 << max(4, int(2 * len(h) - 1).bit_length())
        self.data, self.start, self.end = data, start, end
        self.first, self.place = np.full(slots, -1, np.int32), (h & U(slots - 1)).astype(np.int64)
        todo, at = np.arange(len(h)), self.place
        while len(todo):
            free = self.first[at] < 0
            self.first[at[free]] = todo[free]
            own = self.first[at]
            other = np.flatnonzero(own != todo)
            other = other[~((h[own[other]] == h[todo[other]]) & same_bytes(data, start[own[other]], end[own[other]], data, start[todo[other]], end[todo[other]]))]
            todo = todo[other]
            at = (self.place[todo] + 1) & (slots - 1)
            self.place[todo] = at

    def values(self) -> tuple[np.ndarray, list[bytes]]:
        """The slots in use and the bytes of each."""
        used = np.flatnonzero(self.first >= 0)
        raw, k = self.data.tobytes(), self.first[used]
        return used, [raw[i:j] for i, j in zip(self.start[k].tolist(), self.end[k].tolist(), strict=True)]


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64; grows on demand."""

    def __init__(self, seed: int):
        self.base, self.up, self.down = _odd(seed), np.ones(1, U), np.ones(1, U)

    def need(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 1 << 16)
            for name, base in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                x = np.full(n, base, U)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))


WINDOW_POWERS, OTHER_POWERS = Powers(12), Powers(13)
IS_WORD = np.ones(256, bool)
IS_WORD[list(SPACE_BYTES)] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Block:
    """The words of some texts: byte ranges, hashes and the first word of each text."""

    def __init__(self, texts: list[bytes], is_word: np.ndarray = IS_WORD, lower: bool = False):
        self.data = b" " + b" ".join(texts) + b" " * (1 + PADDING)
        a = np.frombuffer(self.data, np.uint8)
        self.bytes = LOWER[a] if lower else a
        inside = is_word[a]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.start, self.end = edges[0::2], edges[1::2]
        at = np.cumsum([1, *(len(t) + 1 for t in texts)])
        self.first = np.searchsorted(self.start, at)
        self.text_of = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def part_hash(self, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
        """Hash of the bytes of each range."""
        return xxh64(self.bytes, start, end, seed)

    def hashes(self, seed: int = 0) -> np.ndarray:
        return self.part_hash(self.start, self.end, seed)


class Windows:
    """Hashes of runs of consecutive words."""

    def __init__(self, words: np.ndarray, powers: Powers = WINDOW_POWERS):
        powers.need(len(words) + 1)
        self.powers, self.sums = powers, np.zeros(len(words) + 1, U)
        np.cumsum(words * powers.up[: len(words)], out=self.sums[1:])

    def at(self, i: np.ndarray, length: int) -> np.ndarray:
        return mix((self.sums[i + length] - self.sums[i]) * self.powers.down[i])


def pieces(texts: list[bytes], most: int = SUB_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes; a longer text stands alone."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def as_bytes(column) -> list[bytes]:
    """An Arrow text column as UTF-8; null gives the empty text."""
    return [b"" if t is None else t.encode() for t in column.to_pylist()]


def buckets(sorted_hashes: np.ndarray, n: int) -> np.ndarray:
    """Where each of n equal ranges of hashes begins, and the end."""
    edges = (np.arange(1, n, dtype=object) * ((1 << 64) // n)).astype(U) if n > 1 else np.zeros(0, U)
    return np.concatenate([[0], np.searchsorted(sorted_hashes, edges), [len(sorted_hashes)]])


def block_count(total_bytes: int, least: int = 64) -> int:
    """Number of blocks for so much text: 4 MB each, growing with the square root to 64 MB, so that what one
    block sends to one bucket stays worth a row."""
    each = min(64 << 20, max(4 << 20, int((1000 * total_bytes) ** 0.5)))
    return max(least, -(-total_bytes // each))
