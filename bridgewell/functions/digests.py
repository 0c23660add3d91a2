"""First words of the MD5 digests (RFC 1321) of very many short texts, for choosing by digest; hashlib makes the few whole digests that are needed."""

from __future__ import annotations

import hashlib
import math

import numpy as np

LONGEST = 55  # bytes that fit one block of MD5
ORDER = [*range(16), *((5 * i + 1) % 16 for i in range(16)), *((3 * i + 5) % 16 for i in range(16)), *(7 * i % 16 for i in range(16))]
TURNS = [*(7, 12, 17, 22) * 4, *(5, 9, 14, 20) * 4, *(4, 11, 16, 23) * 4, *(6, 10, 15, 21) * 4]
ADDED = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
START = [0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476]
STEPS = 61  # the last three make the other words


class FirstWords:
    """The first words of the digests of prefix + text, as numbers that lie in the order of the digests, for texts (rows of bytes) of one length and prefixes of one length."""

    def __init__(self, texts: np.ndarray, prefix: int, rows: int):
        n, length = texts.shape
        self.whole, self.at = prefix // 4, prefix % 4
        ends = np.zeros((n, -(-(self.at + length + 1) // 4) * 4), np.uint8)
        ends[:, self.at : self.at + length], ends[:, self.at + length] = texts, 0x80
        words = [np.ascontiguousarray(w)[None] for w in ends.view("<u4").astype(np.uint32).T]
        self.head, self.state = words[0], np.empty((5, rows, n), np.uint32)
        self.told = np.zeros((self.whole + 1, rows, 1), np.uint32)  # the words of the prefix
        self.mixed = np.empty((rows, n), np.uint32) if self.at else words[0]  # the word that holds its end and the beginning of the text
        message = [*self.told[: self.whole], self.mixed, *words[1:]]
        message += [0] * (16 - len(message))
        message[14] = 8 * (prefix + length)
        self.calls = self._calls(message)

    def _calls(self, message: list) -> list[tuple]:
        a, b, c, d, t = self.state
        calls, number = [], lambda x: np.array(x & 0xFFFFFFFF, np.uint32)
        for i in range(STEPS):
            if i < 16:
                calls += [(np.bitwise_xor, c, d, t), (np.bitwise_and, t, b, t), (np.bitwise_xor, t, d, t)]
            elif i < 32:
                calls += [(np.bitwise_xor, b, c, t), (np.bitwise_and, t, d, t), (np.bitwise_xor, t, c, t)]
            elif i < 48:
                calls += [(np.bitwise_xor, b, c, t), (np.bitwise_xor, t, d, t)]
            else:
                calls += [(np.invert, d, t), (np.bitwise_or, t, b, t), (np.bitwise_xor, t, c, t)]
            calls.append((np.add, a, t, a))
            m = message[ORDER[i]]
            if isinstance(m, np.ndarray):
                calls.append((np.add, a, m, a))
                m = 0
            calls += [(np.add, a, number(ADDED[i] + m), a), (np.left_shift, a, number(TURNS[i]), t), (np.right_shift, a, number(32 - TURNS[i]), a), (np.bitwise_or, a, t, a), (np.add, a, b, a)]
            a, b, c, d = d, a, b, c
        self.found = b
        return [*calls, (np.add, b, number(START[0]), b)]

    def of(self, prefixes: np.ndarray) -> np.ndarray:
        """A row for each prefix (rows of bytes, `rows` at most)."""
        n = len(prefixes)
        padded = np.zeros((n, 4 * (self.whole + 1)), np.uint8)
        padded[:, : prefixes.shape[1]] = prefixes
        self.told[:, :n, 0] = padded.view("<u4").T
        if self.at:
            np.bitwise_or(self.head, self.told[-1], self.mixed)
        for x, v in zip(self.state, START):
            x.fill(v)
        for f, *given in self.calls:
            f(*given)
        return self.found[:n].byteswap()


def first_words(prefixes: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """The same of texts beyond LONGEST, one by one."""
    return np.array([[int.from_bytes(hashlib.md5(p.tobytes() + x.tobytes()).digest()[:4], "big") for x in texts] for p in prefixes], np.uint32).reshape(len(prefixes), len(texts))
