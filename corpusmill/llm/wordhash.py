"""Words, word hashes and word n-gram hashes of many texts at once, in numpy.

A word is a run of bytes other than 0x20 and 0x09-0x0D of the UTF-8 text. All hashes are 64-bit
polynomial sums with fixed odd multipliers, finished by a bijective mix, so equal words and equal
n-grams hash alike in every worker.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

MASK = (1 << 64) - 1
BASE, STEP = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1
#: Bytes of text that are hashed together; a longer text goes alone.
CHUNK = 1 << 18

_space = np.zeros(256, bool)
_space[[0x20, 9, 10, 11, 12, 13]] = True
_same = np.arange(256)
_lower = np.where((_same >= 65) & (_same <= 90), _same + 32, _same)
_letter = np.zeros(256, bool)
_letter[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_table = mix((_same + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64, n of them at least."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        step = np.full(max(n, CHUNK + 64), base, np.uint64)
        step[0] = 1
        have = _powers[base] = np.multiply.accumulate(step)
    return have


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


class Words:
    """The words of some texts: hash, byte span, and the range of words of each text.

    lower: A-Z are hashed as a-z. letters: words are runs of letters and digits instead (of ASCII, and all else
    beyond ASCII), and Latin-1 letters are lower-cased too.
    """

    def __init__(self, texts: list[bytes], lower: bool = False, letters: bool = False):
        buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        inside = _letter[buf] if letters else ~_space[buf]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside))))
        self.start, self.end = edge[::2], edge[1::2]
        if letters:
            capital = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E)) + 1
            buf = _lower[buf]
            buf[capital] += 32
        value = _table[_lower[buf] if lower else buf] * powers(BASE, len(buf))[: len(buf)]
        self.total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)))
        self.back = powers(inverse(BASE), len(buf))
        self.hash = self.spans(self.start, self.end)
        offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.first = np.searchsorted(self.start, offsets)

    def spans(self, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
        """The hashes of spans of bytes."""
        return mix((self.total[end] - self.total[start]) * self.back[start] + np.uint64(salt))

    def grams(self, n: int) -> np.ndarray:
        """The hash of words i to i+n-1, for each i with so many words after it; texts may be crossed."""
        if len(self.hash) < n:
            return np.zeros(0, np.uint64)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.hash * powers(STEP, len(self.hash))[: len(self.hash)], dtype=np.uint64)))
        back = powers(inverse(STEP), len(self.hash))
        return mix((total[n:] - total[:-n]) * back[: len(total) - n])


def chunks(texts: list, size: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts as bytes) in groups of about size bytes; null is an empty text."""
    group, first, held = [], 0, 0
    for i, t in enumerate(texts):
        b = t.encode("utf-8", "surrogatepass") if t is not None else b""
        if group and held + len(b) > size:
            yield first, group
            group, first, held = [], i, 0
        group.append(b)
        held += len(b) + 1
    if group:
        yield first, group
