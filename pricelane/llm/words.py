"""Words of many texts at once, as positions in one byte buffer and as 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
_random = np.random.default_rng(2)
BYTE = _random.integers(0, 2 ** 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = [np.cumprod(np.r_[np.uint64(1), np.full(1 << 12, BASE)], dtype=np.uint64)]


class Words(NamedTuple):
    letters: np.ndarray  # the bytes of all words in a row
    first: np.ndarray  # where each word starts among the letters
    length: np.ndarray
    bounds: np.ndarray  # of the texts among the words

    def hashes(self) -> np.ndarray:
        if not len(self.first):
            return np.zeros(0, np.uint64)
        longest = int(self.length.max())
        while longest > len(_powers[0]):
            _powers[0] = np.r_[_powers[0], _powers[0] * _powers[0][-1] * BASE]
        place = np.arange(len(self.letters)) - np.repeat(self.first, self.length)
        value = np.add.reduceat(BYTE[self.letters] * _powers[0][place], self.first)
        return mixed(value + self.length.astype(np.uint64) * BYTE[0])


def mixed(value: np.ndarray) -> np.ndarray:
    value = value ^ (value >> np.uint64(32))
    value = value * np.uint64(0xD6E8FEB86659FD93)
    return value ^ (value >> np.uint64(29))


def split(texts: list[bytes], letter: np.ndarray) -> Words:
    """The words of lower-cased texts. letter: by byte, what it counts as in a word; 0 ends a word.
    No word reaches from one text into the next."""
    code = letter[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
    inside = code > 0
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    inside[offsets[1:] - 1] = False
    edge = np.diff(np.r_[False, inside].astype(np.int8))
    starts = np.flatnonzero(edge == 1)
    ends = np.flatnonzero(edge == -1)
    length = ends - starts
    return Words(code[inside], np.cumsum(length) - length, length, np.searchsorted(starts, offsets))


def slices(texts: pa.Array, size: int = SLICE) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, lower-cased texts) for row ranges of about `size` bytes; a longer text stands alone.
    Null counts as empty; only A-Z change."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + size, side="right")))
        yield at, [(t or "").encode("utf-8", "surrogatepass").lower()
                   for t in texts.slice(at, to - at).to_pylist()]
        at = to
