"""Words of many texts at once: byte scans and rolling hashes in numpy.

A batch of texts is one UTF-8 buffer. Words are found where the class of bytes
changes, and every word is hashed from prefix sums of a polynomial over the
whole buffer, so no text is walked in Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SEGMENT_BYTES = 1 << 20  # text handled at once; longer texts are cut at white space
_P = np.uint64(0x9E3779B97F4A7C15)

SPACE, LETTER, SYMBOL = 0, 1, 2
#: white space, letters and digits (with all bytes beyond ASCII), everything else
KINDS = np.full(256, SYMBOL, np.uint8)
KINDS[[9, 10, 11, 12, 13, 32]] = SPACE
KINDS[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = LETTER
#: white space against the rest
BLANKS = np.where(KINDS == SPACE, SPACE, LETTER).astype(np.uint8)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    held = _powers.get(name)
    if held is None or len(held) < n:
        size = max(n, SEGMENT_BYTES + 2)
        held = np.full(size, base)
        held[0] = 1
        held = np.multiply.accumulate(held)
        if size <= 4 * SEGMENT_BYTES:
            _powers[name] = held
    return held[:n]


@dataclass(frozen=True)
class Segment:
    """Pieces of texts that lie one after another in ``data``."""

    data: np.ndarray
    rows: np.ndarray  # the row of each piece in its batch
    starts: np.ndarray  # where each piece begins in data


def segments(texts: pa.Array, limit: int = SEGMENT_BYTES, whole: bool = False) -> Iterator[Segment]:
    """A column of texts (NULL as empty) in pieces of bounded size, in order.

    With ``whole`` a longer text is one piece.
    """
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        begin = offsets[row]
        last = int(np.searchsorted(offsets, begin + limit, "right")) - 1  # rows before `last` end within the limit
        if last > row:
            yield Segment(data[begin : offsets[last]], np.arange(row, last), offsets[row:last] - begin)
            row = last
            continue
        end = offsets[row + 1]
        while begin < end:
            cut = end if whole else min(begin + limit, end)
            if cut < end:
                blanks = np.flatnonzero(KINDS[data[begin + 1 : cut]] == SPACE)
                cut = begin + 1 + blanks[-1] if len(blanks) else cut
            yield Segment(data[begin:cut], np.array([row]), np.zeros(1, np.int64))
            begin = cut
        row += 1


def spans(segment: Segment, kinds: np.ndarray = KINDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and piece of each word (a run of bytes of one kind other than white space)."""
    data = segment.data
    if len(data) == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    k = kinds[data]
    edge = np.empty(len(k), bool)
    edge[0] = True
    np.not_equal(k[1:], k[:-1], out=edge[1:])
    edge[segment.starts[segment.starts < len(k)]] = True
    starts = np.flatnonzero(edge)
    ends = np.append(starts[1:], len(k))
    held = k[starts] != SPACE
    starts, ends = starts[held], ends[held]
    return starts, ends, np.searchsorted(segment.starts, starts, "right") - 1


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads hashes over all their bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class Hasher:
    """64-bit hashes of any byte ranges of a buffer; another odd ``base`` gives other hashes."""

    def __init__(self, data: np.ndarray, base: int = int(_P)):
        n, down = len(data), np.uint64(pow(base, -1, 1 << 64))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(f"up{base}", np.uint64(base), n), out=self.sums[1:])
        self.inverse = _power(f"down{base}", down, n + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.inverse[starts])
