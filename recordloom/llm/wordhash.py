"""Words, lines and shingles of many texts at once, as numpy arrays over Arrow's string buffers.

All functions work on a slice of an Arrow batch: the UTF-8 bytes of some texts one after another, and
the offsets between them.  Hashes are 64 bits wide; words never reach over the border of two texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
NEWLINES = np.zeros(256, bool)
NEWLINES[0x0A] = True
KEEP_CASE = np.arange(256, dtype=np.uint8)
LOWER = KEEP_CASE.copy()
LOWER[0x41:0x5B] += 32

_BYTE_VALUES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E6C63D0876A9A35
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_POSITION = np.random.default_rng(7).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


class Slice(NamedTuple):
    first: int  #: row of the batch at which this slice begins
    data: np.ndarray  #: UTF-8 bytes
    offsets: np.ndarray  #: one more than there are texts


class Words(NamedTuple):
    hashes: np.ndarray
    starts: np.ndarray  #: byte positions in Slice.data
    ends: np.ndarray
    offsets: np.ndarray  #: first word of each text, and the end

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    @property
    def texts(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a string column (null: empty) into slices of about limit bytes; a longer text is a slice of its own."""
    if column.null_count:
        column = pc.fill_null(column, "")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
        yield Slice(at, raw[ends[at] : ends[stop]], ends[at : stop + 1] - ends[at])
        at = stop


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if size <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


def words(part: Slice, separators: np.ndarray = SPACES, fold: np.ndarray = LOWER) -> Words:
    """Runs of bytes that are no separators; fold maps bytes before they are hashed."""
    data, offsets = part.data, part.offsets
    inside = ~separators[data]
    after = np.zeros(len(data) + 1, bool)
    after[1:] = inside
    after[offsets[:-1]] = False
    starts = np.flatnonzero(inside & ~after[:-1])
    before = np.zeros(len(data) + 1, bool)
    before[:-1] = inside
    before[offsets[1:]] = False
    ends = np.flatnonzero(inside & ~before[1:]) + 1
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[fold[data]] * _power(_BASE, len(data)), out=total[1:])
    h = (total[ends] - total[starts]) * _power(_BASE_INVERSE, len(data) + 1)[starts]
    return Words(mix(h + (ends - starts).astype(np.uint64) * _POSITION[63]), starts, ends, np.searchsorted(starts, offsets))


def shingles(found: Words, n: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of every window of n words; with short, a text of fewer words, but not none, is one window."""
    text = found.texts
    if len(text) >= n:
        h = np.zeros(len(text) - n + 1, np.uint64)
        for k in range(n):
            h += found.hashes[k : k + len(h)] * _POSITION[k]
        whole = text[: len(h)] == text[n - 1 :]
        h, owner = mix(h[whole]), text[: len(h)][whole]
    else:
        h, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if short and len(few := np.flatnonzero((found.counts > 0) & (found.counts < n))):
        more = [mix((found.hashes[a:b] * _POSITION[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))[0] for a, b in zip(found.offsets[few], found.offsets[few + 1], strict=True)]
        h, owner = np.concatenate([h, np.array(more, np.uint64)]), np.concatenate([owner, few])
    return h, owner


def distinct(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, hash) in that order, and how often each occurs."""
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(first)
    return h[at], owner[at], np.diff(np.append(at, len(h)))


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The number of true flags in each text."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
