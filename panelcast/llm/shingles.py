"""Hashed word shingles of whole texts, computed for many texts at once with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Texts are hashed in runs of about so many bytes (a longer text is a run of its own).
RUN_BYTES = 1 << 20
_PLACES = 1 << 12
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 1 << 63, _PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves about half of the output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, nulls as empty texts."""
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[ends[0]:ends[-1]], ends - ends[0]


def _word_hashes(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text the number of words before its end."""
    solid = ~_SPACE[raw]
    before = np.empty_like(solid)
    before[0], before[1:] = False, solid[:-1]
    cut = ends[1:-1]
    before[cut[cut < len(raw)]] = False  # a text begins: the byte before belongs to another
    first = solid & ~before
    starts = np.flatnonzero(first)
    at = np.flatnonzero(solid)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(ends), np.int64)
    head = np.flatnonzero(first[at])  # of each word, its first byte's place in ``at``
    lengths = np.diff(np.append(head, len(at)))
    place = np.arange(len(at)) - np.repeat(head, lengths)
    value = _BYTE[_LOWER[raw[at]]] * (_PLACE[place % _PLACES] + (place // _PLACES).astype(np.uint64))
    hashes = np.add.reduceat(value, head)
    return mixed(hashes + lengths.astype(np.uint64)), np.searchsorted(starts, ends)


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles of ``words`` words.

    Words are runs of bytes other than ASCII white space, with A-Z in lower case.  A text
    of fewer words has its whole sequence as its only shingle; one without words has none.
    """
    raw, ends = _buffers(column)
    n, at = len(ends) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + RUN_BYTES, side="right")) - 1)
        part = raw[ends[at]:ends[to]]
        if not len(part):
            yield from (np.empty(0, np.uint64) for _ in range(at, to))
            at = to
            continue
        h, upto = _word_hashes(part, ends[at:to + 1] - ends[at])
        last = max(0, len(h) - words + 1)
        full = sum((h[k:k + last] * _STEP[k] for k in range(words)), np.zeros(last, np.uint64)) if last else h[:0]
        full = mixed(full)
        for k in range(to - at):
            a, b = upto[k], upto[k + 1]
            if b - a >= words:
                s = np.sort(full[a:b - words + 1])
                yield s[np.append(True, s[1:] != s[:-1])]
            elif b > a:
                yield mixed((h[a:b] * _STEP[:b - a]).sum(keepdims=True) + _STEP[32 + b - a])
            else:
                yield h[:0]
        at = to
