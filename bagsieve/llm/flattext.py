"""Whole Arrow columns of text as flat byte arrays: words, word hashes and n-gram hashes without per-word Python.

All hashes are 64-bit polynomials over randomised byte values, finished by a bijective mixer, so that equal
words give equal hashes on every executor and in every run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; temporaries are a small multiple of this (or of one longer document).
SLICE_BYTES = 500_000

_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def _splitmix(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=_U) * _U(0xD1342543DE82EF95) + _U(seed))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
        return h ^ (h >> _U(31))


_BYTE = _splitmix(256, 77)
_powers = [np.ones(1, _U), np.ones(1, _U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if len(_powers[0]) < n:
        n = max(n, SLICE_BYTES + 1)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, _U)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def separators(chars: bytes) -> np.ndarray:
    """A table that says which byte values separate words."""
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


#: Space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = separators(b" \t\n\x0b\x0c\r")

#: Byte values with A-Z lowered.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its values; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    off = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if column.buffers()[2] is None or not len(off):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in pieces of about ``SLICE_BYTES`` of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        piece = np.cumsum(lengths, dtype=np.int64) // SLICE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def words(data: np.ndarray, off: np.ndarray, sep: np.ndarray = BLANKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for every text the index of its first word (one more at the end)."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~sep[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums, from which the hash of any span follows."""
    sums = np.zeros(len(data) + 1, _U)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[data] * powers(len(data) + 1)[0][: len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans [start, end)."""
    with np.errstate(over="ignore"):
        return mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts] + (ends - starts).astype(_U) * _U(0xA24BAED4963EE407))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words [start, end), made in blocks so that temporaries don't grow with the longest text.

    A word of over ``SLICE_BYTES`` bytes has a digest of its bytes; all others have that of ``span_hashes``.
    """
    out = np.zeros(len(starts), _U)
    at = 0
    while at < len(starts):
        end = int(np.searchsorted(ends, starts[at] + SLICE_BYTES, "right"))
        if end == at:
            digest = hashlib.blake2b(data[starts[at] : ends[at]].tobytes(), digest_size=8).digest()
            out[at], at = int.from_bytes(digest, "little"), at + 1
            continue
        low = int(starts[at])
        out[at:end] = span_hashes(prefix_sums(data[low : ends[end - 1]]), starts[at:end] - low, ends[at:end] - low)
        at = end
    return out


def gram_hashes(hashes: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hash of ``n`` consecutive word hashes from every position where they fit, whatever text they are in."""
    if len(hashes) < n:
        return np.zeros(0, _U)
    out = np.full(len(hashes) - n + 1, (n * 0x632BE59BD9B4E019 + salt) & 0xFFFFFFFFFFFFFFFF, _U)
    factor = 1
    with np.errstate(over="ignore"):
        for k in range(n):
            factor = factor * 0xD6E8FEB86659FD93 % (1 << 64)
            out += hashes[k : len(hashes) - n + 1 + k] * _U(factor)
        return mix(out)


def value_sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums like those of bytes, over 64-bit values such as word hashes."""
    sums = np.zeros(len(values) + 1, _U)
    with np.errstate(over="ignore"):
        np.cumsum(values * powers(len(values) + 1)[0][: len(values)], out=sums[1:])
    return sums


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Whether each value is the least of some ``width`` consecutive ones (winnowing; every tie is chosen)."""
    if len(values) < width:
        return np.zeros(len(values), bool)
    low = _sliding(values, width, np.minimum)
    top = np.zeros(len(low) + 2 * (width - 1), values.dtype)
    top[width - 1 : width - 1 + len(low)] = low
    return _sliding(top, width, np.maximum) == values


def _sliding(values: np.ndarray, width: int, least) -> np.ndarray:
    """The least (or most) of every ``width`` consecutive values, in steps of doubled width."""
    done, out = 1, values
    while done * 2 <= width:
        out = least(out[: len(out) - done], out[done:])
        done *= 2
    rest = width - done
    return least(out[: len(out) - rest], out[rest:]) if rest else out
