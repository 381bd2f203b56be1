"""Numpy kernels over bytes and words of many texts at once.

Nothing here keeps more than a few slices of text in memory: callers cut their input
into slices, and a text longer than a slice into overlapping pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U64 = np.uint64
MULT = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (in a new array)."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def randoms(n: int, seed: int) -> np.ndarray:
    return mix64((np.arange(1, n + 1, dtype=U64) + U64(seed)) * U64(MULT))


BYTE_VALUE, SECOND_VALUE = randoms(256, 12345), randoms(256, 987654321)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def roll(values: np.ndarray, k: int, mult: int = MULT) -> np.ndarray:
    """For each of the len-k+1 runs of k values, their polynomial hash modulo 2**64 (not mixed)."""
    n = len(values)
    if n < k:
        return np.empty(0, U64)
    out, done, power, width = None, 0, values, 1
    while True:
        if k & width:
            if out is None:
                out, done = power, width
            else:
                m = n - (done + width) + 1
                out = out[:m] * U64(pow(mult, width, 1 << 64)) + power[done : done + m]
                done += width
        if done == k:
            return out[: n - k + 1]
        m = len(power) - width
        power = power[:m] * U64(pow(mult, width, 1 << 64)) + power[width : width + m]
        width *= 2


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values; len-w+1 results."""
    n = len(values)
    if n < w:
        return values[:0]
    have, width = values, 1
    while width * 2 <= w:
        have = np.minimum(have[: len(have) - width], have[width:])
        width *= 2
    if width < w:
        have = np.minimum(have[: n - w + 1], have[w - width : w - width + n - w + 1])
    return have


def words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of non-space bytes."""
    inside = np.empty(len(buf) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~_IS_SPACE[buf]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, byte_value: np.ndarray = BYTE_VALUE) -> np.ndarray:
    """A mixed 64-bit hash of each word's bytes; other numbers for the bytes make another hash."""
    if not len(starts):
        return np.empty(0, U64)
    powers = _powers(len(buf))
    sums = np.empty(len(buf) + 1, U64)
    sums[0] = 0
    np.cumsum(byte_value[buf] * powers[0][: len(buf)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * powers[1][starts]
    return mix64(h + (ends - starts).astype(U64))


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """mult**i and its inverse for i < n, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        _POWERS[:] = [_series(MULT, size), _series(pow(MULT, -1, 1 << 64), size)]
    return _POWERS


def _series(base: int, n: int) -> np.ndarray:
    out = np.ones(n, U64)
    if n > 1:
        out[1:] = U64(base)
        np.multiply.accumulate(out, out=out)
    return out


def slices(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of texts of at most ``most`` bytes together, or of one longer text."""
    total = np.concatenate([[0], np.cumsum(lengths)])
    i, n = 0, len(lengths)
    while i < n:
        j = max(i + 1, int(np.searchsorted(total, total[i] + most, "right")) - 1)
        yield i, j
        i = j


def dealt(values: np.ndarray, parts: int, bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted numbers of ``bits`` bits dealt by equal ranges to ``parts``: the parts that get any, and where theirs begin and end.

    The work grows with the numbers, not with the parts.
    """
    part = (((values >> U64(bits - 32)) * U64(parts)) >> U64(32)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])[: len(part)])
    return part[starts], starts, np.append(starts[1:], len(part))[: len(starts)]


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as differences, each in as few bytes as the largest needs."""
    if not len(values):
        return b""
    gaps = np.diff(values)
    width = max(1, -(-int(gaps.max()).bit_length() // 8)) if len(gaps) else 1
    return bytes([width]) + values[:1].tobytes() + gaps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_sorted(blob: bytes) -> np.ndarray:
    if not blob:
        return np.empty(0, U64)
    width = blob[0]
    body = np.frombuffer(blob, np.uint8, offset=9).reshape(-1, width)
    full = np.zeros((len(body) + 1, 8), np.uint8)
    full[0] = np.frombuffer(blob, np.uint8, 8, 1)
    full[1:, :width] = body
    out = full.view(U64).ravel()
    return np.cumsum(out, dtype=U64)


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of an Arrow string column without nulls, copied once if it is in chunks."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if offsets is None or data is None or not n:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def runs(mask_starts: np.ndarray, n: int) -> np.ndarray:
    """Ends of the runs that begin at ``mask_starts`` and fill [0, n)."""
    return np.append(mask_starts[1:], n)


def merge_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open spans, touching ones joined; sorted."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]]))
    return s[new], e[np.append(new[1:], len(s)) - 1]
