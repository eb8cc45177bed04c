"""Vectorised tokenising and hashing of Arrow string batches (numpy, whole texts, no per-row Python).

A *piece* is a run of whole rows of about a megabyte; its bytes live in one uint8 array, and words of all its
rows are found, hashed and combined with array operations.  Bytes of white space are x20 and x09-x0D only.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Letters, digits and every byte of a multi-byte character.
WORDLIKE = np.zeros(256, dtype=bool)
WORDLIKE[48:58] = WORDLIKE[65:91] = WORDLIKE[97:123] = WORDLIKE[128:] = True

BASE = 0x100000001B3  # odd, so that it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}
#: Bytes of pieces after which a worker gives its free memory back, and the bytes since it last did.
GIVE_BACK = 1 << 20
_since = 0


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.ones(size, dtype=np.uint64)
        have[1:] = np.uint64(base)
        with np.errstate(over="ignore"):
            have = np.cumprod(have, dtype=np.uint64)
        if size <= 1 << 22:
            _powers[base] = have
    return have[:n]


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def strings(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (from 0) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def trim() -> None:
    """Free memory of this process back to the system: Arrow's, and the C library's where it can."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back:
        give_back(0)


def pieces(data: np.ndarray, offsets: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of whole rows with about `size` bytes.

    After `GIVE_BACK` bytes the worker's free memory goes back to the system: workers live on between stages, and all of an
    executor's count together.
    """
    global _since
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        end = min(end, rows, row + 65536)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end
    _since += len(data)
    if _since >= GIVE_BACK:
        _since = 0
        trim()


def looked_up(table: np.ndarray, at: np.ndarray, step: int = 1 << 17) -> np.ndarray:
    """table[at], a part at a time: numpy turns a whole array of places into 64-bit ones."""
    out = np.empty(len(at), dtype=table.dtype)
    for lo in range(0, len(at), step):
        out[lo : lo + step] = table[at[lo : lo + step]]
    return out


def counts(mask: np.ndarray, step: int = 1 << 17) -> np.ndarray:
    """How many are set before each place, and the end; a part at a time, too."""
    out = np.zeros(len(mask) + 1, dtype=np.int32 if len(mask) < 1 << 31 else np.int64)
    for lo in range(0, len(mask), step):
        part = out[lo + 1 : lo + 1 + step]
        np.cumsum(mask[lo : lo + step], dtype=out.dtype, out=part)
        part += out[lo]
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, and for each row (and the end) the index of its first word."""
    n = len(data)
    space = (data == 32) | (data - np.uint8(9) < 5)
    solid = ~space
    begins, stops = solid.copy(), solid.copy()
    begins[1:] &= space[:-1]
    stops[:-1] &= space[1:]
    inner = offsets[offsets < n]  # words don't reach over the ends of rows
    begins[inner] = solid[inner]
    last = offsets[offsets > 0] - 1
    stops[last] = solid[last]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets)


#: Spans of more bytes are hashed by prefix sums, shorter ones eight bytes at a time.
LONG = 64
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal spans have equal hashes wherever they stand."""
    n = len(data)
    size = ends - starts
    padded = np.zeros((n + 23) // 8 * 8, dtype=np.uint8)
    padded[:n] = data
    eights = padded.view("<u8")
    h = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    at, rest, own = starts, size, None  # own: the spans that have more bytes, None for all
    with np.errstate(over="ignore"):
        while len(at):
            word, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
            v = eights[word] >> shift
            v |= (eights[word + 1] << np.uint64(1)) << (np.uint64(63) - shift)
            v &= _MASKS[np.minimum(rest, 8)]
            x = (h if own is None else h[own]) ^ v
            x *= np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(32)
            if own is None:
                h = x
            else:
                h[own] = x
            more = np.flatnonzero((rest > 8) & (rest <= LONG if own is None else True))
            own = more if own is None else own[more]
            at, rest = at[more] + 8, rest[more] - 8
        long = np.flatnonzero(size > LONG)
        if len(long):
            sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=sums[1:])
            h[long] ^= (sums[ends[long]] - sums[starts[long]]) * powers(INVERSE, n + 1)[starts[long]]
    return mix64(h)


def ngrams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words within a row, and the row boundaries among them."""
    count = np.maximum(np.diff(first) - (n - 1), 0)
    bounds = np.concatenate(([0], np.cumsum(count)))
    total = int(bounds[-1])
    if not total:
        return np.zeros(0, np.uint64), bounds
    at = np.arange(total) + np.repeat(first[:-1] - bounds[:-1], count)
    out = np.zeros(total, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[at + k]
    return mix64(out), bounds


def sparse_rows(row: np.ndarray, bucket: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, bucket) with counts, in order of row; bucket < 2**bits."""
    key, count = np.unique((row.astype(np.int64) << bits) | bucket.astype(np.int64), return_counts=True)
    return key >> bits, key & ((1 << bits) - 1), count


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of the lines (and the end), the row of each line, and its number in the row (as split on x0A)."""
    breaks = np.flatnonzero(data == 10) + 1
    rows = len(offsets) - 1
    of = np.concatenate((np.arange(rows), np.searchsorted(offsets, breaks - 1, "right") - 1))
    at = np.concatenate((offsets[:-1], breaks))
    order = np.lexsort((at, of))
    of, at = of[order], at[order]
    number = np.arange(len(of)) - np.searchsorted(of, of, "left")
    return np.concatenate((at, [len(data)])), of, number


def sequence_hashes(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One hash for the sequence of words of each row."""
    return sequence_hashes_at(h, first[:-1], first[1:])


def sequence_hashes_at(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash for each run of words from starts to ends; equal sequences have equal hashes wherever they stand."""
    n = len(h)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(h * powers(BASE, n), out=sums[1:])
        out = (sums[ends] - sums[starts]) * powers(INVERSE, n + 1)[starts]
        return mix64(out ^ (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
