"""XXH64 of many byte spans at once (numpy).

Spans are hashed in lanes: all spans of a batch take the same step together, those that are done drop out.
"""

from __future__ import annotations

import numpy as np

# Fixed values of the published algorithm.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, k: int) -> np.ndarray:
    return (x << np.uint64(k)) | (x >> np.uint64(64 - k))


def _round(acc: np.ndarray, v: np.ndarray) -> np.ndarray:
    return _turned(acc + v * _P2, 31) * _P1


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """The hashes of data[starts:ends]; data are bytes."""
    n = len(data)
    padded = np.zeros((n + 23) // 8 * 8, dtype=np.uint8)
    padded[:n] = data
    eights = padded.view("<u8")

    def load(at: np.ndarray) -> np.ndarray:
        """The eight bytes from each place on."""
        word, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
        return (eights[word] >> shift) | ((eights[word + 1] << np.uint64(1)) << (np.uint64(63) - shift))

    size = ends - starts
    with np.errstate(over="ignore"):
        s = np.uint64(seed)
        h = np.full(len(starts), s + _P5, dtype=np.uint64)
        at = starts.copy()
        long = np.flatnonzero(size >= 32)
        if len(long):
            acc = [np.full(len(long), x, dtype=np.uint64) for x in (s + _P1 + _P2, s + _P2, s, s - _P1)]
            place, stripes = at[long], size[long] >> 5
            live = np.arange(len(long))
            for k in range(int(stripes.max())):
                live = live[stripes[live] > k]
                for j in range(4):
                    acc[j][live] = _round(acc[j][live], load(place[live] + 32 * k + 8 * j))
            x = _turned(acc[0], 1) + _turned(acc[1], 7) + _turned(acc[2], 12) + _turned(acc[3], 18)
            for v in acc:
                x = (x ^ _round(np.zeros(1, np.uint64), v)) * _P1 + _P4
            h[long] = x
            at[long] += stripes << 5
        h += size.astype(np.uint64)
        rest = ends - at
        for _ in range(3):  # what is left has under 32 bytes
            live = np.flatnonzero(rest >= 8)
            if not len(live):
                break
            every = len(live) == len(h)
            x = (h if every else h[live]) ^ _round(np.zeros(1, np.uint64), load(at if every else at[live]))
            x = _turned(x, 27) * _P1 + _P4
            if every:
                h, at, rest = x, at + 8, rest - 8
            else:
                h[live] = x
                at[live] += 8
                rest[live] -= 8
        tail = load(at)
        live = np.flatnonzero(rest >= 4)
        if len(live):
            x = h[live] ^ ((tail[live] & np.uint64(0xFFFFFFFF)) * _P1)
            h[live] = _turned(x, 23) * _P2 + _P3
            tail[live] >>= np.uint64(32)
            rest[live] -= 4
        for _ in range(3):
            live = np.flatnonzero(rest > 0)
            if not len(live):
                break
            x = h[live] ^ ((tail[live] & np.uint64(0xFF)) * _P5)
            h[live] = _turned(x, 11) * _P1
            tail[live] >>= np.uint64(8)
            rest[live] -= 1
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        return h ^ (h >> np.uint64(32))
