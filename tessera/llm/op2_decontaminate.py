"""Benchmark decontamination: random-walk embedding, bit samples of windows from every byte, exact edit distance.

The CGK embedding of a text walks over it: each step puts out the byte under the pointer, and a random bit, of that
step and that byte, says whether the pointer moves on.  Two texts a few edits apart walk together again soon after an
edit, so their embeddings differ in few places of the same number.  A window begins at every byte of every document and
at every byte of every item; `REPEATS` samples of the embedding's places are compared, each taken at about half of the
steps, and a window whose sample equals one of an item's is a candidate.

How many places an item's samples have follows from the target: the greatest number at which items of that length,
with all the edits that `SIMILARITY` allows (substitutions, insertions and deletions at random places), are found with
probability `RECALL`.  It is measured by a seeded simulation on random texts of many letters, where nothing meets by
chance.  All samples, of all lengths and repeats, come from one walk over a document.

A candidate's item-sized window is checked by exact edit distance (bit-parallel over the item and over many windows,
start and end free within the slack): a hit has at most (1 - SIMILARITY) x length edits.

Items are used in blocks of at most about `BLOCK` items, whose tables are broadcast (so the broadcast has a bound at any
number of items); every block scans all documents, whole.  There is no shuffle.

Very long texts are scanned whole, in steps of bounded memory.  Texts are compared with A-Z lower-cased and white space collapsed.  Defined cases: null and empty texts hold no
passage; items with fewer than `SHORTEST` bytes after that are found where they stand unedited as whole words; null ids are
passed on; repeated rows are judged alike; an item may be found in any number of documents and a document hold any number
of items, the best place of each (of equally good ones the first that the samples give); items that repeat id and
text are one, equal texts of different ids are reported each; empty tables give an empty result; other columns are ignored or, in `decontaminate`, passed on.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import text as tx
from tessera.llm.tables import bounded_batches, table

SIMILARITY = 0.8
#: Probability that an item with the most edits, at random places, is found.
RECALL = 0.99
#: Samples of a window's embedding, numbers of places that a sample may have, and steps of a walk at most.
REPEATS, SIZES, STEPS = 2, (2, 3, 4, 5, 6, 7, 8, 9, 11, 13, 16, 20, 24), 64
#: Texts of the simulation, letters in them, lengths from which on only one in each step of a scale is simulated, that step.
TRIALS, LETTERS, EACH, GRID = 200, 60, 64, 1.25
SHORTEST = 12
BLOCK = 20_000
STEP, PIECE = 1 << 15, 4 << 20
#: Windows nearer than this part of their item's length are one.
MERGED = 16
#: Windows, for each 64 characters of their item, below which one at a time is faster.
FEW = 6
_FACTOR, _MIX = np.int32(0x01000193), np.uint32(0x9E3779B1)


def _walks() -> tuple[np.ndarray, list[np.ndarray]]:
    """Two words of random bits for each byte (bit t says whether a walk moves on at step t; the words also name the byte),
    and the sampled steps of each repeat: every second one, as a walk often stays a step, the first repeat from step 0 on, so
    that any text has a place in its sample."""
    rng = np.random.default_rng(23)
    word = rng.integers(0, 1 << 32, (2, 256), dtype=np.uint32).view(np.int32)
    return word, [np.arange(r, STEPS, REPEATS) for r in range(REPEATS)]


WORD, SAMPLED = _walks()


def normalise(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A-Z lower-cased, runs of white space as one space, none at the start of a row."""
    n = len(data)
    space = tx.looked_up(tx.SPACE, data)
    before = np.ones(n, dtype=bool)
    before[1:] = space[:-1]
    starts = offsets[:-1]
    before[starts[starts < n]] = True
    kept = ~(space & before)
    out = tx.looked_up(tx.LOWER, data)
    out[space] = 32
    return out[kept], tx.counts(kept)[offsets].astype(np.int64)


def walk(data: np.ndarray, n: int, wanted: dict[int, list[tuple[int, int]]]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(repeat, size, samples, pointers) of walks from each of the first n bytes, where wanted[step] asks for them.

    data must reach `STEPS` bytes further.  A pointer stands at the last byte that its sample has.
    """
    words = [w[data] for w in WORD]
    at = np.arange(n)
    h = [np.zeros(n, dtype=np.int32) for _ in SAMPLED]
    with np.errstate(over="ignore"):
        for t in range(max(wanted, default=-1) + 1):
            v = words[t >> 5].take(at)
            for r in range(REPEATS):
                if _IN[r][t]:
                    h[r] *= _FACTOR
                    h[r] += v
            for r, size in wanted.get(t, ()):
                yield r, size, h[r].view(np.uint32), at
            v >>= t & 31
            v &= 1
            at += v


_IN = [np.isin(np.arange(STEPS), steps) for steps in SAMPLED]


def steps_of(sizes: Iterable[tuple[int, int]]) -> dict[int, list[tuple[int, int]]]:
    """The steps after which samples (repeat, size) are complete."""
    out: dict[int, list[tuple[int, int]]] = {}
    for r, size in sorted(sizes):
        out.setdefault(int(SAMPLED[r][size - 1]), []).append((r, size))
    return out


def slot(h: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (h * _MIX) >> np.uint32(32 - bits)


def whole(raw: bytes, a: int, b: int, lo: int, hi: int) -> bool:
    """Whether raw[a:b] begins and ends no word in its middle, in the row raw[lo:hi]."""
    cut = lambda k: lo < k < hi and tx.WORDLIKE[raw[k - 1]] and tx.WORDLIKE[raw[k]]
    return lo <= a and b <= hi and not cut(a) and not cut(b)


def allowed(m: int) -> int:
    """Edits that an item of m characters may have."""
    return int((1 - SIMILARITY) * m + 1e-9)


def edited(text: list[int], k: int, rng: np.random.Generator) -> list[int]:
    """text with k substitutions, insertions or deletions at different random places."""
    out = list(text)
    for i in sorted(rng.choice(len(text), k, replace=False).tolist(), reverse=True):
        kind = rng.integers(3)
        if kind == 0:
            out[i] = (out[i] + 1 + int(rng.integers(LETTERS - 1))) % LETTERS
        elif kind == 1:
            del out[i]
        else:
            out.insert(i, int(rng.integers(LETTERS)))
    return out


@cache
def simulated(m: int) -> dict[int, float]:
    """For each size of samples the share of items of m letters that are found in spite of all the edits allowed."""
    rng = np.random.default_rng(m)
    items = [rng.integers(0, LETTERS, m).tolist() for _ in range(TRIALS)]
    sides = []
    for texts in (items, [edited(x, math.ceil((1 - SIMILARITY) * m - 1e-9) if m >= EACH else allowed(m), rng) for x in items]):
        size = np.array([len(x) for x in texts])
        data = np.concatenate([*(np.array(x, dtype=np.uint8) + 1 for x in texts), np.zeros(STEPS, np.uint8)]).astype(np.uint8)
        sides.append((data, int(size.sum()), np.repeat(np.arange(TRIALS), size), np.repeat(np.cumsum(size), size)))
    found: dict[int, np.ndarray] = {k: np.zeros(TRIALS, dtype=bool) for k in SIZES}
    wanted = steps_of((r, k) for r in range(REPEATS) for k in SIZES if k <= len(SAMPLED[r]))
    for one, two in zip(*(walk(d, n, wanted) for d, n, _, _ in sides), strict=True):
        keys = []
        for (_, _, h, at), (_, _, trial, end) in zip((one, two), sides, strict=True):
            keys.append((trial.astype(np.uint64) << np.uint64(32) | h)[at < end])
        both = np.intersect1d(*keys)
        trial = sides[0][2][one[3] < sides[0][3]]
        found[one[1]][trial[np.isin(keys[0], both)]] = True
    return {k: float(x.mean()) for k, x in found.items()}


@cache
def sample_size(m: int) -> int:
    """Places in the samples of items of m characters: by the simulation of that length, all of whose items must be found, or
    from `EACH` on of a length not above m (longer items of equal similarity are found more often)."""
    length = float(EACH)
    while length * GRID <= min(m, 1000):
        length *= GRID
    got = simulated(m if m < EACH else int(length))
    size = SIZES[0]
    for k in SIZES:
        if got[k] < (RECALL if m >= EACH else 1):  # the letters of a short item are few, so its windows fail together
            break
        size = k
    return size


class Items:
    """A block of items ready for look-up; picklable."""

    def __init__(self, ids: list, texts: list[str]):
        column = pa.array(texts, pa.large_string())
        data, offsets = normalise(*tx.strings(column))
        self.ids = ids
        raw = data.tobytes()
        self.raw = [raw[offsets[i] : offsets[i + 1]].rstrip() for i in range(len(ids))]
        self.text = [b.decode() for b in self.raw]
        by: dict[tuple[int, int], list[int]] = {}
        ends = [0, *np.cumsum([len(x) for x in self.raw]).tolist()]
        joined = np.frombuffer(b"".join(self.raw) + bytes(STEPS), np.uint8)
        first = {x: k for k, x in reversed(list(enumerate(self.raw)))}
        #: Items equal to one before, by that one.
        self.same: dict[int, list[int]] = {}
        short = []
        for k, x in enumerate(self.raw):
            if not x:
                continue
            if first[x] != k:
                self.same.setdefault(first[x], []).append(k)
            elif len(x) < SHORTEST:
                short.append(k)
            else:
                for r in range(REPEATS):
                    by.setdefault((r, sample_size(len(self.text[k]))), []).append(k)
        #: By (repeat, size): bits of the samples' slots, samples in order, and the item and place of each.
        self.tables: dict[tuple[int, int], tuple] = {}
        parts: dict[tuple[int, int], list[tuple]] = {}
        owner = np.repeat(np.arange(len(self.raw)), np.diff(ends))
        place = np.arange(ends[-1]) - np.repeat(ends[:-1], np.diff(ends))
        end = np.repeat(ends[1:], np.diff(ends))
        for r, size, h, at in walk(joined, ends[-1], steps_of(by)):
            own = np.isin(owner, by[r, size]) & (at < end)
            parts.setdefault((r, size), []).append((h[own], owner[own], place[own]))
        if short:  # from their first byte, as many places as they have
            best: dict[int, tuple] = {}
            starts = np.array([ends[k] for k in short])
            for _, size, h, at in walk(joined, ends[-1], steps_of((0, k + 1) for k in range(len(SAMPLED[0])))):
                for k, s in zip(short, starts.tolist(), strict=True):
                    if at[s] < ends[k + 1]:
                        best[k] = (size, h[s])
            for k, (size, h) in best.items():
                parts.setdefault((0, size), []).append((np.array([h], dtype=np.uint32), np.array([k]), np.array([0])))
        for key, part in parts.items():
            h, item, at = (np.concatenate(x) for x in zip(*part, strict=True))
            order = np.argsort(h, kind="stable")
            bits = min(max(int(np.ceil(np.log2(32 * max(len(h), 1)))), 16), 22) if len(h) < 1 << 19 else min(int(np.ceil(np.log2(8 * len(h)))), 26)
            slots = np.zeros(1 << bits, dtype=bool)
            slots[slot(h, bits)] = True
            self.tables[key] = (np.packbits(slots), h[order], item[order], at[order], bits)

    def open(self) -> None:
        """What is derived once in each worker."""
        if "slots" not in self.__dict__:
            self.slots = {q: np.unpackbits(t[0]).astype(bool) for q, t in self.tables.items()}
            self.wanted = steps_of(self.tables)
            self.masks: dict[int, dict[str, int]] = {}
            self.planes: dict[int, np.ndarray] = {}
            letters = sorted(set().union(*self.text))
            self.letter = {c: i + 1 for i, c in enumerate(letters)}
            self.symbol = np.zeros(0x110000, dtype=np.uint16 if len(letters) < 65535 else np.uint32)
            self.symbol[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("slots", "wanted", "masks", "planes", "letter", "symbol")}

    def search(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(row, item, edits, start) of the best place of every item found in a row; start in normalised bytes."""
        self.open()
        if not self.tables or not len(data):
            return []
        data, offsets = normalise(data, offsets)
        rows, owners, starts = [], [], []
        n = len(data)
        padded = np.concatenate((data, np.zeros(STEPS, np.uint8)))
        for lo in range(0, n, STEP):  # so that all arrays stay in the cache
            for at, last, item, place in self.meetings(padded[lo : lo + STEP + STEPS], min(STEP, n - lo)):
                at = at + lo
                row = np.searchsorted(offsets, at, "right") - 1
                within = last + lo < offsets[row + 1]
                rows.append(row[within])
                owners.append(item[within])
                starts.append((at - place)[within])
        if not rows:
            return []
        row, item, start = np.concatenate(rows), np.concatenate(owners), np.concatenate(starts)
        order = np.lexsort((start, item, row))
        row, item, start = row[order], item[order], start[order]
        new = np.ones(len(row), dtype=bool)
        new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (start[1:] != start[:-1])
        seen = np.stack((row[new], item[new], start[new]))
        raw, best = data.tobytes(), {}
        last: tuple = ()
        todo: list[tuple[int, int, int, int, int]] = []
        for r, k, s in zip(*seen.tolist(), strict=True):
            key = (r, k)
            size = len(self.raw[k])
            if size < SHORTEST:
                if key not in best and whole(raw, s, s + size, int(offsets[r]), int(offsets[r + 1])) and raw[s : s + size] == self.raw[k]:
                    best[key] = (0, s - int(offsets[r]))
                continue
            if key in best or last[:2] == key and s - last[2] < max(1, size // MERGED):
                continue  # a place within the slack of the one before gives the same window
            slack = allowed(len(self.text[k])) + size // MERGED + 4
            lo, hi = max(int(offsets[r]), s - slack), min(int(offsets[r + 1]), s + size + slack)
            if hi <= lo:
                continue
            last = (r, k, s)
            exact = raw.find(self.raw[k], lo, hi)
            if exact >= 0:
                best[key] = (0, exact - int(offsets[r]))
            else:
                todo.append((r, k, s, lo, hi))
        todo = [x for x in todo if x[:2] not in best]
        for (r, k, s, _, _), d in zip(todo, self.edits(data, raw, todo), strict=True):
            if d <= allowed(len(self.text[k])) and ((r, k) not in best or d < best[r, k][0]):
                best[r, k] = (d, max(s - int(offsets[r]), 0))
        found = [(r, k, d, s) for (r, k), (d, s) in best.items()]
        return found + [(r, j, d, s) for r, k, d, s in found for j in self.same.get(k, ())]

    def meetings(self, data: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(windows, their walks' ends, items, places in the items) where a sample of a window from one of the first n bytes is
        an item's."""
        for r, size, h, last in walk(data, n, self.wanted):
            t = self.tables[r, size]
            maybe = np.flatnonzero(self.slots[r, size][slot(h, t[4])])
            lo, hi = np.searchsorted(t[1], h[maybe], "left"), np.searchsorted(t[1], h[maybe], "right")
            many = hi - lo
            k = np.arange(int(many.sum())) + np.repeat(lo - (np.cumsum(many) - many), many)
            if len(k):
                yield np.repeat(maybe, many), np.repeat(last[maybe], many), t[2][k], t[3][k]

    def edits(self, data: np.ndarray, raw: bytes, windows: list[tuple[int, int, int, int, int]]) -> list[int]:
        """Least edit distance of each window's item to any part of it (row, item, start, bytes from, to)."""
        if not windows:
            return []
        before = tx.counts((data & 0xC0) != 0x80)
        symbols = tx.looked_up(self.symbol, np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32))
        item = np.array([w[1] for w in windows])
        lo, hi = (before[[w[k] for w in windows]].astype(np.int64) for k in (3, 4))
        width = np.array([-(-len(self.text[k]) // 64) for k in item])
        out = np.zeros(len(windows), dtype=np.int64)
        for many in np.unique(width).tolist():
            own = np.flatnonzero(width == many)
            for at in range(0, len(own), 4096):
                part = own[at : at + 4096]
                if len(part) < FEW * many:
                    for i in part.tolist():
                        out[i] = self.one(int(item[i]), raw[windows[i][3] : windows[i][4]].decode("utf-8", "ignore"))
                else:
                    which, local = np.unique(item[part], return_inverse=True)
                    eq = np.stack([self.plane(k) for k in which.tolist()])
                    out[part] = least_edits_of(eq, local, np.array([len(self.text[k]) for k in which.tolist()])[local], symbols, lo[part], hi[part])
        return out.tolist()

    def plane(self, k: int) -> np.ndarray:
        """(letter, word): the places of each letter in the item, as bits."""
        have = self.planes.get(k)
        if have is None:
            item = self.text[k]
            have = np.zeros((len(self.letter) + 1, -(-len(item) // 64)), dtype=np.uint64)
            at = np.arange(len(item))
            np.bitwise_or.at(have, ([self.letter[c] for c in item], at // 64), np.uint64(1) << (at % 64).astype(np.uint64))
            if len(self.planes) > 1000:
                self.planes.clear()
            self.planes[k] = have
        return have

    def one(self, k: int, window: str) -> int:
        item = self.text[k]
        eq = self.masks.get(k)
        if eq is None:
            eq = {}
            for i, c in enumerate(item):
                eq[c] = eq.get(c, 0) | 1 << i
            if len(self.masks) > 2000:
                self.masks.clear()
            self.masks[k] = eq
        return least_edits(eq, len(item), window)


def least_edits_of(eq: np.ndarray, item: np.ndarray, m: np.ndarray, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """`least_edits` of many windows symbols[lo:hi] at once, exact where it is `allowed`, else any number above that.

    eq (item, symbol, word) holds bits of places, m the items' lengths.  A window is left when the columns to come can't
    improve what it has, or can't bring it to what is allowed.
    """
    order = np.argsort(lo - hi, kind="stable")  # the longest first, so that those not at their end are a prefix
    lo, size, item, m = lo[order], (hi - lo)[order], item[order], m[order]
    many, words = len(order), eq.shape[2]
    flat, base = np.ascontiguousarray(eq.transpose(2, 0, 1)).reshape(words, -1), item * eq.shape[1]
    up, down = [np.full(many, ~np.uint64(0)) for _ in range(words)], [np.zeros(many, np.uint64) for _ in range(words)]
    last, one, high = ((m - 1) % 64).astype(np.uint64), np.uint64(1), np.uint64(63)
    now, best, most = m.astype(np.int64), m.astype(np.int64), np.array([allowed(x) for x in m.tolist()])
    out = np.empty(many, dtype=np.int64)
    with np.errstate(over="ignore"):
        for c in range(int(size[0]) if many else 0):
            if c % 16 == 15:
                alive = now - (size - c) <= np.minimum(most, best - 1)
                if alive.mean() < 0.9:
                    out[order[~alive]] = best[~alive]
                    lo, size, base, last, now, best, most, order = (x[alive] for x in (lo, size, base, last, now, best, most, order))
                    up, down = [x[alive] for x in up], [x[alive] for x in down]
            n = int(np.searchsorted(-size, -c, "left"))
            if not n:
                break
            at = base[:n] + symbols[lo[:n] + c]
            carry = rise_in = fall_in = None
            for w in range(words):
                e, u, d = flat[w][at], up[w][:n], down[w][:n]
                v = e | d
                x = e & u
                total = x + u
                if w + 1 < words:
                    over = total < x
                if carry is not None:
                    total += carry
                    if w + 1 < words:
                        over |= total < carry
                if w + 1 < words:
                    carry = over.astype(np.uint64)
                h = (total ^ u) | e
                rise = d | ~(h | u)
                fall = u & h
                if w + 1 == words:
                    now[:n] += ((rise >> last[:n]) & one).astype(np.int64) - ((fall >> last[:n]) & one).astype(np.int64)
                    np.minimum(best[:n], now[:n], out=best[:n])
                r, f = rise << one, fall << one
                if w:
                    r |= rise_in
                    f |= fall_in
                rise_in, fall_in = rise >> high, fall >> high
                up[w][:n] = f | ~(v | r)
                down[w][:n] = r & v
    out[order] = best
    return out


def least_edits(eq: dict[str, int], m: int, window: str) -> int:
    mask, top = (1 << m) - 1, 1 << (m - 1)
    up, down, now = mask, 0, m
    best = m
    for c in window:
        e = eq.get(c, 0)
        v = e | down
        h = (((e & up) + up) ^ up) | e
        rise = down | (~(h | up) & mask)
        fall = up & h
        if rise & top:
            now += 1
        elif fall & top:
            now -= 1
            best = min(best, now)
        rise = (rise << 1) & mask
        fall = (fall << 1) & mask
        up = fall | (~(v | rise) & mask)
        down = rise & v
    return best


def blocks(items: DataFrame, text: str = "text", id_col: str = "item_id") -> Iterator[Items]:
    """Blocks of items in turn; each is a bounded part of the table."""
    items = items.select(F.col(id_col).cast("bigint").alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t")).distinct()
    n = -(-items.count() // BLOCK)
    for b in range(n):
        part = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).orderBy("i", "t").collect()
        yield Items([r["i"] for r in part], [r["t"] for r in part])


def contaminations(docs: DataFrame, items: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, item_id, edits, similarity, start): each item found in each row of docs, at its best place."""
    bounded_batches(docs.sparkSession)
    out = None
    for block in blocks(items):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = sent.value
            for batch in batches:
                ids, (data, offsets) = batch.column(0), tx.strings(batch.column(1))
                for lo, _, part, at in tx.pieces(data, offsets, PIECE):
                    hits = own.search(part, at)
                    if hits:
                        r, k, d, s = map(list, zip(*hits, strict=True))
                        size = [len(own.text[i]) for i in k]
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array([lo + i for i in r])), pa.array([own.ids[i] for i in k], pa.int64()), pa.array(d, pa.int32()), pa.array([round(1 - x / y, 6) for x, y in zip(d, size, strict=True)]), pa.array(s, pa.int64())], names=["doc_id", "item_id", "edits", "similarity", "start"])

        part = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(find, "doc_id bigint, item_id bigint, edits int, similarity double, start bigint")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, edits int, similarity double, start bigint")
    return out


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that hold no item, with all their columns."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text)
    for block in blocks(items):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def keep(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = sent.value
            for batch in batches:
                data, offsets = tx.strings(batch.column(at))
                clean = np.ones(batch.num_rows, dtype=bool)
                for lo, _, part, ends in tx.pieces(data, offsets, PIECE):
                    for r, _, _, _ in own.search(part, ends):
                        clean[lo + r] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
