"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

1. A character trigram model is counted over the whole corpus (one bincount a task, summed by code).
2. Words that look disguised become lattices: leetspeak characters stand for letters, separators between single
   letters and repeats in a run may be dropped, runs of four or more one-character words are read as one word.
   Viterbi decoding, exact, under noise costs plus the character model restores the word.  Words without a letter,
   shorter runs, and words with only doubled letters stay as they are.
3. Restored texts are scored by logistic regression on the set of their words and word stems, hashed.

Model labels come from at most `linear.SAMPLE` labelled rows that are not held out; every row is scored.  Labels,
lang, source and doc_id are no inputs of a score.  Letters are A-Z lower-cased, accents of Latin-1 letters folded.

Defined cases: null and empty texts have the score of the bias alone; a null doc_id is scored and not held out;
repeated rows get equal scores; very long words are decoded whole (time linear in their length); without labels
every score is 0.5; a score at the threshold counts as toxic; an empty table gives an empty result; other columns
play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import linear
from tessera.llm import text as tx
from tessera.llm.tables import bounded_batches, table

BITS = 20
#: Lengths of stems in bytes.
STEMS = (5, 7)
#: A stem is a feature of a text once for each of these numbers of distinct words that it reaches there.
MANY = (1, 2, 4)
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "*": "aeiou",
}
#: Costs in nats: a letter written as leet, a letter repeated in a run, a leet character or a symbol that is only noise.
SUBSTITUTED, REPEATED, DOUBLED, DROPPED, SEPARATOR = 1.0, 0.7, 4.0, 4.0, 0.5
_OPTIONS = {"alpha": 10.0, "l1": 3.0, "l2": 0.01, "epochs": 12}

_SYMBOL = np.zeros(256, dtype=np.int64)  # 1-26 letters, 0 all else
_SYMBOL[97:123] = np.arange(1, 27)
_LETTER = _SYMBOL > 0
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_FOLD = tx.LOWER.copy()  # what follows the byte C3 in Latin-1 letters
for _c in range(0xC0, 0x100):
    _FOLD[0x80 + (_c & 0x3F)] = ord("aaaaaaaceeeeiiiidnooooo*ouuuuypsaaaaaaaceeeeiiiidnooooo/ouuuuypy"[_c - 0xC0])


def fold(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with A-Z lower-cased and Latin-1 letters without accents, and the new row offsets."""
    lead = data == 0xC3
    if not lead.any():
        return tx.LOWER[data], offsets
    out = tx.LOWER[data]
    after = np.flatnonzero(lead[:-1]) + 1
    out[after] = _FOLD[data[after]]
    kept = ~lead
    return out[kept], np.concatenate(([0], np.cumsum(kept)))[offsets]


def count_trigrams(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Counts (27, 27, 27) of character trigrams over every text; 0 stands for any byte that is no letter."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(27**3, dtype=np.int64)
        for batch in batches:
            data, offsets = tx.strings(batch.column(0))
            for _, _, part, at in tx.pieces(data, offsets):
                part, at = fold(part, at)
                s = np.zeros(len(part) + 2, dtype=np.int64)
                s[1:-1] = _SYMBOL[part]
                total += np.bincount(s[:-2] * 729 + s[1:-1] * 27 + s[2:], minlength=27**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["code", "n"])

    bounded_batches(docs.sparkSession)
    out = np.zeros(27**3, dtype=np.float64)
    for r in docs.select(F.col(text).alias("t")).mapInArrow(count, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).collect():  # at most 27**3 rows
        out[r["code"]] = r["n"]
    return out.reshape(27, 27, 27)


def character_costs(counts: np.ndarray) -> np.ndarray:
    """-log p(c | a, b), the trigram estimate smoothed by bigrams."""
    bi = counts.sum(0) + 0.5
    bi /= bi.sum(1, keepdims=True)
    tri = (counts + 5 * bi[None]) / (counts.sum(2, keepdims=True) + 5)
    return -np.log(tri)


def decode(span: str, cost: list) -> str:
    """The likeliest restored word. Viterbi over all states of the last two letters (27 x 27 at most, a few in most words);
    cost[a][b][c] is a nested list."""
    best: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    run = 0
    for i, ch in enumerate(span):
        run = run + 1 if i and span[i - 1] == ch else 1
        letter = "a" <= ch <= "z"
        if letter:
            options = [(ord(ch) - 96, 0.0)]
            skip = (REPEATED if run > 2 or span[i + 1 : i + 2] == ch and run == 2 else DOUBLED) if run > 1 else None
        elif ch in LEET:
            options = [(ord(c) - 96, SUBSTITUTED) for c in LEET[ch]]
            skip = REPEATED if run > 1 else DROPPED
        else:
            options, skip = [], SEPARATOR
        new: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (c0, path) in best.items():
            row = cost[a][b]
            for c, extra in options:
                total = c0 + extra + row[c]
                have = new.get((b, c))
                if have is None or total < have[0]:
                    new[b, c] = (total, (path, c))
            if skip is not None:
                total = c0 + skip
                have = new.get((a, b))
                if have is None or total < have[0]:
                    new[a, b] = (total, path)
        best = new
    _, path = min(((c + cost[a][b][0], p) for (a, b), (c, p) in best.items()), key=lambda x: x[0])
    out = []
    while path:
        path, c = path
        out.append(chr(96 + c))
    return "".join(reversed(out))


def disguised(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Core starts and ends of the words (outer symbols stripped), flags of words to decode, and runs of
    one-character words [from, to)."""
    n = len(data)
    solid = tx.WORDLIKE[data]
    at = np.where(solid, np.arange(n), n)
    following = np.minimum.accumulate(at[::-1])[::-1] if n else at
    previous = np.maximum.accumulate(np.where(solid, np.arange(n), -1))
    lo = np.minimum(following[starts], ends)
    hi = np.maximum(previous[ends - 1] + 1, lo)
    # a short tail or head of leet symbols belongs to the word (a$$, $tupid); longer runs are decoration
    leet = np.isin(data, np.frombuffer(b"@$|+(<", np.uint8)) if n else solid
    tail, head = ends - hi, lo - starts
    hi = np.where((tail > 0) & (tail < 3) & (hi > lo) & leet[np.maximum(ends - 1, 0)], ends, hi)
    lead = leet | (data == 33)
    lo = np.where((head > 0) & (head < 3) & (hi > lo) & lead[starts], starts, lo)
    letters = np.concatenate(([0], np.cumsum(_LETTER[data])))
    odd = np.concatenate(([0], np.cumsum(~_LETTER[data] & (data < 128))))
    twice = np.zeros(n + 1, dtype=np.int64)
    if n > 2:
        twice[3:] = np.cumsum((data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]))
        twice[1:3] = 0
    inner = odd[hi] - odd[lo]
    triple = np.where(hi - lo > 2, twice[hi] - twice[np.minimum(lo + 2, hi)], 0)
    flag = (letters[hi] - letters[lo] > 0) & ((inner > 0) | (triple > 0))
    single = (hi - lo == 1) & solid[np.minimum(lo, max(n - 1, 0))] if len(starts) else np.zeros(0, bool)
    single = single.astype(np.int8)
    inside = np.concatenate(([0], single, [0]))
    rise = np.flatnonzero(np.diff(inside) == 1)
    fall = np.flatnonzero(np.diff(inside) == -1)
    runs = []
    for a, b in zip(rise.tolist(), fall.tolist(), strict=True):  # runs are rare; cut them at row borders
        if b - a >= 4:
            cut = [a, *first[(first > a) & (first < b)].tolist(), b]
            runs += [(x, y) for x, y in zip(cut, cut[1:], strict=False) if y - x >= 4]
    return lo, hi, flag, np.array([x for x, _ in runs], dtype=np.int64), np.array([y for _, y in runs], dtype=np.int64)


def _distinct(row: np.ndarray, stem: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, stem, number of distinct words) for each row and stem; row < 2**17, stem < 2**24, as pieces are cut."""
    key = np.unique((row.astype(np.uint64) << np.uint64(46)) | (stem << np.uint64(22)) | (word >> np.uint64(42)))
    group, count = np.unique(key >> np.uint64(22), return_counts=True)
    return (group >> np.uint64(24)).astype(np.int64), group & np.uint64((1 << 24) - 1), count


class Restored:
    """Features of restored texts; picklable, with a decoder cache for each worker."""

    def __init__(self, cost: np.ndarray):
        self.cost = cost

    def __getstate__(self):
        return {"cost": self.cost}

    def _word(self, span: str) -> bytes:
        memo = self.__dict__.setdefault("memo", {})
        out = memo.get(span)
        if out is None:
            if "table" not in self.__dict__:
                self.table = self.cost.tolist()
            out = decode(span, self.table).encode()
            if len(memo) > 50_000:
                memo.clear()
            if len(span) < 64:
                memo[span] = out
        return out

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes, starts, ends and row of every restored word."""
        data, offsets = fold(data, offsets)
        starts, ends, first = tx.words(data, offsets)
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        lo, hi, flag, run_from, run_to = disguised(data, starts, ends, first)
        plain = ~flag
        extra, extra_row = [], []
        for a, b in zip(run_from.tolist(), run_to.tolist(), strict=True):
            extra.append(self._word(data[lo[a:b]].tobytes().decode("latin-1")))
            extra_row.append(int(row[a]))
            plain[a:b] = flag[a:b] = False
        raw = data.tobytes()
        for k in np.flatnonzero(flag).tolist():
            extra.append(self._word(raw[lo[k] : hi[k]].decode("latin-1")))
            extra_row.append(int(row[k]))
        tail = np.frombuffer(b"".join(extra), np.uint8)
        size = np.fromiter(map(len, extra), np.int64, len(extra))
        at = np.cumsum(size) - size + len(data)
        s, e = np.concatenate((lo[plain], at)), np.concatenate((hi[plain], at + size))
        r = np.concatenate((row[plain], np.array(extra_row, dtype=np.int64)))
        filled = e > s
        return np.concatenate((data, tail)), s[filled], e[filled], r[filled]

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data, s, e, r = self.words(data, offsets)
        h = tx.span_hashes(data, s, e)
        rows, buckets = [r], [h >> np.uint64(64 - BITS)]
        for k, n in enumerate(STEMS):
            long = np.flatnonzero(e - s >= n)
            stem = tx.span_hashes(data, s[long], s[long] + n) >> np.uint64(40)
            row, of, count = _distinct(r[long], stem, h[long])
            for t in MANY:
                enough = count >= t
                rows.append(row[enough])
                buckets.append(tx.mix64(of[enough] * np.uint64(64) + np.uint64(8 * k + t)) >> np.uint64(64 - BITS))
        row, bucket, _ = tx.sparse_rows(np.concatenate(rows), np.concatenate(buckets), BITS)
        return row, bucket, np.ones(len(row))


def classify(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Rows of docs (the columns `keep`, default doc_id) with their score."""
    features = Restored(character_costs(count_trigrams(docs)))
    weights = linear.train(docs, labels, "toxic", features, BITS, **_OPTIONS)
    return linear.score(docs, weights, features, keep=keep)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", linear.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
