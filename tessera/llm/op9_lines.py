"""Line dedup: exact set-similarity join of lines with prefix, positional and length filters.

A line is the set of its words (A-Z lower-cased).  Words are ordered by rarity: frequencies are counted over all
texts in a table of 2**20 hashed counters (a fixed size; any table gives a correct join, a good one a fast join).
Lines with equal sets become one row.  Two sets of Jaccard t or more share a word among the first
n - ceil(t n) + 1 of each; so each distinct line is posted under 32-bit hashes of those words, and lines that meet there must pass

* the length filter (the smaller set has at least t times the words of the larger; cells are sorted by length, so other
  pairs are never formed),
* the positional filter (the words after the meeting place suffice for the overlap that t asks for),
* a parity filter (each word flips one bit of 64 to 4096, at least 1.3 a word, so that hardly any other pair passes in lines of any
  length; the bits that differ are at most the symmetric difference),

all of which keep every pair that reaches t.  Words that stand once in the whole corpus are posted nowhere.  What passes links lines into coarse groups, in which Jaccard of every pair
is verified on the words themselves, in cells of bounded size.  A frequent word's postings are dealt into cells too.
Cells are compared in passes, each of which writes half of the postings and removes them.
A line goes if a line of Jaccard t or more (an equal set included) stands earlier by (doc_id, line).

Defined cases: null and empty texts and lines without a word have nothing to remove and their documents still
appear; a null doc_id counts as the last document; rows that repeat a doc_id are one document; an empty
table gives an empty result; other columns are passed on by `cut`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import text as tx
from tessera.llm.components import components, solve
from tessera.llm.setjoin import lines_at, linked, sized
from tessera.llm.tables import bitmap, bounded_batches, broadcast_if_small, cells, checkpoint, fresh, grouped, in_bitmap, lent, released, stored, table

SIMILARITY = 0.8
#: Postings of a word that go to one cell: a thousandth of all, but CELL at least and MOST at most (some 50 bytes each).
#: A word beyond that is cut into k chunks, and each of its postings is written k times.
CELL, MOST = 2048, 1 << 14
#: A pass writes half of the postings at most, unless they are few.
PASSES, PASS = 2, 1 << 20
#: Lines of at most so many words have their 128 parity bits folded into 64.
FOLDED = 32
#: Lines of more words than these have 256, 512, 1024, 2048, 4096 bits.
WIDE = (96, 192, 384, 768, 1536)
LAST = (1 << 63) - 1
_BITS, _BLOCK = 20, 1 << 12
#: The level of a counter that has counted one word.
ONCE = 8


def count_words(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Hashed word counters over every text, 2**20 of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << _BITS, dtype=np.int64)
        held: list[np.ndarray] = []
        for batch in batches:
            data, offsets = tx.strings(batch.column(0))
            for _, _, part, at in tx.pieces(data, offsets):
                part = tx.LOWER[part]
                starts, ends, _ = tx.words(part, at)
                held.append((tx.span_hashes(part, starts, ends) >> np.uint64(64 - _BITS)).astype(np.int32))
                if sum(map(len, held)) > 1 << 20:
                    total += np.bincount(np.concatenate(held), minlength=1 << _BITS)
                    held = []
        if held:
            total += np.bincount(np.concatenate(held), minlength=1 << _BITS)
        rows = total.reshape(-1, _BLOCK)
        used = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([rows[k].tobytes() for k in used], pa.binary())], names=["block", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(n, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["block", "n"])

    out = np.zeros((1 << _BITS) // _BLOCK * _BLOCK, dtype=np.int64).reshape(-1, _BLOCK)
    for r in docs.select(F.col(text).alias("t")).mapInArrow(count, "block bigint, n binary").repartition("block").mapInArrow(add, "block bigint, n binary").toLocalIterator():
        out[r["block"]] = np.frombuffer(bytes(r["n"]), np.int64)
    return out.ravel()


def _key(total: np.ndarray, n: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return tx.mix64(total ^ n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def key_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Key of each text's set of words."""
    from tessera.llm.setjoin import shingle_sets

    sets = shingle_sets(column, 1)
    with np.errstate(over="ignore"):
        total = np.array([np.add.reduce(tx.mix64(s)) if len(s) else np.uint64(0) for s in sets], dtype=np.uint64)
    return _key(total, np.array([len(s) for s in sets], dtype=np.int64))


def prefix_sizes(n: np.ndarray, t: float = SIMILARITY) -> np.ndarray:
    return n - np.ceil(t * n - 1e-9).astype(np.int64) + 1


def _order(line: np.ndarray, rank: np.ndarray, h: np.ndarray) -> np.ndarray:
    """By line, then rarity, then hash: one sort of packed keys, unless they can't tell all apart."""
    if line[-1] < 1 << 20:
        packed = (line.astype(np.uint64) << np.uint64(44)) | (rank.astype(np.uint64) << np.uint64(36)) | (h >> np.uint64(28))
        order = np.argsort(packed)
        packed, sorted_h = packed[order], h[order]
        if not ((packed[1:] == packed[:-1]) & (sorted_h[1:] != sorted_h[:-1])).any():
            return order
    return np.lexsort((h, rank, line))


def posted(docs: DataFrame, levels: np.ndarray, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, line, key, n, parity_a, parity_b, wide, prefix) of each line with a word; line -1 marks each row of docs.

    prefix holds the 32-bit hashes of the prefix's words, rarest first, without those that stand once in all texts.
    """
    sent = docs.sparkSession.sparkContext.broadcast(levels)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = sent.value
        one = np.uint64(1)
        seen: set[int] = set()
        for batch in batches:
            data, offsets = tx.strings(batch.column(1))
            ids = batch.column(0)
            rows = batch.num_rows
            nothing = pa.array(np.zeros(rows, np.int64))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(rows, -1), pa.int32()), nothing, pa.array(np.zeros(rows), pa.int32()), nothing, nothing, pa.array([b""] * rows, pa.binary()), pa.array([b""] * rows, pa.binary())], names=_NAMES)
            for lo, _, part, at in tx.pieces(data, offsets):
                edges, row, number = tx.lines(part, at)
                part = tx.LOWER[part]
                starts, ends, first = tx.words(part, edges)
                if not len(starts):
                    continue
                spans = tx.span_hashes(part, starts, ends)
                line = np.repeat(np.arange(len(row)), np.diff(first))
                rank = level[(spans >> np.uint64(64 - _BITS)).astype(np.int64)]
                h = tx.mix64(spans)  # what one-word shingles have, so that fetched lines give the same key
                order = _order(line, rank, h)
                h, line, rank = h[order], line[order], rank[order]
                new = np.ones(len(h), dtype=bool)
                new[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
                h, line, rank = h[new], line[new], rank[new]
                begin = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
                of = line[begin]
                n = np.diff(np.concatenate((begin, [len(h)])))
                with np.errstate(over="ignore"):
                    key = _key(np.add.reduceat(tx.mix64(h), begin), n)
                bit = one << (h & np.uint64(63))
                high = (h >> np.uint64(6)) & one == one
                folded = np.bitwise_xor.reduceat(bit, begin)
                parity_b = np.where(n <= FOLDED, np.uint64(0), np.bitwise_xor.reduceat(np.where(high, bit, np.uint64(0)), begin))
                parity_a = folded ^ parity_b
                wide = _wide(h, n)
                p = np.where(n > 3, prefix_sizes(n), 0)  # up to three words, only equal sets reach 0.8
                # a set that this task has posted is not posted again (what it remembers is bounded)
                fresh = np.zeros(len(key), dtype=bool)
                unique, at_first = np.unique(key, return_index=True)
                fresh[[i for k, i in zip(unique.tolist(), at_first.tolist(), strict=True) if k not in seen]] = True
                if len(seen) > 100_000:
                    seen.clear()
                seen.update(unique.tolist())
                p = np.where(fresh, p, 0)
                bounds = np.concatenate(([0], np.cumsum(p)))
                take = np.arange(bounds[-1]) + np.repeat(begin - bounds[:-1], p)
                often = rank[take] > ONCE
                bounds = np.concatenate(([0], np.cumsum(often)))[bounds]
                lists = _binary((h[take[often]] >> np.uint64(32)).astype("<u4"), bounds)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row[of] + lo)), pa.array(number[of], pa.int32()), pa.array(key.view(np.int64)), pa.array(n, pa.int32()), pa.array(parity_a.view(np.int64)), pa.array(parity_b.view(np.int64)), wide, lists], names=_NAMES)

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("text")).mapInArrow(post, "id bigint, line int, key bigint, n int, parity_a bigint, parity_b bigint, wide binary, prefix binary")


def _wide(h: np.ndarray, n: np.ndarray) -> pa.Array:
    """Parity bits of the long ones among lines of n words with hashes h; short ones have none here."""
    blocks = np.searchsorted(WIDE, n)
    blocks = np.where(blocks > 0, 2 << blocks, 0)
    bounds = np.concatenate(([0], np.cumsum(blocks)))
    out = np.zeros(int(bounds[-1]), dtype=np.uint64)
    long = np.flatnonzero(blocks)
    if len(long):
        many = n[long]
        at = np.arange(many.sum()) + np.repeat((np.cumsum(n) - n)[long] - (np.cumsum(many) - many), many)
        h = h[at]
        np.bitwise_xor.at(out, np.repeat(bounds[long], many) + ((h >> np.uint64(6)).astype(np.int64) & np.repeat(blocks[long] - 1, many)), np.uint64(1) << (h & np.uint64(63)))
    return _binary(out.view("<u4"), 2 * bounds)


def _binary(words: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((4 * bounds).astype("<i4")), pa.py_buffer(words)])


def _words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes in a column of prefixes, and how many each has."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, "<i4")[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw.copy().view("<i4"), np.diff(at) // 4


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_words_of(batch.column(0))[0], pa.int32())], names=["w"])


_NAMES = ["id", "line", "key", "n", "parity_a", "parity_b", "wide", "prefix"]


def passing(n: np.ndarray, at: np.ndarray, pa_: np.ndarray, pb: np.ndarray, i: np.ndarray, j: np.ndarray, t: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j), of compatible lengths, that pass the positional and parity filters."""
    ni, nj = n[i], n[j]
    total = ni + nj
    most = int(total.max(initial=0))
    if most < 1 << 16:  # by table
        need = np.ceil(t / (1 + t) * np.arange(most + 1) - 1e-9).astype(np.int64)[total]
    else:
        need = np.ceil(t / (1 + t) * total - 1e-9).astype(np.int64)
    # a pair with a folded side is compared folded
    one = pa_[i] ^ pa_[j]
    two = pb[i] ^ pb[j]
    both = (ni > FOLDED) & (nj > FOLDED)
    differ = np.where(both, np.bitwise_count(one).astype(np.int64) + np.bitwise_count(two), np.bitwise_count(one ^ two))
    ok = (differ <= total - 2 * need) & (np.minimum(ni - at[i], nj - at[j]) >= need)
    return i[ok], j[ok]


def passing_wide(n: np.ndarray, words: np.ndarray, start: np.ndarray, blocks: np.ndarray, i: np.ndarray, j: np.ndarray, t: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) that pass the parity filter on all bits that both have; blocks of 64 bits from start in words, 0 in short lines."""
    least = np.minimum(blocks[i], blocks[j])
    ok = np.ones(len(i), dtype=bool)
    for w in np.unique(least[least > 0]).tolist():
        for at in np.array_split(np.flatnonzero(least == w), max(1, int((least == w).sum()) * w >> 20)):
            total = n[i[at]] + n[j[at]]
            bits = _folded(words, start, blocks, i[at], w) ^ _folded(words, start, blocks, j[at], w)
            ok[at] = np.bitwise_count(bits).sum(axis=1, dtype=np.int64) <= total - 2 * np.ceil(t / (1 + t) * total - 1e-9).astype(np.int64)
    return i[ok], j[ok]


def _folded(words: np.ndarray, start: np.ndarray, blocks: np.ndarray, x: np.ndarray, w: int) -> np.ndarray:
    """w blocks of each x, whose more blocks are folded."""
    out = words[start[x][:, None] + np.arange(w)]
    for k in range(1, int(blocks[x].max(initial=0)) // w):
        more = np.flatnonzero(blocks[x] > k * w)
        out[more] ^= words[start[x[more]][:, None] + (k * w + np.arange(w))]
    return out


def _once_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each key, of rows in order of their keys."""
    last = None
    for batch in batches:
        if batch.num_rows:
            key = batch.column(0).to_numpy()
            new = np.concatenate(([key[0] != last], key[1:] != key[:-1]))
            last = key[-1]
            yield batch.filter(pa.array(new))


def _post_batches(part: int, parts: int, hot: Broadcast | None):
    """(word, key, meta, parity_a, parity_b, wide) of the prefix words of one pass, and of all that may be in hot.

    meta packs the number of words and the place of this one.
    """

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            words, many = _words_of(batch.column(5))
            row = np.repeat(np.arange(len(many)), many)
            n = batch.column(1).to_numpy().astype(np.int64)
            at = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + (prefix_sizes(n) - many)[row]  # words that stand once come first
            if parts > 1:
                own = words % parts == part
                if hot is not None:
                    own |= in_bitmap(hot.value, words.astype(np.int64).view(np.uint64) << np.uint64(32))
                words, row, at = words[own], row[own], at[own]
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(batch.column(0).to_numpy()[row]), pa.array(n[row] << 31 | at), pa.array(batch.column(2).to_numpy()[row]), pa.array(batch.column(3).to_numpy()[row]), batch.column(4).take(pa.array(row))], names=["word", "key", "meta", "parity_a", "parity_b", "wide"])

    return post


#: Lengths from this on are sorted as equal.
_LONGEST = (1 << 20) - 1
#: Pairs that are filtered at a time.
_PAIRS = 1 << 18


def _meet_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t, bounds in grouped(batches, ["cell"]):
        sizes = np.diff(bounds)
        if (sizes < 2).all():
            continue
        group = np.repeat(np.arange(len(sizes)) << 20, sizes)
        n = t.column("meta").to_numpy() >> 31
        order = np.argsort(group + np.minimum(n, _LONGEST), kind="stable")
        n, group = n[order], group[order]
        at = t.column("meta").to_numpy()[order] & ((1 << 31) - 1)
        key, side = t.column("key").to_numpy()[order], t.column("side").to_numpy()[order]
        a, b = (t.column(c).to_numpy().view(np.uint64)[order] for c in ("parity_a", "parity_b"))
        bits, blocks = _words_of(t.column("wide").combine_chunks().take(pa.array(order)))
        bits, blocks = bits.view(np.uint64), blocks // 2
        begin = np.cumsum(blocks) - blocks
        # partners of i: the rows after it in its cell that are not too long
        end = np.searchsorted(group + np.minimum(n, _LONGEST), group + np.minimum((n / SIMILARITY + 1e-9).astype(np.int64), _LONGEST), "right")
        many = end - np.arange(len(n)) - 1
        upto = np.cumsum(many)
        left, right = [], []
        lo = 0
        while lo < len(n):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + _PAIRS, "right")))
            own = many[lo:hi]
            i = np.repeat(np.arange(lo, hi), own)
            j = np.arange(len(i)) - np.repeat(np.cumsum(own) - own, own) + i + 1
            i, j = passing(n, at, a, b, i, j)
            i, j = passing_wide(n, bits, begin, blocks, i, j)
            ok = (side[i] == 0) | (side[i] != side[j])
            if n[lo:hi].max() >= _LONGEST * SIMILARITY:
                ok &= np.minimum(n[i], n[j]) >= SIMILARITY * np.maximum(n[i], n[j]) - 1e-9
            x, y = key[i[ok]], key[j[ok]]
            if len(x) > 4 * (int(end[hi - 1]) - lo):  # dense: a spanning forest of what passed
                x, y = _spanning(x, y)
            left.append(x)
            right.append(y)
            lo = hi
        x, y = _spanning(np.concatenate(left), np.concatenate(right))
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])


def _spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewer links that connect the same: each node with the least of those it reaches."""
    if not len(a):
        return a, b
    node, least = solve(a, b)
    own = node != least
    return least[own], node[own]


def cell_size(postings: int) -> int:
    return max(CELL, min(postings >> 10, MOST))


def passes(postings: int, more: int) -> int:
    """Passes of so many postings, of which frequent words' are written so many times more."""
    return max(1, -(-(postings + more) // max(PASS, postings // PASSES)))


def judged(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Every line with a word (and line -1 for each row): id, line, keep_id, keep_line, links, removed."""
    spark = docs.sparkSession
    bounded_batches(spark)
    counts = count_words(docs, text)
    levels = np.minimum(np.round(8 * np.log2(counts + 1)), 255).astype(np.uint8)
    rows = stored(posted(docs, levels, text, id_col))
    real = rows.filter("line >= 0")
    posted_rows = real.filter("octet_length(prefix) > 0")
    postings = (posted_rows.agg(F.sum(F.octet_length("prefix"))).first()[0] or 0) // 4
    most = cell_size(postings)
    # only how cells are cut depends on this estimate, by an eighth of the keys; every posting is compared whatever it says
    eighth = posted_rows.filter(F.pmod("key", F.lit(8)) == 0).select("prefix").mapInArrow(_explode, "w int")
    hot = checkpoint(eighth.groupBy("w").agg((8 * F.count("*")).alias("size")).filter(F.col("size") > most))
    hot_words, written = hot.agg(F.count("*"), F.coalesce(F.sum(F.col("size") * (F.ceil(F.col("size") / F.lit(float(most))) - 1)), F.lit(0))).first()
    parts = passes(postings, int(written))
    sent = spark.sparkContext.broadcast(bitmap(hot.select(F.shiftleft(F.col("w").cast("bigint"), 32).alias("h")), hot_words)) if hot_words and parts > 1 else None
    hot = broadcast_if_small(hot)
    met = []
    with released(spark), lent(posted_rows.select("key", "n", "parity_a", "parity_b", "wide", "prefix").repartition("key").sortWithinPartitions("key").mapInArrow(_once_batches, "key bigint, n int, parity_a bigint, parity_b bigint, wide binary, prefix binary")) as once:
        for part in range(parts):
            words = once.mapInArrow(_post_batches(part, parts, sent), "word int, key bigint, meta bigint, parity_a bigint, parity_b bigint, wide binary")
            cell, side = F.col("word").cast("bigint"), F.lit(0).cast("byte")
            if hot_words:
                words = words.join(hot, F.col("word") == F.col("w"), "left").withColumn("size", F.coalesce("size", F.lit(1)))
                words = cells(words, "word", "size", "key", most)
                # a cell of a word that is cut gets a hash: two cells that share one are compared as one, which loses no pair
                cell = F.when(F.col("size") > most, F.xxhash64("word", "cell_a", "cell_b")).otherwise(cell)
                side = F.when(F.col("cell_a") == F.col("cell_b"), 0).when(F.col("chunk") == F.col("cell_b"), 2).otherwise(1).cast("byte")
            dealt = words.select(cell.alias("cell"), "key", "meta", "parity_a", "parity_b", "wide", side.alias("side"))
            dealt = dealt.filter(F.pmod("cell", F.lit(parts)) == part) if hot_words else dealt
            met.append(checkpoint(dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(_meet_batches, "a bigint, b bigint").distinct()))
    with released(spark):
        coarse = checkpoint(components(reduce(DataFrame.union, met)).select(F.col("node").alias("c_key"), F.col("component").alias("coarse")))
    place = F.struct(F.coalesce("id", F.lit(LAST)).alias("id"), F.col("line").cast("bigint").alias("line"))
    distinct = real.groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("rows"))
    wanted = distinct.join(coarse, F.col("key") == F.col("c_key")).select(F.col("first.id").alias("at_id"), F.col("first.line").cast("int").alias("at_line"), F.col("key").alias("node"), "coarse", F.col("first.id").alias("rank_id"), F.col("first.line").alias("rank_line"))
    with released(spark):
        wanted = checkpoint(sized(wanted))
    links = linked(lines_at(docs, wanted, id_col, text, key_of), SIMILARITY, 1)
    facts = distinct.join(links, F.col("key") == F.col("node"), "left").filter("rows > 1 or links is not null")
    low = F.struct(F.col("low.low_id").alias("id"), F.col("low.low_line").alias("line"))
    keep = F.when(F.col("links").isNull(), F.col("first")).otherwise(F.least("first", low))
    with released(spark):
        facts = checkpoint(facts.select(F.col("key").alias("k"), keep.alias("keep"), F.coalesce("links", F.lit(0)).alias("links")))
    out = rows.select("id", "line", "key").join(broadcast_if_small(facts), (F.col("key") == F.col("k")) & (F.col("line") >= 0), "left")
    here = F.struct(F.coalesce("id", F.lit(LAST)).alias("id"), F.col("line").cast("bigint").alias("line"))
    gone = F.coalesce(here > F.col("keep"), F.lit(False))
    return out.select("id", "line", F.when(gone & (F.col("keep.id") != LAST), F.col("keep.id")).alias("keep_id"), F.when(gone, F.col("keep.line")).alias("keep_line"), F.coalesce("links", F.lit(0)).alias("links"), gone.alias("removed"))


def cut(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs with all their columns, their texts without the removed lines."""
    x_id, x_lines = fresh(docs, "x_id", "x_lines")
    gone = checkpoint(judged(docs, text, id_col).filter("removed").groupBy(F.col("id").alias(x_id)).agg(F.collect_set("line").alias(x_lines)))
    x = docs.join(broadcast_if_small(gone), docs[id_col].eqNullSafe(gone[x_id]), "left")
    rest = F.array_join(F.filter(F.split(F.col(text), "\n"), lambda line, i: ~F.array_contains(F.col(x_lines), i)), "\n")
    return x.withColumn(text, F.when(F.col(x_lines).isNull(), F.col(text)).otherwise(rest)).drop(x_id, x_lines)


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: its lines with a word, those removed, links of its lines to other sets, and the
    least document that one of its removed lines repeats."""
    out = judged(table(spark, sf_dir, "documents"))
    line = F.col("line") >= 0
    return out.groupBy(F.col("id").alias("doc_id")).agg(F.count_if(line).alias("n_lines"), F.count_if("removed").alias("n_removed"), F.sum(F.when(line, F.col("links")).otherwise(0)).alias("n_links"), F.min("keep_id").alias("first_doc_id"))


ORACLE = """
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 as no from documents),
s as (select doc_id, no, list_sort(list_distinct(list_filter(regexp_split_to_array(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''))) as w from l),
r as (select * from s where len(w) > 0),
c as (select w, row_number() over (order by w) as c, min({'d': doc_id, 'n': no}) as first, count(*) as rows from r group by w),
t as (select c, first, len(w) as n, unnest(w) as tok from c),
p as (select a.c as x, b.c as y, any_value(b.first) as f from t a join t b on a.tok = b.tok and a.c <> b.c and a.n * 5 >= b.n * 4 and b.n * 5 >= a.n * 4
  group by a.c, b.c, a.n, b.n having count(*) * 9 >= 4 * (a.n + b.n)),
k as (select x, count(*) as links, min(f) as low from p group by x),
j as (select r.doc_id, r.no, coalesce(links, 0) as links, case when low is null or c.first < low then c.first else low end as keep from r join c using (w) left join k on k.x = c.c),
g as (select *, {'d': doc_id, 'n': no} > keep as gone from j)
select d.doc_id, count(g.no) as n_lines, count_if(coalesce(gone, false)) as n_removed, coalesce(sum(links), 0)::bigint as n_links, min(case when gone then keep.d end) as first_doc_id
from (select distinct doc_id from documents) d left join g on g.doc_id = d.doc_id group by d.doc_id
"""
