"""SimHash near-dedup with bit-sliced comparison.

Fingerprints: words of the text (A-Z lower-cased) in 3-word shingles, repeats included; bit i is 1 if it is set in
over half of the shingles' XXH64.  Links join fingerprints at `RADIUS` or fewer differing bits; components of
links are the groups.

Search, exact at every size: equal fingerprints become one row first.  64 bits are cut into b blocks; two
fingerprints within the radius agree in at least b - RADIUS whole blocks, so each fingerprint goes to one bucket
for every choice of b - RADIUS blocks (b grows with the number of fingerprints, so that buckets stay small).
A bucket beyond `CELL` members is dealt into cells that hold every pair (see `tables.cells`).  Within a
bucket the bit planes are stored vertically (one word holds one bit of 64 fingerprints), and many distances are
counted at once by a saturating carry-save counter; a block of lanes is abandoned once all exceed the radius.
Each bucket sends a spanning forest of its links, never all its pairs.

The pipeline's near-duplicate stage asks for a similarity, 0.8, at which far more bits differ than blocks allow.  There the
fingerprints are of the set of five-word shingles and have 512 bits, buckets are samples of those bits (see `sampled_masks`),
members of a bucket are compared by the same bit planes, and exact Jaccard decides inside what the links connect.

Defined cases: null and empty texts, and texts without a word, have fingerprint zero and link like any other;
fewer than three words are one shingle; repeated rows give repeated results; a null doc_id never
becomes a component id unless its whole component has none; very long texts are read whole; a bit that is set in exactly
half of the hashes is 0; an empty table gives an empty result; other columns are ignored or, in `near_dedup`,
passed on whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import text as tx
from tessera.llm.components import components
from tessera.llm.setjoin import sized, verified
from tessera.llm.tables import bounded_batches, broadcast_if_small, cells, checkpoint, fresh, grouped, released, stored, table
from tessera.llm.xxh import xxh64

SHINGLE = 3
SEED = 42
RADIUS = 3
CELL = 1024


#: Shingles whose bits are counted at a time.
_RUN = 1 << 16


def shingle_spans(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the words of all rows, single spaces between them, and start, end and row of every shingle there."""
    starts, ends, first = tx.words(data, offsets)
    space = tx.SPACE[data]
    kept = ~space
    kept[ends[ends < len(data)]] = True
    to = np.concatenate(([0], np.cumsum(kept)))
    joined = np.where(space, np.uint8(32), tx.LOWER[data])[kept]
    many = np.diff(first)
    count = np.where(many > 0, np.maximum(many - (shingle - 1), 1), 0)
    row = np.repeat(np.arange(len(many)), count)
    one = np.arange(len(row)) + np.repeat(first[:-1] - (np.cumsum(count) - count), count)
    last = np.minimum(one + shingle - 1, first[1:][row] - 1)
    return joined, to[starts[one]], to[ends[last]], row


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each row."""
    joined, start, end, row = shingle_spans(data, offsets, shingle)
    rows = len(offsets) - 1
    ones = np.zeros((rows, 64), dtype=np.int64)
    for at in range(0, len(row), _RUN):
        own = row[at : at + _RUN]
        lo, hi = int(start[at]), int(end[at + len(own) - 1])  # spans are in order
        h = xxh64(joined[lo:hi], start[at : at + _RUN] - lo, end[at : at + _RUN] - lo, SEED)
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        new = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        ones[own[new]] += np.add.reduceat(bits, new, axis=0, dtype=np.int32)
    set_ = 2 * ones > np.bincount(row, minlength=rows)[:, None]
    return np.packbits(set_, axis=1, bitorder="little").view("<u8").ravel() if rows else np.zeros(0, np.uint64)


def _fingerprint_batches(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = tx.strings(batch.column("text"))
        out = [fingerprints_of(part, at, shingle) for _, _, part, at in tx.pieces(data, offsets)]
        fp = np.concatenate([np.zeros(0, np.uint64), *out]).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fp)], names=["id", "fp"])


#: Columns of fingerprints; `links` takes wider ones too.
_WORDS = ["fp", *(f"fp{k}" for k in range(2, 9))]


def fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): the 64 bits as a signed number."""
    bounded_batches(docs.sparkSession)
    make = lambda batches: _fingerprint_batches(batches, shingle)
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("text")).mapInArrow(make, "id bigint, fp bigint")


def block_masks(n: int, radius: int = RADIUS) -> list[int]:
    """Bit masks of the buckets' keys for n fingerprints: b blocks, every choice of b - radius of them.

    Five blocks at least (for radius 3: ten keys of about 26 bits), more where n asks for longer keys.
    """
    b = radius + 2
    while b < radius + 5 and 64 * (b - radius) / b < np.log2(max(n, 2)):
        b += 1
    edge = [round(64 * i / b) for i in range(b + 1)]
    blocks = [((1 << (edge[i + 1] - edge[i])) - 1) << edge[i] for i in range(b)]
    return [sum(pick) for pick in combinations(blocks, b - radius)]


def within(planes_a: np.ndarray, planes_b: np.ndarray, radius: int) -> np.ndarray:
    """Lanes (bits of uint64 words) whose distance is at most radius, from bit planes along axis 0.

    Counter planes hold 64 distances a word and start at 2**planes - 1 - radius, so that the carry out of the last
    plane (kept in a sticky plane) says that a distance exceeds the radius; after every eight bit planes the block is
    abandoned if all lanes have overflowed.
    """
    shape = np.broadcast_shapes(planes_a.shape[1:], planes_b.shape[1:])
    depth = max(int(radius).bit_length(), 1)
    start, full = (1 << depth) - 1 - radius, ~np.uint64(0)
    counter = [np.full(shape, full if start >> d & 1 else 0, dtype=np.uint64) for d in range(depth)]
    over = np.zeros(shape, dtype=np.uint64)
    for k in range(len(planes_a)):
        carry = planes_a[k] ^ planes_b[k]
        for d in range(depth):
            now = counter[d]
            counter[d] = now ^ carry
            carry = now & carry
        over |= carry
        if k % 8 == 7 and k >= radius and (over == full).all():
            return np.zeros(shape, dtype=np.uint64)
    return ~over


def planes_of(fp: np.ndarray) -> np.ndarray:
    """(bits, ceil(n / 64)) of (n, words): word w of plane k holds bit k of fingerprints 64 w ... 64 w + 63."""
    n, size = fp.shape
    bits = np.unpackbits(np.ascontiguousarray(fp).astype("<u8").view(np.uint8).reshape(n, 8 * size), axis=1, bitorder="little")
    lanes = np.zeros((64 * size, -(-n // 64) * 64), dtype=np.uint8)
    lanes[:, :n] = bits.T
    return np.packbits(lanes, axis=1, bitorder="little").view("<u8").astype(np.uint64)


def pairs_within(fp: np.ndarray, bounds: np.ndarray, chunk: np.ndarray, cross: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Positions of a spanning forest of the links within each group [bounds[g], bounds[g + 1]).

    Where cross[g], only pairs of different chunks are compared.
    """
    left, right = [], []
    sizes = np.diff(bounds)
    small = np.flatnonzero((sizes > 1) & (sizes <= 16))
    for m in np.unique(sizes[small]):  # lanes are the pairs of many small groups
        at = bounds[small[sizes[small] == m]]
        i, j = np.triu_indices(int(m), 1)
        a, b = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
        for s in range(0, len(a), 1 << 14):
            x, y = a[s : s + (1 << 14)], b[s : s + (1 << 14)]
            near = within(planes_of(fp[x]), planes_of(fp[y]), radius)
            hit = np.unpackbits(near.astype("<u8").view(np.uint8), bitorder="little")[: len(x)].astype(bool)
            left.append(x[hit])
            right.append(y[hit])
    for g in np.flatnonzero(sizes > 16):
        lo, hi = int(bounds[g]), int(bounds[g + 1])
        a, b = _forest(fp[lo:hi], chunk[lo:hi] if cross[g] else None, radius)
        left.append(a + lo)
        right.append(b + lo)
    empty = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (empty, empty)


def _forest(fp: np.ndarray, chunk: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(fp)
    planes = planes_of(fp)
    parent = np.arange(n)
    out_a, out_b = [], []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    every = ~np.uint64(0)
    for s in range(0, n, 64):
        rows = fp[s : s + 64]
        bit = (rows.T[:, None, :] >> np.arange(64, dtype=np.uint64)[None, :, None]) & np.uint64(1)
        asked = np.where(bit.reshape(-1, len(rows), 1), every, np.uint64(0))
        near = within(asked, planes[:, None, s // 64 :], radius)
        if not near.any():
            continue
        bits = np.unpackbits(near.astype("<u8").view(np.uint8).reshape(len(rows), -1), axis=1, bitorder="little")[:, : n - s]
        i, j = np.nonzero(bits)
        i, j = i + s, j + s
        keep = i < j
        if chunk is not None:
            keep &= chunk[i] != chunk[j]
        for x, y in zip(i[keep].tolist(), j[keep].tolist(), strict=True):
            rx, ry = root(x), root(y)
            if rx != ry:
                parent[max(rx, ry)] = min(rx, ry)
                out_a.append(x)
                out_b.append(y)
    return np.array(out_a, dtype=np.int64), np.array(out_b, dtype=np.int64)


def _compare_batches(batches: Iterator[pa.RecordBatch], radius: int, node: str) -> Iterator[pa.RecordBatch]:
    for t, bounds in grouped(batches, ["bucket", "cell_a", "cell_b"]):
        fp = np.stack([t.column(w).to_numpy().view(np.uint64) for w in _WORDS if w in t.column_names], axis=1)
        chunk = t.column("chunk").to_numpy()
        cross = (t.column("cell_a").to_numpy() != t.column("cell_b").to_numpy())[bounds[:-1]]
        a, b = pairs_within(fp, bounds, chunk, cross, radius)
        name = t.column(node).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(name[a]), pa.array(name[b])], names=["a", "b"])


def links(fps: DataFrame, masks: list[int], radius: int = RADIUS, compared: int = 1, eighth: bool = False) -> DataFrame:
    """(a, b): links between fingerprints (distinct by key, or by fp where there is no key) that connect what the radius connects in the masks' buckets.

    Masks are over all words; the first `compared` words count in distances.  With `eighth`, how large buckets are cut is
    planned from an eighth of the fingerprints; every one is compared.
    """
    words = [w for w in _WORDS if w in fps.columns]
    node = "key" if "key" in fps.columns else "fp"
    cols = list(dict.fromkeys([node, *words[:compared]]))
    signed = lambda m: F.lit(m - (1 << 64) if m >> 63 else m).cast("bigint")
    parts = [F.array(*[signed(m >> 64 * k & (1 << 64) - 1) for k in range(len(words))]) for m in masks]

    def spread(rows: DataFrame) -> DataFrame:
        x = rows.select(*dict.fromkeys([node, *words]), F.posexplode(F.array(*parts)).alias("mask", "m"))
        return x.select(*cols, F.xxhash64("mask", *[F.col(w).bitwiseAND(F.col("m")[k]) for k, w in enumerate(words)]).alias("bucket"))

    some, times = (fps.filter(F.pmod(F.xxhash64(node), F.lit(8)) == 0), 8) if eighth else (fps, 1)
    hot = checkpoint(spread(some).groupBy("bucket").agg((times * F.count("*")).alias("count")).filter(F.col("count") > CELL).select(F.col("bucket").alias("b"), "count"))
    sizes = spread(fps).join(broadcast_if_small(hot), F.col("bucket") == F.col("b"), "left").withColumn("count", F.coalesce("count", F.lit(1)))
    keys = ["bucket", "cell_a", "cell_b"]
    dealt = cells(sizes.select(*cols, "bucket", "count"), "bucket", "count", node, CELL).select(*keys, "chunk", *cols)
    compare = lambda batches: _compare_batches(batches, radius, node)
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "a bigint, b bigint")


def group(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, fp, component): component is the smallest id of the group."""
    prints = checkpoint(fingerprints(docs, text, id_col))
    nodes = prints.groupBy("fp").agg(F.min("id").alias("first"))
    found = components(links(nodes.select("fp"), block_masks(nodes.count())))
    # the smallest id of each component of fingerprints
    named = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", F.coalesce("component", "fp").alias("root"), "first")
    lowest = named.groupBy("root").agg(F.min("first").alias("component"))
    label = named.join(lowest.select(F.col("root").alias("r"), "component"), F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component")
    return prints.join(label, prints["fp"] == label["f"], "left").select("id", "fp", "component")


#: Near-duplicate stages: five-word shingles, similarity 0.8 or more, the recall of a pair just there, words of 64 bits in
#: a fingerprint, and how many of them count in distances.
STAGE_SHINGLE, SIMILARITY, RECALL, STAGE_WORDS, COMPARED = 5, 0.8, 0.96, 8, 2
#: Share of bits that differ in a pair of that similarity: 0.1515 (angle / pi) in large sets, up to 0.1612 in sets of 6 to 30
#: shingles; a set of 5 and one of its subsets of 4, which differ in 0.1875, are linked exactly.
DIFFER = 0.1615
#: Of 128 bits, four deviations above the mean.
STAGE_RADIUS = int(np.ceil(64 * COMPARED * DIFFER + 4 * np.sqrt(64 * COMPARED * DIFFER * (1 - DIFFER))))
#: Shingles whose bits are counted in one byte.
_BYTE = 255


def sample_recall(k: int, bits: int = 64 * STAGE_WORDS, differ: float = DIFFER) -> tuple[np.ndarray, np.ndarray]:
    """Over the distances d of a pair: the probability of d, and that k sampled bits all agree at d.

    The distance differs from pair to pair and decides for all samples, so recall is averaged over it, not over samples.
    """
    d = np.arange(bits + 1)
    logs = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, bits + 1)))))
    chance = np.exp(logs[bits] - logs[d] - logs[bits - d] + d * np.log(differ) + (bits - d) * np.log(1 - differ))
    left = np.maximum(bits - d, k)
    agree = np.where(bits - d >= k, np.exp(logs[left] - logs[left - k] - logs[bits] + logs[bits - k]), 0.0)
    return chance, agree


def sampled_masks(n: int, recall: float = RECALL, seed: int = 5) -> list[int]:
    """Samples of bits of n fingerprints that bring a pair of SIMILARITY together with the recall.

    A sample has log2(n) - 2 bits, so that a bucket holds about four unrelated fingerprints at every size.
    """
    bits = 64 * STAGE_WORDS
    k = int(max(np.ceil(np.log2(max(n, 2))) - 2, 8))
    chance, agree = sample_recall(k)
    tables = 1
    while (chance * (1 - (1 - agree) ** tables)).sum() < recall:
        tables += 1 + tables // 64
    rng = np.random.default_rng(seed)
    return [sum(1 << int(i) for i in rng.choice(bits, k, replace=False)) for _ in range(tables)]


#: For a set of five, the places of each subset of four.
_FOURS = np.array([list(x) for x in combinations(range(5), 4)])


def set_fingerprints(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(texts, STAGE_WORDS): fingerprints of the sets of five-word shingles; fewer words are one shingle, none has zero.

    Then the rows of the sets of five, each five times, and the fingerprints of their subsets of four: more bits than
    DIFFER says differ between such a set and such a subset, but the subset's own fingerprint meets it exactly.
    """
    data, offsets = tx.strings(column)
    out, of, fours = [np.zeros((0, STAGE_WORDS), np.uint64)], [np.zeros(0, np.int64)], [np.zeros((0, STAGE_WORDS), np.uint64)]
    for lo, _, part, at in tx.pieces(data, offsets):
        part = tx.LOWER[part]
        starts, ends, first = tx.words(part, at)
        h = tx.span_hashes(part, starts, ends)
        grams, bounds = tx.ngrams(h, first, STAGE_SHINGLE)
        many = np.diff(first)
        few = np.flatnonzero((many > 0) & (many < STAGE_SHINGLE))
        row = np.concatenate((np.repeat(np.arange(len(many)), np.diff(bounds)), few)).astype(np.uint64)
        grams = np.concatenate((grams, tx.sequence_hashes_at(h, first[few], first[few + 1])))
        packed = np.sort(row << np.uint64(48) | grams >> np.uint64(16))  # a piece has 2**16 rows at most
        packed = packed[np.concatenate(([True], packed[1:] != packed[:-1]))] if len(packed) else packed
        row, h = (packed >> np.uint64(48)).astype(np.int64), packed << np.uint64(16)
        out.append(_majorities(row, h, len(many)))
        begin = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else np.zeros(0, np.int64)
        begin = begin[np.diff(np.concatenate((begin, [len(row)]))) == 5]
        of.append(np.repeat(row[begin] + lo, 5))
        fours.append(_majorities(np.repeat(np.arange(5 * len(begin)), 4), h[(begin[:, None, None] + _FOURS).ravel()], 5 * len(begin)))
    return np.concatenate(out), np.concatenate(of), np.concatenate(fours)


def _majorities(row: np.ndarray, h: np.ndarray, rows: int) -> np.ndarray:
    """Bits that are set in over half of the hashes of a row; rows ascend.

    Eight bits at a time are counted in the bytes of a word, over runs of at most 255 hashes.
    """
    out = np.zeros((rows, STAGE_WORDS), dtype=np.uint64)
    if not len(row):
        return out
    begin = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    size = np.diff(np.concatenate((begin, [len(row)])))
    runs = -(-size // _BYTE)
    of = np.cumsum(runs) - runs
    at = np.repeat(begin, runs) + _BYTE * (np.arange(int(runs.sum())) - np.repeat(of, runs))
    ones = np.empty((len(begin), 8, 8), dtype=np.int64)
    every = np.uint64(0x0101010101010101)
    for w in range(STAGE_WORDS):
        with np.errstate(over="ignore"):
            x = tx.mix64(h + np.uint64((w + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        for bit in range(8):
            sums = np.add.reduceat(x >> np.uint64(bit) & every, at)
            ones[:, :, bit] = np.add.reduceat(sums.astype("<u8").view(np.uint8).reshape(-1, 8), of, axis=0, dtype=np.int64)
        out[row[begin], w] = np.packbits(2 * ones > size[:, None, None], axis=2, bitorder="little").reshape(-1, 8).view("<u8").ravel()
    return out


def _keys(fp: np.ndarray) -> np.ndarray:
    key = np.zeros(len(fp), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for w in range(STAGE_WORDS):
            key = tx.mix64(key * np.uint64(tx.BASE) + fp[:, w])
    return key.view(np.int64)


def near_groups(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(node, component) of the documents that have a near copy; component is the smallest id of the group.

    Fingerprints of the sets of five-word shingles meet in buckets of sampled bits and are compared there, bit-sliced, within
    the radius that a similarity of 0.8 has.  What that connects is a coarse component, in which exact Jaccard decides.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    words = _WORDS[:STAGE_WORDS]

    def hash_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, of, four = set_fingerprints(batch.column(1))
            edges = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(fp)))))
            lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(_keys(four)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_keys(fp)), lists, *(pa.array(np.ascontiguousarray(c).view(np.int64)) for c in fp.T)], names=["id", "key", "fours", *words])

    texts = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("node"), F.col(text).alias("text"))
    prints = stored(texts.mapInArrow(hash_all, ", ".join(["id bigint, key bigint, fours array<bigint>", *(f"{w} bigint" for w in words)])))
    with released(spark):
        nodes = stored(prints.groupBy("key").agg(F.count("*").alias("rows"), *[F.min(w).alias(w) for w in words]))
        near = links(nodes.drop("rows"), sampled_masks(nodes.count()), STAGE_RADIUS, COMPARED, eighth=True)
        subsets = prints.select("key", F.explode("fours").alias("four")).distinct().join(nodes.select(F.col("key").alias("b")), F.col("four") == F.col("b"))
        found = components(near.unionByName(subsets.select(F.col("key").alias("a"), "b")))
    coarse = nodes.join(found, nodes["key"] == found["node"], "left").filter("component is not null or rows > 1")
    coarse = coarse.select(F.col("key").alias("k"), F.coalesce("component", "key").alias("coarse"))
    inside = checkpoint(sized(prints.select("id", "key").join(coarse, F.col("key") == F.col("k")).select(F.col("id").alias("node"), "coarse").distinct()).withColumnRenamed("node", "i"))
    members = texts.join(broadcast_if_small(inside), F.col("node") == F.col("i")).select("coarse", "size", "leader", "node", "text")
    return verified(members, SIMILARITY, STAGE_SHINGLE)


def near_dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One document of each group of near copies, the one with the smallest id, with all its columns.

    Rows with a null id are kept; rows that share an id are one document.
    """
    x_node = fresh(docs, "x_node")[0]
    drop = checkpoint(near_groups(docs, text, id_col).filter("node <> component").select(F.col("node").alias(x_node)))
    return docs.join(broadcast_if_small(drop), docs[id_col] == drop[x_node], "left_anti")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = group(table(spark, sf_dir, "documents"))
    return g.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
