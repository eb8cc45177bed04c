"""Exact Jaccard links within coarse components, in cells of bounded size.

A coarse component (what some hashing scheme connected, unverified) may be small or hold a third of all rows.  Its
members are compared with its leader first; what is left is dealt into cells, each cell computes overlaps from an
inverted index of its own shingles, and sends a spanning forest of the links that reach the threshold: linear in
its members, though every pair that could matter is tested.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import text as tx
from tessera.llm.components import components
from tessera.llm.tables import bitmap, cells, checkpoint, grouped, in_bitmap, stored

#: Members of a cell's chunk at most: where links are counted, and where the rest of a group is verified (small, as the
#: cells of one large group should be dealt evenly).
CELL, SMALL = 256, 128
SHINGLE = 5


def shingle_sets(column: pa.Array | pa.ChunkedArray, n: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct hashes of the n-word shingles (A-Z lower-cased); fewer words are one shingle, none is empty."""
    data, offsets = tx.strings(column)
    out: list[np.ndarray] = []
    for _, _, part, at in tx.pieces(data, offsets):
        part = tx.LOWER[part]
        starts, ends, first = tx.words(part, at)
        h = tx.span_hashes(part, starts, ends)
        grams, bounds = tx.ngrams(h, first, n)
        for i in range(len(first) - 1):
            if bounds[i + 1] > bounds[i]:
                out.append(np.unique(grams[bounds[i] : bounds[i + 1]]))
            elif first[i + 1] > first[i]:
                few = h[first[i] : first[i + 1]]
                with np.errstate(over="ignore"):
                    out.append(tx.mix64(np.array([np.bitwise_xor.reduce(few * (2 * np.arange(len(few), dtype=np.uint64) + np.uint64(3)))], dtype=np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def forest(sets: list[np.ndarray], threshold: float, chunk: np.ndarray | None = None) -> tuple[list[int], list[int]]:
    """Spanning forest of the pairs with Jaccard of at least threshold; with chunk, of pairs in different chunks.

    Two empty sets are equal (similarity 1).
    """
    m = len(sets)
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(m), size)
    flat = np.concatenate(sets) if m else np.zeros(0, np.uint64)
    order = np.argsort(flat, kind="stable")
    sorted_tokens, sorted_owner = flat[order], owner[order]
    new = np.concatenate(([True], sorted_tokens[1:] != sorted_tokens[:-1])) if len(flat) else np.zeros(0, bool)
    group_at = np.flatnonzero(new)
    group_end = np.concatenate((group_at[1:], [len(flat)])) if len(flat) else group_at
    group = np.empty(len(flat), dtype=np.int64)
    group[order] = np.cumsum(new) - 1
    edge = np.concatenate(([0], np.cumsum(size)))
    parent = list(range(m))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    left, right = [], []
    nothing = np.flatnonzero(size == 0)
    for x in range(m):
        if size[x]:
            g = group[edge[x] : edge[x + 1]]
            lo, many = group_at[g], group_end[g] - group_at[g]
            total = int(many.sum())
            if total == len(g):
                continue
            at = np.arange(total) + np.repeat(lo - (np.cumsum(many) - many), many)
            shared = np.bincount(sorted_owner[at], minlength=m)
            near = np.flatnonzero(shared >= threshold * (size + size[x] - shared) - 1e-9)
            near = near[(near < x) & (size[near] > 0)]
        else:
            near = nothing[nothing < x]
        if chunk is not None:
            near = near[chunk[near] != chunk[x]]
        for y in near.tolist():
            a, b = root(x), root(y)
            if a != b:
                parent[max(a, b)] = min(a, b)
                left.append(y)
                right.append(x)
    return left, right


def sized(members: DataFrame, weight: str | None = None) -> DataFrame:
    """members (coarse, node, ...) with the size and the leader of their coarse component, from narrow rows, before any
    text is fetched.  The leader is the node of most weight (of equal ones the least): in a group of edited copies, the
    text that was copied most."""
    w = F.col(weight) if weight else F.lit(0)
    facts = members.groupBy("coarse").agg(F.count("*").alias("size"), F.max(F.struct(w.alias("w"), (-F.col("node")).alias("n"))).alias("top"))
    facts = facts.select(F.col("coarse").alias("c"), "size", (-F.col("top.n")).alias("leader"))
    return members.join(facts, same_coarse()).drop("c")


def same_coarse() -> Column:
    """coarse = c; the second key gives both sides an exchange of their own, so that a large group's rows can be split."""
    return (F.col("coarse") == F.col("c")) & (F.hash("coarse") == F.hash("c"))


def verified(members: DataFrame, threshold: float, shingle: int = SHINGLE) -> DataFrame:
    """(node, component) of members (coarse, size, leader, node, text) whose links reach the threshold exactly.

    Every member is compared with its leader; those that reach it are one component and need no comparison with each
    other.  Only the rest is compared with all, in cells, so a large group of copies of one text costs one comparison a
    member.  Only nodes with a link appear.
    """
    members = stored(members.filter("size > 1").select("coarse", "size", "leader", "node", "text"))
    led = members.filter("node <> leader").join(members.filter("node = leader").select(F.col("coarse").alias("c"), F.col("text").alias("lead")), F.col("coarse") == F.col("c"))

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            leader, node = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            once, of = np.unique(leader, return_index=True)
            own, lead = shingle_sets(batch.column(4), shingle), shingle_sets(batch.column(5).take(pa.array(of)), shingle)
            ok = []
            for x, k in zip(own, np.searchsorted(once, leader).tolist(), strict=True):
                y = lead[k]
                shared = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(shared >= threshold * (len(x) + len(y) - shared) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(leader), pa.array(node), pa.array(ok, pa.bool_())], names=["coarse", "size", "leader", "node", "ok"])

    near = checkpoint(led.select("coarse", "size", "leader", "node", "text", "lead").mapInArrow(follow, "coarse bigint, size bigint, leader bigint, node bigint, ok boolean"))
    stars = near.filter("ok").select(F.col("leader").alias("a"), F.col("node").alias("b"))
    # the rest: members that the leader did not reach, where there is anyone else to compare them with
    rest = near.filter("size > 2").groupBy("coarse").agg(F.count_if(~F.col("ok")).alias("open"), F.count_if("ok").alias("done")).filter("open > 0 and open + done > 1")
    todo = near.join(rest.withColumnRenamed("coarse", "c"), same_coarse())
    opens, dones = (F.ceil(F.col(k) / F.lit(float(SMALL))).cast("int") for k in ("open", "done"))
    todo = todo.withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(7)), F.when(F.col("ok"), dones).otherwise(opens)).cast("int"))
    # cells (i, j >= 0) pair open chunks, cells (i, -1 - j) an open chunk with a chunk of followers
    with_open = F.transform(F.sequence(F.lit(0), opens - 1), lambda k: F.struct(F.least(F.col("chunk"), k).alias("cell_a"), F.greatest(F.col("chunk"), k).alias("cell_b")))
    with_done = F.when(F.col("done") > 0, F.transform(F.sequence(F.lit(0), dones - 1), lambda k: F.struct(F.col("chunk").alias("cell_a"), (-1 - k).alias("cell_b")))).otherwise(F.array().cast("array<struct<cell_a:int,cell_b:int>>"))
    of_done = F.transform(F.sequence(F.lit(0), opens - 1), lambda k: F.struct(k.alias("cell_a"), (-1 - F.col("chunk")).alias("cell_b")))
    todo = todo.select("coarse", "node", "ok", "chunk", F.explode(F.when(F.col("ok"), of_done).otherwise(F.concat(with_open, with_done))).alias("cell"))
    texts = members.select(F.col("coarse").alias("c"), F.col("node").alias("n"), "text")
    keys = ["coarse", "cell_a", "cell_b"]
    dealt = todo.join(texts, (F.col("coarse") == F.col("c")) & (F.col("node") == F.col("n"))).select("coarse", F.col("cell.cell_a").alias("cell_a"), F.col("cell.cell_b").alias("cell_b"), "chunk", "ok", "node", "text")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in grouped(batches, keys):
            node = t.column("node").to_numpy()
            sets = shingle_sets(t.column("text"), shingle)
            one, two = t.column("cell_a").to_numpy(), t.column("cell_b").to_numpy()
            chunk, ok = t.column("chunk").to_numpy(), t.column("ok").to_numpy(zero_copy_only=False)
            a, b = [], []
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                side = ok[lo:hi] if two[lo] < 0 else chunk[lo:hi] if one[lo] != two[lo] else None
                x, y = forest(sets[lo:hi], threshold, side)
                a += [lo + i for i in x]
                b += [lo + i for i in y]
            yield pa.RecordBatch.from_arrays([pa.array(node[a] if a else [], pa.int64()), pa.array(node[b] if b else [], pa.int64())], names=["a", "b"])

    links = dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(check, "a bigint, b bigint")
    return components(links.unionByName(stars))


def _spot(ids: np.ndarray, lines: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return tx.mix64(ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + lines.astype(np.uint64))


def lines_at(docs: DataFrame, wanted: DataFrame, id_col: str, text: str, key_of) -> DataFrame:
    """wanted (at_id, at_line, node, ...) with the text of that line; key_of(column of texts) must give the node.

    A bitmap of the wanted places, of bounded size, goes to the scan, so that hardly more than the wanted lines move.
    The check by key_of drops other lines of rows that share an id, so repeated ids do no harm; a null id is 2**63 - 1.
    """
    last = (1 << 63) - 1

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = _spot(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])

    sent = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select("at_id", "at_line").mapInArrow(spots, "h bigint"), wanted.count()))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            data, offsets = tx.strings(batch.column(1))
            ids = batch.column(0).fill_null(last).to_numpy(zero_copy_only=False)
            for lo, _, part, at in tx.pieces(data, offsets):
                edges, row, number = tx.lines(part, at)
                own = ids[row + lo]
                hit = np.flatnonzero(in_bitmap(table, _spot(own, number)))
                if len(hit):
                    raw = part.tobytes()
                    ends = edges[1:] - (np.append(part, 0)[np.maximum(edges[1:] - 1, 0)] == 10) * (edges[1:] > edges[:-1])
                    texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(edges[hit].tolist(), ends[hit].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(own[hit], pa.int64()), pa.array(number[hit], pa.int32()), pa.array(key_of(pa.array(texts, pa.string())).view(np.int64)), pa.array(texts, pa.string())], names=["f_id", "f_line", "f_key", "text"])

    found = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text).alias("_text")).mapInArrow(fetch, "f_id bigint, f_line int, f_key bigint, text string")
    on = (F.col("f_id") == F.col("at_id")) & (F.col("f_line") == F.col("at_line")) & (F.col("f_key") == F.col("node"))
    return found.join(wanted, on).drop("f_id", "f_line", "f_key").dropDuplicates(["node"])


def linked(members: DataFrame, threshold: float, shingle: int) -> DataFrame:
    """(node, links, low): for each member of (coarse, size, node, text, rank_id, rank_line) with a link of at least the threshold, the
    number of its links and the least rank at their other ends.  Linear output: no pair leaves a task."""
    keys = ["coarse", "cell_a", "cell_b"]
    dealt = cells(members.filter("size > 1"), "coarse", "size", "node", CELL).select(*keys, "chunk", "node", "rank_id", "rank_line", "text")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in grouped(batches, keys):
            node, chunk = t.column("node").to_numpy(), t.column("chunk").to_numpy()
            rank_id, rank_line = t.column("rank_id").to_numpy(), t.column("rank_line").to_numpy()
            sets = shingle_sets(t.column("text"), shingle)
            cross = t.column("cell_a").to_numpy() != t.column("cell_b").to_numpy()
            out_node, out_links, out_id, out_line = [], [], [], []
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                order = np.lexsort((rank_line[lo:hi], rank_id[lo:hi])) + lo
                for x, near in neighbours([sets[i] for i in order], threshold, chunk[order] if cross[lo] else None):
                    low = order[near[0]]
                    out_node.append(int(node[order[x]]))
                    out_links.append(len(near))
                    out_id.append(int(rank_id[low]))
                    out_line.append(int(rank_line[low]))
            yield pa.RecordBatch.from_arrays([pa.array(out_node, pa.int64()), pa.array(out_links, pa.int64()), pa.array(out_id, pa.int64()), pa.array(out_line, pa.int64())], names=["node", "links", "low_id", "low_line"])

    made = dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(check, "node bigint, links bigint, low_id bigint, low_line bigint")
    return made.groupBy("node").agg(F.sum("links").alias("links"), F.min(F.struct("low_id", "low_line")).alias("low"))


def neighbours(sets: list[np.ndarray], threshold: float, chunk: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(x, ascending positions of the other sets that reach the threshold) for each x that has any; sets not empty."""
    m = len(sets)
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(m), size)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    ranked, by = flat[order], owner[order]
    new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    at = np.flatnonzero(new)
    end = np.concatenate((at[1:], [len(flat)]))
    group = np.empty(len(flat), dtype=np.int64)
    group[order] = np.cumsum(new) - 1
    edge = np.concatenate(([0], np.cumsum(size)))
    for x in range(m):
        g = group[edge[x] : edge[x + 1]]
        many = end[g] - at[g]
        total = int(many.sum())
        if total == len(g):
            continue
        k = np.arange(total) + np.repeat(at[g] - (np.cumsum(many) - many), many)
        shared = np.bincount(by[k], minlength=m)
        ok = shared >= threshold * (size + size[x] - shared) - 1e-9
        ok[x] = False
        if chunk is not None:
            ok &= chunk != chunk[x]
        near = np.flatnonzero(ok)
        if len(near):
            yield x, near
