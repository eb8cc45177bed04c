"""Helpers on DataFrames shared by the operators: input tables, checkpoints, bounded broadcasts, cells of hot groups."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import text as tx
from tessera.operators.lineage import checkpoint, folder

#: Rows of a side that may be broadcast after its size was counted; beyond it the join shuffles.
BROADCAST_ROWS = 100_000


#: Rows and bytes of an Arrow batch where the session leaves the defaults: a batch of long texts stays small in workers.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches where the session has not set its own; they only bound the memory of Python workers."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if spark.conf.get(key, None) is None:  # None: not set by anyone
            spark.conf.set(key, str(value))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df doesn't have, whatever its columns are called (Spark ignores case)."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        made = f"_{name}"
        while made.lower() in have:
            made += "_"
        out.append(made)
    return out


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet under the shared checkpoint folder and read back: columnar and compressed, for tables that
    are read more than once."""
    from uuid import uuid4

    path = f"{folder(df.sparkSession)}/stored-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def lent(df: DataFrame) -> Iterator[DataFrame]:
    """Like `stored`, but the files go at the end of the block: for tables that are large and used within it only."""
    spark = df.sparkSession
    out = stored(df)
    try:
        yield out
    finally:
        for name in {f.rpartition("/")[0] for f in out.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Inside, shuffle files go as soon as the execution that wrote them ends, not when the driver happens to collect
    its garbage.  For tables that are made and written inside; not for a `toLocalIterator`, which reads on after that."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def lower_az(text: Column) -> Column:
    """A-Z only to a-z; other letters stay. Pure ASCII takes the faster built-in, which does the same there."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


#: Positions of a `key_filter`: 2**29 bits, so that what is broadcast has at most 64 MB.
POSITIONS, _PAGE = 1 << 29, 1 << 15


def key_filter(keys: DataFrame, names: list[str]) -> DataFrame:
    """Pages of a bitmap of the keys' hashes (page, bits), of bounded size, by built-in functions only."""
    at = _position(names)
    pages = keys.select(F.shiftright(at, 15).alias("page"), (at.bitwiseAND(_PAGE - 1)).alias("bit"))
    return pages.groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits"))


def _position(names: list[str]) -> Column:
    return F.pmod(F.xxhash64(*names), F.lit(POSITIONS))


def may_hold(df: DataFrame, pages: DataFrame, names: list[str], flag: str) -> DataFrame:
    """df with a boolean column: false proves that the row's key is not among those of the filter, true proves nothing."""
    page, bits, at = fresh(df, "k_page", "k_bits", "k_at")
    x = df.withColumn(at, _position(names))
    x = x.join(F.broadcast(pages.select(F.col("page").alias(page), F.col("bits").alias(bits))), F.shiftright(at, 15) == F.col(page), "left")
    byte = F.conv(F.hex(F.substring(bits, (F.shiftright(at, 3).bitwiseAND(_PAGE // 8 - 1) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.call_function("shiftright", byte, F.col(at).bitwiseAND(7).cast("int")).bitwiseAND(1) == 1
    return x.withColumn(flag, F.coalesce(hit, F.lit(False))).drop(page, bits, at)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most so many rows; reads no more than that."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if is_small(df, rows) else df


def cells(members: DataFrame, bucket: str, size: str, member: str, most: int) -> DataFrame:
    """Deal the members of each bucket into cells of bounded size that together hold every pair of the bucket.

    A bucket of at most `most` members is one cell.  A larger one is cut into k = ceil(size / most) chunks by the
    hash of the member, and each chunk goes to the k cells that pair it with every chunk (itself included), so no
    task ever holds more than about two chunks of one bucket.  Adds cell_a, cell_b (chunk numbers, a <= b) and
    chunk (the member's own).
    """
    k = F.ceil(F.col(size) / F.lit(float(most))).cast("int")
    out = members.withColumn("chunks", k).withColumn("chunk", F.pmod(F.xxhash64(F.col(member), F.lit(7)), F.col("chunks")).cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return out.withColumn("cell_a", F.least("chunk", "other")).withColumn("cell_b", F.greatest("chunk", "other")).drop("other", "chunks")


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups with the groups' bounds, from batches in order of the keys.

    Many small groups come together in one table; a group that spans batches is joined first.  Memory is bounded
    by a batch and the largest group, and what is free at the end goes back to the system.
    """
    held: list[pa.Table] = []
    for now in _larger(batches):
        change = _changes(now, keys)
        last = int(change[-1]) if len(change) else 0
        if held and _same(held[-1], now, keys):
            if not last and not len(change):
                held.append(now)
                continue
            cut = int(change[0])
            whole = pa.concat_tables([*held, now.slice(0, cut)]).combine_chunks()
            yield whole, _bounds(whole, keys)
            if last > cut:
                yield now.slice(cut, last - cut), _bounds(now.slice(cut, last - cut), keys)
        else:
            if held:
                whole = pa.concat_tables(held).combine_chunks()
                yield whole, _bounds(whole, keys)
            if last:
                yield now.slice(0, last), _bounds(now.slice(0, last), keys)
        held = [now.slice(last)]
    if held:
        whole = pa.concat_tables(held).combine_chunks()
        yield whole, _bounds(whole, keys)
    held, whole = [], None
    tx.trim()


def _larger(batches: Iterator[pa.RecordBatch], rows: int = 1 << 16, size: int = 16 << 20) -> Iterator[pa.Table]:
    """Small batches joined up to so many rows or bytes."""
    got: list[pa.RecordBatch] = []
    n = b = 0
    for batch in batches:
        if batch.num_rows:
            got.append(batch)
            n, b = n + batch.num_rows, b + batch.nbytes
        if n >= rows or b >= size:
            yield pa.Table.from_batches(got).combine_chunks()
            got, n, b = [], 0, 0
    if got:
        yield pa.Table.from_batches(got).combine_chunks()


def _changes(t: pa.Table, keys: list[str]) -> np.ndarray:
    differs = np.zeros(max(t.num_rows - 1, 0), dtype=bool)
    for k in keys:
        c = t.column(k).to_numpy()
        differs |= c[1:] != c[:-1]
    return np.flatnonzero(differs) + 1


def _bounds(t: pa.Table, keys: list[str]) -> np.ndarray:
    return np.concatenate(([0], _changes(t, keys), [t.num_rows]))


def _same(a: pa.Table, b: pa.Table, keys: list[str]) -> bool:
    return all(a.column(k)[a.num_rows - 1].as_py() == b.column(k)[0].as_py() for k in keys)


def bitmap(hashes: DataFrame, rows: int) -> np.ndarray:
    """Bits of the values (one bigint column, well mixed) in a bitmap of bounded size: 8 bits a row, at most 2**29 bits.

    A bit that is not set proves that a value is absent; one that is set proves nothing.
    """
    bits = min(max(int(np.ceil(np.log2(max(rows, 1) * 8))), 16), 29)
    block = 1 << 15  # bits of a block

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((1 << bits) // 8, dtype=np.uint8)
        for batch in batches:
            at = (batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
            np.bitwise_or.at(table, at >> 3, (1 << (at & 7)).astype(np.uint8))
        parts = table.reshape(-1, block // 8)
        used = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([parts[k].tobytes() for k in used], pa.binary())], names=["block", "bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                now = np.frombuffer(b, np.uint8)
                total[k] = total[k] | now if k in total else now
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["block", "bits"])

    out = np.zeros(((1 << bits) // block, block // 8), dtype=np.uint8)
    for r in hashes.mapInArrow(mark, "block bigint, bits binary").repartition("block").mapInArrow(merge, "block bigint, bits binary").toLocalIterator():
        out[r["block"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out.ravel()


def in_bitmap(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = (hashes >> np.uint64(64 - int(np.log2(len(table) * 8)))).astype(np.int64)
    return (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
