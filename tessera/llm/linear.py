"""Hashed sparse logistic regression with follow-the-regularised-leader updates.

Training reads a bounded, documented sample of labelled rows (the `sample` rows with the least hash of their id),
computes features on the executors, and updates in one task.  The weights are one array of 2**bits floats, so what
travels to the driver and back has a fixed size.  Scoring is a sparse dot product over every row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import text as tx
from tessera.llm.tables import bounded_batches, fresh

#: Labelled rows that training reads at most.
SAMPLE = 6000
#: (bytes, offsets) -> row, bucket, value, in order of row
Features = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def held_out(id_col: str) -> Column:
    """Whether crc32 of the id as text is divisible by 5; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, bits: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.3, l2: float = 0.1, epochs: int = 4, seed: int = 0) -> np.ndarray:
    """Weights, the bias last. Per-coordinate FTRL-proximal over the rows in a seeded order each epoch."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    order = np.random.default_rng(seed)

    def weight(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(n[i])) / alpha + l2))

    bias = np.array([size - 1])
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at, value = rows[k]
            at, value = np.concatenate((at, bias)), np.concatenate((value, [1.0]))
            w = weight(at)
            p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
            g = (p - labels[k]) * value
            s = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - s * w
            n[at] += g * g
    return weight(np.arange(size)).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, label: str, features: Features, bits: int, id_col: str = "doc_id", text: str = "text", sample: int = SAMPLE, wrap: Callable | None = None, **options) -> np.ndarray:
    """Weights from rows of `labels` that are not held out. `label` must be 0 or 1; other rows are left out.

    Without a labelled row all weights are zero, so every score is 0.5.
    """
    bounded_batches(docs.sparkSession)
    # labels of one id are one row, and so are rows of one id (the text with the least hash), so that both are bounded
    chosen = labels.filter(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("_id"), F.col(label).cast("double").alias("_y"))
    chosen = chosen.groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64(F.col("_id"), F.lit(1)), "_id").limit(sample)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "_id")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tx.strings(batch.column("text"))
            ids, ys = batch.column("_id").to_pylist(), batch.column("_y").to_pylist()
            for lo, hi, part, at in tx.pieces(data, offsets, 1 << 19):
                row, bucket, value = features(part, at)
                cut = np.searchsorted(row, np.arange(hi - lo + 1))
                idx, val = [], []
                for k in range(hi - lo):
                    idx.append(bucket[cut[k] : cut[k + 1]].astype("<i4").tobytes())
                    val.append(value[cut[k] : cut[k + 1]].astype("<f4").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi], pa.int64()), pa.array(ys[lo:hi], pa.float64()), pa.array(idx, pa.binary()), pa.array(val, pa.binary())], names=["id", "y", "idx", "val"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = []
        for batch in batches:
            got += zip(batch.column("id").to_pylist(), batch.column("y").to_pylist(), batch.column("idx").to_pylist(), batch.column("val").to_pylist(), strict=True)
        got.sort()
        rows = [(np.frombuffer(i, "<i4").astype(np.int64), np.frombuffer(v, "<f4").astype(np.float64)) for _, _, i, v in got]
        w = ftrl(rows, np.array([y for _, y, _, _ in got]), bits, **options)
        del got, rows
        tx.trim()
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())], names=["w"])

    made = rows.mapInArrow(extract, "id bigint, y double, idx binary, val binary")
    made = made.groupBy("id").agg(F.min("y").alias("y"), F.min("idx").alias("idx"), F.min_by("val", "idx").alias("val"))
    made = made.repartition(1).mapInArrow(fit, "w binary").collect()
    return np.frombuffer(bytes(made[0]["w"]), np.float32).copy() if made else np.zeros((1 << bits) + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray, features: Features, id_col: str = "doc_id", text: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """Every row with its score, 0 to 1, as the column `name` (which takes the place of one that docs has). keep: columns
    passed on (default: the id alone)."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    names = [c for c in (keep or [id_col]) if c.lower() != name.lower()]
    own = fresh(docs, "score_text")[0]
    source = docs.select(*[F.col(f"`{c}`") for c in names], F.col(text).alias(own))
    schema = source.drop(own).schema.add(name, "double")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            data, offsets = tx.strings(batch.column(batch.num_columns - 1))
            out = np.zeros(batch.num_rows)
            for lo, hi, part, at in tx.pieces(data, offsets, 1 << 19):
                row, bucket, value = features(part, at)
                out[lo:hi] = np.bincount(row, weights=w[bucket] * value, minlength=hi - lo)
            p = 1 / (1 + np.exp(-np.clip(out + w[-1], -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p)], names=[*batch.schema.names[:-1], name])

    return source.mapInArrow(apply, schema)
