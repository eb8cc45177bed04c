"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader, sparse dot products.

Features of a text are its words as they stand and their shapes (class of the first byte, classes of the last two,
length up to 12, whether the word repeats the one before), each as 1-grams and 2-grams, hashed into 2**`BITS` buckets;
a value is the feature's share of the text's words.  Labels come from at most `linear.SAMPLE` labelled rows that
are not held out; every row is scored.  Labels, lang, source and doc_id are no inputs of a score.

Defined cases: null and empty texts, and texts without a word, have the score of the bias alone; a null doc_id is
scored and not held out; repeated rows get equal scores (of rows that share a labelled id, training uses the one whose
features come first); very long texts are scored whole; a score at the threshold is kept; without labels every score
is 0.5; an empty table gives an empty result; other columns play no part, and one named like the score is replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import linear
from tessera.llm import text as tx
from tessera.llm.tables import fresh, table

BITS = 18
KEEP = 0.3
#: 0 lower-case letter, 1 upper-case, 2 digit, 3 byte of a multi-byte character, other bytes themselves.
_CLASS = np.arange(256, dtype=np.uint64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 3
_OPTIONS = {"alpha": 0.5, "l1": 0.05, "l2": 0.02, "epochs": 5}


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, first = tx.words(data, offsets)
    h = tx.span_hashes(data, starts, ends)
    many = np.diff(first)
    same = np.zeros(len(h), dtype=np.uint64)
    if len(h):
        same[1:] = h[1:] == h[:-1]
        same[first[:-1][many > 0]] = 0
    with np.errstate(over="ignore"):
        shape = _CLASS[data[starts]]
        for c in (_CLASS[data[ends - 1]], _CLASS[data[np.maximum(ends - 2, starts)]], np.minimum(ends - starts, 12).astype(np.uint64), same):
            shape = shape * np.uint64(257) + c
    shape = tx.mix64(shape + np.uint64(1 << 40))
    row, bucket, value = [], [], []
    share = 10.0 / np.maximum(many, 1)
    for base in (h, shape):
        for n in (1, 2):
            g, bounds = (base, first) if n == 1 else tx.ngrams(base, first, 2)
            r = np.repeat(np.arange(len(many)), np.diff(bounds))
            row.append(r)
            bucket.append((g >> np.uint64(64 - BITS)).astype(np.int64))
            value.append(share[r])
    row, bucket, value = np.concatenate(row), np.concatenate(bucket), np.concatenate(value)
    return row, bucket, value


def sample_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same with equal buckets of a row summed, as training needs them."""
    row, bucket, value = features(data, offsets)
    key = (row << BITS) | bucket
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return key[at] >> BITS, key[at] & ((1 << BITS) - 1), np.add.reduceat(value, at) if len(at) else value


def model(docs: DataFrame, labels: DataFrame, **names) -> np.ndarray:
    return linear.train(docs, labels, "quality", sample_features, BITS, **names, **_OPTIONS)


def classify(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """Rows of docs (the columns `keep`, default doc_id) with their score, as the column `name`."""
    return linear.score(docs, model(docs, labels), features, keep=keep, name=name)


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier doesn't reject, with all their columns."""
    name = fresh(docs, "quality")[0]
    return classify(docs, labels, docs.columns, name).filter(F.col(name) >= KEEP).drop(name)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", linear.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))
