"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Two texts are equal when identical after lower-casing A-Z only.  Each step groups what the step before left
in groups of two or more:

1. one scan counts normalised lengths (map-side combined: at most one row a length and task);
2. rows whose length occurs twice are grouped by (length, hash of the first `PREFIX` characters);
3. rows whose (length, prefix hash) occurs twice are read in full and grouped by their SHA-256.

The keys that survive a step go to the scan of the next: as a broadcast where a bounded count shows that they are few,
else as a bitmap of their hashes of at most 64 MB, which lets a few other rows pass (they are alone in their group
after the next hash).  Texts never move: shuffles carry a length, hashes and an id.  A group with a third of all
rows is one pre-aggregated row a task.

Defined cases: null text counts as empty, and all such rows are one group; a null doc_id ranks below every
number, and a group of nulls only keeps one of them with keep_id null; rows that repeat both doc_id and text keep
one of them (which of their copies is not defined where other columns differ); very long texts are hashed whole; an
empty table gives an empty result; extra columns, whatever their names, are ignored or, in `exact_dedup`, passed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.tables import broadcast_if_small, checkpoint, fresh, is_small, key_filter, lower_az, may_hold, table

PREFIX = 256
#: Keys of a step that are broadcast at most (a key is 12 bytes); beyond it a bitmap is.
MAX_KEYS = 200_000


def _norm(text: str) -> Column:
    return lower_az(F.coalesce(F.col(text), F.lit("")))


def refine(docs: DataFrame, text: str = "text", id_col: str = "doc_id", digest_all: bool = False) -> DataFrame:
    """(id, full, n, digest): one row for each distinct (id, text), n its repeats.

    `full` is the SHA-256 of a text that survived every step, else null (such a row equals no other);
    `digest` is the SHA-256 of every text where digest_all asks for it, else null.
    """
    # lower-casing A-Z keeps lengths, so only what is hashed needs it
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("len", F.char_length("t"))
    head = F.xxhash64(lower_az(F.substring("t", 1, PREFIX)))
    full = F.unhex(F.sha2(lower_az(F.col("t")), 256))

    twice = rows.groupBy("len").count().filter("count > 1").select("len")
    rows = _surviving(rows, twice, ["len"], "l2")
    rows = rows.withColumn("prefix", F.when(F.col("l2"), head))

    pairs = rows.filter("prefix is not null").groupBy("len", "prefix").count().filter("count > 1").select("len", "prefix")
    rows = _surviving(rows, pairs, ["len", "prefix"], "p2")
    if digest_all:
        rows = rows.withColumn("digest", full).withColumn("full", F.when(F.col("p2"), F.col("digest")))
    else:
        rows = rows.withColumn("digest", F.lit(None).cast("binary")).withColumn("full", F.when(F.col("p2"), full))
    # len and prefix tell apart rows that have no full hash
    return rows.groupBy("id", "len", "prefix", "full", "digest").agg(F.count("*").alias("n")).drop("len", "prefix")


def _surviving(rows: DataFrame, keys: DataFrame, names: list[str], flag: str) -> DataFrame:
    """rows with a flag that is true where their key is among the keys (or, with a bitmap, may be)."""
    if is_small(keys, MAX_KEYS):
        return rows.join(F.broadcast(keys.withColumn(flag, F.lit(True))), names, "left")
    return may_hold(rows, key_filter(keys, names), names, flag).withColumn(flag, F.col(flag) & F.col(names[-1]).isNotNull())


def decide(docs: DataFrame, text: str = "text", id_col: str = "doc_id", digest_all: bool = False) -> DataFrame:
    """`refine` with keep_id and group_size; the text of (id) stays if id is keep_id."""
    rows = refine(docs, text, id_col, digest_all)
    groups = rows.filter("full is not null").groupBy("full").agg(F.max("id").alias("g_keep"), F.sum("n").alias("g_size")).filter("g_size > 1")
    # joined by a renamed key, so that the exchange of the rows can be split where one group is very large
    out = rows.join(groups.select(F.sha1("full").alias("g"), "g_keep", "g_size"), F.sha1("full") == F.col("g"), "left")
    alone = F.col("g").isNull()
    return out.select("id", "full", "digest", "n", F.when(alone, F.col("id")).otherwise(F.col("g_keep")).alias("keep_id"), F.coalesce("g_size", F.lit(1).cast("bigint")).alias("group_size"))


def groups_of(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    d = decide(docs, text, id_col, digest_all=True).withColumn("i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))))
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("i") == 1)
    return d.select(F.col("id").alias("doc_id"), "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows that stay, with all their columns.

    Rows that go are found by their id first; only the texts of such ids are hashed again (those of rows without an id
    all are).
    """
    d = decide(docs, text, id_col)
    x_id, x_full, x_stays, x_hash = fresh(docs, "x_id", "x_full", "x_stays", "x_hash")
    stays = F.col("id").eqNullSafe(F.col("keep_id"))
    moved = checkpoint(d.filter(~stays | (F.col("n") > 1)).select(F.col("id").alias(x_id), F.col("full").alias(x_full), stays.alias(x_stays)))
    digest = F.unhex(F.sha2(_norm(text), 256))

    def matched(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        # not written as an equality, which would make the hash a key that is computed for every row
        with_id, without = keys.filter(F.col(x_id).isNotNull()), keys.filter(F.col(x_id).isNull())
        same = (rows[id_col] == F.col(x_id)) & (digest >= F.col(x_full)) & (digest <= F.col(x_full))
        known = rows.filter(F.col(id_col).isNotNull()).join(broadcast_if_small(with_id), same, how)
        unknown = rows.filter(F.col(id_col).isNull()).join(broadcast_if_small(without), digest == F.col(x_full), how)
        return known.unionByName(unknown)

    out = matched(docs, moved, "left_anti")
    repeated = moved.filter(x_stays)
    if not repeated.isEmpty():  # rows that repeat both id and text: one of each stays
        again = matched(docs, repeated, "left_semi").withColumn(x_hash, digest)
        out = out.unionByName(again.dropDuplicates([id_col, x_hash]).drop(x_hash))
    return out


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups_of(table(spark, sf_dir, "documents"))


ORACLE = """
with n as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents)
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       coalesce(row_number() over (partition by t order by doc_id desc nulls last) = 1, false) as kept, sha256(t) as text_sha256
from n
"""
