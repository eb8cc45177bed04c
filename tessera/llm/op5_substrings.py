"""Substring dedup: paragraph MinHash banding, joined buckets, exact Jaccard, removals by components.

What repeats is looked for in two kinds of units, so that neither line breaks nor longer lines hide a passage.

Paragraphs: lines of at least `MIN_WORDS` words, as sets of five-word shingles (A-Z lower-cased).

1. One pass hashes every paragraph of every text: a key of its word sequence and the bands of its MinHash.  The
   number of bands is tuned so that a pair of Jaccard `SIMILARITY` meets in a band with probability `RECALL`.
2. Equal paragraphs become one row (combined before the shuffle).  In each bucket of a band, members link to one
   of them, within tasks before the shuffle; components of these links are coarse, unverified groups.
3. Texts of grouped paragraphs only are fetched, and exact Jaccard of every pair of a group is computed in cells of
   bounded size; verified links give the final components.
4. Of each component, or of equal paragraphs, the first occurrence by (doc_id, paragraph) stays.

Passages: runs of words wherever they stand, across lines and inside longer ones.

1. Of every `GAP` neighbouring words of a text the one whose three-word gram has the least hash begins a window of
   `WINDOW` words.  The choice depends on these words alone, so a run of `WINDOW` + `GAP` - 1 = 33 words that stands
   in two places has a window in common there, and one of 50 words has several.
2. Windows with equal word sequences are one class.  (Jaccard 0.8 of 20 words with as many as 16 shingles leaves room
   for a change of the last word only: a word changed further inside already costs five shingles.)
3. Of each class the first occurrence by (doc_id, place) stays.  Overlapping windows of a text that stay, or that
   go, are joined to passages of full length.

An edited copy inside other lines is found as far as 33 words in a row of it are unedited.  Shorter repeated lines are
no passages: `op9_lines` is about those.

Keys are 64-bit hashes of the whole word sequence.  Defined cases: null and empty texts have no paragraph; a null
doc_id counts as the last document; rows that repeat a doc_id are occurrences like any other, and `cut` treats them
alike; very long texts and lines are cut into pieces of words like any other, whole; of occurrences that tie, with
the same doc_id, text and place, all stay or go; empty tables give an empty result; other columns, whatever their
names, are passed on by `cut`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm import text as tx
from tessera.llm.components import components
from tessera.llm.setjoin import lines_at, sized, verified
from tessera.llm.tables import bitmap, bounded_batches, broadcast_if_small, checkpoint, fresh, in_bitmap, stored, table

SHINGLE, SIMILARITY, RECALL = 5, 0.8, 0.995
MIN_WORDS = 20
#: Words of a window; neighbouring places of which one begins a window; words whose hash decides which.
WINDOW, GAP, GRAM = 20, 14, 3
#: MinHashes in a band.
ROWS = 4
LAST = (1 << 63) - 1


def bands_for(similarity: float = SIMILARITY, recall: float = RECALL, rows: int = ROWS) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(11).integers(1, 1 << 63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def key_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Key of each text's word sequence."""
    data, offsets = tx.strings(column)
    out = []
    for _, _, part, at in tx.pieces(data, offsets):
        part = tx.LOWER[part]
        starts, ends, first = tx.words(part, at)
        out.append(tx.sequence_hashes(tx.span_hashes(part, starts, ends), first))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def paragraphs(docs: DataFrame, text: str = "text", id_col: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, line, words, key, bands) of every paragraph."""
    bounded_batches(docs.sparkSession)
    bands = bands_for()

    def hash_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multipliers = _multipliers(bands * ROWS)
        for batch in batches:
            data, offsets = tx.strings(batch.column(1))
            ids = batch.column(0)
            for lo, _, part, at in tx.pieces(data, offsets):
                edges, row, number = tx.lines(part, at)
                part = tx.LOWER[part]
                starts, ends, first = tx.words(part, edges)
                count = np.diff(first)
                chosen = np.flatnonzero(count >= max(min_words, SHINGLE))
                if not len(chosen):
                    continue
                h = tx.span_hashes(part, starts, ends)
                key = tx.sequence_hashes(h, first)[chosen]
                grams, bounds = tx.ngrams(h, first, SHINGLE)
                has = np.flatnonzero(np.diff(bounds) > 0)
                pick = np.searchsorted(has, chosen)
                made = np.empty((len(chosen), bands), dtype=np.uint64)
                with np.errstate(over="ignore"):
                    for b in range(bands):
                        mixed = np.full(len(chosen), b + 1, dtype=np.uint64)
                        for k in range(ROWS):
                            low = np.minimum.reduceat(grams * multipliers[b * ROWS + k], bounds[has])[pick]
                            mixed = tx.mix64(mixed * np.uint64(tx.BASE) + low)
                        made[:, b] = mixed
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(chosen) * bands + 1, bands), pa.int32()), pa.array(made.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row[chosen] + lo)), pa.array(number[chosen], pa.int32()), pa.array(count[chosen], pa.int32()), pa.array(key.view(np.int64)), lists], names=["id", "line", "words", "key", "bands"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("text")).mapInArrow(hash_all, "id bigint, line int, words int, key bigint, bands array<bigint>")


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of a bucket within a batch link to one of them (root set); only that one goes on (root null)."""
    for batch in batches:
        bands = batch.column(1)
        if not batch.num_rows:
            continue
        bucket = bands.flatten().to_numpy()
        key = np.repeat(batch.column(0).to_numpy(), len(bucket) // batch.num_rows)
        order = np.lexsort((key, bucket))
        bucket, key = bucket[order], key[order]
        new = np.ones(len(bucket), dtype=bool)
        new[1:] = bucket[1:] != bucket[:-1]
        root = key[np.flatnonzero(new)[np.cumsum(new) - 1]]
        keep = new | (root != key)
        yield pa.RecordBatch.from_arrays([pa.array(bucket[keep]), pa.array(key[keep]), pa.array(root[keep], mask=new[keep])], names=["bucket", "key", "root"])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of bucket: each links to the bucket's first key, and to its local root. Nothing is held but that key."""
    last, root = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        bucket, key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        local = batch.column(2)
        new = np.ones(len(bucket), dtype=bool)
        new[1:] = bucket[1:] != bucket[:-1]
        lead = key[np.flatnonzero(new)[np.cumsum(new) - 1]]
        if bucket[0] == last:
            lead[: int(np.argmin(bucket == last)) if (bucket != last).any() else len(bucket)] = root
        last, root = bucket[-1], lead[-1]
        linked = ~local.is_null().to_numpy(zero_copy_only=False)
        a = np.concatenate((lead, local.fill_null(0).to_numpy()[linked]))
        b = np.concatenate((key, key[linked]))
        yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], names=["a", "b"])


def bucket_links(rows: DataFrame) -> DataFrame:
    """(a, b) of rows (key, bands, ...): links that connect the keys of each bucket."""
    dealt = rows.select("key", "bands").mapInArrow(_local_stars, "bucket bigint, key bigint, root bigint")
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "key").mapInArrow(_stars, "a bigint, b bigint")


def repeated(docs: DataFrame, text: str = "text", id_col: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """Every occurrence of a repeated paragraph: id, line, words, keep_id, keep_line, copies, removed."""
    all_rows = stored(paragraphs(docs, text, id_col, min_words))
    place = F.struct(F.coalesce("id", F.lit(LAST)).alias("id"), F.col("line").alias("line"))
    distinct = all_rows.groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("rows"))
    coarse = checkpoint(components(bucket_links(all_rows)).select(F.col("node").alias("n"), F.col("component").alias("coarse")))
    wanted = distinct.join(coarse, F.col("key") == F.col("n")).select(F.col("first.id").alias("at_id"), F.col("first.line").alias("at_line"), F.col("key").alias("node"), "coarse", "rows")
    final = verified(lines_at(docs, checkpoint(sized(wanted, "rows")), id_col, text, key_of), SIMILARITY, SHINGLE)
    named = distinct.join(final, F.col("key") == F.col("node"), "left").filter("rows > 1 or component is not null").select("key", "first", "rows", F.coalesce("component", "key").alias("group"))
    groups = named.groupBy("group").agg(F.min("first").alias("keep"), F.sum("rows").alias("copies"))
    labels = checkpoint(named.select("key", F.col("group").alias("g")).join(groups, F.col("g") == F.col("group")).select(F.col("key").alias("k"), F.col("keep.id").alias("k_id"), F.col("keep.line").alias("keep_line"), "copies"))
    out = all_rows.select("id", "line", "words", "key").join(broadcast_if_small(labels), F.col("key") == F.col("k"))
    kept = (F.coalesce("id", F.lit(LAST)) == F.col("k_id")) & (F.col("line") == F.col("keep_line"))
    return out.select("id", "line", "words", F.when(F.col("k_id") != LAST, F.col("k_id")).alias("keep_id"), "keep_line", "copies", (~kept).alias("removed"))


def window_places(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Numbers of the words that begin a window, ascending; h are the words' hashes, first the rows' bounds."""
    n = len(h)
    many = np.maximum(np.diff(first) - (WINDOW + GAP - 2), 0)
    total = int(many.sum())
    if not total:
        return np.zeros(0, np.int64)
    low = np.uint64((1 << 20) - 1)
    with np.errstate(over="ignore"):
        gram = h.copy()
        for k in range(1, GRAM):
            gram[: n - k] = gram[: n - k] * np.uint64(0x9E3779B97F4A7C15) + h[k:]
    least = (tx.mix64(gram) & ~low) | (np.arange(n, dtype=np.uint64) & low)  # the first of equal grams counts
    reach = 1
    while reach < GAP:  # least of the places from each on
        step = min(reach, GAP - reach)
        least = np.minimum(least[: len(least) - step], least[step:])
        reach += step
    at = np.arange(total) + np.repeat(first[:-1] - (np.cumsum(many) - many), many)
    place = at + ((least[at] - at.astype(np.uint64)) & low).astype(np.int64)
    return place[np.concatenate(([True], place[1:] != place[:-1]))]


def windows(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, row, at, key) of every window; row is a hash of the whole text, at the number of the first word.

    Where windows that follow each other in a row are equal, as in one word said many times, one in `WINDOW` words does.
    """
    bounded_batches(docs.sparkSession)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tx.strings(batch.column(1))
            ids = batch.column(0)
            for lo, _, part, at in tx.pieces(data, offsets):
                part = tx.LOWER[part]
                starts, ends, first = tx.words(part, at)
                h = tx.span_hashes(part, starts, ends)
                place = window_places(h, first)
                if not len(place):
                    continue
                row = np.searchsorted(first, place, "right") - 1
                key = tx.sequence_hashes_at(h, place, place + WINDOW)
                new = np.concatenate(([True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])))
                turn = (place - place[new][np.cumsum(new) - 1]) // WINDOW
                new[1:] |= turn[1:] != turn[:-1]
                place, row, key = place[new], row[new], key[new]
                whole = (tx.sequence_hashes(h, first) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row + lo)), pa.array(whole[row]), pa.array((place - first[row]).astype(np.int32)), pa.array(key.view(np.int64))], names=["id", "row", "at", "key"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("text")).mapInArrow(find, "id bigint, row int, at int, key bigint")


def passages(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Every occurrence of a repeated passage: id, row, start, words, keep_id, keep_start, copies, removed.

    A passage is a run of overlapping windows that go, or that stay.  keep_id and keep_start tell where the first of its
    windows stands first, copies how often the most frequent one stands.
    """
    every = stored(windows(docs, text, id_col))
    twice = every.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    # a bitmap of the repeated keys, of bounded size, leaves hardly any other window to the shuffles below
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(twice, every.count() // 2))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(table, batch.column(3).to_numpy().view(np.uint64))))

    some = every.mapInArrow(again, every.schema)
    place = F.struct(F.coalesce("id", F.lit(LAST)).alias("id"), "row", "at")
    classes = some.groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("copies")).filter("copies > 1").withColumnRenamed("key", "k")
    # the second key gives the classes an exchange of their own, so that a frequent window's rows can be split
    found = some.join(classes, (F.col("key") == F.col("k")) & (F.hash("key") == F.hash("k")))
    found = found.select("id", "row", "at", (place != F.col("first")).alias("removed"), F.col("first.id").alias("keep_id"), F.col("first.at").alias("keep_start"), "copies").distinct()
    by = W.partitionBy("id", "row", "removed").orderBy("at")
    found = found.withColumn("new", F.coalesce(F.col("at") > F.lag("at").over(by) + WINDOW, F.lit(True)).cast("int"))
    found = found.withColumn("run", F.sum("new").over(by.rowsBetween(W.unboundedPreceding, W.currentRow)))
    out = found.groupBy("id", "row", "removed", "run").agg(F.min("at").alias("start"), (F.max("at") + WINDOW - F.min("at")).alias("words"), F.min_by(F.struct("keep_id", "keep_start"), "at").alias("keep"), F.max("copies").alias("copies"))
    return out.select("id", "row", "start", "words", F.when(F.col("keep.keep_id") != LAST, F.col("keep.keep_id")).alias("keep_id"), F.col("keep.keep_start").alias("keep_start"), "copies", "removed")


def cut(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs with all their columns, their texts without the removed paragraphs and passages."""
    x_id, x_lines, x_spans = fresh(docs, "x_id", "x_lines", "x_spans")
    own = F.struct("row", "start", "words")
    lines = repeated(docs, text, id_col).filter("removed").select("id", "line", F.lit(None).cast("struct<row:int,start:int,words:int>").alias("span"))
    spans = passages(docs, text, id_col).filter("removed").select("id", F.lit(None).cast("int").alias("line"), own.alias("span"))
    gone = checkpoint(lines.unionByName(spans).groupBy(F.col("id").alias(x_id)).agg(F.collect_set("line").alias(x_lines), F.collect_set("span").alias(x_spans)))
    joined = docs.join(broadcast_if_small(gone), docs[id_col].eqNullSafe(gone[x_id]), "left").drop(x_id)
    at = docs.columns.index(text)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            spans, lines = columns.pop(), columns.pop()
            touched = np.flatnonzero(~lines.is_null().to_numpy(zero_copy_only=False))
            if len(touched):
                texts = columns[at].to_pylist()
                for k in touched.tolist():
                    texts[k] = without(texts[k], lines[k].as_py(), [tuple(x.values()) for x in spans[k].as_py()])
                columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-2])

    return joined.mapInArrow(clean, docs.schema)


def without(text: str | None, lines: list[int], spans: list[tuple[int, int, int]]) -> str | None:
    """text without those lines, and without the words of those spans (row, start, words) that belong to this text."""
    if text is None:
        return None
    raw = text.encode()
    data = tx.LOWER[np.frombuffer(raw, np.uint8)]
    starts, ends, first = tx.words(data, np.array([0, len(data)]))
    whole = int((tx.sequence_hashes(tx.span_hashes(data, starts, ends), first) >> np.uint64(32)).astype(np.uint32).view(np.int32)[0])
    kept = np.ones(len(raw), dtype=bool)
    for row, start, words in spans:
        if row == whole:
            kept[starts[start] : starts[start + words] if start + words < len(starts) else ends[-1]] = False
    drop, out, at = set(lines), [], 0
    for k, line in enumerate(raw.split(b"\n")):
        if k not in drop:
            mask = kept[at : at + len(line)]
            out.append(line if mask.all() else np.frombuffer(line, np.uint8)[mask].tobytes())
        at += len(line) + 1
    return b"\n".join(out).decode()


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership of repeated paragraphs (a line, by number) and passages (from a word on, by number); documents that hold
    none don't appear."""
    docs = table(spark, sf_dir, "documents")
    no = F.lit(None).cast("int")
    lines = repeated(docs).select(F.col("id").alias("doc_id"), F.col("line").alias("paragraph"), no.alias("start_word"), "words", F.col("keep_id").alias("keep_doc_id"), F.col("keep_line").alias("keep_paragraph"), no.alias("keep_start_word"), "copies", "removed")
    runs = passages(docs).select(F.col("id").alias("doc_id"), no.alias("paragraph"), F.col("start").alias("start_word"), "words", F.col("keep_id").alias("keep_doc_id"), no.alias("keep_paragraph"), F.col("keep_start").alias("keep_start_word"), "copies", "removed")
    return lines.unionByName(runs)
