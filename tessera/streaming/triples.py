"""Triples from a stream of N-Triples lines, appended to a quad table that batch queries read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.sources.rdf import not_ntriples, parse_ntriples


def ntriples_stream(spark: SparkSession, path: str, doc: str = "stream") -> DataFrame:
    """(s, p, o) of lines of new files in a folder; parsed by columns only. Lines that are no statements are left out:
    `rejected` has them."""
    return parse_ntriples(spark.readStream.text(path), doc, strict=False)


def rejected(spark: SparkSession, path: str) -> DataFrame:
    """The lines of new files in a folder that are neither statements, comments nor blank, for a sink of their own."""
    return not_ntriples(spark.readStream.text(path))


def append_quads(triples: DataFrame, path: str, checkpoint: str, graph: str | None = None, once: bool = False) -> StreamingQuery:
    """Append a stream of triples to the Parquet quad table at path, exactly once.

    Statements may repeat across batches; `quad_table` reads each once.
    """
    out = triples.select(F.lit(graph).cast("string").alias("g"), "s", "p", "o")
    writer = out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def quad_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("g", "s", "p", "o").distinct()


def predicate_counts(triples: DataFrame) -> DataFrame:
    """Running number of statements of each predicate; use with output mode complete or update."""
    return triples.groupBy("p").agg(F.count("*").alias("n"))
