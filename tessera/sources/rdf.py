"""RDF documents: N-Triples read line by line on the executors, Turtle parsed per file, N-Triples written as text.

Blank node labels get the document's id, so that nodes of different documents stay apart.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import terms as t
from tessera.errors import QueryError
from tessera.functions.columns import BLANK, IRI_KIND, LITERAL, TERM
from tessera.namespaces import PREFIXES, RDF, XSD

TRIPLES = f"s {TERM}, p string, o {TERM}"
_NODE = r'(<[^>]*>|_:[^\s]+|"(?:[^"\\]|\\.)*"(?:\^\^<[^>]*>|@[A-Za-z]+(?:-[A-Za-z0-9]+)*)?)'
_LINE = rf"^\s*(<[^>]*>|_:[^\s]+)\s+<([^>]*)>\s+{_NODE}\s*\.\s*(?:#.*)?$"
_BLANK = r"^\s*(?:#.*)?$"
_LITERAL = r'^"((?:[^"\\]|\\.)*)"(?:\^\^<([^>]*)>|@([A-Za-z]+(?:-[A-Za-z0-9]+)*))?$'


def _unescaped(s: Column) -> Column:
    """Escapes resolved. \\u needs a decoder, so such strings take the slower way through JSON, which shares these
    escapes (but \\U and \\')."""
    plain = s
    json = F.concat(F.lit('{"s":"'), F.regexp_replace(F.regexp_replace(s, r"\\'", "'"), r"\\U0000([0-9A-Fa-f]{4})", r"\\\\u$1"), F.lit('"}'))
    return F.when(F.instr(s, "\\") > 0, F.get_json_object(json, "$.s")).otherwise(plain)


def _term(x: Column, doc: str) -> Column:
    iri, blank = x.startswith("<"), x.startswith("_:")
    lang = F.lower(F.nullif(F.regexp_extract(x, _LITERAL, 3), F.lit("")))
    dt = F.nullif(F.regexp_extract(x, _LITERAL, 2), F.lit(""))
    lex = F.when(iri, _unescaped(F.substring(x, F.lit(2), F.length(x) - 2))).when(blank, F.concat(F.lit(f"{doc}_"), F.substring(x, F.lit(3), F.length(x)))).otherwise(_unescaped(F.regexp_extract(x, _LITERAL, 1)))
    return F.struct(
        F.when(iri, IRI_KIND).when(blank, BLANK).otherwise(LITERAL).cast("tinyint").alias("kind"),
        lex.alias("lex"),
        F.when(iri | blank, F.lit(None)).when(lang.isNotNull(), F.lit(RDF.langString)).otherwise(F.coalesce(dt, F.lit(XSD.string))).alias("dt"),
        F.when(iri | blank, F.lit(None)).otherwise(lang).alias("lang"),
    )


def parse_ntriples(lines: DataFrame, doc: str = "d", column: str = "value", strict: bool = True) -> DataFrame:
    """(s, p, o) of a column of N-Triples lines, by columns only; comments and blank lines are left out.

    Another line that is no statement is an error; where strict is false it is left out (a stream goes on).
    """
    x = F.col(column)
    if strict:
        wrong = F.raise_error(F.concat(F.lit("not a statement of N-Triples: "), F.substring(column, 1, 200)))
        ok = lines.withColumn(column, F.when(x.rlike(_LINE), x).when(~x.rlike(_BLANK), wrong)).filter(x.isNotNull())
    else:
        ok = lines.filter(x.rlike(_LINE))
    return ok.select(_term(F.regexp_extract(x, _LINE, 1), doc).alias("s"), F.regexp_extract(x, _LINE, 2).alias("p"), _term(F.regexp_extract(x, _LINE, 3), doc).alias("o"))


def not_ntriples(lines: DataFrame, column: str = "value") -> DataFrame:
    """The lines that are neither statements, comments nor blank."""
    x = F.col(column)
    return lines.filter(~x.rlike(_LINE) & ~x.rlike(_BLANK)).select(column)


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    return parse_ntriples(spark.read.text(path), doc_id(path)).distinct()


def doc_id(path: str) -> str:
    return f"d{zlib.crc32(path.encode()):08x}"


def turtle_triples(text: str, doc: str = "d") -> list[tuple]:
    """(s, p, o) tuples of term tuples, of one Turtle document."""
    from tessera.parser import Parser
    from tessera.plans import algebra as a

    z = Parser(text)
    out: list[a.Triple] = []
    while z.peek()[0] != "end":
        kind, x = z.peek()
        if kind == "lang" and x in ("@prefix", "@base") or kind == "word" and x.lower() in ("prefix", "base"):
            z.at += 1
            if x.lower().endswith("prefix"):
                name = z.next()[1]
                z.prefixes[name[:-1]] = z.absolute(z.next()[1][1:-1])
            else:
                z.base = z.absolute(z.next()[1][1:-1])
            z.take(".")
        elif not z.take("."):
            z.triples(out)
    from tessera.plans.compiler import Compiler

    fixed = Compiler({**{k: str(v) for k, v in PREFIXES.items()}, **z.prefixes}, z.base)
    out = fixed.unquoted_template(out)

    def term(y: Any) -> tuple:
        if isinstance(y, t.PName):
            y = fixed.term(y)
        if isinstance(y, t.IRI):
            return (IRI_KIND, z.absolute(y.iri), None, None)
        if isinstance(y, t.BNode):
            return (BLANK, f"{doc}_{y.label}", None, None)
        if isinstance(y, t.Lit):
            return (LITERAL, y.lex, y.dt, y.tag)
        raise QueryError("parse", f"not a term of a document: {y!r}")

    return [(term(x.s), term(x.p)[1], term(x.o)) for x in out]


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """Turtle files, one task a file (the syntax has state, so a file can't be split)."""
    struct = pa.struct([("kind", pa.int8()), ("lex", pa.string()), ("dt", pa.string()), ("lang", pa.string())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = turtle_triples(text, doc_id(name))
                as_dict = lambda x: dict(zip(("kind", "lex", "dt", "lang"), x, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([as_dict(r[0]) for r in rows], struct), pa.array([r[1] for r in rows], pa.string()), pa.array([as_dict(r[2]) for r in rows], struct)], names=["s", "p", "o"])

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("name"), F.col("value").alias("text"))
    return files.mapInArrow(parse, TRIPLES).distinct()


def read_rdf(spark: SparkSession, path: str) -> DataFrame:
    return read_turtle(spark, path) if path.endswith((".ttl", ".turtle")) else read_ntriples(spark, path)


def _written(x: Column) -> Column:
    esc = x["lex"]
    for a_, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        esc = F.replace(esc, F.lit(a_), F.lit(b))
    tail = F.when(x["lang"].isNotNull(), F.concat(F.lit("@"), x["lang"])).when(x["dt"].isNull() | (x["dt"] == XSD.string), F.lit("")).otherwise(F.concat(F.lit("^^<"), x["dt"], F.lit(">")))
    return F.when(x["kind"] == IRI_KIND, F.concat(F.lit("<"), x["lex"], F.lit(">"))).when(x["kind"] == BLANK, F.concat(F.lit("_:"), x["lex"])).otherwise(F.concat(F.lit('"'), esc, F.lit('"'), tail))


def ntriples_lines(triples: DataFrame) -> DataFrame:
    return triples.select(F.concat(_written(F.col("s")), F.lit(" <"), F.col("p"), F.lit("> "), _written(F.col("o")), F.lit(" .")).alias("value"))


def write_ntriples(triples: DataFrame, path: str) -> None:
    ntriples_lines(triples).write.text(path)
