"""Nested JSON records to triples, declared entity by entity; columns only.

A template such as "work/series_{series.id}" is filled from the record, or with `each` from the elements of an array
(`{it.id}`); a missing part gives no triple.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.columns import IRI_KIND, LITERAL, term
from tessera.namespaces import RDF, XSD


@dataclass(frozen=True)
class Entity:
    iri: str
    types: tuple[str, ...] = ()
    each: str | None = None
    #: predicate -> path, or (path, datatype)
    values: dict[str, str | tuple[str, str]] = field(default_factory=dict, hash=False)
    #: predicate -> template of an IRI
    links: dict[str, str] = field(default_factory=dict, hash=False)
    #: predicate -> constant text
    constants: dict[str, str] = field(default_factory=dict, hash=False)


def _has(schema: T.StructType, path: str) -> bool:
    now: T.DataType = schema
    for part in path.split("."):
        if isinstance(now, T.ArrayType):
            now = now.elementType
        if not isinstance(now, T.StructType) or part not in now.names:
            return False
        now = now[part].dataType
    return True


def _filled(template: str, df: DataFrame, base: str) -> Column | None:
    parts: list[Column] = [F.lit(base)] if not re.match(r"[A-Za-z][\w+.-]*:", template) else []
    for text, path in re.findall(r"([^{]+)|\{([^}]+)\}", template):
        if text:
            parts.append(F.lit(text))
        elif _has(df.schema, path):
            x = F.col(path).cast("string")
            parts.append(F.replace(F.url_encode(x), F.lit("+"), F.lit("%20")))
        else:
            return None
    return F.concat(*parts)


def entity_triples(records: DataFrame, e: Entity, base: str) -> DataFrame | None:
    df = records
    if e.each:
        if not _has(df.schema, e.each):
            return None
        df = df.withColumn("it", F.explode(e.each))
    subject = _filled(e.iri, df, base)
    if subject is None:
        return None
    s = term(IRI_KIND, subject)
    items: list[tuple[str, Column]] = [(RDF.type, term(IRI_KIND, F.lit(x))) for x in e.types]
    for p, x in e.values.items():
        path, dt = (x, XSD.string) if isinstance(x, str) else x
        if _has(df.schema, path):
            value = F.nullif(F.col(path).cast("string"), F.lit(""))
            items.append((p, term(IRI_KIND, value) if dt == "iri" else term(LITERAL, value, F.lit(dt))))
    for p, template in e.links.items():
        target = _filled(template, df, base)
        if target is not None:
            items.append((p, term(IRI_KIND, target)))
    items += [(p, term(LITERAL, F.lit(x), F.lit(XSD.string))) for p, x in e.constants.items()]
    pairs = F.array(*[F.struct(F.lit(p).alias("p"), o.alias("o")) for p, o in items])
    out = df.select(s.alias("s"), F.explode(pairs).alias("x")).filter("s is not null and x.o is not null")
    return out.select("s", F.col("x.p").alias("p"), F.col("x.o").alias("o"))


def json_triples(records: DataFrame, entities: list[Entity], base: str) -> DataFrame:
    """(s, p, o) of all entities, each statement once."""
    parts = [x for e in entities if (x := entity_triples(records, e, base)) is not None]
    return reduce(DataFrame.unionByName, parts).distinct()


def read_json(spark: SparkSession, path: str, entities: list[Entity], base: str) -> DataFrame:
    """Of files that hold arrays of records (or one record a line)."""
    return json_triples(spark.read.option("multiLine", True).json(path), entities, base)


def insert_blocks(text: str) -> list[str]:
    """Update text split at its operations, for loaders that send one at a time."""
    return [b.strip() for b in re.split(r";\s*(?=(?:PREFIX|INSERT|DELETE|LOAD|CLEAR|DROP|CREATE|COPY|MOVE|ADD)\b)", text) if b.strip()]
