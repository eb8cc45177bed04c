"""Ontologies to record types: classes, their properties by domain, Spark schemas, and wide tables of instances.

An ontology is a schema, so what is read here is small; instances stay in DataFrames.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import terms as t
from tessera.engine import Engine, local_name
from tessera.functions import columns as c
from tessera.namespaces import OWL, RDF, RDFS, XSD
from tessera.plans import algebra as a
from tessera.plans.compiler import Active, Compiler

_TYPES = {
    XSD.string: T.StringType(), XSD.anyURI: T.StringType(), XSD.boolean: T.BooleanType(), XSD.date: T.DateType(), XSD.dateTime: T.TimestampNTZType(),
    XSD.decimal: T.DecimalType(38, 18), XSD.float: T.FloatType(), XSD.double: T.DoubleType(),
}


@dataclass(frozen=True)
class PropertyInfo:
    iri: str
    label: str | None
    comment: str | None
    domains: tuple[str, ...]
    ranges: tuple[str, ...]
    functional: bool
    is_object: bool

    @property
    def name(self) -> str:
        return local_name(self.iri)

    def type(self) -> T.DataType:
        one = T.StringType() if self.is_object or len(self.ranges) != 1 else T.LongType() if self.ranges[0] in c.INTEGERS else _TYPES.get(self.ranges[0], T.StringType())
        return one if self.functional else T.ArrayType(one)


@dataclass(frozen=True)
class ClassInfo:
    iri: str
    label: str | None
    comment: str | None
    super_classes: tuple[str, ...]
    properties: tuple[PropertyInfo, ...]

    @property
    def name(self) -> str:
        return local_name(self.iri)

    def schema(self) -> T.StructType:
        """Record type: the resource's IRI, then a field for each property (functional ones scalar, others arrays)."""
        fields = [T.StructField("iri", T.StringType(), False)]
        return T.StructType([*fields, *(T.StructField(p.name, p.type()) for p in self.properties)])


def read_ontology(engine: Engine, inherited: bool = True) -> dict[str, ClassInfo]:
    """Classes of the engine's default graph. inherited: properties of super-classes count too."""
    info: dict[str, dict[str, list]] = {}
    wanted = [RDF.type, RDFS.label, RDFS.comment, RDFS.subClassOf, RDFS.domain, RDFS.range]
    values = " ".join(f"<{p}>" for p in wanted)
    kinds = " ".join(f"<{k}>" for k in (OWL.Class, RDFS.Class, OWL.ObjectProperty, OWL.DatatypeProperty, OWL.FunctionalProperty, RDF.Property))
    rows = engine.query(f"SELECT DISTINCT ?s ?p ?o WHERE {{ VALUES ?k {{ {kinds} }} ?s a ?k . VALUES ?p {{ {values} }} ?s ?p ?o }}")
    for r in rows:
        info.setdefault(r["s"], {}).setdefault(r["p"], []).append(r["o"])
    one = lambda d, p: min(d.get(p, []), default=None)
    props = []
    for iri, d in sorted(info.items()):
        kind = d.get(RDF.type, [])
        if {OWL.ObjectProperty, OWL.DatatypeProperty, RDF.Property, OWL.FunctionalProperty} & set(kind):
            props.append(PropertyInfo(iri, one(d, RDFS.label), one(d, RDFS.comment), tuple(sorted(d.get(RDFS.domain, []))), tuple(sorted(d.get(RDFS.range, []))), OWL.FunctionalProperty in kind, OWL.ObjectProperty in kind))
    classes = {i for i, d in info.items() if {OWL.Class, RDFS.Class} & set(d.get(RDF.type, []))}

    def above(iri: str) -> set[str]:
        seen, todo = set(), [iri]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += info.get(x, {}).get(RDFS.subClassOf, []) if inherited else []
        return seen

    out = {}
    for iri in sorted(classes):
        d, up = info[iri], above(iri)
        out[iri] = ClassInfo(iri, one(d, RDFS.label), one(d, RDFS.comment), tuple(sorted(d.get(RDFS.subClassOf, []))), tuple(p for p in props if up & set(p.domains)))
    return out


def records(engine: Engine, cls: ClassInfo) -> DataFrame:
    """One row for each instance of a class, in its record type. One grouped pass over the class's statements."""
    z, active = Compiler(engine.prefixes), Active(engine.catalog)
    s, p, o = t.Var("s"), t.Var("p"), t.Var("o")
    rel = z.bgp([a.Triple(s, t.IRI(RDF.type), t.IRI(cls.iri)), a.Triple(s, p, o)], active)
    value = c.lift(rel.val("o"))
    df = rel.df.select(c.lexical(rel.val("s")).alias("iri"), rel.val("p").col.alias("p"), value.col["lex"].alias("lex"))
    fields = []
    for q in cls.properties:
        kind = q.type()
        one = kind.elementType if isinstance(kind, T.ArrayType) else kind
        x = F.when(F.col("p") == q.iri, F.col("lex").try_cast(one))
        fields.append((F.min(x) if q.functional else F.array_sort(F.collect_set(x))).alias(q.name))
    return df.groupBy("iri").agg(*fields) if fields else df.select("iri").distinct()
