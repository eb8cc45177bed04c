"""Where statements come from: a quad table, relational tables mapped to classes, named graphs, endpoints."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.columns import TERM

QUADS = f"g string, s {TERM}, p string, o {TERM}"


@dataclass(frozen=True)
class Ref:
    """An object that is an IRI: prefix + the column's value (a foreign key)."""

    column: str
    prefix: str


@dataclass(frozen=True)
class ClassMap:
    """A table as a class.

    subject: IRI prefix; key: column, tuple of columns (joined by "/"), or None if the subject is the row itself.
    predicates: IRI -> column name or Ref.  A NULL gives no statement.  The key must be unique.  Rows without a key have
    no identity beyond one scan: a query that would compare them with those of another scan is refused.
    """

    cls: str
    table: str
    subject: str
    key: str | tuple[str, ...] | None
    predicates: dict[str, str | Ref] = field(hash=False)
    graph: str | None = None


@dataclass
class Catalog:
    spark: SparkSession
    tables: dict[str, Callable[[], DataFrame] | DataFrame] = field(default_factory=dict)
    maps: list[ClassMap] = field(default_factory=list)
    quads: DataFrame | None = None
    graphs: set[str] = field(default_factory=set)
    endpoints: dict[str, Catalog] = field(default_factory=dict)
    #: Updates since the quads were last written.
    pending: int = 0

    def table(self, name: str) -> DataFrame:
        got = self.tables[name]
        if callable(got):
            got = self.tables[name] = got()
        return got

    def empty_quads(self) -> DataFrame:
        return self.spark.createDataFrame([], QUADS)

    def named_graphs(self) -> list[str]:
        """Names of graphs with mapped tables (those of quads are found in the data)."""
        return sorted({m.graph for m in self.maps if m.graph})

    def with_quads(self, quads: DataFrame) -> Catalog:
        return Catalog(self.spark, self.tables, self.maps, quads, set(self.graphs), self.endpoints)


def quads_of(triples: DataFrame, graph: str | None = None) -> DataFrame:
    """(s, p, o) as quads of one graph."""
    return triples.select(F.lit(graph).cast("string").alias("g"), "s", "p", "o")
