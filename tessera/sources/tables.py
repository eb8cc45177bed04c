"""The Parquet tables of a test directory as classes; predicates are `t:` plus the column's name."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tessera.namespaces import RDFS, Namespace
from tessera.sources.catalog import Catalog, ClassMap, Ref

T = Namespace("http://example.org/tables#")
DATA = "http://example.org/data/"
PREFIXES = {"t": str(T), "d": DATA}


def _columns(names: str) -> dict[str, str | Ref]:
    return {T[n]: n for n in names.split()}


def _ref(column: str, table: str) -> Ref:
    return Ref(column, f"{DATA}{table}/")


#: Order and line number alone repeat in the generated lines, so their key has more columns.
#: table, class, key, columns, references (predicate -> column, table), label column
_MAPS = [
    ("region", "Region", "r_regionkey", "r_regionkey r_name", {}, "r_name"),
    ("nation", "Nation", "n_nationkey", "n_nationkey n_name n_regionkey", {"region": ("n_regionkey", "region")}, "n_name"),
    ("customer", "Customer", "c_custkey", "c_custkey c_name c_acctbal c_mktsegment c_nationkey", {"c_nation": ("c_nationkey", "nation")}, None),
    ("supplier", "Supplier", "s_suppkey", "s_suppkey s_name s_acctbal s_nationkey", {"s_nation": ("s_nationkey", "nation")}, None),
    ("part", "Part", "p_partkey", "p_partkey p_name p_brand p_type p_size p_retailprice", {}, None),
    ("orders", "Order", "o_orderkey", "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority", {"customer": ("o_custkey", "customer")}, None),
    ("lineitem", "LineItem", ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"), "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate", {"order": ("l_orderkey", "orders"), "part": ("l_partkey", "part"), "supplier": ("l_suppkey", "supplier")}, None),
    ("events", "Event", "event_id", "event_id ts user_id event_type value props", {}, None),
    ("documents", "Document", "doc_id", "doc_id text lang source n_chars", {}, None),
    ("labels", "Label", "doc_id", "quality toxic", {"document": ("doc_id", "documents")}, None),
    ("pages", "Page", "page_id", "page_id url html", {}, None),
    ("conversations", "Turn", ("conv_id", "turn"), "conv_id turn role content", {}, None),
    ("benchmark", "Item", "item_id", "item_id item_text", {}, None),
]
_RENAMED = {"content": "text", "item_text": "text"}


def class_map(table: str, graph: str | None = None) -> ClassMap:
    name, cls, key, columns, refs, label = next(m for m in _MAPS if m[0] == table)
    predicates = {p: _RENAMED.get(str(c), c) for p, c in _columns(columns).items()}
    predicates |= {T[p]: _ref(c, target) for p, (c, target) in refs.items()}
    if label:
        predicates[RDFS.label] = label
    return ClassMap(T[cls], name, f"{DATA}{name}/", key, predicates, graph)


def tables_catalog(spark: SparkSession, sf_dir: str, graphs: dict[str, str] | None = None, only: list[str] | None = None) -> Catalog:
    """Catalog of the directory's tables. graphs: table -> name of the graph it is in (default: the default graph)."""
    names = only or [m[0] for m in _MAPS]
    read = {n: (lambda n=n: spark.read.parquet(f"{sf_dir}/{n}.parquet")) for n in names}
    maps = [class_map(n, (graphs or {}).get(n)) for n in names]
    return Catalog(spark, read, maps)
