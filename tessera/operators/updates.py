"""Updates on immutable snapshots of the quad table: every operation gives a new catalog.

An operation writes what it changes, not the table: insertions are checkpointed and added to the plan of the table,
deletions are an anti-join on it (by broadcast where a count shows that they are few); after `PENDING` operations the
whole table is checkpointed, which cuts the lineage.  The table is a set, so only new statements are compared with it.

WHERE is evaluated once, on the old state; deletions come before insertions.  Statements of mapped tables can be matched
but not changed, and an insertion that they already make is still stored.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import patterns as p
from tessera import terms as t
from tessera.builder import _lifted
from tessera.errors import QueryError, ValidationError
from tessera.operators.lineage import checkpoint
from tessera.plans import algebra as a
from tessera.plans.compiler import Active, Compiler, Rel
from tessera.sources.catalog import Catalog

_KEYS = ["g", "s", "p", "o"]
#: Operations after which the table is written again, and statements that are broadcast at most.
PENDING, FEW = 8, 100_000


def _size(quads: tuple[a.Quads, ...], solutions: int) -> int:
    """Statements that templates make of so many solutions at most."""
    return sum(5 * len(q.triples) for q in quads) * solutions  # a quoted one makes more


def _stable(quads: tuple[a.Quads, ...]) -> bool:
    """Whether templates give the same statements again: they make no new nodes."""
    return not any(isinstance(x, t.BNode | t.Quoted) for q in quads for tr in q.triples for x in (tr.s, tr.p, tr.o))


def _same() -> Any:
    return reduce(lambda m, n: m & n, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in _KEYS])


def _renamed(y: DataFrame) -> DataFrame:
    return y.select(*[F.col(k).alias(f"{k}_") for k in _KEYS])


def _unite(x: DataFrame, y: DataFrame, most: int | None = None, stable: bool = False) -> DataFrame:
    """x and the statements of y that it lacks. most: the size of y at most, None to have it counted."""
    y = y if stable else checkpoint(y)
    small = most <= FEW if most is not None else y.limit(FEW + 1).count() <= FEW
    given = F.broadcast if small else (lambda z: z)
    there = x.join(given(_renamed(y)), _same(), "left_semi").distinct()  # no more rows than y
    return x.unionByName(checkpoint(y.distinct().join(given(_renamed(there)), _same(), "left_anti")))


def _without(x: DataFrame, y: DataFrame, most: int) -> DataFrame:
    """y: what templates, which can't make new nodes in deletions, give of checkpointed solutions."""
    y = _renamed(y)
    return x.join(F.broadcast(y) if most <= FEW else y, _same(), "left_anti")


def _of_graph(q: DataFrame, g: str | None) -> DataFrame:
    return q.filter(F.col("g").isNull() if g is None else F.col("g") == g)


def _relabel(q: DataFrame, g: str | None) -> DataFrame:
    return q.withColumn("g", F.lit(g).cast("string"))


def run_update(catalog: Catalog, op: a.Update, prefixes: dict[str, str] | None = None) -> Catalog:
    z = Compiler({**(prefixes or {}), **dict(op.prefixes)})
    try:
        out = _apply(catalog, op, z)
    except Exception:
        if op.silent:
            return catalog
        raise
    if out.quads is not None and out.quads is not catalog.quads:
        out.pending = catalog.pending + 1
        if out.pending >= PENDING:
            out.quads, out.pending = checkpoint(out.quads), 0
    return out


def _ref(z: Compiler, g: Any) -> str | None:
    """Name of a graph, None of the default graph."""
    if g is None or g == "DEFAULT":
        return None
    if isinstance(g, str):
        raise QueryError("analysis", f"one graph is needed, not {g}")
    return z.term(g).iri


def _quads_of(z: Compiler, quads: tuple[a.Quads, ...], rel: Rel, with_: str | None) -> DataFrame:
    """Templates instantiated for each solution, in their graphs."""
    parts = []
    for q in quads:
        g = z.term(q.graph) if q.graph is not None else None
        if isinstance(g, t.Var):
            if g.name not in rel.vars:
                continue
            from tessera.functions import columns as c

            lex = c.lexical(rel.val(g.name))
            made = _with_graph(z, q, rel, lex)
            parts.append(made)
        else:
            name = g.iri if g is not None else with_
            parts.append(z.construct(q.triples, rel).select(F.lit(name).cast("string").alias("g"), "s", "p", "o"))
    empty = rel.df.sparkSession.createDataFrame([], _schema())
    return reduce(DataFrame.unionByName, parts, empty)


def _with_graph(z: Compiler, q: a.Quads, rel: Rel, lex: Any) -> DataFrame:
    from tessera.functions import columns as c

    structs = []
    scope = rel.scope()
    for tr in q.triples:
        s, pr, o = (z.template_term(x, scope, next(iter(rel.vars.values()))[0]) for x in (tr.s, tr.p, tr.o))
        ok = (s["kind"] != c.LITERAL) & (pr["kind"] == c.IRI_KIND) & o.isNotNull() & lex.isNotNull()
        structs.append(F.when(ok, F.struct(lex.alias("g"), s.alias("s"), pr["lex"].alias("p"), o.alias("o"))))
    out = rel.df.select(F.explode(F.array(*structs)).alias("q")).filter("q is not null")
    return out.select("q.g", "q.s", "q.p", "q.o")


def _schema() -> str:
    from tessera.sources.catalog import QUADS

    return QUADS


def _names(catalog: Catalog, quads: tuple[a.Quads, ...], z: Compiler, with_: str | None = None) -> set[str]:
    out = {z.term(q.graph).iri for q in quads if q.graph is not None and not isinstance(z.term(q.graph), t.Var)}
    return out | ({with_} if with_ and any(q.graph is None for q in quads) else set())


def _exists(catalog: Catalog, g: str | None) -> bool:
    return g is None or g in catalog.graphs or g in catalog.named_graphs() or catalog.quads is not None and not _of_graph(catalog.quads, g).isEmpty()


def _apply(catalog: Catalog, op: a.Update, z: Compiler) -> Catalog:
    old = catalog.quads if catalog.quads is not None else catalog.empty_quads()
    unit = z.unit(Active(catalog))
    out = Catalog(catalog.spark, catalog.tables, catalog.maps, old, set(catalog.graphs), catalog.endpoints)
    if op.kind == "insert_data":
        out.quads = _unite(old, _quads_of(z, op.insert, unit, None), _size(op.insert, 1), _stable(op.insert))
        out.graphs |= _names(catalog, op.insert, z)
        return out
    if op.kind == "delete_data":
        out.quads = _without(old, _quads_of(z, op.delete, unit, None), _size(op.delete, 1))
        return out
    if op.kind in ("modify", "delete_where"):
        with_ = _ref(z, op.with_) if op.with_ is not None else None
        active = Active(catalog)
        if op.using or op.using_named:
            active = replace(active, from_=tuple(z.term(g).iri for g in op.using), named=tuple(z.term(g).iri for g in op.using_named))
        elif with_:
            active = replace(active, from_=(with_,))
        rel = z.group(op.where, active)
        rel = Rel(checkpoint(rel.df), rel.vars)  # evaluated once, on the old state
        quads, solutions = old, rel.df.count()
        if op.delete:
            quads = _without(quads, _quads_of(z, op.delete, rel, with_), _size(op.delete, solutions))
        if op.insert:
            quads = _unite(quads, _quads_of(z, op.insert, rel, with_), _size(op.insert, solutions), _stable(op.insert))
            out.graphs |= _names(catalog, op.insert, z, with_)
        out.quads = quads
        return out
    if op.kind == "load":
        from tessera.sources.rdf import read_rdf

        source = z.term(op.source).iri if not isinstance(op.source, str) else op.source
        target = _ref(z, op.target)
        out.quads = _unite(old, _relabel(read_rdf(catalog.spark, source.removeprefix("file://")), target).select(*_KEYS))
        if target:
            out.graphs.add(target)
        return out
    if op.kind in ("clear", "drop"):
        drop = op.kind == "drop"
        if op.target == "ALL":
            out.quads = old.filter(F.lit(False))
            out.graphs = set() if drop else out.graphs
        elif op.target == "NAMED":
            out.quads = old.filter("g is null")
            out.graphs = set() if drop else out.graphs
        else:
            g = _ref(z, op.target)
            if not _exists(catalog, g):
                raise QueryError("execution", f"no graph {g}")
            out.quads = old.filter(F.col("g").isNotNull() if g is None else ~F.col("g").eqNullSafe(F.lit(g)))
            if drop and g:
                out.graphs.discard(g)
        return out
    if op.kind == "create":
        g = _ref(z, op.target)
        if g is None or _exists(catalog, g):
            raise QueryError("execution", f"graph {g} is there already")
        out.graphs.add(g)
        return out
    source, target = _ref(z, op.source), _ref(z, op.target)
    if not _exists(catalog, source):
        raise QueryError("execution", f"no graph {source}")
    if source == target:
        return catalog
    moved = _relabel(_of_graph(old, source), target)
    if op.kind == "add":
        out.quads = _unite(old, moved)
    else:
        rest = old.filter(F.col("g").isNotNull() if target is None else ~F.col("g").eqNullSafe(F.lit(target)))
        if op.kind == "move":
            rest = rest.filter(F.col("g").isNotNull() if source is None else ~F.col("g").eqNullSafe(F.lit(source)))
            out.graphs.discard(source)
        out.quads = rest.unionByName(moved)
    if target:
        out.graphs.add(target)
    return out


# --- builder ---------------------------------------------------------------------------------------------


def _graph_arg(g: Any) -> Any:
    return g.upper() if isinstance(g, str) and g.upper() in ("DEFAULT", "NAMED", "ALL") else p.resource(g)


def _quads_arg(patterns: tuple) -> tuple[tuple[a.Quads, ...], tuple]:
    plain, out, binds = [], [], []
    for e in p.group_of(*patterns).elements:
        if isinstance(e, a.GraphEl):
            ts, more = _lifted(e.group.elements)
            out.append(a.Quads(ts, e.graph))
            binds += more
        else:
            plain.append(e)
    ts, more = _lifted(tuple(plain))
    return (*([a.Quads(ts)] if ts else []), *out), (*binds, *more)


@dataclass(frozen=True)
class UpdateBuilder:
    """Operations in order; immutable."""

    operations: tuple[a.Update, ...] = ()

    def _with(self, u: a.Update) -> UpdateBuilder:
        return UpdateBuilder((*self.operations, u))

    def insert_data(self, *patterns: Any) -> UpdateBuilder:
        quads, binds = _quads_arg(patterns)
        return self._with(a.Update("modify", insert=quads, where=a.Group(binds)) if binds else a.Update("insert_data", insert=quads))

    def delete_data(self, *patterns: Any) -> UpdateBuilder:
        return self._with(a.Update("delete_data", delete=_quads_arg(patterns)[0]))

    def delete_where(self, *patterns: Any) -> UpdateBuilder:
        quads = _quads_arg(patterns)[0]
        from tessera.parser import pattern_of

        return self._with(a.Update("delete_where", delete=quads, where=pattern_of(quads)))

    def modify(self) -> Modify:
        return Modify(self)

    def load(self, source: str, into: Any = None, silent: bool = False) -> UpdateBuilder:
        return self._with(a.Update("load", source=t.IRI(source), target=None if into is None else p.resource(into), silent=silent))

    def clear(self, target: Any = "DEFAULT", silent: bool = False) -> UpdateBuilder:
        return self._with(a.Update("clear", target=_graph_arg(target), silent=silent))

    def drop(self, target: Any = "DEFAULT", silent: bool = False) -> UpdateBuilder:
        return self._with(a.Update("drop", target=_graph_arg(target), silent=silent))

    def create(self, target: Any, silent: bool = False) -> UpdateBuilder:
        target = _graph_arg(target)
        if isinstance(target, str):
            raise ValidationError("create needs the name of a graph")
        return self._with(a.Update("create", target=target, silent=silent))

    def _two(self, kind: str, source: Any, target: Any, silent: bool) -> UpdateBuilder:
        source, target = _graph_arg(source), _graph_arg(target)
        if source in ("NAMED", "ALL") or target in ("NAMED", "ALL"):
            raise ValidationError(f"{kind} needs one graph on either side")
        return self._with(a.Update(kind, source=source, target=target, silent=silent))

    def copy(self, source: Any, target: Any, silent: bool = False) -> UpdateBuilder:
        return self._two("copy", source, target, silent)

    def move(self, source: Any, target: Any, silent: bool = False) -> UpdateBuilder:
        return self._two("move", source, target, silent)

    def add(self, source: Any, target: Any, silent: bool = False) -> UpdateBuilder:
        return self._two("add", source, target, silent)

    def execute(self, engine: Any, **options: Any) -> None:
        engine.update(self, **options)


@dataclass(frozen=True)
class Modify:
    base: UpdateBuilder
    deletes: tuple = ()
    inserts: tuple = ()
    wheres: tuple = ()
    graph: Any = None
    usings: tuple = ()

    def delete(self, *patterns: Any) -> Modify:
        return replace(self, deletes=(*self.deletes, *patterns))

    def insert(self, *patterns: Any) -> Modify:
        return replace(self, inserts=(*self.inserts, *patterns))

    def where(self, *patterns: Any) -> Modify:
        return replace(self, wheres=(*self.wheres, *patterns))

    def with_(self, g: Any) -> Modify:
        return replace(self, graph=p.resource(g))

    def using(self, *graphs: Any) -> Modify:
        return replace(self, usings=(*self.usings, *map(p.resource, graphs)))

    def done(self) -> UpdateBuilder:
        delete, b1 = _quads_arg(self.deletes)
        insert, b2 = _quads_arg(self.inserts)
        where = a.Group((*p.group_of(*self.wheres).elements, *b1, *(replace(b, var=b.var) for b in b2)))
        return self.base._with(a.Update("modify", insert, delete, where, self.graph, self.usings))


def update() -> UpdateBuilder:
    return UpdateBuilder()


def insert(*patterns: Any) -> UpdateBuilder:
    return UpdateBuilder().insert_data(*patterns)


def delete_op(*patterns: Any) -> UpdateBuilder:
    return UpdateBuilder().delete_data(*patterns)


def modify() -> Modify:
    return UpdateBuilder().modify()
