"""Algebra to DataFrame plans.

Each compiled part is a `Rel`: a DataFrame with one column for each variable, and what is known of each.  What the
optimizer can't know is decided here: patterns on one subject of a mapped class are one scan, hops along foreign keys join
keys, OPTIONAL columns of the same row need no join, EXISTS and MINUS become semi and anti joins, and joins on
variables that may be unbound are split so that equi-joins remain.  All else is left to Catalyst.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import terms as t
from tessera.errors import QueryError
from tessera.functions import columns as c
from tessera.functions.columns import Info, Scope, Val
from tessera.namespaces import PREFIXES, RDF, XSD
from tessera.operators.lineage import checkpoint
from tessera.plans import algebra as a
from tessera.sources.catalog import Catalog, ClassMap, Ref

_numbers = count()
HIDDEN = "_h"


def fresh() -> str:
    return f"c{next(_numbers)}"


@dataclass
class Rel:
    df: DataFrame
    vars: dict[str, tuple[str, Info]] = field(default_factory=dict)
    unit: bool = False
    small: bool = False
    nothing: bool = False  # known to be empty; its variables have no form of their own

    def scope(self, hidden: dict | None = None) -> Scope:
        return Scope({n: Val(F.col(col), i) for n, (col, i) in self.vars.items()}, hidden)

    def val(self, name: str) -> Val:
        col, i = self.vars[name]
        return Val(F.col(col), i)

    def keep(self, names: Iterable[str]) -> Rel:
        names = [n for n in names if n in self.vars]
        return Rel(self.df.select(*[self.vars[n][0] for n in names]), {n: self.vars[n] for n in names})

    def certain(self, name: str) -> bool:
        return not self.vars[name][1].nullable


@dataclass(frozen=True)
class Active:
    """What patterns are matched against."""

    catalog: Catalog
    graph: object = None  # None: default graph; else an IRI or a Var
    from_: tuple | None = None
    named: tuple | None = None


_INT = {"tinyint", "smallint", "int", "bigint"}


def native(df: DataFrame, column: str) -> Val | None:
    """A table's column as a value, None if no term has its type."""
    kind = dict(df.dtypes)[column]
    col = F.col(f"`{column}`")
    if kind in _INT:
        return Val(col.cast("bigint") if kind != "bigint" else col, c.INTEGER)
    if kind.startswith("decimal"):
        return Val(col.cast("decimal(38,18)"), c.DECIMAL)
    if kind == "timestamp":
        return Val(col.cast("timestamp_ntz"), Info("lit", XSD.dateTime))
    for dt, name in c.NATIVE.items():
        if kind == name:
            return Val(col, Info("lit", dt))
    return None


class Compiler:
    def __init__(self, prefixes: dict[str, str] | None = None, base: str | None = None):
        self.prefixes = {**{k: str(v) for k, v in PREFIXES.items()}, **(prefixes or {})}
        self.base = base

    # --- names ---------------------------------------------------------------------------------

    def term(self, x: object) -> object:
        """Prefixed names and relative IRIs resolved; blank nodes as hidden variables."""
        if isinstance(x, t.PName):
            p, local = x.text.split(":", 1)
            if p not in self.prefixes:
                raise QueryError("analysis", f"unknown prefix: {p!r}")
            return t.IRI(self.prefixes[p] + local.replace("\\", ""))
        if isinstance(x, t.IRI) and self.base and ":" not in x.iri:
            from urllib.parse import urljoin

            return t.IRI(urljoin(self.base, x.iri))
        if isinstance(x, t.BNode):
            return t.Var(f"{HIDDEN}b_{x.label}")
        if isinstance(x, a.Path):
            return a.Path(x.op, tuple(self.term(y) for y in x.args))
        return x

    def expr(self, e: t.Expr) -> t.Expr:
        if isinstance(e, t.Call):
            op = e.op
            if op.startswith("<") and ":" in op and "//" not in op and op[1:].split(":")[0] in self.prefixes:
                p, local = op[1:-1].split(":", 1)
                op = f"<{self.prefixes[p]}{local}>"
            return t.Call(op, tuple(self.expr(x) for x in e.args))
        if isinstance(e, t.Agg):
            return replace(e, arg=self.expr(e.arg)) if e.arg is not None else e
        if isinstance(e, t.PName):
            return self.term(e)
        return e

    # --- scans ---------------------------------------------------------------------------------

    def empty(self, active: Active, names: Iterable[str]) -> Rel:
        df, vars = active.catalog.spark.range(0).select(), {}
        for n in names:
            col = fresh()
            df, vars[n] = df.withColumn(col, F.lit(None).cast("string")), (col, c.IRI_INFO)
        return Rel(df, vars, nothing=True)

    def unit(self, active: Active) -> Rel:
        return Rel(active.catalog.spark.range(1).select(), unit=True)

    def quads(self, active: Active) -> DataFrame | None:
        """(s, p, o), with g where the graph is a variable."""
        q = active.catalog.quads
        if q is None:
            return None
        g = active.graph
        if g is None:
            if active.from_ is None:
                return q.filter("g is null").select("s", "p", "o")
            if not active.from_:
                return None
            out = q.filter(F.col("g").isin(*active.from_)).select("s", "p", "o")
            return out.distinct() if len(active.from_) > 1 else out
        if isinstance(g, t.IRI):
            if active.named is not None and g.iri not in active.named:
                return None
            return q.filter(F.col("g") == g.iri).select("s", "p", "o")
        out = q.filter("g is not null")
        return out.filter(F.col("g").isin(*active.named)) if active.named is not None else out

    def maps(self, active: Active) -> list[ClassMap]:
        g, maps = active.graph, active.catalog.maps
        if g is None:
            return [m for m in maps if (m.graph is None if active.from_ is None else m.graph in active.from_)]
        maps = [m for m in maps if m.graph and (active.named is None or m.graph in active.named)]
        return [m for m in maps if m.graph == g.iri] if isinstance(g, t.IRI) else maps

    def quad_triple(self, tr: a.Triple, df: DataFrame, active: Active) -> Rel:
        out: dict[str, tuple[Column, Info]] = {}
        conditions: list[Column] = []

        def bind(x: object, v: Val) -> None:
            if isinstance(x, t.Var):
                if x.name in out:
                    conditions.append(c.same_term(Val(*out[x.name]), v))
                else:
                    out[x.name] = (v.col, v.info)
                return
            if v.info.kind == "term":
                if isinstance(x, t.IRI):
                    conditions.append((v.col["lex"] == x.iri) & (v.col["kind"] == c.IRI_KIND))
                else:
                    conditions.append((v.col["lex"] == x.lex) & (v.col["kind"] == c.LITERAL) & (v.col["dt"] == x.dt) & v.col["lang"].eqNullSafe(F.lit(x.tag)))
            else:
                conditions.append(v.col == (x.iri if isinstance(x, t.IRI) else F.lit(None)))

        bind(tr.p, Val(F.col("p"), c.IRI_INFO))
        bind(tr.s, Val(F.col("s"), c.TERM_INFO))
        bind(tr.o, Val(F.col("o"), c.TERM_INFO))
        if isinstance(active.graph, t.Var):
            bind(active.graph, Val(F.col("g"), c.IRI_INFO))
        for k in conditions:
            df = df.filter(k)
        names = {n: (fresh(), i) for n, (_, i) in out.items()}
        return Rel(df.select(*[out[n][0].alias(names[n][0]) for n in out]), names)

    def map_star(self, m: ClassMap, subject: object, triples: list[a.Triple], optional: list[a.Triple], active: Active) -> Rel | None:
        """All triples of one subject from one scan of a mapped class; None if the class can't give one of them."""
        for tr in (*triples, *optional):  # before the table is opened
            if isinstance(tr.p, t.IRI) and (tr.o not in (t.IRI(m.cls),) and not isinstance(tr.o, t.Var) if tr.p.iri == RDF.type else tr.p.iri not in m.predicates):
                return None
        df = active.catalog.table(m.table)
        out: dict[str, Val] = {}
        where: list[Column] = []
        if m.key is None:
            key = Val(F.monotonically_increasing_id(), Info("iri", prefix=m.subject, row=True))
        elif isinstance(m.key, str):
            got = native(df, m.key)
            key = Val(got.col, Info("iri", prefix=m.subject))
        else:
            key = Val(F.concat(F.lit(m.subject), F.concat_ws("/", *[F.col(k).cast("string") for k in m.key])), c.IRI_INFO)
        if isinstance(subject, t.IRI):
            if not subject.iri.startswith(m.subject) or m.key is None:
                return None
            if isinstance(m.key, str):
                part, kind = subject.iri[len(m.subject) :], dict(df.dtypes)[m.key]
                if kind in _INT and not part.isdigit():
                    return None
                where.append(F.col(m.key) == (int(part) if kind in _INT else part))
            else:
                where.append(key.col == subject.iri)
        elif isinstance(subject, t.Var):
            out[subject.name] = key
        else:
            return None

        def of(predicate: str) -> Val | None:
            target = m.predicates.get(predicate)
            if target is None:
                return None
            if isinstance(target, Ref):
                got = native(df, target.column)
                return Val(got.col, Info("iri", prefix=target.prefix))
            return native(df, target)

        def bind(x: object, v: Val, needed: bool = True) -> bool:
            if isinstance(x, t.Var):
                if x.name in out:
                    where.append(c.same_term(out[x.name], v))
                    return True
                if needed:
                    where.append(v.col.isNotNull())
                out[x.name] = v if needed else v.maybe()
                return True
            same = self.constant_is(x, v)
            if same is None:
                return False
            where.append(same)
            return True

        free: list[a.Triple] = []
        for tr in triples:
            if isinstance(tr.p, t.Var):
                free.append(tr)
                continue
            if tr.p.iri == RDF.type:
                if isinstance(tr.o, t.Var):
                    if tr.o.name in out:
                        where.append(c.same_term(out[tr.o.name], Val(F.lit(m.cls), c.IRI_INFO)))
                    out[tr.o.name] = Val(F.lit(m.cls), c.IRI_INFO)
                elif not (isinstance(tr.o, t.IRI) and tr.o.iri == m.cls):
                    return None
                continue
            v = of(tr.p.iri)
            if v is None or not bind(tr.o, v):
                return None
        for tr in optional:
            v = of(tr.p.iri)
            if v is None:
                return None
            bind(tr.o, v, needed=False)
        if isinstance(active.graph, t.Var):
            bind(active.graph, Val(F.lit(m.graph), c.IRI_INFO))
        for k in where:
            df = df.filter(k)
        names = {n: (fresh(), v.info) for n, v in out.items()}
        every = [(RDF.type, Val(F.lit(m.cls), c.IRI_INFO)), *((p, of(p)) for p in m.predicates)] if free else []
        made = df.select(*[v.col.alias(names[n][0]) for n, v in out.items()], *[F.col(f"`{x}`") for x in ([] if not free else df.columns)])
        rel = Rel(made, names)
        for tr in free:  # one scan: a row gives a (predicate, object) for each column that is set
            pairs = F.array(*[F.struct(F.lit(str(p)).alias("p"), c.lift(v).col.alias("o")) for p, v in every if v is not None])
            each = fresh()
            df2 = rel.df.withColumn(each, F.explode(pairs)).filter(F.col(f"{each}.o").isNotNull())
            for x, v in ((tr.p, Val(F.col(f"{each}.p"), c.IRI_INFO)), (tr.o, Val(F.col(f"{each}.o"), c.TERM_INFO))):
                if isinstance(x, t.Var):
                    if x.name in rel.vars:
                        df2 = df2.filter(c.same_term(rel.val(x.name), v))
                    else:
                        col = fresh()
                        df2 = df2.withColumn(col, v.col)
                        rel.vars[x.name] = (col, v.info)
                else:
                    df2 = df2.filter(c.same_term(v, c.constant(x)))
            rel = Rel(df2, rel.vars)
        if free:
            rel = rel.keep(rel.vars)
        return rel

    @staticmethod
    def constant_is(x: object, v: Val) -> Column | None:
        """Condition that a native value is the constant term; None if it never is. Numbers match by value."""
        if isinstance(x, t.IRI):
            if v.info.kind != "iri":
                return None
            if v.info.prefix is None:
                return v.col == x.iri
            part = x.iri[len(v.info.prefix) :]
            return v.col.cast("string") == part if x.iri.startswith(v.info.prefix) and not part.isdigit() else v.col == int(part) if x.iri.startswith(v.info.prefix) else None
        k = c.constant(x)
        if k.info.numeric and v.info.numeric:
            return c.compare("eq", v, k).col
        return v.col == k.col if k.info.same == v.info.same else None

    # --- basic graph patterns --------------------------------------------------------------------

    def bgp(self, triples: list[a.Triple], active: Active, optional: dict | None = None, start: Rel | None = None) -> Rel:
        plain: list[a.Triple] = []
        paths: list[a.Triple] = []
        for tr in self.unquote(triples):
            s, p, o = (self.term(x) for x in (tr.s, tr.p, tr.o))
            if isinstance(p, a.Path) and p.op == "inv" and not isinstance(p.args[0], a.Path):
                s, p, o = o, p.args[0], s
            if isinstance(p, a.Path) and p.op == "seq":
                steps, at = p.args, s
                for k, step in enumerate(steps):
                    to = o if k == len(steps) - 1 else t.Var(f"{HIDDEN}p{next(_numbers)}")
                    x = a.Triple(at, step, to)
                    if isinstance(step, a.Path) and step.op == "inv" and not isinstance(step.args[0], a.Path):
                        x = a.Triple(to, step.args[0], at)
                    (paths if isinstance(x.p, a.Path) else plain).append(x)
                    at = to
                continue
            (paths if isinstance(p, a.Path) else plain).append(a.Triple(s, p, o))
        stars: dict[object, list[a.Triple]] = {}
        for tr in dict.fromkeys(plain):
            stars.setdefault(tr.s, []).append(tr)
        rels = [self.star(s, ts, active, (optional or {}).get(s, [])) for s, ts in stars.items()]
        constants = {id(r): sum(not isinstance(x, t.Var) for tr in ts for x in (tr.s, tr.o)) for r, ts in zip(rels, stars.values(), strict=True)}
        rel = start
        while rels:
            linked = [r for r in rels if rel is not None and set(r.vars) & set(rel.vars)] or rels
            best = max(linked, key=lambda r: constants[id(r)])
            rels.remove(best)
            rel = best if rel is None else self.join(rel, best)
        while paths:
            near = next((p for p in paths if rel is not None and {x.name for x in (p.s, p.o) if isinstance(x, t.Var)} & set(rel.vars)), paths[0])
            paths.remove(near)
            from tessera.operators.paths import path

            made = path(self, near.s, near.p, near.o, active, rel)
            rel = made if rel is None else self.join(rel, made)
        return rel if rel is not None else self.unit(active)

    def unquote(self, triples: Iterable[a.Triple]) -> list[a.Triple]:
        """Quoted triples as statements with subject, predicate and object."""
        out: list[a.Triple] = []
        names: dict[t.Quoted, t.Var] = {}

        def node(x: object) -> object:
            if not isinstance(x, t.Quoted):
                return x
            if x not in names:
                names[x] = t.Var(f"{HIDDEN}q{next(_numbers)}")
                for p, y in ((RDF.subject, x.s), (RDF.predicate, x.p), (RDF.object, x.o)):
                    out.append(a.Triple(names[x], t.IRI(p), node(y)))
            return names[x]

        for tr in triples:
            out.append(a.Triple(node(tr.s), tr.p, node(tr.o)))
        return out

    def star(self, subject: object, triples: list[a.Triple], active: Active, optional: list[a.Triple]) -> Rel:
        quads = self.quads(active)
        maps = self.maps(active)
        found = [r for m in maps if (r := self.map_star(m, subject, triples, optional, active)) is not None]
        if quads is not None:
            one = []
            for tr in triples:
                one.append(self.quad_triple(tr, quads, active))
            rel = reduce(self.join, one)
            for tr in optional:
                rel = self.left_join(rel, self.quad_triple(tr, quads, active), [])
            if maps and len(triples) > 1 and not found:
                rel = self.mixed(subject, triples, active, quads, maps)  # a subject may have statements of both kinds
                for tr in optional:
                    rel = self.left_join(rel, self.one(subject, tr, active, quads, maps), [])
                return rel
            found.append(rel)
        if not found:
            names = [x.name for tr in [*triples, *optional] for x in (tr.s, tr.p, tr.o) if isinstance(x, t.Var)]
            return self.empty(active, [*dict.fromkeys(names), *([active.graph.name] if isinstance(active.graph, t.Var) else [])])
        out = reduce(self.union, found)
        if active.graph is None and active.from_ is not None and len(active.from_) > 1 and len(found) > 1:
            out = Rel(out.df.distinct(), out.vars)
        return out

    def one(self, subject: object, tr: a.Triple, active: Active, quads: DataFrame, maps: list[ClassMap]) -> Rel:
        parts = [r for m in maps if (r := self.map_star(m, subject, [tr], [], active)) is not None]
        return reduce(self.union, [*parts, self.quad_triple(tr, quads, active)])

    def mixed(self, subject: object, triples: list[a.Triple], active: Active, quads: DataFrame, maps: list[ClassMap]) -> Rel:
        return reduce(self.join, [self.one(subject, tr, active, quads, maps) for tr in triples])

    # --- joins -----------------------------------------------------------------------------------

    def aligned(self, x: Rel, y: Rel, names: Iterable[str]) -> tuple[Rel, Rel]:
        """Both with the named variables in one form (term identity is then column equality)."""
        names = list(names)
        for n in names:
            if x.vars[n][1].row and y.vars[n][1].row:
                raise QueryError("analysis", f"?{n} names rows of a class without a key, which two patterns can't share")
            if x.vars[n][1].same != y.vars[n][1].same:
                x, y = self.lifted(x, n), self.lifted(y, n)
        return x, y

    @staticmethod
    def lifted(r: Rel, name: str) -> Rel:
        col, i = r.vars[name]
        if i.kind == "term":
            return r
        new = fresh()
        v = c.lift(Val(F.col(col), i))
        return Rel(r.df.withColumn(new, v.col).drop(col), {**r.vars, name: (new, v.info)}, small=r.small)

    def join(self, x: Rel, y: Rel) -> Rel:
        if x.unit:
            return y
        if y.unit:
            return x
        shared = [n for n in x.vars if n in y.vars]
        x, y = self.aligned(x, y, shared)
        if not shared:
            right = F.broadcast(y.df) if y.small else y.df
            left = F.broadcast(x.df) if x.small and not y.small else x.df
            return Rel(left.crossJoin(right), {**x.vars, **y.vars}, small=x.small and y.small)
        loose = [n for n in shared if not (x.certain(n) and y.certain(n))]
        if not loose:
            return self._equi(x, y, shared)
        n = loose[0]
        parts = []
        for xs in self.split(x, n):
            for ys in self.split(y, n):
                parts.append(self.join(xs, ys))
        return reduce(self.union, parts)

    @staticmethod
    def split(r: Rel, name: str) -> list[Rel]:
        """The rows where a variable is bound, and those where it isn't (without the variable)."""
        col, i = r.vars[name]
        if not i.nullable:
            return [r]
        bound = Rel(r.df.filter(F.col(col).isNotNull()), {**r.vars, name: (col, replace(i, nullable=False))}, small=r.small)
        rest = {k: v for k, v in r.vars.items() if k != name}
        return [bound, Rel(r.df.filter(F.col(col).isNull()).drop(col), rest, small=r.small)]

    @staticmethod
    def _equi(x: Rel, y: Rel, shared: list[str]) -> Rel:
        right = F.broadcast(y.df) if y.small else y.df
        left = F.broadcast(x.df) if x.small and not y.small else x.df
        renamed = {n: fresh() for n in shared}
        for n in shared:
            right = right.withColumnRenamed(y.vars[n][0], renamed[n])
        on = reduce(lambda p, q: p & q, [F.col(x.vars[n][0]) == F.col(renamed[n]) for n in shared])
        df = left.join(right, on).drop(*renamed.values())
        return Rel(df, {**y.vars, **x.vars}, small=x.small and y.small)

    @staticmethod
    def _condition(x: Rel, shared: list[str], cols: dict[str, str]) -> Column | None:
        parts = [F.col(x.vars[n][0]) == F.col(cols[n]) for n in shared]
        return reduce(lambda p, q: p & q, parts) if parts else None

    @staticmethod
    def loose(x: Rel, y: Rel) -> str | None:
        """A shared variable that may be unbound on a side."""
        return next((n for n in x.vars if n in y.vars and not (x.certain(n) and y.certain(n))), None)

    def left_join(self, x: Rel, y: Rel, exprs: list[t.Expr]) -> Rel:
        """Rows of x with their compatible rows of y, or alone. A variable that may be unbound splits both sides, so that
        every join has equal keys."""
        shared = [n for n in x.vars if n in y.vars]
        x, y = self.aligned(x, y, shared)
        if n := self.loose(x, y):
            parts = []
            for xs in self.split(x, n):
                ys = self.split(y, n) if n in xs.vars else [y]
                if len(ys) == 1:
                    parts.append(self.left_join(xs, ys[0], exprs))
                    continue
                for part in ys:
                    both = self.join(xs, part)
                    for e in exprs:
                        both = Rel(both.df.filter(c.ebv(both.scope().value(self.expr(e)))), both.vars)
                    parts.append(both)
                parts.append(reduce(lambda r, part: self.anti(r, part, "left_anti", minus=False, exprs=exprs), ys, xs))
            return reduce(self.union, parts)
        right = F.broadcast(y.df) if y.small else y.df
        cols = {n: fresh() for n in shared}
        for n in shared:
            right = right.withColumnRenamed(y.vars[n][0], cols[n])
        on = self._condition(x, shared, cols)
        scope = Scope({**{n: Val(F.col(col), i) for n, (col, i) in y.vars.items() if n not in cols}, **{n: x.val(n) for n in x.vars}})
        for e in exprs:
            k = c.ebv(scope.value(self.expr(e)))
            on = k if on is None else on & k
        df = x.df.join(right, on if on is not None else F.lit(True), "left")
        vars = {n: (col, replace(i, nullable=True)) for n, (col, i) in y.vars.items() if n not in cols}
        return Rel(df.drop(*cols.values()), {**vars, **x.vars})

    def anti(self, x: Rel, y: Rel, how: str, minus: bool, exprs: list[t.Expr] = ()) -> Rel:
        """Rows of x without (or, semi, with) a compatible row of y; split like those of left_join."""
        shared = [n for n in x.vars if n in y.vars]
        if minus and not shared:
            return x
        x, y = self.aligned(x, y, shared)
        if n := self.loose(x, y):
            parts = []
            for rest in self.split(x, n):
                for part in self.split(y, n) if n in rest.vars else [y]:
                    if how == "left_semi":
                        parts.append(self.anti(rest, part, how, minus, exprs))
                    rest = self.anti(rest, part, "left_anti", minus, exprs)
                if how == "left_anti":
                    parts.append(rest)
            out = reduce(self.union, parts)
            return Rel(out.df, {n: out.vars[n] for n in x.vars})
        cols = {n: fresh() for n in shared}
        right = y.df
        for n in shared:
            right = right.withColumnRenamed(y.vars[n][0], cols[n])
        on = self._condition(x, shared, cols)
        if exprs:
            scope = Scope({**{n: Val(F.col(cols.get(n, col)), i) for n, (col, i) in y.vars.items()}, **{n: x.val(n) for n in x.vars}})
            for e in exprs:
                k = c.ebv(scope.value(self.expr(e)))
                on = k if on is None else on & k
        if not exprs and shared:
            right = right.select(*cols.values())
        df = x.df.join(right, on if on is not None else F.lit(True), how)
        return Rel(df, x.vars)

    def union(self, x: Rel, y: Rel) -> Rel:
        for p, q in ((x, y), (y, x)):
            if p.nothing and set(p.vars) <= set(q.vars):
                return q
        names = list(dict.fromkeys([*x.vars, *y.vars]))
        left, right, vars = [], [], {}
        for n in names:
            col = fresh()
            if n in x.vars and n in y.vars:
                p, q = c.common(x.val(n), y.val(n))
                info = replace(p.info, nullable=p.info.nullable or q.info.nullable)
            elif n in x.vars:
                p = x.val(n)
                q, info = None, replace(p.info, nullable=True)
            else:
                q = y.val(n)
                p, info = None, replace(q.info, nullable=True)
            left.append((p.col if p else F.lit(None)).alias(col))
            right.append((q.col if q else F.lit(None)).alias(col))
            vars[n] = (col, info)
        return Rel(x.df.select(*left).union(y.df.select(*right)), vars)

    # --- groups ------------------------------------------------------------------------------------

    def group(self, g: a.Group, active: Active) -> Rel:
        rel, filters = self.parts(g, active)
        return self.filtered(rel, filters, active)

    def parts(self, g: a.Group, active: Active) -> tuple[Rel, list[t.Expr]]:
        """The group without its filters, and those."""
        rel = self.unit(active)
        filters: list[t.Expr] = []
        waiting: list[a.Triple] = []
        elements = list(g.elements)

        def flush(optional: dict | None = None) -> None:
            nonlocal rel
            if waiting:
                made = self.bgp(list(waiting), active, optional, start=None if rel.unit else rel)
                rel = made
                waiting.clear()

        k = 0
        while k < len(elements):
            e = elements[k]
            if isinstance(e, a.Triple):
                waiting.append(e)
            elif isinstance(e, a.Filter):
                filters.append(e.expr)
            elif isinstance(e, a.Optional_):
                same: dict[object, list[a.Triple]] = {}
                if waiting:
                    while k < len(elements) and isinstance(elements[k], a.Optional_) and (row := self.same_row(elements[k], waiting, rel, same, active)):
                        same.setdefault(row.s, []).append(row)
                        k += 1
                    flush(same)
                    if same:
                        continue
                inner, conditions = self.parts(e.group, active)
                outside = [x for x in conditions if not self.exists_in(x)]
                inner = self.filtered(inner, [x for x in conditions if self.exists_in(x)], active)
                rel = self.left_join(rel, inner, outside)
            else:
                flush()
                rel = self.element(rel, e, active)
            k += 1
        flush()
        return rel, filters

    @staticmethod
    def exists_in(e: t.Expr) -> bool:
        return any(isinstance(x, t.Exists) for x in t.walk(e))

    def same_row(self, e: a.Optional_, waiting: list[a.Triple], rel: Rel, have: dict, active: Active) -> a.Triple | None:
        """An OPTIONAL that is one column of a mapped row that the pattern reads anyway: no join is needed."""
        if len(e.group.elements) != 1 or not isinstance(tr := e.group.elements[0], a.Triple) or active.catalog.quads is not None:
            return None
        s, p, o = (self.term(x) for x in (tr.s, tr.p, tr.o))
        if not isinstance(s, t.Var) or not isinstance(p, t.IRI) or not isinstance(o, t.Var) or p.iri == RDF.type:
            return None
        star = [a.Triple(self.term(x.s), self.term(x.p), self.term(x.o)) for x in waiting if self.term(x.s) == s]
        used = {y.name for x in waiting for y in (self.term(x.s), self.term(x.p), self.term(x.o)) if isinstance(y, t.Var)} | set(rel.vars) | {y.o.name for z in have.values() for y in z}
        if not star or o.name in used or any(not isinstance(x.p, t.IRI) for x in star):
            return None
        fit = [m for m in self.maps(active) if self.map_star(m, s, star, [], active) is not None]
        return a.Triple(s, p, o) if len(fit) == 1 and p.iri in fit[0].predicates else None

    def element(self, rel: Rel, e: object, active: Active) -> Rel:
        if isinstance(e, a.Group):
            return self.join(rel, self.group(e, active))
        if isinstance(e, a.Union_):
            return self.join(rel, reduce(self.union, [self.group(b, active) for b in e.branches]))
        if isinstance(e, a.Minus):
            return self.anti(rel, self.group(e.group, active), "left_anti", minus=True)
        if isinstance(e, a.Values):
            return self.join(rel, self.values(e, active))
        if isinstance(e, a.Bind):
            return self.extend(rel, e.var, e.expr, active)
        if isinstance(e, a.GraphEl):
            g = self.term(e.graph)
            inner = self.group(e.group, replace(active, graph=g))
            if isinstance(g, t.Var) and g.name not in inner.vars:
                inner = self.join(inner, self.graph_names(g, active))
            return self.join(rel, inner)
        if isinstance(e, a.SubQuery):
            return self.join(rel, self.query(e.query, active, inner=True))
        if isinstance(e, a.Service):
            return self.service(rel, e, active)
        raise QueryError("analysis", f"unknown element: {e!r}")

    def graph_names(self, g: t.Var, active: Active) -> Rel:
        col = fresh()
        spark = active.catalog.spark
        names = spark.createDataFrame([(n,) for n in {*active.catalog.named_graphs(), *active.catalog.graphs}], "g string")
        if active.catalog.quads is not None:
            names = names.union(active.catalog.quads.select("g").filter("g is not null")).distinct()
        if active.named is not None:
            names = names.filter(F.col("g").isin(*active.named))
        return Rel(names.select(F.col("g").alias(col)), {g.name: (col, c.IRI_INFO)})

    def service(self, rel: Rel, e: a.Service, active: Active) -> Rel:
        ep = self.term(e.endpoint)
        catalog = active.catalog.endpoints.get(ep.iri) if isinstance(ep, t.IRI) else None
        try:
            if catalog is None:
                raise QueryError("execution", f"no such endpoint: {ep!r}")
            made = self.group(e.group, Active(catalog))
            if e.silent:
                made = Rel(checkpoint(made.df), made.vars)
        except Exception:
            if e.silent:
                return rel
            raise
        return self.join(rel, made)

    def values(self, e: a.Values, active: Active) -> Rel:
        spark = active.catalog.spark
        rows = [[self.term(x) for x in r] for r in e.rows]
        vals: list[list[Val | None]] = [[None if isinstance(x, t._Undef) else c.constant(x) for x in r] for r in rows]
        forms = []
        for k in range(len(e.vars)):
            kinds = {r[k].info.same for r in vals if r[k] is not None}
            forms.append(next(iter(kinds)) if len(kinds) == 1 else ("term", None, None) if kinds else ("iri", None, None))
        names = {n: (fresh(), Info(*forms[k], nullable=any(r[k] is None for r in vals))) for k, n in enumerate(e.vars)}
        if not rows:
            return self.empty(active, e.vars)
        structs = []
        for r in vals:
            cells = []
            for k, n in enumerate(e.vars):
                x = r[k]
                kind = c.TERM if forms[k][0] == "term" else c.NATIVE.get(forms[k][1], "string")
                col = F.lit(None).cast(kind) if x is None else (c.lift(x).col if forms[k][0] == "term" else x.col)
                cells.append(col.alias(names[n][0]))
            structs.append(F.struct(*cells) if cells else F.struct(F.lit(0).alias("_")))
        each = fresh()
        df = spark.range(1).select(F.explode(F.array(*structs)).alias(each)).select(*[F.col(each)[names[n][0]].alias(names[n][0]) for n in e.vars])
        return Rel(df, names, small=True)

    def extend(self, rel: Rel, name: str, e: t.Expr, active: Active) -> Rel:
        if name in rel.vars:
            raise QueryError("analysis", f"?{name} is bound already")
        rel, hidden = self.with_exists(rel, [e], active)
        v = rel.scope(hidden).value(self.expr(e))
        col = fresh()
        return Rel(rel.df.withColumn(col, v.col), {**rel.vars, name: (col, replace(v.info, nullable=True) if not isinstance(e, t.Lit | t.IRI) else v.info)})

    # --- filters -----------------------------------------------------------------------------------

    def filtered(self, rel: Rel, exprs: Iterable[t.Expr], active: Active) -> Rel:
        for e in self.conjuncts(exprs):
            negated, inner = False, e
            while isinstance(inner, t.Call) and inner.op == "not":
                negated, inner = not negated, inner.args[0]
            if isinstance(inner, t.Exists):
                rel = self.exists(rel, inner, negated != inner.negated, active)
                continue
            rel, hidden = self.with_exists(rel, [e], active)
            e = self.expr(e)
            if isinstance(e, t.Call) and e.op == "bound" and isinstance(e.args[0], t.Var) and e.args[0].name in rel.vars:
                n = e.args[0].name
                rel = Rel(rel.df.filter(F.col(rel.vars[n][0]).isNotNull()), {**rel.vars, n: (rel.vars[n][0], replace(rel.vars[n][1], nullable=False))})
                continue
            rel = Rel(rel.df.filter(c.ebv(rel.scope(hidden).value(e))), rel.vars)
        return rel

    @staticmethod
    def conjuncts(exprs: Iterable[t.Expr]) -> list[t.Expr]:
        out: list[t.Expr] = []
        todo = list(exprs)
        while todo:
            e = todo.pop(0)
            if isinstance(e, t.Call) and e.op == "and":
                todo = [*e.args, *todo]
            else:
                out.append(e)
        return out

    def _inner(self, rel: Rel, e: t.Exists, active: Active) -> tuple[Rel, list[t.Expr]]:
        """The pattern of an EXISTS, and its filters that need variables of the outer row."""
        inner, filters = self.parts(e.group, active)
        outer = []
        own = []
        for f in self.conjuncts(filters):
            names = {x.name for x in t.walk(f) if isinstance(x, t.Var)}
            (outer if names - set(inner.vars) and names & set(rel.vars) and not self.exists_in(f) else own).append(f)
        return self.filtered(inner, own, active), outer

    def exists(self, rel: Rel, e: t.Exists, negated: bool, active: Active) -> Rel:
        inner, outer = self._inner(rel, e, active)
        return self.anti(rel, inner, "left_anti" if negated else "left_semi", minus=False, exprs=outer)

    def with_exists(self, rel: Rel, exprs: Iterable[t.Expr], active: Active) -> tuple[Rel, dict]:
        """EXISTS inside larger expressions as marker columns."""
        hidden: dict[object, Val] = {}
        for e in {x for y in exprs for x in t.walk(y) if isinstance(x, t.Exists)}:
            row, mark = fresh(), fresh()
            name = HIDDEN + row
            marked = Rel(rel.df.withColumn(row, F.monotonically_increasing_id()), {**rel.vars, name: (row, c.INTEGER)})
            inner, outer = self._inner(rel, e, active)
            shared = [n for n in rel.vars if n in inner.vars]
            if not outer and shared and all(rel.certain(n) and inner.certain(n) for n in shared):
                x, y = self.aligned(rel, inner, shared)
                keys = {n: fresh() for n in shared}
                right = y.df.select(*[F.col(y.vars[n][0]).alias(keys[n]) for n in shared]).distinct().withColumn(mark, F.lit(True))
                on = reduce(lambda p, q: p & q, [F.col(x.vars[n][0]) == F.col(keys[n]) for n in shared])
                rel = Rel(x.df.join(right, on, "left").drop(*keys.values()), x.vars)
            else:
                marked = Rel(checkpoint(marked.df), marked.vars)
                found = self.anti(marked, inner, "left_semi", minus=False, exprs=outer)
                kept = found.df.select(F.col(found.vars[name][0]).alias(row + "r"), F.lit(True).alias(mark))
                rel = Rel(marked.df.join(kept, F.col(row) == F.col(row + "r"), "left").drop(row, row + "r"), rel.vars)
            found = F.coalesce(F.col(mark), F.lit(False))
            hidden[e] = Val(~found if e.negated else found, c.BOOLEAN)
        return rel, hidden

    # --- queries -----------------------------------------------------------------------------------

    def query(self, q: a.Query, active: Active, inner: bool = False) -> Rel:
        """A SELECT; the columns of the result are those of its projection."""
        if q.prefixes or q.base:
            return Compiler({**self.prefixes, **dict(q.prefixes)}, q.base or self.base).query(replace(q, prefixes=(), base=None), active, inner)
        if q.from_ or q.from_named:
            active = replace(active, from_=tuple(self.term(g).iri for g in q.from_), named=tuple(self.term(g).iri for g in q.from_named))
        rel = self.group(q.where, active)
        if q.values:
            rel = self.join(rel, self.values(q.values, active))
        projection = q.projection
        if projection == "*":
            projection = tuple((n, None) for n in rel.vars if not n.startswith(HIDDEN))
        exprs = [e for _, e in projection if e is not None] + list(q.having) + [e for e, _ in q.order_by]
        hidden: dict[object, Val] = {}
        if q.group_by or any(isinstance(x, t.Agg) for e in exprs for x in t.walk(e)):
            aliases = {n: e for n, e in projection if e is not None}
            rel, hidden = self.grouped(rel, q, [self.expr(e) for e in exprs], aliases, active)
        for n, e in projection:
            if e is None:
                continue
            rel, more = self.with_exists(rel, [e], active)
            v = rel.scope({**hidden, **more}).value(self.expr(e))
            col = fresh()
            rel = Rel(rel.df.withColumn(col, v.col), {**rel.vars, n: (col, v.info)})
        if q.having:
            for e in q.having:
                rel = Rel(rel.df.filter(c.ebv(rel.scope(hidden).value(self.expr(e)))), rel.vars)
        names = [n for n, _ in projection]
        for n in names:
            if n not in rel.vars:
                col = fresh()
                rel = Rel(rel.df.withColumn(col, F.lit(None).cast("string")), {**rel.vars, n: (col, Info("lit", XSD.string, nullable=True))})
        keys = []
        df = rel.df
        for e, up in q.order_by:
            for k in c.sort_keys(rel.scope(hidden).value(self.expr(e))):
                col = fresh()
                df = df.withColumn(col, k)
                keys.append((col, F.col(col).asc_nulls_first() if up else F.col(col).desc_nulls_last()))
        cols = [rel.vars[n][0] for n in dict.fromkeys(names)]
        out = {n: rel.vars[n] for n in dict.fromkeys(names)}
        if q.modifier == "distinct":
            if keys:
                df = df.groupBy(*cols).agg(*[F.min(k).alias(k) for k, _ in keys]) if cols else df
            else:
                df = df.select(*cols).distinct()
        if keys and not (inner and q.limit is None and not q.offset):  # the order of a part means nothing by itself
            df = df.orderBy(*[k for _, k in keys])
        df = df.select(*cols)
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        return Rel(df, out)

    def grouped(self, rel: Rel, q: a.Query, exprs: list[t.Expr], aliases: dict, active: Active) -> tuple[Rel, dict]:
        keys: list[tuple[str | None, t.Expr, str, Info]] = []
        df = rel.df
        scope = rel.scope()
        for e, name in q.group_by:
            e = self.expr(e)
            if isinstance(e, t.Var) and e.name not in rel.vars:
                continue  # an unbound key: one group (an aggregate's own alias among them)
            v = scope.value(e)
            col = fresh()
            df = df.withColumn(col, v.col)
            keys.append((name or (e.name if isinstance(e, t.Var) else None), e, col, v.info))
        aggs: dict[t.Agg, None] = {}
        for e in exprs:
            for x in t.walk(e):
                if isinstance(x, t.Agg):
                    aggs[x] = None
        plan, results = [], {}
        for x in aggs:
            made = self.aggregate(x, scope, [col for col, _ in rel.vars.values()])
            cols = []
            for k in made[0]:
                col = fresh()
                plan.append(k.alias(col))
                cols.append(F.col(col))
            results[x] = made[1](*cols)
        if keys:
            out = df.groupBy(*[k[2] for k in keys]).agg(*plan) if plan else df.select(*[k[2] for k in keys]).distinct()
        else:
            out = df.agg(*plan) if plan else df.limit(1)
        vars = {name: (col, i) for name, _, col, i in keys if name}
        hidden: dict[object, Val] = dict(results)
        for _, e, col, i in keys:
            if not isinstance(e, t.Var):
                hidden[e] = Val(F.col(col), i)
        return Rel(out, vars), hidden

    def aggregate(self, x: t.Agg, scope: Scope, columns: list[str]) -> tuple:
        """Aggregate columns, and a function of their results to the value."""
        maybe = lambda i: replace(i, nullable=True)
        if x.arg is None:
            if x.distinct:
                return [F.count_distinct(F.struct(*columns) if columns else F.lit(1))], lambda n: Val(n, c.INTEGER)
            return [F.count(F.lit(1))], lambda n: Val(n, c.INTEGER)
        v = scope.value(x.arg)
        if x.op == "count":
            return [F.count_distinct(v.col) if x.distinct else F.count(v.col)], lambda n: Val(n, c.INTEGER)
        if x.op in ("sum", "avg"):
            n = c.number(v)
            bad = F.count(F.lit(1)) - F.count(n) if v.info.nullable or not v.info.numeric else F.lit(0).cast("bigint")
            if x.distinct:
                total = F.sum_distinct(n)
                number = F.count_distinct(n)
            else:
                total, number = F.sum(n), F.count(n)
            if v.info.numeric:
                zero = F.lit(0)
                if v.info.dt == XSD.integer:
                    total = F.try_sum(n) if not x.distinct else total
                    if x.op == "avg":  # the sum may be wider than the numbers
                        wide = n.cast("decimal(20,0)")
                        total = F.sum_distinct(wide) if x.distinct else F.sum(wide)
                if x.op == "sum":
                    kind = c.NATIVE[v.info.dt]
                    return [total, bad, number], lambda s, b, n: Val(F.when(b == 0, F.when(n == 0, zero).otherwise(s)).cast(kind), maybe(v.info))
                info = c.DECIMAL if v.info.dt in (XSD.integer, XSD.decimal) else c.DOUBLE
                kind = c.NATIVE[info.dt]
                if info is c.DECIMAL:
                    return [total, bad, number], lambda s, b, n: Val(F.when(b == 0, F.when(n == 0, zero.cast(kind)).otherwise(c.quotient(s, n))), maybe(info))
                mean = F.avg(n) if not x.distinct else F.sum_distinct(n) / F.when(number != 0, number)
                return [mean, bad, number], lambda s, b, n: Val(F.when(b == 0, F.when(n == 0, zero).otherwise(s)).cast(kind), maybe(info))
            top = F.max(c.rank(v))
            if x.op == "sum":
                return [total, bad, number, top], lambda s, b, n, r: Val(F.when(b == 0, c.number_term(F.when(n == 0, F.lit(0.0)).otherwise(s), F.coalesce(r, F.lit(0)))), maybe(c.TERM_INFO))
            return [total, bad, number, top], lambda s, b, n, r: Val(F.when(b == 0, c.number_term(F.when(n == 0, F.lit(0.0)).otherwise(s / F.when(n != 0, n)), F.when(n == 0, F.lit(0)).otherwise(F.greatest(r, F.lit(1))))), maybe(c.TERM_INFO))
        if x.op in ("min", "max", "sample"):
            f = F.max if x.op == "max" else F.min
            if v.info.kind != "term":
                return [f(v.col)], lambda k: Val(k, maybe(v.info))
            keys = F.when(v.col.isNotNull(), F.struct(*[k.alias(f"k{i}") for i, k in enumerate(c.sort_keys(v))], v.col.alias("t")))
            return [f(keys)], lambda k: Val(k["t"], maybe(c.TERM_INFO))
        if x.op == "group_concat":
            s = c.lexical(v)
            items = F.collect_set(s) if x.distinct else F.collect_list(s)
            return [items], lambda xs: Val(F.array_join(F.sort_array(xs), x.sep), c.STRING)
        raise QueryError("analysis", f"unknown aggregate: {x.op}")

    # --- graphs --------------------------------------------------------------------------------------

    def construct(self, template: Iterable[a.Triple], rel: Rel) -> DataFrame:
        """(s, p, o) terms of a template for each solution; ill-formed triples are left out. One pass over the
        solutions, so a blank node of the template is the same in all triples of a solution."""
        row = fresh()
        triples = self.unquoted_template(template)
        fresh_nodes = any(isinstance(x, t.BNode) for tr in triples for x in (tr.s, tr.p, tr.o))
        df = rel.df.withColumn(row, F.uuid()) if fresh_nodes else rel.df
        scope = rel.scope()
        structs = []
        for tr in triples:
            s, p, o = (self.template_term(x, scope, row) for x in (tr.s, tr.p, tr.o))
            ok = (s["kind"] != c.LITERAL) & (p["kind"] == c.IRI_KIND) & o.isNotNull()
            structs.append(F.when(ok, F.struct(s.alias("s"), p["lex"].alias("p"), o.alias("o"))))
        if not structs:
            return rel.df.sparkSession.createDataFrame([], f"s {c.TERM}, p string, o {c.TERM}")
        each = fresh()
        out = df.select(F.explode(F.array(*structs)).alias(each)).filter(F.col(each).isNotNull())
        return out.select(F.col(f"{each}.s").alias("s"), F.col(f"{each}.p").alias("p"), F.col(f"{each}.o").alias("o")).distinct()

    def unquoted_template(self, template: Iterable[a.Triple]) -> list[a.Triple]:
        out = []
        names: dict[t.Quoted, t.BNode] = {}

        def node(x: object) -> object:
            if isinstance(x, t.Quoted):
                if x not in names:
                    names[x] = t.BNode(f"q{len(names)}")
                    for p, y in ((RDF.subject, x.s), (RDF.predicate, x.p), (RDF.object, x.o)):
                        out.append(a.Triple(names[x], t.IRI(p), node(y)))
                return names[x]
            return x

        for tr in template:
            out.append(a.Triple(node(tr.s), tr.p, node(tr.o)))
        return out

    def template_term(self, x: object, scope: Scope, row: str) -> Column:
        if isinstance(x, t.BNode):
            return c.term(c.BLANK, F.concat(F.lit(f"b{x.label}_"), F.col(row)))
        x = self.term(x)
        if isinstance(x, t.Call):
            x = self.expr(x)
        return c.lift(scope.value(x)).col

    def describe(self, q: a.Query, active: Active) -> DataFrame:
        """All statements of the resources, and of the blank nodes that they lead to."""
        parts = []
        p, o = t.Var("_p"), t.Var("_o")
        rel = self.group(q.where, active) if q.where.elements else None
        for x in q.targets:
            x = self.term(x)
            if isinstance(x, t.Var):
                if rel is None or x.name not in rel.vars:
                    continue
                named = Rel(rel.df.select(rel.vars[x.name][0]).distinct(), {x.name: (rel.vars[x.name][0], replace(rel.vars[x.name][1], nullable=False))})
                named = Rel(named.df.filter(F.col(rel.vars[x.name][0]).isNotNull()), named.vars)
                parts.append(self.construct([a.Triple(x, p, o)], self.join(named, self.bgp([a.Triple(x, p, o)], active))))
            else:
                parts.append(self.construct([a.Triple(x, p, o)], self.bgp([a.Triple(x, p, o)], active)))
        if not parts:
            return active.catalog.spark.createDataFrame([], f"s {c.TERM}, p string, o {c.TERM}")
        out = reduce(DataFrame.union, parts).distinct()
        quads = self.quads(active)
        if quads is None:
            return out
        out = checkpoint(out)
        front = out
        while True:
            nodes = front.filter(F.col("o.kind") == c.BLANK).select(F.col("o").alias("n")).distinct()
            more = quads.select("s", "p", "o").join(nodes, F.col("s") == F.col("n"), "left_semi").join(out.select(F.col("s").alias("s2"), F.col("p").alias("p2"), F.col("o").alias("o2")), (F.col("s") == F.col("s2")) & (F.col("p") == F.col("p2")) & (F.col("o") == F.col("o2")), "left_anti")
            front = checkpoint(more)
            if front.isEmpty():
                return out
            out = checkpoint(out.union(front))
