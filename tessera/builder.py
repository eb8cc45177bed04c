"""Fluent, immutable builder of queries; every method gives a new builder.

A built query evaluates VALUES, patterns, FILTER, OPTIONAL, BIND and UNION in that order, whatever the order of calls.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from tessera import patterns as p
from tessera import terms as t
from tessera.errors import ValidationError
from tessera.plans import algebra as a


def _projection(x: Any) -> Any:
    if x == "*" or x == ["*"]:
        return "*"
    out = []
    for y in x if isinstance(x, list | tuple) else [x]:
        if isinstance(y, t.Aliased):
            out.append((y.name, y.expr))
        elif isinstance(y, t.Var):
            out.append((y.name, None))
        elif isinstance(y, str):
            out.append((t.check_var(y), None))
        else:
            raise ValidationError(f"an expression in a projection needs a name: {y!r}")
    return tuple(out)


def _lifted(template: tuple) -> tuple[tuple, tuple]:
    """Expressions in a template as BINDs before it."""
    binds, out = [], []
    for tr in template:
        parts = []
        for x in (tr.s, tr.p, tr.o):
            if isinstance(x, t.Call):
                name = f"_hx{len(binds)}"
                binds.append(a.Bind(x, name))
                x = t.Var(name)
            parts.append(x)
        out.append(a.Triple(*parts))
    return tuple(out), tuple(binds)


@dataclass(frozen=True)
class Builder:
    form: str = "select"
    projection: Any = "*"
    patterns_: tuple = ()
    filters: tuple = ()
    optionals: tuple = ()
    binds: tuple = ()
    unions: tuple = ()
    values_: tuple = ()
    q: a.Query = a.Query()
    prefixes_: tuple = ()

    def _q(self, **k: Any) -> Builder:
        return replace(self, q=replace(self.q, **k))

    def from_(self, *graphs: Any) -> Builder:
        return self._q(from_=(*self.q.from_, *map(p.resource, graphs)))

    def from_named(self, *graphs: Any) -> Builder:
        return self._q(from_named=(*self.q.from_named, *map(p.resource, graphs)))

    def prefix(self, name: str, iri: str) -> Builder:
        return replace(self, prefixes_=(*self.prefixes_, (t.check_prefix(name), t.check_iri(str(iri)))))

    def prefixes(self, names: dict[str, str]) -> Builder:
        out = self
        for k, x in names.items():
            out = out.prefix(k, x)
        return out

    def where(self, *patterns: Any) -> Builder:
        return replace(self, patterns_=(*self.patterns_, *(e for x in patterns for e in p.flat(x))))

    def filter(self, *exprs: Any) -> Builder:
        return replace(self, filters=(*self.filters, *(a.Filter(t.value(e)) if not isinstance(e, a.Filter) else e for e in exprs)))

    def optional(self, *patterns: Any) -> Builder:
        return replace(self, optionals=(*self.optionals, *(p.optional(x) for x in patterns)))

    def bind(self, e: Any, name: str | None = None) -> Builder:
        return replace(self, binds=(*self.binds, p.bind(e, name)))

    def union(self, *branches: Any) -> Builder:
        return replace(self, unions=(*self.unions, p.union(*branches)))

    def minus(self, *patterns: Any) -> Builder:
        return self.where(p.minus(*patterns))

    def values(self, name: Any, items: list) -> Builder:
        return replace(self, values_=(*self.values_, p.values(name, items)))

    def group_by(self, *keys: Any) -> Builder:
        more = []
        for k in keys:
            if isinstance(k, t.Aliased):
                more.append((k.expr, k.name))
            else:
                more.append((t.v(k) if isinstance(k, str) else k, None))
        return self._q(group_by=(*self.q.group_by, *more))

    def having(self, *exprs: Any) -> Builder:
        return self._q(having=(*self.q.having, *map(t.value, exprs)))

    def order_by(self, key: Any, direction: str = "ASC") -> Builder:
        if direction.upper() not in ("ASC", "DESC"):
            raise ValidationError(f"not a direction: {direction!r}")
        if isinstance(key, t.Aliased):
            key = key.expr
        return self._q(order_by=(*self.q.order_by, (t.v(key) if isinstance(key, str) else key, direction.upper() == "ASC")))

    def limit(self, n: int) -> Builder:
        return self._q(limit=_count(n, "limit"))

    def offset(self, n: int) -> Builder:
        return self._q(offset=_count(n, "offset"))

    def distinct(self) -> Builder:
        return self._q(modifier="distinct")

    def reduced(self) -> Builder:
        return self._q(modifier="reduced")

    def as_subquery(self) -> a.SubQuery:
        return a.SubQuery(self.query())

    def query(self) -> a.Query:
        """The algebra of this query."""
        template, extra = _lifted(self.q.template)
        aggregate = [b for b in self.binds if any(isinstance(x, t.Agg) for x in t.walk(b.expr))]
        binds = tuple(b for b in self.binds if b not in aggregate)
        elements = (*self.values_, *self.patterns_, *self.filters, *self.optionals, *binds, *self.unions, *extra)
        projection = self.projection
        if aggregate:  # an aggregate in BIND is an item of the projection
            named = {b.var: b.expr for b in aggregate}
            if projection != "*":
                projection = tuple((n, named.pop(n, e) if e is None else e) for n, e in projection)
            projection = (*(() if projection == "*" else projection), *named.items())
        return replace(self.q, form=self.form, projection=projection, where=a.Group(elements), template=template, prefixes=self.prefixes_)

    def execute(self, engine: Any, **options: Any) -> Any:
        return engine.execute(self, **options)

    def df(self, engine: Any) -> Any:
        return engine.dataframe(self)


def _count(n: Any, what: str) -> int:
    if isinstance(n, bool) or not isinstance(n, int) or n < 0:
        raise ValidationError(f"{what} must be an integer from 0 up, not {n!r}")
    return n


def select(projection: Any = "*") -> Builder:
    return Builder("select", _projection(projection))


def ask() -> Builder:
    return Builder("ask")


def construct(*template: Any) -> Builder:
    return Builder("construct", q=a.Query(template=tuple(e for x in template for e in p.flat(x))))


def describe(resources: Any) -> Builder:
    xs = resources if isinstance(resources, list | tuple) else [resources]
    return Builder("describe", q=a.Query(targets=tuple(p.resource(x) for x in xs)))


def subquery(b: Builder) -> a.SubQuery:
    return b.as_subquery()
