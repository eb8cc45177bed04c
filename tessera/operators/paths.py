"""Property paths: sequences, alternatives and inverses become joins and unions; closures a semi-naive loop.

Each round joins only the pairs found last, drops known pairs with an anti-join, and checkpoints what is new (what was
known stays where it was written).  A bound end seeds the loop, so only what is reachable from it is explored, an edge a
round; where no end is bound, new pairs are joined to all pairs, so a round doubles the length and their number is
logarithmic.

Only tables counted as small are broadcast; the sizes that Catalyst carries on through the rounds say little, and a table
of edges that it takes for small would go to the driver in each round.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import terms as t
from tessera.functions import columns as c
from tessera.functions.columns import Val
from tessera.operators.lineage import checkpoint
from tessera.plans import algebra as a

if TYPE_CHECKING:
    from tessera.plans.compiler import Active, Compiler, Rel

#: Rows of a table that a round may broadcast; beyond it the round's joins shuffle.
FEW = 20_000


def path(z: Compiler, s: object, p: object, o: object, active: Active, bound: Rel | None = None) -> Rel:
    """Solutions of a path between two terms; bound: what is known already of their variables."""
    if not isinstance(p, a.Path):
        return z.bgp([a.Triple(s, p, o)], active)
    if p.op == "inv":
        return path(z, o, p.args[0], s, active, bound)
    if p.op == "seq":
        return z.bgp([a.Triple(s, p, o)], active)
    if p.op == "alt":
        return reduce(z.union, [path(z, s, x, o, active, bound) for x in p.args])
    if p.op == "neg":
        return negated(z, s, p, o, active)
    return closure(z, s, p, o, active, bound)


def negated(z: Compiler, s: object, p: a.Path, o: object, active: Active) -> Rel:
    ahead = [x.iri for x in p.args if not isinstance(x, a.Path)]
    back = [x.args[0].iri for x in p.args if isinstance(x, a.Path)]
    parts = []
    for names, x, y, wanted in ((ahead, s, o, bool(ahead) or not back), (back, o, s, bool(back))):
        if wanted:
            q = t.Var(_hidden())
            r = z.bgp([a.Triple(x, q, y)], active)
            if names:
                r = replace(r, df=r.df.filter(~F.col(r.vars[q.name][0]).isin(*names)))
            parts.append(r.keep([n for n in r.vars if n != q.name]))
    return reduce(z.union, parts)


def _hidden() -> str:
    from tessera.plans.compiler import HIDDEN, fresh

    return HIDDEN + fresh()


def closure(z: Compiler, s: object, p: a.Path, o: object, active: Active, bound: Rel | None) -> Rel:
    from tessera.plans.compiler import Rel, fresh

    x, y = t.Var(_hidden()), t.Var(_hidden())
    edges = path(z, x, p.args[0], y, active)
    if edges.vars[x.name][1].same != edges.vars[y.name][1].same:
        edges = z.lifted(z.lifted(edges, x.name), y.name)
    info = replace(edges.vars[x.name][1], nullable=False)
    e = edges.df.select(F.col(edges.vars[x.name][0]).alias("a"), F.col(edges.vars[y.name][0]).alias("b")).distinct()

    def seeds(end: object):
        """Distinct values of a bound end in the edges' form, and whether it is bound."""
        nonlocal info, e
        if isinstance(end, t.Var):
            if bound is None or end.name not in bound.vars:
                return None
            v = bound.val(end.name)
            df = bound.df
        else:
            v, df = c.constant(end), active.catalog.spark.range(1)
        if v.info.same != info.same:
            if info.prefix is not None and isinstance(end, t.IRI) and end.iri.startswith(info.prefix) and end.iri[len(info.prefix) :].isdigit():
                v = Val(F.lit(int(end.iri[len(info.prefix) :])), info)
            else:
                v = c.lift(v)
                if info.kind != "term":
                    e = e.select(c.lift(Val(F.col("a"), info)).col.alias("a"), c.lift(Val(F.col("b"), info)).col.alias("b"))
                    info = replace(c.TERM_INFO)
        return df.select(v.col.alias("n")).filter("n is not null").distinct()

    from_s = seeds(s)
    from_o = seeds(o) if from_s is None else None
    if from_s is not None and not isinstance(o, t.Var):
        seeds(o)  # brings the edges into the form of both ends
        from_s = seeds(s)
    forward = from_s is not None or from_o is None
    step = e if forward else e.select(F.col("b").alias("a"), F.col("a").alias("b"))
    start = from_s if forward else from_o
    loops, many_seeds = p.op in ("plus", "star"), False
    if loops:
        step = checkpoint(step)
        if start is not None and isinstance(s if forward else o, t.Var):
            start = checkpoint(start)
            many_seeds = start.count() > FEW
    pairs = first = step if start is None else step.join(start.hint("merge") if many_seeds else start, F.col("a") == F.col("n"), "left_semi")
    if loops:
        known = front = step if start is None else checkpoint(first)
        steps, found = step.count(), front.count()
        total = found
        while found:
            more = _sized(known, total) if start is None else _sized(step, steps)
            ahead = _sized(front.select(F.col("a").alias("from"), F.col("b").alias("mid")), found).join(more, F.col("mid") == F.col("a")).select(F.col("from").alias("a"), "b").distinct()
            front = checkpoint(ahead.join(_sized(known.select(F.col("a").alias("ka"), F.col("b").alias("kb")), total), (F.col("a") == F.col("ka")) & (F.col("b") == F.col("kb")), "left_anti"))
            found = front.count()
            known, total = known.union(front), total + found
        pairs = known
    if p.op in ("star", "opt"):
        if start is None:
            nodes = _all_nodes(z, active)
            if info.kind != "term":
                pairs = pairs.select(c.lift(Val(F.col("a"), info)).col.alias("a"), c.lift(Val(F.col("b"), info)).col.alias("b"))
                info = c.TERM_INFO
            start = nodes
        pairs = pairs.union(start.select(F.col("n").alias("a"), F.col("n").alias("b"))).distinct()
    if not forward:
        pairs = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))
    out, vars = pairs, {}
    for end, col in ((s, "a"), (o, "b")):
        v = Val(F.col(col), info)
        if not isinstance(end, t.Var):
            same = c.same_term(v, c.constant(end)) if info.kind == "term" else z.constant_is(end, v)
            out = out.filter(same if same is not None else F.lit(False))
        elif end.name in vars:
            out = out.filter(F.col("a") == F.col("b"))
        else:
            vars[end.name] = col
    names = {n: (fresh(), info) for n in vars}
    out = out.select(*[F.col(vars[n]).alias(names[n][0]) for n in vars])
    out = out.distinct() if len(vars) < 2 else out
    return Rel(out.hint("merge") if many_seeds else out, names)  # what gave the seeds is joined to it next


def _sized(df: DataFrame, rows: int) -> DataFrame:
    """A side of a join, broadcast if it has few rows; else it stays where it is unless the other side is broadcast."""
    return F.broadcast(df) if rows <= FEW else df.hint("merge")


def _all_nodes(z: Compiler, active: Active):
    """Subjects and objects of all statements, of quads and mapped tables."""
    x, q, y = (t.Var(_hidden()) for _ in range(3))
    every = z.bgp([a.Triple(x, q, y)], active)
    ends = [every.df.select(c.lift(every.val(v.name)).col.alias("n")) for v in (x, y)]
    return ends[0].union(ends[1]).distinct()
