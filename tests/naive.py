"""A small in-memory evaluator of the algebra, for tests only: solutions are dicts, terms are the JSON forms' tuples."""

from itertools import product

from tessera import terms as t
from tessera.plans import algebra as a


def term(x):
    return ("iri", x.iri) if isinstance(x, t.IRI) else ("lit", x.lex, x.dt) if isinstance(x, t.Lit) else x


def compatible(x, y):
    return all(y[k] == v for k, v in x.items() if k in y)


def bgp(triples, graph):
    out = [{}]
    for tr in triples:
        new = []
        for s in out:
            for st in pairs(tr, graph):
                ok, row = True, dict(s)
                for x, v in st:
                    if isinstance(x, t.Var | t.BNode):
                        name = x.name if isinstance(x, t.Var) else "_b" + x.label
                        if row.setdefault(name, v) != v:
                            ok = False
                    elif term(x) != v:
                        ok = False
                if ok:
                    new.append(row)
        out = new
    return out


def pairs(tr, graph):
    if isinstance(tr.p, a.Path):
        return [((tr.s, x), (tr.o, y)) for x, y in path(tr.p, graph, tr)]
    return [((tr.s, s), (tr.p, p), (tr.o, o)) for s, p, o in graph]


def path(p, graph, tr):
    if not isinstance(p, a.Path):
        return [(s, o) for s, q, o in graph if q == term(p)]
    sub = [path(x, graph, tr) for x in p.args] if p.op != "neg" else []
    if p.op == "inv":
        return [(y, x) for x, y in sub[0]]
    if p.op == "alt":
        return [x for s in sub for x in s]
    if p.op == "seq":
        out = sub[0]
        for s in sub[1:]:
            out = [(x, z) for x, y in out for w, z in s if y == w]
        return out
    if p.op == "neg":
        ahead = {term(x) for x in p.args if not isinstance(x, a.Path)}
        back = {term(x.args[0]) for x in p.args if isinstance(x, a.Path)}
        out = [(s, o) for s, q, o in graph if q not in ahead] if ahead or not back else []
        return out + ([(o, s) for s, q, o in graph if q not in back] if back else [])
    nodes = {s for s, _, _ in graph} | {o for _, _, o in graph} | {term(x) for x in (tr.s, tr.o) if not isinstance(x, t.Var)}
    out = set(sub[0])
    if p.op in ("plus", "star"):
        while True:
            more = {(x, z) for x, y in out for w, z in sub[0] if y == w} - out
            if not more:
                break
            out |= more
    if p.op in ("star", "opt"):
        out |= {(n, n) for n in nodes}
    return list(out)


def value(e, row):
    """None is an error or unbound."""
    if isinstance(e, t.Var):
        return row.get(e.name)
    if isinstance(e, t.Lit | t.IRI):
        return term(e)
    if e.op == "bound":
        return e.args[0].name in row
    xs = [value(x, row) for x in e.args]
    if e.op == "not":
        return None if xs[0] is None else not xs[0]
    if e.op == "and":
        return False if False in xs else None if None in xs else True
    if e.op == "or":
        return True if True in xs else None if None in xs else False
    if None in xs:
        return None
    if e.op in ("eq", "neq"):
        return (xs[0] == xs[1]) == (e.op == "eq")
    if e.op in ("lt", "gt"):
        if xs[0][0] != "lit" or xs[1][0] != "lit":
            return None
        x, y = int(xs[0][1]), int(xs[1][1])
        return x < y if e.op == "lt" else x > y
    raise NotImplementedError(e.op)


def group(g, graph):
    rows, filters, waiting = [{}], [], []

    def flush():
        nonlocal rows
        if waiting:
            rows = join(rows, bgp(waiting, graph))
            waiting.clear()

    for e in g.elements:
        if isinstance(e, a.Triple):
            waiting.append(e)
            continue
        if isinstance(e, a.Filter):
            filters.append(e.expr)
            continue
        flush()
        if isinstance(e, a.Optional_):
            conditions = [f.expr for f in e.group.elements if isinstance(f, a.Filter)]
            inner = group(a.Group(tuple(x for x in e.group.elements if not isinstance(x, a.Filter))), graph)
            out = []
            for x in rows:
                hits = [{**x, **y} for y in inner if compatible(x, y) and all(value(c, {**x, **y}) is True for c in conditions)]
                out += hits or [x]
            rows = out
        elif isinstance(e, a.Union_):
            rows = join(rows, [r for b in e.branches for r in group(b, graph)])
        elif isinstance(e, a.Minus):
            inner = group(e.group, graph)
            rows = [x for x in rows if not any(compatible(x, y) and set(x) & set(y) for y in inner)]
        elif isinstance(e, a.Values):
            rows = join(rows, [{n: term(v) for n, v in zip(e.vars, r, strict=True) if v is not t.UNDEF} for r in e.rows])
        elif isinstance(e, a.Group):
            rows = join(rows, group(e, graph))
        else:
            raise NotImplementedError(type(e))
    flush()
    for f in filters:
        if isinstance(f, t.Exists):
            inner = lambda x: [y for y in group(f.group, graph) if compatible(x, y)]  # noqa: E731, B023
            rows = [x for x in rows if bool(inner(x)) != f.negated]
        else:
            rows = [x for x in rows if value(f, x) is True]
    return rows


def join(xs, ys):
    return [{**x, **y} for x, y in product(xs, ys) if compatible(x, y)]
