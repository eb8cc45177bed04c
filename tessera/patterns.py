"""Pattern authoring: triples, nested nodes, relationships, arrow text, lists, blank and quoted nodes.

Strings as subjects and predicates may be variables (?x), full IRIs or prefixed names; strings as objects are
literals unless they start with ? or $.
"""

from __future__ import annotations

import re
import zlib
from itertools import count as _count
from typing import Any

from tessera import terms as t
from tessera.errors import ValidationError
from tessera.namespaces import RDF
from tessera.plans import algebra as a

_ids = _count()


def resource(x: Any) -> Any:
    """A subject, graph or class: variable, IRI, prefixed name or term."""
    if not isinstance(x, str) or isinstance(x, t.Expr):
        return x
    if x[:1] in "?$":
        return t.v(x)
    if x.startswith("<") or "://" in x or x.startswith("urn:"):
        return t.iri(x)
    if x.startswith("_:"):
        return t.BNode(x[2:])
    if ":" in x:
        return t.prefixed(x)
    return t.v(x)


def predicate(x: Any) -> Any:
    if isinstance(x, str):
        if x == "a":
            return t.IRI(RDF.type)
        if x[:1] not in "?$" and ":" not in x:
            raise ValidationError(f"not a predicate: {x!r}")
        return resource(x)
    return x


def object_of(x: Any, p: Any = None) -> Any:
    if isinstance(x, Node):
        return x.term
    if isinstance(x, str):
        if x[:1] in "?$" and len(x) > 1:
            return t.v(x)
        if p == t.IRI(RDF.type) or isinstance(p, t.PName) and p.text == "rdf:type":
            return resource(x)
        return t.Lit(x)
    return t.value(x)


def flat(x: Any) -> list:
    """Elements of a pattern given in any style."""
    if x is None:
        return []
    if isinstance(x, Node | Rel):
        return x.elements()
    if isinstance(x, a.Group):
        return [x]
    if isinstance(x, list | tuple):
        return [e for y in x for e in flat(y)]
    if isinstance(x, str):
        from tessera.parser import parse_group

        return list(parse_group(x).elements)
    return [x]


def group_of(*patterns: Any) -> a.Group:
    return a.Group(tuple(e for p in patterns for e in flat(p)))


def triple(s: Any, p: Any, o: Any) -> list[a.Triple]:
    p = predicate(p)
    extra: list = []
    if isinstance(o, (ListPattern, BNodePattern)):
        extra = o.elements()
        o = o.head
    elif isinstance(o, Node):
        extra = o.elements()
    if isinstance(s, Node):
        extra, s = s.elements() + extra, s.term
    return [a.Triple(resource(s), p, object_of(o, p)), *extra]


def triples(s: Any, pairs: Any) -> list[a.Triple]:
    out: list[a.Triple] = []
    for p, o in pairs.items() if isinstance(pairs, dict) else pairs:
        for x in o if isinstance(o, list | tuple) else [o]:
            out += triple(s, p, x)
    return out


class Node:
    """A resource with types and properties; immutable, every method gives a new node."""

    def __init__(self, name: Any, types: tuple = (), props: tuple = ()):
        self.term, self.types, self.props = resource(name), types, props

    def a(self, *types: Any) -> Node:
        return Node(self.term, (*self.types, *types), self.props)

    type = types_ = a

    def prop(self, p: Any, *values: Any) -> Node:
        return Node(self.term, self.types, (*self.props, *((p, x) for x in values)))

    def properties(self, props: dict) -> Node:
        more = tuple((p, x) for p, o in props.items() for x in (o if isinstance(o, list | tuple) else [o]))
        return Node(self.term, self.types, (*self.props, *more))

    @property
    def is_(self) -> Node:
        return self

    with_ = and_ = that = has = is_

    def elements(self, seen: set | None = None) -> list[a.Triple]:
        seen = set() if seen is None else seen
        if id(self) in seen:
            return []
        seen.add(id(self))
        out: list[a.Triple] = [a.Triple(self.term, t.IRI(RDF.type), resource(x)) for x in self.types]
        later: list[a.Triple] = []
        for p, x in self.props:
            if isinstance(x, Node):
                out.append(a.Triple(self.term, predicate(p), x.term))
                later += x.elements(seen)
            else:
                out += triple(self.term, p, x)
        return list(dict.fromkeys(out + later))


def node(name: Any, type_: Any = None, props: dict | None = None) -> Node:
    if isinstance(type_, dict):
        type_, props = None, type_
    types = () if type_ is None else tuple(type_) if isinstance(type_, list | tuple) else (type_,)
    return Node(name, types).properties(props or {})


class Rel:
    """An edge; with properties also a reified statement."""

    def __init__(self, source: Any, p: Any, target: Any, facts: tuple = ()):
        self.source, self.p, self.target, self.facts = source, p, target, facts

    def prop(self, p: Any, *values: Any) -> Rel:
        return Rel(self.source, self.p, self.target, (*self.facts, *((p, x) for x in values)))

    def props(self, facts: dict) -> Rel:
        more = tuple((p, x) for p, o in facts.items() for x in (o if isinstance(o, list | tuple) else [o]))
        return Rel(self.source, self.p, self.target, (*self.facts, *more))

    properties = props

    @property
    def is_(self) -> Rel:
        return self

    with_ = and_ = that = has = is_

    def elements(self) -> list[a.Triple]:
        s, o = (x.term if isinstance(x, Node) else resource(x) for x in (self.source, self.target))
        p = predicate(self.p)
        out = [a.Triple(s, p, o)]
        for x in (self.source, self.target):
            if isinstance(x, Node):
                out += x.elements()
        if self.facts:
            statement = t.BNode(f"rel{zlib.crc32(repr((s, p, o)).encode()):08x}")
            out += [a.Triple(statement, t.IRI(RDF.type), t.IRI(RDF.Statement)), a.Triple(statement, t.IRI(RDF.subject), s), a.Triple(statement, t.IRI(RDF.predicate), p), a.Triple(statement, t.IRI(RDF.object), o)]
            for q, x in self.facts:
                out += triple(statement, q, x)
        return list(dict.fromkeys(out))


def rel(source: Any, p: Any, target: Any) -> Rel:
    return Rel(source, p, target)


def match(*patterns: Any) -> list:
    return list(dict.fromkeys(e for p in patterns for e in flat(p)))


_EDGE = re.compile(r"\s*(<)?-\s*\[\s*([^\]]+?)\s*\]\s*-(>)?\s*")
_NODE = re.compile(r"\s*\(?\s*(?:\{(\w+)\}|([?$]?\w+))\s*\)?")


def cypher(text: str, **nodes: Any) -> list:
    """`cypher("{a}-[schema:knows]->{b}<-[schema:knows]-{c}", a=..., b=..., c=...)`: all edges of the chain, in the
    direction of their arrows, and the patterns of the nodes."""

    def take(at: int) -> tuple[Any, int]:
        m = _NODE.match(text, at)
        if not m:
            raise ValidationError(f"a node is missing at {text[at:]!r}")
        name = m[1] or m[2]
        if m[1] and name not in nodes:
            raise ValidationError(f"no node named {name!r}")
        return nodes.get(name, None) if m[1] else nodes.get(name, t.v(name)), m.end()

    out: list = []
    left, at = take(0)
    found = [left]
    while at < len(text) and text[at:].strip():
        m = _EDGE.match(text, at)
        if not m or bool(m[1]) == bool(m[3]):
            raise ValidationError(f"an arrow is missing at {text[at:]!r}")
        right, at = take(m.end())
        found.append(right)
        s, o = (right, left) if m[1] else (left, right)
        out += Rel(s, m[2], o).elements()
        left = right
    return match(*[x for x in found if isinstance(x, Node)], out)


def quoted_triple(s: Any, p: Any, o: Any) -> t.Quoted:
    p = predicate(p)
    return t.Quoted(resource(s), p, object_of(o, p))


def bnode(label: str | None = None) -> t.BNode:
    return t.BNode(label or f"n{next(_ids)}")


class BNodePattern:
    """A blank node with properties."""

    def __init__(self, props: dict):
        self.head, self.props = bnode(), props

    def elements(self) -> list[a.Triple]:
        return triples(self.head, {p: (BNodePattern(o) if isinstance(o, dict) else o) for p, o in self.props.items()})


def bnode_pattern(props: dict) -> BNodePattern:
    return BNodePattern(props)


class ListPattern:
    """A collection, as a chain of first and rest."""

    def __init__(self, items: list):
        self.items = items
        self.cells = [bnode() for _ in items]
        self.head = self.cells[0] if items else t.IRI(RDF.nil)

    def elements(self) -> list[a.Triple]:
        out: list[a.Triple] = []
        for k, x in enumerate(self.items):
            out += triple(self.cells[k], t.IRI(RDF.first), x)
            out.append(a.Triple(self.cells[k], t.IRI(RDF.rest), self.cells[k + 1] if k + 1 < len(self.cells) else t.IRI(RDF.nil)))
        return out


def rdf_list(items: list) -> ListPattern:
    return ListPattern(list(items))


# --- clauses ----------------------------------------------------------------------------------------


def filter_(e: Any) -> a.Filter:
    return a.Filter(t.value(e))


def optional(*patterns: Any) -> a.Optional_:
    return a.Optional_(group_of(*patterns))


def bind(e: Any, name: str | None = None) -> a.Bind:
    if isinstance(e, t.Aliased):
        e, name = e.expr, name or e.name
    if name is None:
        raise ValidationError("bind needs a name")
    return a.Bind(t.value(e), t.check_var(name))


def union(*patterns: Any) -> a.Union_:
    return a.Union_(tuple(group_of(p) for p in patterns))


def exists(*patterns: Any) -> t.Exists:
    return t.Exists(group_of(*patterns))


def not_exists(*patterns: Any) -> t.Exists:
    return t.Exists(group_of(*patterns), True)


def minus(*patterns: Any) -> a.Minus:
    return a.Minus(group_of(*patterns))


def graph(g: Any, *patterns: Any) -> a.GraphEl:
    return a.GraphEl(resource(g), group_of(*patterns))


def service(endpoint: Any, *patterns: Any, silent: bool = False) -> a.Service:
    return a.Service(resource(endpoint), group_of(*patterns), silent)


def values(name: str | tuple, items: list) -> a.Values:
    """values("x", [1, 2]) or values(("x", "y"), [(1, 2), (3, undef())])."""
    names = (name,) if isinstance(name, str) else tuple(name)
    rows = [(x,) if isinstance(name, str) else tuple(x) for x in items]
    return a.Values(tuple(t.check_var(n) for n in names), tuple(tuple(x if isinstance(x, t._Undef) else t.value(x) for x in r) for r in rows))


def raw(text: str) -> list:
    """Elements of a group from query text."""
    from tessera.parser import parse_group

    return list(parse_group(text).elements)


raw_pattern = raw


def raw_expr(text: str) -> t.Expr:
    from tessera.parser import parse_expression

    return parse_expression(text)


# --- paths ------------------------------------------------------------------------------------------


def _path(x: Any) -> Any:
    return predicate(x)


def zero_or_more(p: Any) -> a.Path:
    return a.Path("star", (_path(p),))


def one_or_more(p: Any) -> a.Path:
    return a.Path("plus", (_path(p),))


def zero_or_one(p: Any) -> a.Path:
    return a.Path("opt", (_path(p),))


def sequence(*ps: Any) -> a.Path:
    return a.Path("seq", tuple(map(_path, ps)))


def alternative(*ps: Any) -> a.Path:
    return a.Path("alt", tuple(map(_path, ps)))


def inverse(p: Any) -> a.Path:
    p = _path(p)
    if isinstance(p, a.Path) and p.op == "seq":  # the inverse of a sequence runs backwards
        return a.Path("seq", tuple(inverse(x) for x in reversed(p.args)))
    return a.Path("inv", (p,))


def negated_property_set(*ps: Any) -> a.Path:
    return a.Path("neg", tuple(map(_path, ps)))
