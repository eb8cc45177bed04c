"""The one logical algebra that the builder and the text front end share: frozen nodes."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from tessera.terms import Expr


# --- paths
@dataclass(frozen=True)
class Path:
    """op: seq, alt, inv, star, plus, opt, neg; args are paths or IRIs (for neg also inv of an IRI)."""

    op: str
    args: tuple


# --- elements of a group
@dataclass(frozen=True)
class Triple:
    s: Any
    p: Any
    o: Any


@dataclass(frozen=True)
class Group:
    elements: tuple = ()


@dataclass(frozen=True)
class Filter:
    expr: Expr


@dataclass(frozen=True)
class Bind:
    expr: Expr
    var: str


@dataclass(frozen=True)
class Optional_:
    group: Group


@dataclass(frozen=True)
class Union_:
    branches: tuple


@dataclass(frozen=True)
class Minus:
    group: Group


@dataclass(frozen=True)
class Values:
    vars: tuple
    rows: tuple


@dataclass(frozen=True)
class GraphEl:
    graph: Any
    group: Group


@dataclass(frozen=True)
class Service:
    endpoint: Any
    group: Group
    silent: bool = False


@dataclass(frozen=True)
class SubQuery:
    query: Query


@dataclass(frozen=True)
class Query:
    form: str = "select"
    projection: Any = "*"  # "*" or a tuple of (name, Expr | None)
    where: Group = Group()
    prefixes: tuple = ()
    base: str | None = None
    from_: tuple = ()
    from_named: tuple = ()
    group_by: tuple = ()  # (Expr, name | None)
    having: tuple = ()
    order_by: tuple = ()  # (Expr, ascending)
    limit: int | None = None
    offset: int | None = None
    modifier: str | None = None  # distinct, reduced; the last one set wins
    template: tuple = ()
    targets: tuple = ()  # of DESCRIBE
    values: Values | None = None


@dataclass(frozen=True)
class Quads:
    """Triples in a graph (None: the default graph) of an update."""

    triples: tuple
    graph: Any = None


@dataclass(frozen=True)
class Update:
    """One operation. kind: insert_data, delete_data, delete_where, modify, load, clear, drop, create, copy, move, add."""

    kind: str
    insert: tuple = ()  # of Quads
    delete: tuple = ()
    where: Group = Group()
    with_: Any = None
    using: tuple = ()
    using_named: tuple = ()
    source: Any = None
    target: Any = None
    silent: bool = False
    prefixes: tuple = field(default=())
