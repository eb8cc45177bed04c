"""Text front end: query and update text of the W3C graph query language 1.1 (with quoted triples) to the algebra.

A tokenizer and a recursive descent; the Turtle reader shares them.
"""

from __future__ import annotations

import re
from typing import Any

from tessera import terms as t
from tessera.errors import QueryError
from tessera.namespaces import RDF, XSD
from tessera.plans import algebra as a

_TOKEN = re.compile(
    r"""
    (?P<space>[\s]+|\#[^\n]*)
  | (?P<iri><[^\x00-\x20<>"{}|^`\\]*>)
  | (?P<quote><<|>>)
  | (?P<string>\"{3}(?:(?:\"|\"\")?(?:[^"\\]|\\.))*\"{3}|'{3}(?:(?:'|'')?(?:[^'\\]|\\.))*'{3}|"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
  | (?P<lang>@[a-zA-Z]+(?:-[a-zA-Z0-9]+)*)
  | (?P<var>[?$]\w+)
  | (?P<bnode>_:\w(?:[\w.-]*[\w-])?)
  | (?P<number>(?:\d+\.\d*|\.\d+|\d+)[eE][+-]?\d+|\d+\.\d+|\.\d+|\d+)
  | (?P<pname>(?:[^\W\d_](?:[\w.-]*[\w-])?)?:(?:(?:[\w:]|%[0-9A-Fa-f]{2}|\\[_~.!$&'()*+,;=/?\#@%-])(?:(?:[\w.:-]|%[0-9A-Fa-f]{2}|\\[_~.!$&'()*+,;=/?\#@%-])*(?:[\w:-]|%[0-9A-Fa-f]{2}|\\[_~.!$&'()*+,;=/?\#@%-]))?)?)
  | (?P<word>[A-Za-z_]\w*)
  | (?P<op>\^\^|&&|\|\||!=|<=|>=|[{}()\[\].,;=<>+\-*/!|^?%])
    """,
    re.VERBOSE | re.DOTALL,
)
_ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def unescape(s: str) -> str:
    def one(m: re.Match) -> str:
        x = m[0]
        if x[1] in "uU":
            return chr(int(x[2:], 16))
        if x[1] not in _ESCAPES:
            raise QueryError("parse", f"bad escape: {x}")
        return _ESCAPES[x[1]]

    return re.sub(r"\\(?:u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", one, s, flags=re.DOTALL)


_BUILTINS = {
    "str": "str", "lang": "lang", "langmatches": "langmatches", "datatype": "datatype", "iri": "iri", "uri": "iri",
    "abs": "abs", "ceil": "ceil", "floor": "floor", "round": "round", "concat": "concat", "strlen": "strlen", "ucase": "ucase",
    "lcase": "lcase", "encode_for_uri": "encode_for_uri", "contains": "contains", "strstarts": "strstarts", "strends": "strends",
    "strbefore": "strbefore", "strafter": "strafter", "year": "year", "month": "month", "day": "day", "hours": "hours",
    "minutes": "minutes", "seconds": "seconds", "timezone": "timezone", "tz": "tz", "now": "now", "uuid": "uuid",
    "struuid": "struuid", "rand": "rand", "bnode": "bnode", "md5": "md5", "sha1": "sha1", "sha256": "sha256", "sha384": "sha384",
    "sha512": "sha512", "coalesce": "coalesce", "if": "if", "strlang": "strlang", "strdt": "strdt", "sameterm": "sameterm",
    "isiri": "isiri", "isuri": "isiri", "isblank": "isblank", "isliteral": "isliteral", "isnumeric": "isnumeric", "regex": "regex",
    "substr": "substr", "replace": "replace", "bound": "bound",
}
_AGGREGATES = {"count", "sum", "avg", "min", "max", "sample", "group_concat"}
_COMPARE = {"=": "eq", "!=": "neq", "<": "lt", ">": "gt", "<=": "lte", ">=": "gte"}


class Parser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise QueryError("parse", f"unexpected text: {text[at : at + 20]!r}", text)
            if m.lastgroup != "space":
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.at, self.text = 0, text
        self.prefixes: dict[str, str] = {}
        self.base: str | None = None
        self.fresh = 0

    # --- tokens
    def peek(self, k: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + k] if self.at + k < len(self.tokens) else ("end", "")

    def next(self) -> tuple[str, str]:
        out = self.peek()
        self.at += 1
        return out

    def word(self, *names: str) -> bool:
        """Whether the next token is one of these keywords."""
        kind, x = self.peek()
        return kind == "word" and x.lower() in names

    def take(self, *xs: str) -> str | None:
        """The next token if it is one of these (keywords in any case)."""
        kind, x = self.peek()
        if kind in ("op", "quote") and x in xs or kind == "word" and x.lower() in xs:
            self.at += 1
            return x.lower()
        return None

    def need(self, *xs: str) -> str:
        out = self.take(*xs)
        if out is None:
            raise self.wrong(" or ".join(xs))
        return out

    def wrong(self, wanted: str) -> QueryError:
        return QueryError("parse", f"{wanted} expected, not {self.peek()[1]!r}", self.text)

    # --- terms
    def iri(self) -> Any:
        kind, x = self.next()
        if kind == "iri":
            return t.IRI(self.absolute(unescape(x[1:-1])))
        if kind == "pname":
            p, local = x.split(":", 1)
            if p in self.prefixes:
                return t.IRI(self.prefixes[p] + re.sub(r"\\(.)", r"\1", local))
            return t.PName(x)
        self.at -= 1
        raise self.wrong("an IRI")

    def absolute(self, x: str) -> str:
        if self.base and not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", x):
            from urllib.parse import urljoin

            return urljoin(self.base, x)
        return x

    def literal(self) -> t.Lit:
        kind, x = self.next()
        if kind == "string":
            q = 3 if x[:3] in ('"""', "'''") else 1
            s = unescape(x[q:-q])
            if self.peek()[0] == "lang":
                return t.Lit(s, RDF.langString, self.next()[1][1:].lower())
            if self.take("^^"):
                d = self.iri()
                if isinstance(d, t.PName):
                    from tessera.namespaces import PREFIXES

                    p, local = d.text.split(":", 1)
                    if p not in PREFIXES:
                        raise QueryError("parse", f"unknown prefix: {p!r}", self.text)
                    d = t.IRI(str(PREFIXES[p]) + local)
                return t.Lit(s, d.iri)
            return t.Lit(s)
        if kind == "number":
            return t.Lit(x, XSD.double if "e" in x.lower() else XSD.decimal if "." in x else XSD.integer)
        if kind == "word" and x.lower() in ("true", "false"):
            return t.Lit(x.lower(), XSD.boolean)
        self.at -= 1
        raise self.wrong("a literal")

    def blank(self) -> t.BNode:
        self.fresh += 1
        return t.BNode(f"_{id(self) % 9973}_{self.fresh}")

    def signed(self) -> t.Lit | None:
        if self.peek()[1] in ("+", "-") and self.peek(1)[0] == "number":
            sign = self.next()[1]
            x = self.literal()
            return t.Lit((sign if sign == "-" else "") + x.lex, x.dt)
        return None

    def node(self, out: list) -> Any:
        """A term of a pattern; triples of collections and blank nodes go to out."""
        kind, x = self.peek()
        if kind == "var":
            self.at += 1
            return t.Var(x[1:])
        if kind in ("iri", "pname"):
            return self.iri()
        if kind == "bnode":
            self.at += 1
            return t.BNode(x[2:])
        if x == "[":
            self.at += 1
            me = self.blank()
            if not self.take("]"):
                self.properties(me, out)
                self.need("]")
            return me
        if x == "(":
            self.at += 1
            items = []
            while not self.take(")"):
                items.append(self.node(out))
            cells = [self.blank() for _ in items]
            for k, item in enumerate(items):
                out.append(a.Triple(cells[k], t.IRI(RDF.first), item))
                out.append(a.Triple(cells[k], t.IRI(RDF.rest), cells[k + 1] if k + 1 < len(cells) else t.IRI(RDF.nil)))
            return cells[0] if cells else t.IRI(RDF.nil)
        if x == "<<":
            self.at += 1
            s, p, o = self.node(out), self.verb(), self.node(out)
            self.need(">>")
            return t.Quoted(s, p, o)
        return self.signed() or self.literal()

    def verb(self) -> Any:
        if self.word("a") and self.peek()[1] == "a":
            self.at += 1
            return t.IRI(RDF.type)
        if self.peek()[0] == "var":
            return t.Var(self.next()[1][1:])
        return self.path()

    # --- paths
    def path(self) -> Any:
        xs = [self.path_sequence()]
        while self.take("|"):
            xs.append(self.path_sequence())
        return xs[0] if len(xs) == 1 else a.Path("alt", tuple(xs))

    def path_sequence(self) -> Any:
        xs = [self.path_step()]
        while self.take("/"):
            xs.append(self.path_step())
        return xs[0] if len(xs) == 1 else a.Path("seq", tuple(xs))

    def path_step(self) -> Any:
        if self.take("^"):
            from tessera.patterns import inverse

            return inverse(self.path_step())
        if self.take("!"):
            xs = []
            if self.take("("):
                while not self.take(")"):
                    xs.append(self.path_negated())
                    self.take("|")
            else:
                xs.append(self.path_negated())
            return a.Path("neg", tuple(xs))
        if self.take("("):
            out = self.path()
            self.need(")")
        elif self.word("a") and self.peek()[1] == "a":
            self.at += 1
            out = t.IRI(RDF.type)
        else:
            out = self.iri()
        op = self.take("*", "+", "?")
        return a.Path({"*": "star", "+": "plus", "?": "opt"}[op], (out,)) if op else out

    def path_negated(self) -> Any:
        back = self.take("^")
        if self.word("a") and self.peek()[1] == "a":
            self.at += 1
            x: Any = t.IRI(RDF.type)
        else:
            x = self.iri()
        return a.Path("inv", (x,)) if back else x

    # --- triples
    def properties(self, s: Any, out: list) -> None:
        while True:
            p = self.verb()
            while True:
                o = self.node(out)
                out.append(a.Triple(s, p, o))
                if not self.take(","):
                    break
            if not self.take(";"):
                return
            while self.take(";"):
                pass
            if self.peek()[1] in (".", "]", "}", "") or self.peek()[0] == "end":
                return

    def triples(self, out: list) -> None:
        had = len(out)
        s = self.node(out)
        bare = isinstance(s, t.BNode) and len(out) > had or self.peek()[1] in (".", "}")
        if not (bare and self.peek()[1] in (".", "}", "")):
            self.properties(s, out)

    # --- groups
    def group(self) -> a.Group:
        self.need("{")
        if self.word("select"):
            q = self.select()
            self.need("}")
            return a.Group((a.SubQuery(q),))
        out: list = []
        while not self.take("}"):
            if self.take("."):
                continue
            if self.take("optional"):
                out.append(a.Optional_(self.group()))
            elif self.take("minus"):
                out.append(a.Minus(self.group()))
            elif self.take("graph"):
                g = t.Var(self.next()[1][1:]) if self.peek()[0] == "var" else self.iri()
                out.append(a.GraphEl(g, self.group()))
            elif self.take("service"):
                silent = bool(self.take("silent"))
                g = t.Var(self.next()[1][1:]) if self.peek()[0] == "var" else self.iri()
                out.append(a.Service(g, self.group(), silent))
            elif self.take("filter"):
                out.append(a.Filter(self.constraint()))
            elif self.take("bind"):
                self.need("(")
                e = self.expression()
                self.need("as")
                out.append(a.Bind(e, self.var()))
                self.need(")")
            elif self.take("values"):
                out.append(self.values())
            elif self.peek()[1] == "{":
                xs = [self.group()]
                while self.take("union"):
                    xs.append(self.group())
                out.append(xs[0] if len(xs) == 1 and not isinstance(xs[0].elements[:1] and xs[0].elements[0], a.SubQuery) else a.Union_(tuple(xs)) if len(xs) > 1 else xs[0].elements[0])
            else:
                self.triples(out)
        return a.Group(tuple(out))

    def var(self) -> str:
        kind, x = self.next()
        if kind != "var":
            self.at -= 1
            raise self.wrong("a variable")
        return x[1:]

    def constraint(self) -> t.Expr:
        if self.take("("):
            e = self.expression()
            self.need(")")
            return e
        return self.primary()

    def values(self) -> a.Values:
        one = self.peek()[0] == "var"
        names = []
        if one:
            names.append(self.var())
        else:
            self.need("(")
            while not self.take(")"):
                names.append(self.var())
        rows = []
        self.need("{")
        while not self.take("}"):
            if one:
                rows.append((self.data_value(),))
            else:
                self.need("(")
                row = []
                while not self.take(")"):
                    row.append(self.data_value())
                if len(row) != len(names):
                    raise QueryError("parse", "a row of VALUES has another length", self.text)
                rows.append(tuple(row))
        return a.Values(tuple(names), tuple(rows))

    def data_value(self) -> Any:
        if self.take("undef"):
            return t.UNDEF
        return self.node([])

    # --- expressions
    def expression(self) -> t.Expr:
        out = self.conjunction()
        while self.take("||"):
            out = t.Call("or", (out, self.conjunction()))
        return out

    def conjunction(self) -> t.Expr:
        out = self.relation()
        while self.take("&&"):
            out = t.Call("and", (out, self.relation()))
        return out

    def relation(self) -> t.Expr:
        out = self.sum()
        kind, x = self.peek()
        if kind == "op" and x in _COMPARE:
            self.at += 1
            return t.Call(_COMPARE[x], (out, self.sum()))
        negated = self.word("not") and self.peek(1)[1].lower() == "in"
        if negated:
            self.at += 1
        if self.take("in"):
            xs = self.arguments()
            e = t.in_list(out, xs)
            return t.Call("not", (e,)) if negated else e
        return out

    def sum(self) -> t.Expr:
        out = self.product()
        while op := self.take("+", "-"):
            out = t.Call("add" if op == "+" else "sub", (out, self.product()))
        return out

    def product(self) -> t.Expr:
        out = self.unary()
        while op := self.take("*", "/", "%"):
            out = t.Call({"*": "mul", "/": "div", "%": "mod"}[op], (out, self.unary()))
        return out

    def unary(self) -> t.Expr:
        if self.take("!"):
            return t.Call("not", (self.unary(),))
        got = self.signed()
        if got is not None:
            return got
        if self.take("-"):
            return t.Call("neg", (self.unary(),))
        if self.take("+"):
            return self.unary()
        return self.primary()

    def arguments(self) -> list[t.Expr]:
        self.need("(")
        xs: list[t.Expr] = []
        while not self.take(")"):
            xs.append(self.expression())
            self.take(",")
        return xs

    def primary(self) -> t.Expr:
        kind, x = self.peek()
        if x == "(":
            self.at += 1
            e = self.expression()
            self.need(")")
            return e
        if kind == "var":
            self.at += 1
            return t.Var(x[1:])
        if kind in ("iri", "pname"):
            f = self.iri()
            if self.peek()[1] == "(":
                name = f.iri if isinstance(f, t.IRI) else f.text
                return t.Call(f"<{name}>", tuple(self.arguments()))
            return f
        if x == "<<":
            return self.node([])
        if kind == "word":
            low = x.lower()
            if low == "exists":
                self.at += 1
                return t.Exists(self.group())
            if low == "not" and self.peek(1)[1].lower() == "exists":
                self.at += 2
                return t.Exists(self.group(), True)
            if low in _AGGREGATES:
                self.at += 1
                return self.aggregate(low)
            if low in _BUILTINS:
                self.at += 1
                return t.Call(_BUILTINS[low], tuple(self.arguments()))
        return self.literal()

    def aggregate(self, name: str) -> t.Agg:
        self.need("(")
        distinct = bool(self.take("distinct"))
        arg = None if self.take("*") else self.expression()
        sep = " "
        if self.take(";"):
            self.need("separator")
            self.need("=")
            sep = self.literal().lex
        self.need(")")
        return t.Agg(name, arg, distinct, sep)

    # --- queries
    def prologue(self) -> None:
        while True:
            if self.take("prefix"):
                kind, x = self.next()
                if kind != "pname" or not x.endswith(":"):
                    raise QueryError("parse", f"a prefix expected, not {x!r}", self.text)
                k, y = self.next()
                if k != "iri":
                    raise QueryError("parse", f"an IRI expected, not {y!r}", self.text)
                self.prefixes[x[:-1]] = self.absolute(y[1:-1])
            elif self.take("base"):
                self.base = self.absolute(self.next()[1][1:-1])
            else:
                return

    def dataset(self) -> dict:
        from_, named = [], []
        while self.take("from"):
            (named if self.take("named") else from_).append(self.iri())
        return {"from_": tuple(from_), "from_named": tuple(named)}

    def select(self) -> a.Query:
        self.need("select")
        modifier = self.take("distinct", "reduced")
        projection: Any = []
        if self.take("*"):
            projection = "*"
        else:
            while True:
                if self.peek()[0] == "var":
                    projection.append((self.var(), None))
                elif self.take("("):
                    e = self.expression()
                    self.need("as")
                    projection.append((self.var(), e))
                    self.need(")")
                else:
                    break
            if not projection:
                raise self.wrong("a projection")
            projection = tuple(projection)
        data = self.dataset()
        self.take("where")
        return a.Query("select", projection, self.group(), modifier=modifier, **data, **self.modifiers())

    def modifiers(self) -> dict:
        out: dict[str, Any] = {}
        if self.take("group"):
            self.need("by")
            keys = []
            while True:
                if self.peek()[0] == "var":
                    keys.append((t.Var(self.var()), None))
                elif self.take("("):
                    e = self.expression()
                    name = self.var() if self.take("as") else None
                    self.need(")")
                    keys.append((e, name))
                elif self.peek()[0] in ("iri", "pname") or self.peek()[0] == "word" and self.peek()[1].lower() in _BUILTINS:
                    keys.append((self.primary(), None))
                else:
                    break
            out["group_by"] = tuple(keys)
        if self.take("having"):
            conditions = []
            while self.peek()[1] == "(" or self.peek()[0] == "word" and self.peek()[1].lower() in _BUILTINS | dict.fromkeys(_AGGREGATES):
                conditions.append(self.constraint())
            out["having"] = tuple(conditions)
        if self.take("order"):
            self.need("by")
            keys = []
            while True:
                if d := self.take("asc", "desc"):
                    self.need("(")
                    keys.append((self.expression(), d == "asc"))
                    self.need(")")
                elif self.peek()[0] == "var":
                    keys.append((t.Var(self.var()), True))
                elif self.peek()[1] == "(" or self.peek()[0] in ("iri", "pname") or self.peek()[0] == "word" and self.peek()[1].lower() in _BUILTINS | dict.fromkeys(_AGGREGATES):
                    keys.append((self.constraint(), True))
                else:
                    break
            out["order_by"] = tuple(keys)
        while what := self.take("limit", "offset"):
            kind, x = self.next()
            if kind != "number" or not x.isdigit():
                raise QueryError("parse", f"a number expected, not {x!r}", self.text)
            out[what] = int(x)
        if self.take("values"):
            out["values"] = self.values()
        return out

    def query(self) -> a.Query:
        self.prologue()
        if self.word("select"):
            q = self.select()
        elif self.take("ask"):
            data = self.dataset()
            self.take("where")
            q = a.Query("ask", "*", self.group(), **data, **self.modifiers())
        elif self.take("construct"):
            if self.peek()[1] == "{":
                template = self.template()
                data = self.dataset()
                self.take("where")
                where = self.group()
            else:
                data = self.dataset()
                self.need("where")
                where = self.group()
                template = tuple(e for e in where.elements if isinstance(e, a.Triple))
            q = a.Query("construct", "*", where, template=template, **data, **self.modifiers())
        elif self.take("describe"):
            targets: list = []
            if not self.take("*"):
                while self.peek()[0] in ("var", "iri", "pname"):
                    targets.append(t.Var(self.var()) if self.peek()[0] == "var" else self.iri())
            data = self.dataset()
            where = a.Group()
            if self.take("where") or self.peek()[1] == "{":
                where = self.group()
            if not targets:
                targets = list(dict.fromkeys(x for e in where.elements if isinstance(e, a.Triple) for x in (e.s, e.p, e.o) if isinstance(x, t.Var)))
            q = a.Query("describe", "*", where, targets=tuple(targets), **data, **self.modifiers())
        else:
            raise self.wrong("SELECT, ASK, CONSTRUCT or DESCRIBE")
        if self.peek()[0] != "end":
            raise self.wrong("the end")
        from dataclasses import replace

        return replace(q, prefixes=tuple(self.prefixes.items()), base=self.base)

    def template(self) -> tuple:
        self.need("{")
        out: list = []
        while not self.take("}"):
            if not self.take("."):
                self.triples(out)
        return tuple(out)

    # --- updates
    def update(self) -> tuple[a.Update, ...]:
        out: list[a.Update] = []
        self.prologue()
        while self.peek()[0] != "end":
            out.append(self.operation())
            if not self.take(";"):
                break
            self.prologue()
        if self.peek()[0] != "end":
            raise self.wrong("; or the end")
        return tuple(out)

    def quads(self) -> tuple[a.Quads, ...]:
        self.need("{")
        plain: list = []
        out: list[a.Quads] = []
        while not self.take("}"):
            if self.take("."):
                continue
            if self.take("graph"):
                g = t.Var(self.next()[1][1:]) if self.peek()[0] == "var" else self.iri()
                out.append(a.Quads(self.template(), g))
            else:
                self.triples(plain)
        return (*([a.Quads(tuple(plain))] if plain else []), *out)

    def graph_ref(self) -> Any:
        word = self.take("default", "named", "all")
        if word:
            return word.upper()
        self.take("graph")
        return self.iri()

    def operation(self) -> a.Update:
        with_ = self.iri() if self.take("with") else None
        what = self.need("insert", "delete", "load", "clear", "drop", "create", "copy", "move", "add")
        if what == "load":
            silent = bool(self.take("silent"))
            source = self.iri()
            target = None
            if self.take("into"):
                self.need("graph")
                target = self.iri()
            return a.Update("load", source=source, target=target, silent=silent)
        if what in ("clear", "drop", "create"):
            silent = bool(self.take("silent"))
            return a.Update(what, target=self.graph_ref(), silent=silent)
        if what in ("copy", "move", "add"):
            silent = bool(self.take("silent"))
            source = self.graph_ref()
            self.need("to")
            return a.Update(what, source=source, target=self.graph_ref(), silent=silent)
        if self.take("data"):
            return a.Update(f"{what}_data", **{what: self.quads()})
        if what == "delete" and self.take("where"):
            q = self.quads()
            return a.Update("delete_where", delete=q, where=pattern_of(q))
        delete = insert = ()
        if what == "delete":
            delete = self.quads()
            if self.take("insert"):
                insert = self.quads()
        else:
            insert = self.quads()
        using, named = [], []
        while self.take("using"):
            (named if self.take("named") else using).append(self.iri())
        self.need("where")
        return a.Update("modify", insert, delete, self.group(), with_, tuple(using), tuple(named))


def pattern_of(quads: tuple[a.Quads, ...]) -> a.Group:
    out: list = []
    for q in quads:
        out += q.triples if q.graph is None else [a.GraphEl(q.graph, a.Group(q.triples))]
    return a.Group(tuple(out))


def parse_query(text: str) -> a.Query:
    return Parser(text).query()


def parse_update(text: str) -> tuple[a.Update, ...]:
    p = Parser(text)
    from dataclasses import replace

    return tuple(replace(u, prefixes=tuple(p.prefixes.items())) for u in p.update())


def parse_group(text: str) -> a.Group:
    """Elements of a group, with or without its braces."""
    p = Parser("{" + text + "\n}")
    g = p.group()
    if p.peek()[0] != "end":
        raise p.wrong("the end")
    return g.elements[0] if len(g.elements) == 1 and isinstance(g.elements[0], a.Group) else g


def parse_expression(text: str) -> t.Expr:
    p = Parser(text)
    e = p.expression()
    if p.peek()[0] != "end":
        raise p.wrong("the end")
    return e
