"""Terms and expressions: immutable nodes with a fluent interface.

Strings given as values are literals; `v("x")`, `iri(...)` and `prefixed(...)` make the other kinds.  Nothing here
touches Spark; `functions.columns` turns expressions into columns.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import re
from collections.abc import Iterable
from dataclasses import dataclass
from typing import Any

from tessera.errors import ValidationError
from tessera.namespaces import RDF, XSD

_VAR = re.compile(r"[^\W\d]\w*|\d\w*", re.UNICODE)
_BAD_IRI = re.compile(r'[\x00-\x20<>"{}|^`\\]')
_PREFIX = re.compile(r"[A-Za-z][\w.-]*|", re.UNICODE)
_LOCAL = re.compile(r"(?:[\w:%\\.-]|\\.)*", re.UNICODE)
_LANG = re.compile(r"[A-Za-z]{1,8}(-[A-Za-z0-9]{1,8})*")


def check_var(name: str) -> str:
    name = name[1:] if name[:1] in "?$" else name
    if not _VAR.fullmatch(name):
        raise ValidationError(f"not a variable name: {name!r}")
    return name


def check_iri(iri: str) -> str:
    if not iri or _BAD_IRI.search(iri):
        raise ValidationError(f"not an IRI: {iri!r}")
    return iri


def check_prefix(name: str) -> str:
    if not _PREFIX.fullmatch(name) or name.endswith("."):
        raise ValidationError(f"not a prefix: {name!r}")
    return name


def check_lang(tag: str) -> str:
    if not _LANG.fullmatch(tag):
        raise ValidationError(f"not a language tag: {tag!r}")
    return tag.lower()


class Expr:
    """Anything that has a value in a solution."""

    def as_(self, name: str) -> Aliased:
        return Aliased(self, check_var(name))

    # arithmetic
    def add(self, x): return Call("add", (self, value(x)))  # noqa: E704
    def sub(self, x): return Call("sub", (self, value(x)))  # noqa: E704
    def mul(self, x): return Call("mul", (self, value(x)))  # noqa: E704
    def div(self, x): return Call("div", (self, value(x)))  # noqa: E704
    def mod(self, x): return Call("mod", (self, value(x)))  # noqa: E704
    def neg(self): return Call("neg", (self,))  # noqa: E704
    def abs(self): return Call("abs", (self,))  # noqa: E704
    def round(self): return Call("round", (self,))  # noqa: E704
    def ceil(self): return Call("ceil", (self,))  # noqa: E704
    def floor(self): return Call("floor", (self,))  # noqa: E704

    # comparison
    def eq(self, x): return Call("eq", (self, value(x)))  # noqa: E704
    def neq(self, x): return Call("neq", (self, value(x)))  # noqa: E704
    def lt(self, x): return Call("lt", (self, value(x)))  # noqa: E704
    def lte(self, x): return Call("lte", (self, value(x)))  # noqa: E704
    def gt(self, x): return Call("gt", (self, value(x)))  # noqa: E704
    def gte(self, x): return Call("gte", (self, value(x)))  # noqa: E704
    def between(self, lo, hi): return Call("and", (self.gte(lo), self.lte(hi)))  # noqa: E704
    def in_list(self, *xs): return in_list(self, *xs)  # noqa: E704
    def not_in_list(self, *xs): return not_in_list(self, *xs)  # noqa: E704
    def same_term(self, x): return Call("sameterm", (self, value(x)))  # noqa: E704

    # logic
    def and_(self, *xs): return and_(self, *xs)  # noqa: E704
    def or_(self, *xs): return or_(self, *xs)  # noqa: E704
    def not_(self): return Call("not", (self,))  # noqa: E704
    def is_null(self): return Call("not", (Call("bound", (self,)),))  # noqa: E704
    def is_not_null(self): return Call("bound", (self,))  # noqa: E704
    def bound(self): return Call("bound", (self,))  # noqa: E704
    def is_iri(self): return Call("isiri", (self,))  # noqa: E704
    def is_blank(self): return Call("isblank", (self,))  # noqa: E704
    def is_literal(self): return Call("isliteral", (self,))  # noqa: E704
    def is_numeric(self): return Call("isnumeric", (self,))  # noqa: E704

    # strings
    def concat(self, *xs): return concat(self, *xs)  # noqa: E704
    def str(self): return Call("str", (self,))  # noqa: E704
    def strlen(self): return Call("strlen", (self,))  # noqa: E704
    def ucase(self): return Call("ucase", (self,))  # noqa: E704
    def lcase(self): return Call("lcase", (self,))  # noqa: E704
    def contains(self, x): return Call("contains", (self, value(x)))  # noqa: E704
    def starts_with(self, x): return Call("strstarts", (self, value(x)))  # noqa: E704
    def ends_with(self, x): return Call("strends", (self, value(x)))  # noqa: E704
    def regex(self, pattern, flags=None): return regex(self, pattern, flags)  # noqa: E704
    def substr(self, start, length=None): return substr(self, start, length)  # noqa: E704
    def replace(self, pattern, by, flags=None): return replace_str(self, pattern, by, flags)  # noqa: E704
    def str_before(self, x): return Call("strbefore", (self, value(x)))  # noqa: E704
    def str_after(self, x): return Call("strafter", (self, value(x)))  # noqa: E704
    def lang(self): return Call("lang", (self,))  # noqa: E704
    def datatype(self): return Call("datatype", (self,))  # noqa: E704

    # operators
    __add__ = add
    __sub__ = sub
    __mul__ = mul
    __truediv__ = div
    __mod__ = mod
    __neg__ = neg
    __lt__ = lt
    __le__ = lte
    __gt__ = gt
    __ge__ = gte

    def __radd__(self, x): return value(x).add(self)  # noqa: E704
    def __rsub__(self, x): return value(x).sub(self)  # noqa: E704
    def __rmul__(self, x): return value(x).mul(self)  # noqa: E704
    def __rtruediv__(self, x): return value(x).div(self)  # noqa: E704
    def __and__(self, x): return and_(self, x)  # noqa: E704
    def __or__(self, x): return or_(self, x)  # noqa: E704
    def __invert__(self): return self.not_()  # noqa: E704


@dataclass(frozen=True, order=False)
class Var(Expr):
    name: str

    def __repr__(self) -> str:
        return f"?{self.name}"


@dataclass(frozen=True)
class IRI(Expr):
    iri: str

    def __repr__(self) -> str:
        return f"<{self.iri}>"


@dataclass(frozen=True)
class PName(Expr):
    """prefix:local, resolved against the query's prefixes."""

    text: str


@dataclass(frozen=True)
class Lit(Expr):
    lex: str
    dt: str = XSD.string
    tag: str | None = None

    def __repr__(self) -> str:
        return f'"{self.lex}"@{self.tag}' if self.tag else f'"{self.lex}"^^<{self.dt}>'


@dataclass(frozen=True)
class BNode(Expr):
    """In a WHERE pattern a hidden variable; in a template a fresh node for each solution."""

    label: str


@dataclass(frozen=True)
class Quoted(Expr):
    """A quoted triple."""

    s: Expr
    p: Expr
    o: Expr


@dataclass(frozen=True)
class Call(Expr):
    op: str
    args: tuple

    def __repr__(self) -> str:
        return f"{self.op}{self.args!r}"


@dataclass(frozen=True)
class Agg(Expr):
    op: str
    arg: Expr | None
    distinct: bool = False
    sep: str = " "


@dataclass(frozen=True)
class Exists(Expr):
    group: Any
    negated: bool = False


@dataclass(frozen=True)
class Aliased:
    expr: Expr
    name: str


class _Undef:
    def __repr__(self) -> str:
        return "UNDEF"


UNDEF = _Undef()


def undef() -> _Undef:
    return UNDEF


# --- constructors -------------------------------------------------------------------------------


def variable(name: str) -> Var:
    return Var(check_var(name))


v = variable


def iri(x) -> Expr:
    """A constant IRI, or the IRI of an expression's string."""
    return Call("iri", (x,)) if isinstance(x, Expr) else IRI(check_iri(x.strip("<>") if x.startswith("<") else x))


uri = iri


def prefixed(name: str, local: str | None = None) -> PName:
    name, local = name.split(":", 1) if local is None else (name, local)
    check_prefix(name)
    if not _LOCAL.fullmatch(local):
        raise ValidationError(f"not a local name: {local!r}")
    return PName(f"{name}:{local}")


prefix_name = prefixed


def strlit(x: str) -> Lit:
    return Lit(x)


def typed(x: object, datatype: str) -> Lit:
    return Lit(str(x), check_iri(datatype))


def lang(x: str, tag: str) -> Lit:
    return Lit(x, RDF.langString, check_lang(tag))


def integer(x: int) -> Lit:
    if isinstance(x, bool) or isinstance(x, float) and (math.isnan(x) or not x.is_integer()):
        raise ValidationError(f"not an integer: {x!r}")
    return Lit(str(int(x)), XSD.integer)


def decimal_(x) -> Lit:
    d = decimal.Decimal(str(x))
    if not d.is_finite():
        raise ValidationError(f"not a finite number: {x!r}")
    s = format(d, "f")
    return Lit(s if "." in s else s + ".0", XSD.decimal)


def double(x: float) -> Lit:
    if math.isnan(x) or math.isinf(x):
        raise ValidationError(f"not a finite number: {x!r}")
    return Lit(repr(float(x)), XSD.double)


def num(x) -> Lit:
    return integer(x) if isinstance(x, int) or float(x).is_integer() and not isinstance(x, decimal.Decimal) else decimal_(x)


def boolean(x: bool) -> Lit:
    return Lit("true" if x else "false", XSD.boolean)


bool_ = boolean


def date(x) -> Lit:
    return Lit(x if isinstance(x, str) else x.strftime("%Y-%m-%d"), XSD.date)


def date_time(x) -> Lit:
    if isinstance(x, str):
        return Lit(x, XSD.dateTime)
    if x.tzinfo is not None:
        return Lit(x.astimezone(dt.UTC).replace(tzinfo=None).isoformat() + "Z", XSD.dateTime)
    return Lit(x.isoformat(), XSD.dateTime)


def value(x: Any, strict: bool = True) -> Expr:
    """Python value to term; a plain string is a literal."""
    if isinstance(x, Expr):
        return x
    if isinstance(x, Aliased):
        return x.expr
    if x is None:
        if strict:
            raise ValidationError("no value")
        return Lit("")
    if isinstance(x, bool):
        return boolean(x)
    if isinstance(x, int):
        return integer(x)
    if isinstance(x, float):
        if math.isnan(x) or math.isinf(x):
            raise ValidationError(f"not a finite number: {x!r}")
        return num(x)
    if isinstance(x, decimal.Decimal):
        return decimal_(x)
    if isinstance(x, dt.datetime):
        return date_time(x)
    if isinstance(x, dt.date):
        return date(x)
    if isinstance(x, str):
        return Lit(x)
    raise ValidationError(f"no term for {type(x).__name__}; use rdf_list or bnode_pattern for collections and maps")


# --- functions -----------------------------------------------------------------------------------


def _call(op: str, *names: str):
    def make(*args):
        return Call(op, tuple(value(a) for a in args))

    make.__name__ = names[0] if names else op
    return make


add, sub, mul, div, mod = (_call(x) for x in ("add", "sub", "mul", "div", "mod"))
abs_, round_, ceil, floor = (_call(x) for x in ("abs", "round", "ceil", "floor"))
eq, neq, lt, lte, gt, gte = (_call(x) for x in ("eq", "neq", "lt", "lte", "gt", "gte"))
same_term = _call("sameterm")
str_, strlen, ucase, lcase = _call("str"), _call("strlen"), _call("ucase"), _call("lcase")
contains, starts_with, ends_with = _call("contains"), _call("strstarts"), _call("strends")
strstarts, strends = starts_with, ends_with
str_before, str_after, encode_for_uri = _call("strbefore"), _call("strafter"), _call("encode_for_uri")
getlang, datatype, lang_matches = _call("lang"), _call("datatype"), _call("langmatches")
strdt, strlang = _call("strdt"), _call("strlang")
is_iri, is_blank, is_literal, is_numeric = _call("isiri"), _call("isblank"), _call("isliteral"), _call("isnumeric")
md5, sha1, sha256, sha384, sha512 = (_call(x) for x in ("md5", "sha1", "sha256", "sha384", "sha512"))
now, uuid, struuid, rand, bnode_fn = (_call(x) for x in ("now", "uuid", "struuid", "rand", "bnode"))
year, month, day, hours, minutes, seconds, timezone, tz = (_call(x) for x in ("year", "month", "day", "hours", "minutes", "seconds", "timezone", "tz"))


def bound(x) -> Call:
    return Call("bound", (x if isinstance(x, Expr) else v(x),))


def is_null(x) -> Call:
    return Call("not", (bound(x),))


is_not_null = bound


def concat(*xs) -> Expr:
    return Call("concat", tuple(value(x) for x in xs)) if xs else Lit("")


def coalesce(*xs) -> Expr:
    return Call("coalesce", tuple(value(x) for x in xs)) if xs else Lit("")


def if_else(c, a, b) -> Call:
    return Call("if", (value(c), value(a), value(b)))


def and_(*xs) -> Expr:
    if not xs:
        raise ValidationError("and needs an operand")
    out = value(xs[0])
    for x in xs[1:]:
        out = Call("and", (out, value(x)))
    return out


def or_(*xs) -> Expr:
    if not xs:
        raise ValidationError("or needs an operand")
    out = value(xs[0])
    for x in xs[1:]:
        out = Call("or", (out, value(x)))
    return out


def not_(x) -> Call:
    return Call("not", (value(x),))


def _flat(xs: tuple) -> list:
    return list(xs[0]) if len(xs) == 1 and isinstance(xs[0], list | tuple | set) else list(xs)


def in_list(x, *xs) -> Expr:
    xs = _flat(xs)
    return Call("in", (value(x), *map(value, xs))) if xs else boolean(False)


def not_in_list(x, *xs) -> Expr:
    xs = _flat(xs)
    return Call("not", (in_list(x, *xs),)) if xs else boolean(True)


def between(x, lo, hi) -> Expr:
    return value(x).between(lo, hi)


def expr_list(*xs) -> tuple:
    return tuple(value(x) for x in xs)


def regex(x, pattern, flags: str | None = None) -> Call:
    return Call("regex", (value(x), value(pattern), *([Lit(flags)] if flags else [])))


def substr(x, start, length=None) -> Call:
    return Call("substr", (value(x), value(start), *([value(length)] if length is not None else [])))


def replace_str(x, pattern, by, flags: str | None = None) -> Call:
    return Call("replace", (value(x), value(pattern), value(by), *([Lit(flags)] if flags else [])))


def function(name: str, *args) -> Call:
    """A cast or extension function by its IRI."""
    return Call("<" + name.strip("<>") + ">", tuple(value(a) for a in args))


# --- aggregates ----------------------------------------------------------------------------------


def _arg(x) -> Expr | None:
    return None if x is None or x == "*" else v(x) if isinstance(x, str) and x[:1] in "?$" else value(x)


def count(x=None, distinct: bool = False) -> Agg:
    return Agg("count", _arg(x), distinct)


def count_distinct(x) -> Agg:
    return Agg("count", _arg(x), True)


def sum_(x, distinct: bool = False) -> Agg:
    return Agg("sum", _arg(x), distinct)


def avg(x, distinct: bool = False) -> Agg:
    return Agg("avg", _arg(x), distinct)


def min_(x) -> Agg:
    return Agg("min", _arg(x))


def max_(x) -> Agg:
    return Agg("max", _arg(x))


def sample(x) -> Agg:
    return Agg("sample", _arg(x))


def group_concat(x, sep: str = " ", distinct: bool = False) -> Agg:
    return Agg("group_concat", _arg(x), distinct, sep)


def children(e: Expr) -> Iterable[Expr]:
    if isinstance(e, Call):
        return e.args
    if isinstance(e, Agg):
        return () if e.arg is None else (e.arg,)
    return ()


def walk(e: Expr) -> Iterable[Expr]:
    yield e
    for c in children(e):
        yield from walk(c)
