"""Expressions to columns.

A value is a native column whenever its type is known when the plan is made (mapped columns, literals, function
results), else a term struct (kind, lex, dt, lang).  IRIs made from keys stay keys with their prefix.  Errors are NULL;
three-valued logic of SQL is that of the query language, except in IF and in aggregates.
"""

from __future__ import annotations

import decimal
import re
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import terms as t
from tessera.errors import QueryError
from tessera.namespaces import RDF, XSD

TERM = "struct<kind:tinyint,lex:string,dt:string,lang:string>"
#: Order of kinds in ORDER BY.
BLANK, IRI_KIND, LITERAL = 0, 1, 2

INTEGERS = {XSD[x] for x in ("integer", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "nonPositiveInteger", "negativeInteger", "unsignedLong", "unsignedInt", "unsignedShort", "unsignedByte")}
#: Rank of numeric promotion.
RANK = {XSD.integer: 0, XSD.decimal: 1, XSD.float: 2, XSD.double: 3}
BY_RANK = [XSD.integer, XSD.decimal, XSD.float, XSD.double]
NATIVE = {XSD.string: "string", XSD.integer: "bigint", XSD.decimal: "decimal(38,18)", XSD.float: "float", XSD.double: "double", XSD.boolean: "boolean", XSD.date: "date", XSD.dateTime: "timestamp_ntz"}


@dataclass(frozen=True)
class Info:
    """What is known of a variable: kind lit, iri, bnode or term; datatype of lit; prefix of an IRI kept as a key; whether it
    names a row by its number in one scan, which no other scan gives again."""

    kind: str
    dt: str | None = None
    prefix: str | None = None
    nullable: bool = False
    row: bool = False

    @property
    def same(self) -> tuple:
        return (self.kind, self.dt, self.prefix)

    @property
    def numeric(self) -> bool:
        return self.kind == "lit" and self.dt in RANK

    @property
    def text(self) -> bool:
        return self.kind == "lit" and self.dt == XSD.string


@dataclass(frozen=True)
class Val:
    col: Column
    info: Info

    def maybe(self) -> Val:
        return Val(self.col, replace(self.info, nullable=True))


STRING, INTEGER, DECIMAL, DOUBLE, BOOLEAN = (Info("lit", d) for d in (XSD.string, XSD.integer, XSD.decimal, XSD.double, XSD.boolean))
IRI_INFO, BNODE_INFO, TERM_INFO = Info("iri"), Info("bnode"), Info("term")


def null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def term(kind: int, lex: Column, dt: Column | None = None, lang: Column | None = None) -> Column:
    s = F.struct(F.lit(kind).cast("tinyint").alias("kind"), lex.alias("lex"), (dt if dt is not None else null("string")).alias("dt"), (lang if lang is not None else null("string")).alias("lang"))
    return F.when(lex.isNotNull(), s)


def plain_double(c: Column) -> Column:
    """Lexical form of a double."""
    return F.when(F.isnan(c), F.lit("NaN")).when(c == float("inf"), F.lit("INF")).when(c == float("-inf"), F.lit("-INF")).otherwise(c.cast("string"))


def plain_decimal(c: Column) -> Column:
    s = F.regexp_replace(c.cast("decimal(38,18)").cast("string"), "0+$", "")
    return F.when(s.endswith("."), F.concat(s, F.lit("0"))).otherwise(s)


def lexical(v: Val) -> Column:
    """STR of a value: an IRI's text or a literal's lexical form."""
    i, c = v.info, v.col
    if i.kind == "term":
        return c["lex"]
    if i.kind == "iri":
        return F.concat(F.lit(i.prefix), c.cast("string")) if i.prefix is not None else c
    if i.kind == "bnode":
        return c
    if i.dt in (XSD.double, XSD.float):
        return plain_double(c)
    if i.dt == XSD.decimal:
        return plain_decimal(c)
    if i.dt == XSD.dateTime:
        base = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        micro = F.date_format(c, "SSSSSS")
        return F.when(micro == "000000", base).otherwise(F.concat(base, F.lit("."), F.regexp_replace(micro, "0+$", "")))
    return c.cast("string")


def lift(v: Val) -> Val:
    """As a term struct."""
    i = v.info
    if i.kind == "term":
        return v
    kind = {"iri": IRI_KIND, "bnode": BLANK, "lit": LITERAL}[i.kind]
    return Val(term(kind, lexical(v), F.lit(i.dt) if i.kind == "lit" else None), Info("term", nullable=i.nullable, row=i.row))


def constant(x: t.Expr) -> Val:
    """A constant term as a value."""
    if isinstance(x, t.IRI):
        return Val(F.lit(x.iri), IRI_INFO)
    if isinstance(x, t.Lit):
        if x.tag:
            return Val(term(LITERAL, F.lit(x.lex), F.lit(RDF.langString), F.lit(x.tag)), TERM_INFO)
        py = literal_value(x)
        if py is not None:
            return Val(py, Info("lit", x.dt))
        return Val(term(LITERAL, F.lit(x.lex), F.lit(x.dt)), TERM_INFO)
    raise QueryError("analysis", f"not a constant: {x!r}")


def literal_value(x: t.Lit) -> Column | None:
    """Native column of a well-formed literal of a native datatype (in its own datatype only)."""
    try:
        if x.dt == XSD.string:
            return F.lit(x.lex)
        if x.dt == XSD.integer:
            return F.lit(int(x.lex)).cast("bigint") if abs(int(x.lex)) < 1 << 63 else None
        if x.dt == XSD.decimal:
            return F.lit(decimal.Decimal(x.lex)).cast("decimal(38,18)")
        if x.dt in (XSD.double, XSD.float):
            return F.lit(float(x.lex.replace("INF", "inf"))).cast(NATIVE[x.dt])
        if x.dt == XSD.boolean and x.lex in ("true", "false", "1", "0"):
            return F.lit(x.lex in ("true", "1"))
        if x.dt == XSD.date and re.fullmatch(r"\d{4}-\d\d-\d\d", x.lex):
            return F.lit(x.lex).cast("date")
        if x.dt == XSD.dateTime and re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?", x.lex):
            return F.lit(x.lex).cast("timestamp_ntz")
    except (ValueError, ArithmeticError):
        return None
    return None


# --- numbers -------------------------------------------------------------------------------------


def is_num_dt(dt: Column) -> Column:
    return dt.isin(*INTEGERS, XSD.decimal, XSD.double, XSD.float)


def number(v: Val) -> Column:
    """Numeric value as a native number (double from a term struct), NULL if none."""
    if v.info.numeric:
        return v.col
    if v.info.kind == "term":
        lex = F.when(v.col["lex"] == "INF", F.lit("Infinity")).when(v.col["lex"] == "-INF", F.lit("-Infinity")).otherwise(v.col["lex"])
        return F.when((v.col["kind"] == LITERAL) & is_num_dt(v.col["dt"]), lex.try_cast("double"))
    return null("double")


def rank(v: Val) -> Column:
    if v.info.numeric:
        return F.lit(RANK[v.info.dt])
    if v.info.kind == "term":
        dt = v.col["dt"]
        return F.when(dt.isin(*INTEGERS), 0).when(dt == XSD.decimal, 1).when(dt == XSD.float, 2).when(dt == XSD.double, 3)
    return null("int")


def number_term(x: Column, r: Column) -> Column:
    """Term struct of a double with a rank of promotion."""
    lex = F.when(r == 0, x.try_cast("decimal(38,0)").cast("string")).when(r == 1, plain_decimal(x.try_cast("decimal(38,18)"))).otherwise(plain_double(x))
    dt = F.element_at(F.array(*map(F.lit, BY_RANK)), (r + 1).cast("int"))
    return F.when(x.isNotNull() & r.isNotNull(), term(LITERAL, lex, dt))


def _promoted(a: Val, b: Val) -> tuple[Column, Column, str] | None:
    """Both natively numeric: columns in their common type, and its datatype."""
    if a.info.numeric and b.info.numeric:
        dt = BY_RANK[max(RANK[a.info.dt], RANK[b.info.dt])]
        kind = NATIVE[dt]
        return tuple(x.col if x.info.dt == dt else x.col.cast(kind) for x in (a, b)) + (dt,)  # type: ignore[return-value]
    return None


def arithmetic(op: str, a: Val, b: Val) -> Val:
    both = _promoted(a, b)
    maybe = True
    if both:
        x, y, dt = both
        if op == "div":
            if dt in (XSD.double, XSD.float):
                x, y = x.cast("double"), y.cast("double")
                out = F.when(y != 0, x / F.when(y != 0, y)).when(F.isnan(x) | (x == 0), F.lit(float("nan"))).when(x > 0, F.lit(float("inf"))).when(x < 0, F.lit(float("-inf")))
                return Val(out, Info("lit", dt, nullable=True))
            kind = "decimal(20,0)" if dt == XSD.integer else "decimal(38,10)"  # a quotient of integers has 18 digits after the point
            return Val(F.try_divide(x.cast(kind), y.cast(kind)).cast("decimal(38,18)"), Info("lit", XSD.decimal, nullable=True))
        f = {"add": F.try_add, "sub": F.try_subtract, "mul": F.try_multiply, "mod": F.try_mod}[op]
        if dt == XSD.decimal:
            # operands at a scale that keeps the result's digits
            s = {"mul": "decimal(19,9)"}.get(op)
            if s:
                x, y = x.try_cast(s), y.try_cast(s)
            return Val(f(x, y).try_cast("decimal(38,18)"), Info("lit", dt, nullable=maybe))
        return Val(f(x, y), Info("lit", dt, nullable=a.info.nullable or b.info.nullable or dt == XSD.integer or op == "mod"))
    if not all(i.numeric or i.kind == "term" for i in (a.info, b.info)):
        return Val(null("double"), replace(DOUBLE, nullable=True))
    x, y = number(a).cast("double"), number(b).cast("double")
    r = F.greatest(rank(a), rank(b))
    if op == "div":
        r = F.greatest(r, F.lit(1))
        out = F.when(y != 0, x / F.when(y != 0, y))
    else:
        out = {"add": x + y, "sub": x - y, "mul": x * y, "mod": F.when(y != 0, x % F.when(y != 0, y))}[op]
    return Val(number_term(out, r), replace(TERM_INFO, nullable=True))


def quotient(total: Column, n: Column) -> Column:
    """A sum of integers or decimals by their number, to 18 digits after the point."""
    return F.try_divide(total.cast("decimal(38,18)"), n.cast("decimal(19,0)")).cast("decimal(38,18)")


def unary(op: str, a: Val) -> Val:
    f = {
        "abs": F.abs,
        "ceil": F.ceil,
        "floor": F.floor,
        "round": lambda c: F.floor(c + F.lit(0.5).cast("decimal(2,1)")),
        "neg": lambda c: -c,
    }[op]
    if a.info.numeric:
        if a.info.dt == XSD.integer:
            out = {"abs": F.abs(a.col), "neg": F.try_subtract(F.lit(0).cast("bigint"), a.col)}.get(op, a.col)
        elif a.info.dt == XSD.decimal:
            out = f(a.col).cast("decimal(38,18)")
        else:
            out = F.floor(a.col + 0.5) if op == "round" else f(a.col)
            out = out.cast(NATIVE[a.info.dt])
        return Val(out, replace(a.info, nullable=True))
    if a.info.kind == "term":
        x = number(a)
        out = F.floor(x + 0.5) if op == "round" else f(x)
        return Val(number_term(out.cast("double"), rank(a)), replace(TERM_INFO, nullable=True))
    return Val(null("double"), replace(DOUBLE, nullable=True))


# --- comparison ----------------------------------------------------------------------------------

_OPS = {"eq": lambda a, b: a == b, "neq": lambda a, b: a != b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b, "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b}


def compare(op: str, a: Val, b: Val) -> Val:
    f, maybe = _OPS[op], replace(BOOLEAN, nullable=True)
    both = _promoted(a, b)
    if both:
        return Val(f(both[0], both[1]), replace(BOOLEAN, nullable=a.info.nullable or b.info.nullable))
    i, j = a.info, b.info
    if "term" in (i.kind, j.kind):
        return Val(_compare_terms(op, lift(a).col, lift(b).col, a, b), maybe)
    if i.kind != j.kind:  # different kinds are different terms; they have no order
        known = a.col.isNotNull() & b.col.isNotNull()
        return Val(F.when(known, F.lit(op == "neq")) if op in ("eq", "neq") else null("boolean"), maybe)
    if i.kind == "iri":
        if op not in ("eq", "neq"):
            return Val(null("boolean"), maybe)
        if i.prefix == j.prefix:
            return Val(f(a.col, b.col), maybe)
        return Val(_iri_equal(a, b, op), maybe)
    if i.kind == "bnode":
        return Val(f(a.col, b.col) if op in ("eq", "neq") else null("boolean"), maybe)
    if i.dt == j.dt:
        return Val(f(a.col, b.col), replace(BOOLEAN, nullable=i.nullable or j.nullable))
    if {i.dt, j.dt} <= {XSD.date, XSD.dateTime}:
        return Val(f(a.col.cast("timestamp_ntz"), b.col.cast("timestamp_ntz")), maybe)
    return Val(null("boolean"), maybe)


def _iri_equal(a: Val, b: Val, op: str) -> Column:
    """Of IRIs kept in different forms. A key against a constant text is compared as a key."""
    for x, y in ((a, b), (b, a)):
        if x.info.prefix is not None and y.info.prefix is None:
            p = x.info.prefix
            same = F.when(y.col.startswith(p), x.col.cast("string") == F.substring(y.col, F.lit(len(p) + 1), F.length(y.col))).otherwise(F.lit(False))
            return same if op == "eq" else ~same
    return _OPS[op](lexical(a), lexical(b))


def _compare_terms(op: str, x: Column, y: Column, a: Val, b: Val) -> Column:
    f = _OPS[op]
    nx, ny = number(a), number(b)

    def simple(c: Column) -> Column:
        return (c["kind"] == LITERAL) & (c["dt"] == XSD.string)

    def when(c: Column) -> Column:
        return F.when((c["kind"] == LITERAL) & c["dt"].isin(XSD.date, XSD.dateTime), c["lex"].try_cast("timestamp"))

    def flag(c: Column) -> Column:
        return F.when((c["kind"] == LITERAL) & (c["dt"] == XSD.boolean), c["lex"].isin("true", "1"))

    out = F.when(nx.isNotNull() & ny.isNotNull(), f(nx.cast("double"), ny.cast("double")))
    out = out.when(simple(x) & simple(y), f(x["lex"], y["lex"]))
    out = out.when(when(x).isNotNull() & when(y).isNotNull(), f(when(x), when(y)))
    out = out.when(flag(x).isNotNull() & flag(y).isNotNull(), f(flag(x), flag(y)))
    if op in ("eq", "neq"):
        yes = F.lit(op == "eq")
        same = x.eqNullSafe(y)
        known = x.isNotNull() & y.isNotNull()
        out = out.when(known & same, yes).when(known & ((x["kind"] != y["kind"]) | (x["kind"] != LITERAL) | x["lang"].isNotNull() | y["lang"].isNotNull()), ~yes)
        typed = [XSD.string, XSD.boolean, XSD.date, XSD.dateTime, *INTEGERS, XSD.decimal, XSD.double, XSD.float]
        out = out.when(known & x["dt"].isin(*typed) & y["dt"].isin(*typed) & ~(is_num_dt(x["dt"]) & is_num_dt(y["dt"])) & (x["dt"] != y["dt"]), ~yes)
    return out


def same_term(a: Val, b: Val) -> Column:
    if a.info.same == b.info.same:
        return a.col == b.col
    return lift(a).col == lift(b).col


def ebv(v: Val) -> Column:
    """Effective boolean value."""
    i, c = v.info, v.col
    if i.kind == "lit":
        if i.dt == XSD.boolean:
            return c
        if i.numeric:
            return (c != 0) & ~F.isnan(c.cast("double")) if i.dt in (XSD.double, XSD.float) else c != 0
        if i.dt == XSD.string:
            return F.length(c) > 0
        return null("boolean")
    if i.kind == "term":
        n = number(v)
        return F.when(n.isNotNull(), n != 0).when(c["dt"] == XSD.boolean, c["lex"].isin("true", "1")).when((c["kind"] == LITERAL) & (c["dt"].isin(XSD.string, RDF.langString)), F.length(c["lex"]) > 0)
    return null("boolean")


def sort_keys(v: Val) -> list[Column]:
    """Columns that order values: unbound, blank nodes, IRIs, literals (by value, then text)."""
    if v.info.kind != "term":
        return [v.col]
    c = v.col
    number_first = number(v)
    return [c["kind"], number_first.isNull().cast("int"), number_first, c["lex"], c["dt"], c["lang"]]


# --- functions -----------------------------------------------------------------------------------


def text_of(v: Val) -> Column:
    """String of a string argument; numbers are accepted by their lexical form, IRIs are not."""
    if v.info.kind == "term":
        return F.when(v.col["kind"] == LITERAL, v.col["lex"])
    if v.info.kind == "lit":
        return lexical(v)
    return null("string")


def _keeping(v: Val, c: Column) -> Val:
    """A string result that keeps the language of its argument."""
    if v.info.kind == "term":
        return Val(F.when(c.isNotNull(), F.struct(F.lit(LITERAL).cast("tinyint").alias("kind"), c.alias("lex"), F.when(v.col["lang"].isNotNull(), F.lit(RDF.langString)).otherwise(F.lit(XSD.string)).alias("dt"), v.col["lang"].alias("lang"))), replace(TERM_INFO, nullable=True))
    return Val(c, replace(STRING, nullable=True))


def flags_pattern(pattern: Column, flags: str) -> Column:
    bad = set(flags) - set("ismxq")
    if bad:
        raise QueryError("analysis", f"unknown regex flags: {''.join(sorted(bad))}")
    if "q" in flags:
        pattern = F.concat(F.lit("\\Q"), F.replace(pattern, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    inline = "".join(c for c in "ismx" if c in flags)
    return F.concat(F.lit(f"(?{inline})"), pattern) if inline else pattern


def encode_for_uri(c: Column) -> Column:
    out = F.url_encode(c)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def substring_at(s: Column, start: Column, length: Column | None) -> Column:
    """1-based characters start <= i < start + length, both rounded."""
    first = F.floor(start.cast("double") + 0.5)
    if length is None:
        return F.when(start.isNotNull(), F.substring(s, F.greatest(first, F.lit(1)).cast("int"), F.greatest(F.char_length(s), F.lit(0))))
    end = first + F.floor(length.cast("double") + 0.5)
    begin = F.greatest(first, F.lit(1))
    size = F.greatest(end - begin, F.lit(0))
    return F.when(start.isNotNull() & length.isNotNull(), F.substring(s, begin.cast("int"), size.cast("int")))


_TIME = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hours": F.hour, "minutes": F.minute}


def moment(v: Val) -> Column:
    if v.info.kind == "lit" and v.info.dt in (XSD.date, XSD.dateTime):
        return v.col
    if v.info.kind == "term":
        lex = F.regexp_replace(v.col["lex"], r"(Z|[+-]\d\d:\d\d)$", "")
        return F.when(v.col["dt"].isin(XSD.date, XSD.dateTime), lex.try_cast("timestamp_ntz"))
    return null("timestamp_ntz")


def cast_to(v: Val, dt: str) -> Val:
    """Constructor functions of the native datatypes; an ill-formed value is NULL."""
    if dt == XSD.string:
        return Val(lexical(v), replace(STRING, nullable=True))
    kind = NATIVE[dt]
    if v.info.kind == "iri":
        return Val(null(kind), Info("lit", dt, nullable=True))
    if v.info.kind == "lit" and v.info.dt != XSD.string:
        source = v.col
        if dt == XSD.integer and v.info.numeric:
            source = F.when(source >= 0, F.floor(source)).otherwise(F.ceil(source))
        if dt == XSD.boolean and v.info.numeric:
            return Val(source != 0, Info("lit", dt, nullable=True))
        return Val(source.try_cast(kind), Info("lit", dt, nullable=True))
    s = F.trim(lexical(v))
    if dt == XSD.boolean:
        return Val(F.when(s.isin("true", "1"), True).when(s.isin("false", "0"), False), Info("lit", dt, nullable=True))
    if dt == XSD.integer:
        s = F.when(s.rlike(r"^[+-]?\d+$"), s)
        if v.info.kind == "term":
            n = number(v)
            return Val(F.coalesce(s.try_cast("bigint"), F.when(n >= 0, F.floor(n)).otherwise(F.ceil(n)).try_cast("bigint")), Info("lit", dt, nullable=True))
    if dt in (XSD.double, XSD.float):
        s = F.when(s == "INF", "Infinity").when(s == "-INF", "-Infinity").otherwise(s)
    return Val(s.try_cast(kind), Info("lit", dt, nullable=True))


class Scope:
    """Variables of a row: name -> Val. `hidden` holds results computed beforehand (aggregates, EXISTS)."""

    def __init__(self, vars: dict[str, Val], hidden: dict[object, Val] | None = None):
        self.vars, self.hidden = vars, hidden or {}

    def value(self, e: t.Expr) -> Val:
        if e in self.hidden:
            return self.hidden[e]
        if isinstance(e, t.Var):
            return self.vars.get(e.name) or Val(null("string"), replace(STRING, nullable=True))
        if isinstance(e, t.IRI | t.Lit):
            return constant(e)
        if isinstance(e, t.Call):
            return self.call(e)
        if isinstance(e, t.Agg):
            raise QueryError("analysis", f"aggregate outside of a group: {e!r}")
        raise QueryError("analysis", f"no value: {e!r}")

    def call(self, e: t.Call) -> Val:
        op, args = e.op, e.args
        maybe = replace(BOOLEAN, nullable=True)
        if op == "bound":
            x = args[0]
            known = self.vars.get(x.name) if isinstance(x, t.Var) else self.value(x)
            return Val(known.col.isNotNull() if known else F.lit(False), BOOLEAN)
        a = [self.value(x) for x in args]
        if op in ("and", "or"):
            x, y = ebv(a[0]), ebv(a[1])
            return Val(x & y if op == "and" else x | y, maybe)
        if op == "not":
            return Val(~ebv(a[0]), maybe)
        if op in _OPS:
            return compare(op, a[0], a[1])
        if op == "in":
            out = compare("eq", a[0], a[1]).col
            for x in a[2:]:
                out = out | compare("eq", a[0], x).col
            return Val(out, maybe)
        if op in ("add", "sub", "mul", "div", "mod"):
            return arithmetic(op, a[0], a[1])
        if op in ("abs", "round", "ceil", "floor", "neg"):
            return unary(op, a[0])
        if op == "sameterm":
            return Val(same_term(a[0], a[1]), maybe)
        if op == "if":
            c = ebv(a[0])
            x, y = common(a[1], a[2])
            return Val(F.when(c.isNull(), F.lit(None)).when(c, x.col).otherwise(y.col), replace(x.info, nullable=True))
        if op == "coalesce":
            xs = unify(a)
            return Val(F.coalesce(*[x.col for x in xs]), replace(xs[0].info, nullable=all(x.info.nullable for x in xs)))
        return self.function(op, a, e)

    def function(self, op: str, a: list[Val], e: t.Call) -> Val:
        string, maybe = replace(STRING, nullable=True), replace(BOOLEAN, nullable=True)
        integer, iri = replace(INTEGER, nullable=True), replace(IRI_INFO, nullable=True)
        s = [text_of(x) for x in a]
        if op == "str":
            return Val(lexical(a[0]), replace(STRING, nullable=a[0].info.nullable))
        if op == "concat":
            return Val(F.concat(*s) if s else F.lit(""), string)
        if op == "strlen":
            return Val(F.char_length(s[0]).cast("bigint"), integer)
        if op in ("ucase", "lcase"):
            return _keeping(a[0], (F.upper if op == "ucase" else F.lower)(s[0]))
        if op in ("contains", "strstarts", "strends"):
            f = {"contains": F.contains, "strstarts": F.startswith, "strends": F.endswith}[op]
            return Val(f(s[0], s[1]), maybe)
        if op == "regex":
            return Val(F.rlike(s[0], flags_pattern(s[1], self._flags(e, 2))), maybe)
        if op == "replace":
            pattern = flags_pattern(s[1], self._flags(e, 3))
            return _keeping(a[0], F.when(~F.rlike(F.lit(""), pattern), F.regexp_replace(s[0], pattern, s[2])))
        if op == "substr":
            return _keeping(a[0], substring_at(s[0], number(a[1]), number(a[2]) if len(a) > 2 else None))
        if op in ("strbefore", "strafter"):
            at = F.position(s[1], s[0])
            if op == "strbefore":
                return _keeping(a[0], F.when(at > 0, F.substring(s[0], F.lit(1), at - 1)).when(at.isNotNull(), F.lit("")))
            return _keeping(a[0], F.when(at > 0, F.substring(s[0], at + F.char_length(s[1]), F.char_length(s[0]))).when(at.isNotNull(), F.lit("")))
        if op == "encode_for_uri":
            return Val(encode_for_uri(s[0]), string)
        if op == "lang":
            if a[0].info.kind == "term":
                return Val(F.when(a[0].col["kind"] == LITERAL, F.coalesce(a[0].col["lang"], F.lit(""))), string)
            return Val(F.when(a[0].col.isNotNull(), F.lit("")) if a[0].info.kind == "lit" else null("string"), string)
        if op == "datatype":
            if a[0].info.kind == "term":
                return Val(F.when(a[0].col["kind"] == LITERAL, a[0].col["dt"]), iri)
            return Val(F.when(a[0].col.isNotNull(), F.lit(a[0].info.dt)) if a[0].info.kind == "lit" else null("string"), iri)
        if op == "langmatches":
            tag, r = F.lower(s[0]), F.lower(s[1])
            return Val(F.when(r == "*", tag != "").otherwise((tag == r) | tag.startswith(F.concat(r, F.lit("-")))), maybe)
        if op == "strdt":
            dt = e.args[1]
            if isinstance(dt, t.IRI) and dt.iri in NATIVE:
                return cast_to(Val(s[0], STRING), dt.iri) if dt.iri == XSD.string else Val(term(LITERAL, s[0], F.lit(dt.iri)), replace(TERM_INFO, nullable=True))
            return Val(term(LITERAL, s[0], lexical(a[1])), replace(TERM_INFO, nullable=True))
        if op == "strlang":
            return Val(F.when(s[1].isNotNull(), term(LITERAL, s[0], F.lit(RDF.langString), F.lower(s[1]))), replace(TERM_INFO, nullable=True))
        if op in ("isiri", "isblank", "isliteral"):
            kind = {"isiri": IRI_KIND, "isblank": BLANK, "isliteral": LITERAL}[op]
            if a[0].info.kind == "term":
                return Val(a[0].col["kind"] == kind, maybe)
            name = {"isiri": "iri", "isblank": "bnode", "isliteral": "lit"}[op]
            return Val(F.when(a[0].col.isNotNull(), F.lit(a[0].info.kind == name)), maybe)
        if op == "isnumeric":
            if a[0].info.kind == "term":
                return Val(F.when(a[0].col.isNotNull(), number(a[0]).isNotNull()), maybe)
            return Val(F.when(a[0].col.isNotNull(), F.lit(a[0].info.numeric)), maybe)
        if op == "iri":
            return a[0] if a[0].info.kind == "iri" else Val(lexical(a[0]), iri)
        if op == "bnode":
            return Val(F.concat(F.lit("b"), F.uuid()), BNODE_INFO)
        if op in ("md5", "sha1", "sha256", "sha384", "sha512"):
            f = {"md5": F.md5, "sha1": F.sha1}.get(op) or (lambda c: F.sha2(c, int(op[3:])))
            return Val(f(s[0]), string)
        if op == "now":
            return Val(F.current_timestamp().cast("timestamp_ntz"), Info("lit", XSD.dateTime))
        if op == "uuid":
            return Val(F.concat(F.lit("urn:uuid:"), F.uuid()), IRI_INFO)
        if op == "struuid":
            return Val(F.uuid(), STRING)
        if op == "rand":
            return Val(F.rand(), DOUBLE)
        if op in _TIME:
            return Val(_TIME[op](moment(a[0])).cast("bigint"), integer)
        if op == "seconds":
            return Val(F.date_format(moment(a[0]), "s.SSSSSS").cast("decimal(38,18)"), replace(DECIMAL, nullable=True))
        if op in ("tz", "timezone"):
            zone = F.regexp_extract(lexical(a[0]), r"(Z|[+-]\d\d:\d\d)$", 1)
            if op == "tz":
                return Val(F.when(moment(a[0]).isNotNull(), zone), string)
            sign = F.when(zone.startswith("-"), F.lit("-")).otherwise(F.lit(""))
            hour, minute = F.substring(zone, 2, 2).try_cast("int"), F.substring(zone, 5, 2).try_cast("int")
            span = F.when(zone == "Z", F.lit("PT0S")).when(zone != "", F.concat(sign, F.lit("PT"), F.when(hour > 0, F.concat(hour.cast("string"), F.lit("H"))).otherwise(F.lit("")), F.when(minute > 0, F.concat(minute.cast("string"), F.lit("M"))).otherwise(F.lit(""))))
            return Val(term(LITERAL, span, F.lit(XSD.dayTimeDuration)), replace(TERM_INFO, nullable=True))
        if op.startswith("<"):
            name = op[1:-1]
            if name in INTEGERS:
                name = str(XSD.integer)
            if name in NATIVE:
                return cast_to(a[0], name)
            from tessera.functions.extension import FUNCTIONS

            if name in FUNCTIONS:
                return FUNCTIONS[name](a)
        raise QueryError("analysis", f"unknown function: {op}")

    @staticmethod
    def _flags(e: t.Call, k: int) -> str:
        if len(e.args) <= k:
            return ""
        if not isinstance(e.args[k], t.Lit):
            raise QueryError("analysis", "regex flags must be a constant")
        return e.args[k].lex


def common(a: Val, b: Val) -> tuple[Val, Val]:
    """Both in one form, for IF, COALESCE and UNION."""
    if a.info.same == b.info.same:
        return a, b
    return lift(a), lift(b)


def unify(xs: list[Val]) -> list[Val]:
    first = xs[0].info.same
    return xs if all(x.info.same == first for x in xs) else [lift(x) for x in xs]
