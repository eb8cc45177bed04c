"""The facade: queries and updates against a catalog, results in several shapes, labels and properties of resources."""

from __future__ import annotations

import json
import re
import threading
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import terms as t
from tessera.builder import Builder
from tessera.errors import QueryError, ValidationError
from tessera.functions import columns as c
from tessera.functions.columns import Val
from tessera.namespaces import FOAF, RDF, RDFS, SCHEMA, XSD
from tessera.operators.updates import UpdateBuilder, run_update
from tessera.parser import parse_query, parse_update
from tessera.plans import algebra as a
from tessera.plans.compiler import Active, Compiler, Rel
from tessera.sources.catalog import Catalog

LABELS = (RDFS.label, FOAF.name, SCHEMA.name, SCHEMA.alternateName)


class Engine:
    def __init__(self, catalog: Catalog, prefixes: dict[str, str] | None = None, timeout: float | None = None):
        self.catalog, self.prefixes, self.timeout = catalog, dict(prefixes or {}), timeout

    @property
    def spark(self) -> SparkSession:
        return self.catalog.spark

    # --- plans (nothing runs, but for closures)
    def algebra(self, q: Any) -> a.Query:
        if isinstance(q, str):
            return parse_query(q)
        return q.query() if isinstance(q, Builder) else q

    def _compiler(self, q: a.Query) -> tuple[Compiler, Active]:
        z = Compiler({**self.prefixes, **dict(q.prefixes)}, q.base)
        active = Active(self.catalog)
        if q.form != "select" and (q.from_ or q.from_named):
            active = replace(active, from_=tuple(z.term(g).iri for g in q.from_), named=tuple(z.term(g).iri for g in q.from_named))
        return z, active

    def solutions(self, q: Any) -> Rel:
        q = self.algebra(q)
        z, active = self._compiler(q)
        return z.query(replace(q, prefixes=()), active)

    def dataframe(self, q: Any) -> DataFrame:
        """Native columns of a SELECT (IRIs as strings, mixed terms as structs); one boolean row of an ASK; (s, p, o)
        terms of CONSTRUCT and DESCRIBE."""
        q = self.algebra(q)
        z, active = self._compiler(q)
        if q.form == "select":
            rel = z.query(replace(q, prefixes=()), active)
            out = []
            for n in rel.vars:
                v = rel.val(n)
                out.append((c.lexical(v) if v.info.kind == "iri" else v.col).alias(n))
            return rel.df.select(*out)
        if q.form == "ask":
            rel = z.group(q.where, active)
            return rel.df.limit(1).agg((F.count(F.lit(1)) > 0).alias("boolean"))
        if q.form == "construct":
            inner = z.query(replace(q, form="select", projection="*", prefixes=(), from_=(), from_named=()), active) if q.order_by or q.limit is not None or q.offset or q.group_by else z.group(q.where, active)
            return z.construct(q.template, inner)
        return z.describe(q, active)

    # --- results
    def execute(self, q: Any, timeout: float | None = None, **_: Any) -> Any:
        """Result as a dict in the JSON form, a bool of ASK, or a list of (s, p, o) terms."""
        q = self.algebra(q)
        if q.form == "ask":
            return self.ask(q, timeout)
        if q.form == "select":
            return self.json(q, timeout)
        return self._run(q, lambda: [(_term(r["s"]), {"type": "uri", "value": r["p"]}, _term(r["o"])) for r in self.dataframe(q).toLocalIterator()], timeout)

    def json(self, q: Any, timeout: float | None = None) -> dict:
        return self._run(q, lambda: self._json(q), timeout)

    def _json(self, q: Any) -> dict:
        rel = self.solutions(q)
        out = [c.lift(rel.val(n)).col.alias(f"v{k}") for k, n in enumerate(rel.vars)]
        rows = rel.df.select(*out).toLocalIterator() if out else [()] * rel.df.count()
        names = list(rel.vars)
        return {"head": {"vars": names}, "results": {"bindings": [{n: _term(x) for n, x in zip(names, r, strict=True) if x is not None} for r in rows]}}

    def query(self, q: Any, timeout: float | None = None) -> list[dict]:
        """Rows of coerced Python values."""
        return transform_results(self.json(q, timeout))

    def ask(self, q: Any, timeout: float | None = None) -> bool:
        return self._run(q, lambda: bool(self.dataframe(q).first()[0]), timeout)

    def first(self, q: Any, timeout: float | None = None) -> dict | None:
        q = self.algebra(q)
        return first(self.query(replace(q, limit=1 if q.limit is None else min(q.limit, 1)), timeout))

    def write_json(self, q: Any, path: str) -> None:
        """Solutions as JSON lines, one object of terms each, written by the executors."""
        rel = self.solutions(q)
        rel.df.select(F.to_json(F.struct(*[c.lift(rel.val(n)).col.alias(n) for n in rel.vars])).alias("value")).write.text(path)

    def update(self, u: Any, timeout: float | None = None) -> None:
        """Runs update text, an UpdateBuilder or operations, in order; each sees what the one before left."""
        ops = parse_update(u) if isinstance(u, str) else u.operations if isinstance(u, UpdateBuilder) else tuple(u)

        def go() -> None:
            for op in ops:
                self.catalog = run_update(self.catalog, op, self.prefixes)

        self._run(u, go, timeout)

    def _run(self, q: Any, f: Any, timeout: float | None) -> Any:
        """f() in a job group that a timer cancels. 0 or None: no limit."""
        limit = self.timeout if timeout is None else timeout
        sc = self.spark.sparkContext
        late, done = threading.Event(), threading.Event()
        timer = None
        group = f"tessera-{uuid.uuid4().hex}"
        if limit:
            sc.setJobGroup(group, "query")

            def stop() -> None:  # again and again: the job may not have begun when the time is up
                late.set()
                sc.cancelJobGroup(group)
                while not done.wait(1):
                    sc.cancelJobGroup(group)

            timer = threading.Timer(limit, stop)
            timer.daemon = True
            timer.start()
        try:
            return f()
        except (QueryError, ValidationError):
            raise
        except Exception as e:
            if late.is_set():
                raise QueryError("timeout", f"stopped after {limit} s", q, e) from e
            kind = "abort" if "cancelled" in str(e).lower() else "execution"
            raise QueryError(kind, str(e).splitlines()[0] if str(e) else type(e).__name__, q, e) from e
        finally:
            done.set()
            if timer:
                timer.cancel()
                sc.setLocalProperty("spark.jobGroup.id", None)

    def abort(self) -> None:
        self.spark.sparkContext.cancelAllJobs()

    # --- labels and properties
    def _given(self, uris: Iterable[str] | DataFrame) -> DataFrame:
        if isinstance(uris, DataFrame):
            return uris
        return self.spark.createDataFrame([(k, u) for k, u in enumerate(uris)], "position long, uri string")

    def _statements(self, predicates: list[str]) -> DataFrame:
        """(uri, p, value) of the given predicates."""
        z = Compiler(self.prefixes)
        parts = []
        for p in predicates:
            rel = z.bgp([a.Triple(t.Var("s"), t.IRI(p), t.Var("o"))], Active(self.catalog))
            parts.append(rel.df.select(c.lexical(rel.val("s")).alias("uri"), F.lit(p).alias("p"), c.lexical(rel.val("o")).alias("value")))
        out = parts[0]
        for x in parts[1:]:
            out = out.unionByName(x)
        return out

    def _iri(self, p: str) -> str:
        x = Compiler(self.prefixes).term(t.prefixed(p) if ":" in p and "://" not in p and not p.startswith("urn:") else t.iri(p))
        return x.iri

    def labels_df(self, uris: Any, predicates: Iterable[str] = LABELS) -> DataFrame:
        """(uri, label): the first label that is not empty, in the order of the predicates. One join."""
        predicates = [self._iri(p) for p in predicates]
        found = self._statements(predicates).filter("value <> ''")
        rank = F.element_at(F.create_map(*[x for k, p in enumerate(predicates) for x in (F.lit(p), F.lit(k))]), F.col("p"))
        given = self._given(uris).select("uri").distinct()
        return found.join(given, "uri", "left_semi").groupBy("uri").agg(F.min(F.struct(rank.alias("k"), "value"))["value"].alias("label"))

    def resolve_labels(self, uris: Iterable[str], predicates: Iterable[str] = LABELS) -> dict[str, str]:
        return {r["uri"]: r["label"] for r in self.labels_df(list(uris), predicates).toLocalIterator()}

    def properties_df(self, uris: Any, properties: dict[str, str]) -> DataFrame:
        """One row for each uri that has a property, a column for each name (of several values the greatest)."""
        iris = {self._iri(p): name for name, p in properties.items()}
        given = self._given(uris).select("uri").distinct()
        found = self._statements(list(iris)).join(given, "uri", "left_semi")
        return found.groupBy("uri").agg(*[F.max(F.when(F.col("p") == p, F.col("value"))).alias(n) for p, n in iris.items()])

    def fetch_properties(self, uris: Iterable[str], properties: dict[str, str]) -> dict[str, dict[str, str]]:
        return {r["uri"]: {n: r[n] for n in properties if r[n] is not None} for r in self.properties_df(list(uris), properties).toLocalIterator()}

    def expand_df(self, uris: Any, properties: dict[str, str] | None = None, predicates: Iterable[str] = LABELS, mode: str = "all") -> DataFrame:
        """uri, label and the properties of each uri; mode "with_data" leaves out those that have none."""
        out = self._given(uris)
        out = out.join(self.labels_df(out, predicates), "uri", "left")
        names = list(properties or {})
        if names:
            out = out.join(self.properties_df(out, properties), "uri", "left")
        if mode in ("with_data", "withData"):
            out = out.filter(F.coalesce("label", *names).isNotNull())
        return out

    def expand(self, uris: Iterable[str], properties: dict[str, str] | None = None, predicates: Iterable[str] = LABELS, mode: str = "all") -> list[dict]:
        names = list(properties or {})
        rows = self.expand_df(list(uris), properties, predicates, mode).orderBy("position").toLocalIterator()
        return [{"uri": r["uri"], "label": r["label"], "properties": {n: r[n] for n in names if r[n] is not None}} for r in rows]


def _term(x: Any) -> dict:
    """JSON form of a term struct."""
    if x["kind"] == c.IRI_KIND:
        return {"type": "uri", "value": x["lex"]}
    if x["kind"] == c.BLANK:
        return {"type": "bnode", "value": x["lex"]}
    out = {"type": "literal", "value": x["lex"]}
    if x["lang"]:
        out["xml:lang"] = x["lang"]
    elif x["dt"] and x["dt"] != XSD.string:
        out["datatype"] = x["dt"]
    return out


# --- decoding ------------------------------------------------------------------------------------------


def coerce_value(x: dict) -> Any:
    """Python value of a term; the raw string where its datatype has none or it is ill-formed."""
    import datetime as dt

    s, d = x["value"], x.get("datatype")
    if x["type"] != "literal" and x["type"] != "typed-literal" or not d:
        return s
    try:
        if d == XSD.boolean:
            return s in ("true", "1")
        if d in c.INTEGERS:
            return int(s)
        if d in (XSD.decimal, XSD.double, XSD.float):
            return float(s.replace("INF", "inf"))
        if d == XSD.date:
            return dt.date.fromisoformat(s[:10])
        if d in (XSD.dateTime, XSD.dateTimeStamp):
            return dt.datetime.fromisoformat(s)
        if d == RDF.JSON:
            return json.loads(s)
    except ValueError:
        return s
    return s


def parse_binding(b: dict) -> dict:
    return {k: coerce_value(x) for k, x in b.items()}


def transform_results(result: dict) -> list[dict]:
    if not isinstance(result, dict) or "results" not in result or "bindings" not in result["results"]:
        raise QueryError("protocol", "not a result of a SELECT")
    return [parse_binding(b) for b in result["results"]["bindings"]]


def ask_result(result: dict) -> bool:
    if not isinstance(result, dict) or "boolean" not in result:
        raise QueryError("protocol", "not a result of an ASK")
    return bool(result["boolean"])


def pluck(rows: list[dict], name: str) -> list:
    return [r.get(name) for r in rows]


def first(rows: list) -> Any:
    return rows[0] if rows else None


def iter_rows(df: DataFrame) -> Iterator[dict]:
    for r in df.toLocalIterator():
        yield r.asDict(recursive=True)


def local_name(iri: str) -> str:
    return re.split(r"[#/]", iri)[-1]


__all__ = ["Engine", "Val", "ask_result", "coerce_value", "first", "parse_binding", "pluck", "transform_results"]
