"""Registered queries over the mapped tables, each with its oracle SQL: one for each operator of the inventory."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import builder as b
from tessera import patterns as p
from tessera import terms as x
from tessera.engine import Engine
from tessera.functions import columns as c
from tessera.functions.columns import TERM
from tessera.plans.compiler import Active, Compiler
from tessera.sources.catalog import Catalog
from tessera.sources.tables import DATA, PREFIXES, T, tables_catalog
from tessera.terms import v

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def engine(spark: SparkSession, sf_dir: str, **k: Any) -> Engine:
    return Engine(tables_catalog(spark, sf_dir, **k), PREFIXES)


def add(name: str, make: Callable[[], Any] | str, sql: str | None = None, after: Callable[[DataFrame], DataFrame] | None = None, **k: Any) -> None:
    """Register a query given as a builder (a function that makes one) or as text."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = engine(spark, sf_dir, **k).dataframe(make() if callable(make) else make)
        return after(df) if after else df

    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def plain(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


T_ = p.triples
select = b.select

# --- basic graph patterns
add("bgp_star", lambda: select(["?name", "?bal", "?seg"]).where(T_("?c", {"t:c_name": v("name"), "t:c_acctbal": v("bal"), "t:c_mktsegment": v("seg")})), "select c_name as name, c_acctbal as bal, c_mktsegment as seg from customer")
add("bgp_const_object", lambda: select(["?name"]).where(T_("?c", [("t:c_mktsegment", "BUILDING"), ("t:c_name", "?name")])), "select c_name as name from customer where c_mktsegment = 'BUILDING'")
add("bgp_const_subject", 'SELECT ?p ?o WHERE { <http://example.org/data/nation/7> t:n_name ?o . BIND("name" AS ?p) }', "select 'name' as p, n_name as o from nation where n_nationkey = 7")
add("repeated_var", "SELECT ?k WHERE { ?n t:n_nationkey ?k ; t:n_regionkey ?k }", "select n_nationkey::bigint as k from nation where n_nationkey = n_regionkey")
add("fk_path_join", "SELECT ?ok ?cn ?nn WHERE { ?o t:o_orderkey ?ok ; t:customer ?c . ?c t:c_name ?cn ; t:c_nation ?n . ?n t:n_name ?nn }", "select o_orderkey as ok, c_name as cn, n_name as nn from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey")
add(
    "node_nested",
    lambda: select(["?ok", "?cn", "?nn"]).where(p.node("o", "t:Order", {"t:o_orderkey": v("ok"), "t:customer": p.node("c", "t:Customer", {"t:c_name": v("cn"), "t:c_nation": p.node("n").prop("t:n_name", v("nn"))})})),
    "select o_orderkey as ok, c_name as cn, n_name as nn from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey",
)
add("cypher_edge", lambda: select(["?ok", "?ck"]).where(p.cypher("{c}<-[t:customer]-{o}", c=p.node("c").prop("t:c_custkey", v("ck")), o=p.node("o").prop("t:o_orderkey", v("ok")))), "select o_orderkey as ok, c_custkey as ck from orders join customer on o_custkey = c_custkey")
add("cypher_chain", lambda: select(["?ok", "?nn"]).where(p.cypher("{o}-[t:customer]->{c}-[t:c_nation]->{n}", o=p.node("o").prop("t:o_orderkey", v("ok")), c=p.node("c"), n=p.node("n").prop("t:n_name", v("nn")))), "select o_orderkey as ok, n_name as nn from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey")
add("rel_match", lambda: select(["?nn", "?rn"]).where(p.match(p.rel("n", "t:region", "r"), p.triple("?n", "t:n_name", "?nn"), p.triple("?r", "t:r_name", "?rn"))), "select n_name as nn, r_name as rn from nation join region on n_regionkey = r_regionkey")
add("bnode_pattern", "SELECT ?cn WHERE { ?c t:c_name ?cn ; t:c_nation [ t:n_name ?nn ; t:region [ t:r_name 'ASIA' ] ] }", "select c_name as cn from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name = 'ASIA'")
add("type_scan", "SELECT ?k WHERE { ?s a t:Region ; t:r_regionkey ?k }", "select r_regionkey::bigint as k from region")
add("var_predicate", "SELECT ?p ?o WHERE { ?s a t:Region ; ?p ?o }", "with r as (select * from region) select 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' as p, 'http://example.org/tables#Region' as o from r union all select 'http://example.org/tables#r_regionkey', r_regionkey::varchar from r union all select 'http://example.org/tables#r_name', r_name from r union all select 'http://www.w3.org/2000/01/rdf-schema#label', r_name from r", after=lambda df: df.select("p", F.col("o.lex").alias("o")))
add("iri_projection", "SELECT ?n ?r WHERE { ?n t:region ?r }", f"select '{DATA}nation/' || n_nationkey as n, '{DATA}region/' || n_regionkey as r from nation")

# --- filters
add("filter_compare", lambda: select(["?ok", "?q"]).where(T_("?l", {"t:l_orderkey": v("ok"), "t:l_quantity": v("q")})).filter(v("q").between(10, 20)), "select l_orderkey as ok, l_quantity as q from lineitem where l_quantity between 10 and 20")
add("filter_logic", lambda: select(["?k"]).where(T_("?o", {"t:o_orderkey": v("k"), "t:o_orderstatus": v("s"), "t:o_totalprice": v("tp")})).filter(v("s").eq("F").and_(v("tp").gt(100000)).or_(v("tp").lt(5000).not_().not_())), "select o_orderkey as k from orders where (o_orderstatus = 'F' and o_totalprice > 100000) or o_totalprice < 5000")
add("filter_in", lambda: select(["?k"]).where(T_("?o", {"t:o_orderkey": v("k"), "t:o_orderpriority": v("pr")})).filter(v("pr").in_list(["1-URGENT", "2-HIGH"])), "select o_orderkey as k from orders where o_orderpriority in ('1-URGENT', '2-HIGH')")
add("filter_not_in", lambda: select(["?k"]).where(T_("?o", {"t:o_orderkey": v("k"), "t:o_orderpriority": v("pr")})).filter(v("pr").not_in_list("1-URGENT", "2-HIGH")), "select o_orderkey as k from orders where o_orderpriority not in ('1-URGENT', '2-HIGH')")
add("filter_date", 'SELECT ?k WHERE { ?o t:o_orderkey ?k ; t:o_orderdate ?d FILTER(?d >= "1996-01-01T00:00:00"^^xsd:dateTime && YEAR(?d) = 1996 && MONTH(?d) <= 6) }', "select o_orderkey as k from orders where o_orderdate >= timestamp '1996-01-01' and year(o_orderdate) = 1996 and month(o_orderdate) <= 6")
add("filter_ebv", "SELECT ?k WHERE { ?p t:p_partkey ?k ; t:p_size ?s FILTER(?s - 10) }", "select p_partkey as k from part where p_size <> 10")
add("filter_scope", "SELECT ?k WHERE { FILTER(?b > 9000) ?c t:c_custkey ?k ; t:c_acctbal ?b }", "select c_custkey as k from customer where c_acctbal > 9000")

# --- joins
add("theta_self_join", "SELECT ?a ?b WHERE { ?x t:s_suppkey ?a ; t:s_nation ?n . ?y t:s_suppkey ?b ; t:s_nation ?n FILTER(?a < ?b) }", "select x.s_suppkey as a, y.s_suppkey as b from supplier x join supplier y on x.s_nationkey = y.s_nationkey and x.s_suppkey < y.s_suppkey")
add("cross_values", lambda: select(["?n", "?a", "?b"]).values("a", [1, 2]).values("b", ["x", "y", "z"]).where(p.triple("?s", "t:n_name", "?n")), "select n_name as n, a::bigint as a, b from nation, (values (1), (2)) t(a), (values ('x'), ('y'), ('z')) u(b)")
add("values_restrict", lambda: select(["?k", "?seg"]).values("seg", ["BUILDING", "MACHINERY"]).where(T_("?c", {"t:c_custkey": v("k"), "t:c_mktsegment": v("seg")})), "select c_custkey as k, c_mktsegment as seg from customer where c_mktsegment in ('BUILDING', 'MACHINERY')")
add("values_undef", "SELECT ?k ?seg ?w WHERE { ?c t:c_custkey ?k ; t:c_mktsegment ?seg VALUES (?seg ?w) { ('BUILDING' 1) (UNDEF 2) } }", "select c_custkey as k, c_mktsegment as seg, 1::bigint as w from customer where c_mktsegment = 'BUILDING' union all select c_custkey, c_mktsegment, 2 from customer")
add("optional_label", "SELECT ?id ?q WHERE { ?d t:doc_id ?id OPTIONAL { ?l t:document ?d ; t:quality ?q } }", "select d.doc_id as id, quality::bigint as q from documents d left join labels l on l.doc_id = d.doc_id")
add("optional_filter", "SELECT ?id ?q WHERE { ?d t:doc_id ?id ; t:n_chars ?n OPTIONAL { ?l t:document ?d ; t:quality ?q FILTER(?q = 1 && ?n > 1000) } }", "select d.doc_id as id, quality::bigint as q from documents d left join labels l on l.doc_id = d.doc_id and quality = 1 and n_chars > 1000")
add("optional_same_row", lambda: select(["?k", "?n", "?s"]).where(p.triple("?p", "t:p_partkey", "?k")).optional(p.triple("?p", "t:p_name", "?n")).optional(p.triple("?p", "t:p_size", "?s")), "select p_partkey as k, p_name as n, p_size::bigint as s from part")
add("optional_chain", "SELECT ?id (COALESCE(?q, ?x, -1) AS ?r) WHERE { ?d t:doc_id ?id OPTIONAL { ?l t:document ?d ; t:quality ?q FILTER(?q = 1) } OPTIONAL { ?m t:document ?d ; t:toxic ?x } }", "select d.doc_id as id, coalesce(l.quality, m.toxic, -1)::bigint as r from documents d left join labels l on l.doc_id = d.doc_id and l.quality = 1 left join labels m on m.doc_id = d.doc_id")
add("join_on_optional", "SELECT ?id ?q ?z WHERE { ?d t:doc_id ?id OPTIONAL { ?l t:document ?d ; t:quality ?q } { SELECT ?q ?z WHERE { VALUES (?q ?z) { (0 'no') (1 'yes') } } } }", "with x as (select d.doc_id as id, quality::bigint as q from documents d left join labels l on l.doc_id = d.doc_id) select id, v.q, z from x join (values (0::bigint, 'no'), (1::bigint, 'yes')) v(q, z) on x.q = v.q or x.q is null")
add("minus_labels", "SELECT ?id WHERE { ?d t:doc_id ?id MINUS { ?l t:document ?d } }", "select doc_id as id from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
add("minus_lineitem", "SELECT ?k ?n WHERE { ?l t:l_quantity 5 ; t:l_orderkey ?k ; t:l_linenumber ?n MINUS { ?l t:l_returnflag 'A' } }", "select l_orderkey as k, l_linenumber::bigint as n from lineitem where l_quantity = 5 and l_returnflag <> 'A'")
add("not_exists_lineitem", "SELECT ?k ?q WHERE { ?l t:l_orderkey ?k ; t:l_quantity ?q FILTER(?q < 10) FILTER NOT EXISTS { ?l t:l_discount 0.05 } }", "select l_orderkey as k, l_quantity as q from lineitem where l_quantity < 10 and l_discount <> 0.05")
add("optional_lineitem", "SELECT ?k ?d WHERE { ?l t:l_returnflag 'R' ; t:l_orderkey ?k OPTIONAL { ?l t:l_linestatus 'F' ; t:l_discount ?d } }", "select l_orderkey as k, case when l_linestatus = 'F' then l_discount end as d from lineitem where l_returnflag = 'R'")
add("optional_on_optional", "SELECT ?id ?q ?z WHERE { ?d t:doc_id ?id OPTIONAL { ?l t:document ?d ; t:quality ?q } OPTIONAL { ?r t:r_regionkey ?q ; t:r_name ?z } }", "select d.doc_id as id, coalesce(l.quality, r.r_regionkey)::bigint as q, r_name as z from documents d left join labels l on l.doc_id = d.doc_id left join region r on l.quality is null or r.r_regionkey = l.quality")
add("minus_on_optional", "SELECT ?id ?q WHERE { ?d t:doc_id ?id OPTIONAL { ?l t:document ?d ; t:quality ?q } MINUS { ?r t:r_regionkey ?q FILTER(?q > 0) } }", "select d.doc_id as id, quality::bigint as q from documents d left join labels l on l.doc_id = d.doc_id where quality is null or quality not in (select r_regionkey from region where r_regionkey > 0)")
add("not_exists_on_optional", "SELECT ?id ?q WHERE { ?d t:doc_id ?id OPTIONAL { ?l t:document ?d ; t:quality ?q } FILTER NOT EXISTS { ?r t:r_regionkey ?q FILTER(?q > 0) } }", "select d.doc_id as id, quality::bigint as q from documents d join labels l on l.doc_id = d.doc_id where quality not in (select r_regionkey from region where r_regionkey > 0)")
add("minus_disjoint", "SELECT ?k WHERE { ?n t:n_nationkey ?k MINUS { ?r t:r_regionkey ?z } }", "select n_nationkey::bigint as k from nation")
add("exists", "SELECT ?k WHERE { ?c t:c_custkey ?k FILTER EXISTS { ?o t:customer ?c ; t:o_totalprice ?tp FILTER(?tp > 400000) } }", "select c_custkey as k from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 400000)")
add("not_exists", "SELECT ?k WHERE { ?c t:c_custkey ?k FILTER NOT EXISTS { ?o t:customer ?c ; t:o_totalprice ?tp FILTER(?tp > 400000) } }", "select c_custkey as k from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 400000)")
add("exists_outer", "SELECT ?k WHERE { ?c t:c_custkey ?k ; t:c_acctbal ?b FILTER EXISTS { ?o t:customer ?c ; t:o_totalprice ?tp FILTER(?tp > ?b * 50) } }", "select c_custkey as k from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > c_acctbal * 50)")
add("not_exists_disjoint", "SELECT ?k WHERE { ?n t:n_nationkey ?k FILTER NOT EXISTS { ?r t:r_name 'NOWHERE' } }", "select n_nationkey::bigint as k from nation")
add("exists_or", "SELECT ?id WHERE { ?d t:doc_id ?id ; t:n_chars ?n FILTER(?n < 300 || EXISTS { ?l t:document ?d }) }", "select doc_id as id from documents d where n_chars < 300 or exists (select 1 from labels l where l.doc_id = d.doc_id)")

# --- union
add("union_names", lambda: select(["?n"]).union(p.triple("?c", "t:c_name", "?n"), p.triple("?s", "t:s_name", "?n")), "select c_name as n from customer union all select s_name from supplier")
add("union_missing", "SELECT ?n ?b WHERE { { ?x t:n_name ?n } UNION { ?y t:r_name ?n . ?y t:r_regionkey ?b } }", "select n_name as n, null::bigint as b from nation union all select r_name, r_regionkey::bigint from region")

# --- bind and functions
add("bind_arith", "SELECT ?k ?net ?ratio ?zero WHERE { ?l t:l_orderkey ?k ; t:l_extendedprice ?e ; t:l_discount ?d ; t:l_quantity ?q BIND(?e * (1 - ?d) AS ?net) BIND(?e / ?q AS ?ratio) BIND(?k / 0 AS ?zero) }", "select l_orderkey as k, l_extendedprice * (1 - l_discount) as net, l_extendedprice / l_quantity as ratio, null::decimal(38,18) as zero from lineitem")
add("if_coalesce", "SELECT ?k (IF(?s < 10, 'small', IF(?s < 30, 'middle', 'large')) AS ?c) (COALESCE(?none, ?s) AS ?d) WHERE { ?p t:p_partkey ?k ; t:p_size ?s }", "select p_partkey as k, case when p_size < 10 then 'small' when p_size < 30 then 'middle' else 'large' end as c, p_size::bigint as d from part", after=lambda df: df.select("k", "c", F.col("d.lex").cast("bigint").alias("d")) if "struct" in dict(df.dtypes)["d"] else df)
add("math_funcs", "SELECT ?k (ABS(?b) AS ?a) (CEIL(?b) AS ?c) (FLOOR(?b) AS ?f) (ROUND(?b) AS ?r) (?k % 7 AS ?m) (-?k AS ?neg) WHERE { ?x t:c_custkey ?k ; t:c_acctbal ?b }", "select c_custkey as k, abs(c_acctbal) as a, ceil(c_acctbal) as c, floor(c_acctbal) as f, floor(c_acctbal + 0.5) as r, c_custkey % 7 as m, -c_custkey as neg from customer")
add("string_funcs", "SELECT ?k (CONCAT(?n, '-', STR(?k)) AS ?cat) (UCASE(?n) AS ?u) (LCASE(?n) AS ?l) (STRLEN(?n) AS ?len) (SUBSTR(?n, 3, 4) AS ?sub) (SUBSTR(?n, 0, 2) AS ?s0) (CONTAINS(?n, 'a') AS ?has) (STRSTARTS(?n, 'C') AS ?st) (STRENDS(?n, '1') AS ?en) WHERE { ?x t:c_custkey ?k ; t:c_name ?n }", "select c_custkey as k, c_name || '-' || c_custkey as cat, upper(c_name) as u, lower(c_name) as l, length(c_name) as len, substr(c_name, 3, 4) as sub, substr(c_name, 1, 1) as s0, contains(c_name, 'a') as has, starts_with(c_name, 'C') as st, ends_with(c_name, '1') as en from customer")
add("str_before_after", "SELECT ?k (STRBEFORE(?n, '#') AS ?b) (STRAFTER(?n, '#') AS ?a) (STRBEFORE(?n, '~') AS ?mb) (STRAFTER(?n, '~') AS ?ma) (STRAFTER(?n, '') AS ?all) WHERE { ?x t:c_custkey ?k ; t:c_name ?n }", "select c_custkey as k, case when strpos(c_name, '#') > 0 then left(c_name, strpos(c_name, '#') - 1) else '' end as b, case when strpos(c_name, '#') > 0 then substr(c_name, strpos(c_name, '#') + 1) else '' end as a, '' as mb, '' as ma, c_name as \"all\" from customer")
add("regex_flags", "SELECT ?k WHERE { ?p t:p_partkey ?k ; t:p_name ?n FILTER REGEX(?n, '^[A-M].*1', 'i') }", "select p_partkey as k from part where regexp_matches(p_name, '(?i)^[A-M].*1')")
add("replace", "SELECT ?k (REPLACE(?n, '[aeiou]', '_') AS ?r) WHERE { ?p t:p_partkey ?k ; t:p_name ?n }", "select p_partkey as k, regexp_replace(p_name, '[aeiou]', '_', 'g') as r from part")
add("encode_uri", "SELECT ?k (ENCODE_FOR_URI(CONCAT(?n, ' /~*é')) AS ?e) WHERE { ?p t:p_partkey ?k ; t:p_name ?n }", "select p_partkey as k, url_encode(p_name || ' /~*é') as e from part")
add("hashes", "SELECT ?k (MD5(?n) AS ?a) (SHA1(?n) AS ?b) (SHA256(?n) AS ?c) WHERE { ?x t:n_nationkey ?k ; t:n_name ?n }", "select n_nationkey::bigint as k, md5(n_name) as a, sha1(n_name) as b, sha256(n_name) as c from nation")
add("hashes_long", "SELECT ?k (SHA384(?n) AS ?a) (SHA512(?n) AS ?b) WHERE { ?x t:n_nationkey ?k ; t:n_name ?n }")
add("iri_func", "SELECT ?k ?same (IRI(CONCAT('http://example.org/n/', STR(?k))) AS ?i) (ISIRI(URI('http://example.org/x')) AS ?yes) WHERE { ?x t:n_nationkey ?k ; t:n_name ?n BIND(IRI(STR(?x)) = ?x AS ?same) }", "select n_nationkey::bigint as k, true as same, 'http://example.org/n/' || n_nationkey as i, true as yes from nation")
add("bnode_func", "SELECT (COUNT(DISTINCT ?b) AS ?n) (SUM(IF(ISBLANK(?b), 1, 0)) AS ?blank) WHERE { ?x t:n_name ?name BIND(BNODE() AS ?b) }", "select count(*) as n, count(*)::bigint as blank from nation")
add("type_checks", "SELECT ?k (ISIRI(?x) AS ?i) (ISLITERAL(?n) AS ?l) (ISBLANK(?x) AS ?b) (ISNUMERIC(?k) AS ?num) (DATATYPE(?k) AS ?d) (LANG(?n) AS ?g) (BOUND(?none) AS ?nb) (SAMETERM(?k, ?k) AS ?same) WHERE { ?x t:n_nationkey ?k ; t:n_name ?n }", "select n_nationkey::bigint as k, true as i, true as l, false as b, true as num, 'http://www.w3.org/2001/XMLSchema#integer' as d, '' as g, false as nb, true as same from nation")
add("casts", "SELECT ?k (xsd:string(?k) AS ?s) (xsd:double(?k) AS ?d) (xsd:integer(?b) AS ?i) (xsd:boolean(?k) AS ?z) (xsd:integer(?n) AS ?bad) WHERE { ?x t:c_custkey ?k ; t:c_acctbal ?b ; t:c_name ?n }", "select c_custkey as k, c_custkey::varchar as s, c_custkey::double as d, trunc(c_acctbal)::bigint as i, c_custkey <> 0 as z, null::bigint as bad from customer")
add("lang_funcs", "SELECT ?k (LANG(?s) AS ?g) (LANGMATCHES(LANG(?s), 'en') AS ?m) (STR(?s) AS ?x) WHERE { ?n t:n_nationkey ?k ; t:n_name ?a BIND(STRLANG(?a, 'en-GB') AS ?s) }", "select n_nationkey::bigint as k, 'en-gb' as g, true as m, n_name as x from nation")
add("date_parts", "SELECT ?k (YEAR(?d) AS ?y) (MONTH(?d) AS ?m) (DAY(?d) AS ?dd) (HOURS(?d) AS ?h) WHERE { ?o t:o_orderkey ?k ; t:o_orderdate ?d }", "select o_orderkey as k, year(o_orderdate) as y, month(o_orderdate) as m, day(o_orderdate) as dd, hour(o_orderdate) as h from orders")
add("now_uuid_rand", "SELECT (COUNT(?u) AS ?n) (COUNT(DISTINCT ?u) AS ?d) WHERE { ?x t:n_name ?n0 BIND(UUID() AS ?u) BIND(STRUUID() AS ?s) BIND(RAND() AS ?r) BIND(NOW() AS ?w) FILTER(?r >= 0 && ?r < 1 && STRLEN(?s) = 36 && BOUND(?w)) }")

# --- aggregates
add("agg_basic", "SELECT ?rf ?ls (SUM(?q) AS ?sum_qty) (SUM(?e) AS ?sum_base) (AVG(?q) AS ?avg_qty) (MIN(?e) AS ?lo) (MAX(?e) AS ?hi) (COUNT(*) AS ?n) WHERE { ?l t:l_returnflag ?rf ; t:l_linestatus ?ls ; t:l_quantity ?q ; t:l_extendedprice ?e } GROUP BY ?rf ?ls", "select l_returnflag as rf, l_linestatus as ls, sum(l_quantity) as sum_qty, round(sum(l_extendedprice), 2) as sum_base, round(avg(l_quantity), 6) as avg_qty, min(l_extendedprice) as lo, max(l_extendedprice) as hi, count(*) as n from lineitem group by all", after=lambda df: df.withColumn("sum_base", F.round("sum_base", 2)).withColumn("avg_qty", F.round("avg_qty", 6)))
add("agg_distinct", lambda: select([v("s"), x.count_distinct("?c").as_("n")]).where(T_("?o", {"t:o_orderstatus": v("s"), "t:customer": v("c")})).group_by("?s"), "select o_orderstatus as s, count(distinct o_custkey) as n from orders group by all")
add("avg_exact", "SELECT ?r (AVG(xsd:decimal(?k) / 8) AS ?a) (AVG(?k) AS ?b) WHERE { ?n t:n_nationkey ?k ; t:n_regionkey ?r } GROUP BY ?r", "select n_regionkey::bigint as r, avg(n_nationkey) / 8 as a, avg(n_nationkey) as b from nation group by all", after=lambda df: df.withColumns({n: F.col(n).cast("double") for n in ("a", "b")}))
add("agg_empty", "SELECT (COUNT(*) AS ?n) (SUM(?k) AS ?s) (AVG(?b) AS ?a) (MIN(?k) AS ?lo) WHERE { ?c t:c_custkey ?k ; t:c_acctbal ?b FILTER(false) }", "select 0::bigint as n, 0::bigint as s, 0.0::double as a, null::bigint as lo")
add("group_concat", lambda: select([v("r"), x.group_concat("?n", ", ").as_("names")]).where("?a t:n_name ?n ; t:region ?b . ?b t:r_name ?r").group_by("?r"), "select r_name as r, string_agg(n_name, ', ' order by n_name) as names from nation join region on n_regionkey = r_regionkey group by all")
add("sample", "SELECT ?r (SAMPLE(?n) AS ?one) WHERE { ?a t:n_name ?n ; t:region ?b . ?b t:r_name ?r } GROUP BY ?r", "select r_name as r, min(n_name) as one from nation join region on n_regionkey = r_regionkey group by all")
add("having", lambda: select([v("n"), x.count().as_("c")]).where("?s t:c_nation ?a . ?a t:n_name ?n").group_by("?n").having(x.count().gte(60)), "select n_name as n, count(*) as c from customer join nation on c_nationkey = n_nationkey group by all having count(*) >= 60")
add("group_expr", "SELECT ?y (COUNT(*) AS ?n) WHERE { ?o t:o_orderdate ?d } GROUP BY (YEAR(?d) AS ?y)", "select year(o_orderdate) as y, count(*) as n from orders group by all")
add("group_unbound", "SELECT ?q (COUNT(*) AS ?n) WHERE { ?d t:doc_id ?id OPTIONAL { ?l t:document ?d ; t:quality ?q } } GROUP BY ?q", "select quality::bigint as q, count(*) as n from documents d left join labels l on l.doc_id = d.doc_id group by all")
add("distinct", lambda: select(["?s"]).where(p.triple("?c", "t:c_mktsegment", "?s")).distinct(), "select distinct c_mktsegment as s from customer")
add("reduced", lambda: select(["?s"]).where(p.triple("?c", "t:c_mktsegment", "?s")).reduced(), "select c_mktsegment as s from customer")
add("order_limit_offset", "SELECT ?k ?b WHERE { ?c t:c_custkey ?k ; t:c_acctbal ?b } ORDER BY DESC(?b) ?k LIMIT 20 OFFSET 5", "select c_custkey as k, c_acctbal as b from customer order by c_acctbal desc nulls last, c_custkey limit 20 offset 5")
add("order_unbound", "SELECT ?id ?q WHERE { ?d t:doc_id ?id OPTIONAL { ?l t:document ?d ; t:quality ?q } } ORDER BY ?q ?id LIMIT 50", "select d.doc_id as id, quality::bigint as q from documents d left join labels l on l.doc_id = d.doc_id order by quality nulls first, id limit 50")
add("subquery_topk", "SELECT ?k ?n ?tp WHERE { { SELECT ?c (SUM(?p) AS ?tp) WHERE { ?o t:customer ?c ; t:o_totalprice ?p } GROUP BY ?c ORDER BY DESC(?tp) ?c LIMIT 10 } ?c t:c_custkey ?k ; t:c_name ?n }", "with s as (select o_custkey, sum(o_totalprice) as tp from orders group by o_custkey order by tp desc, o_custkey limit 10) select c_custkey as k, c_name as n, round(tp, 2) as tp from s join customer on c_custkey = o_custkey", after=lambda df: df.withColumn("tp", F.round("tp", 2)))
add("flagship_revenue", "SELECT ?nn (SUM(?e * (1 - ?d)) AS ?revenue) WHERE { ?l t:l_extendedprice ?e ; t:l_discount ?d ; t:order ?o . ?o t:customer ?c . ?c t:c_nation ?n . ?n t:n_name ?nn } GROUP BY ?nn ORDER BY DESC(?revenue) ?nn LIMIT 10", "select n_name as nn, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by all order by revenue desc, nn limit 10", after=lambda df: df.withColumn("revenue", F.round("revenue", 2)))

# --- paths
add("path_seq", lambda: select(["?cn", "?rn"]).where(p.triple("?c", "t:c_name", "?cn"), p.triple("?c", p.sequence("t:c_nation", "t:region", "t:r_name"), "?rn")), "select c_name as cn, r_name as rn from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
add("path_alt", "SELECT ?n WHERE { ?x t:n_name|t:r_name ?n }", "select n_name as n from nation union all select r_name from region")
add("path_inv", "SELECT ?rn ?nn WHERE { ?r t:r_name ?rn ; ^t:region ?n . ?n t:n_name ?nn }", "select r_name as rn, n_name as nn from region join nation on n_regionkey = r_regionkey")
add("path_opt", "SELECT ?nk ?y WHERE { ?n t:n_nationkey ?nk ; t:region? ?y }", f"select n_nationkey::bigint as nk, '{DATA}nation/' || n_nationkey as y from nation union all select n_nationkey, '{DATA}region/' || n_regionkey from nation", after=lambda df: df.select("nk", F.col("y.lex").alias("y")) if "struct" in dict(df.dtypes)["y"] else df)
add("path_negated", "SELECT ?p ?o WHERE { ?n a t:Nation ; t:n_nationkey ?p ; !(t:n_name|rdfs:label|rdf:type) ?o }", f"select n_nationkey::bigint as p, n_nationkey::varchar as o from nation union all select n_nationkey, n_regionkey::varchar from nation union all select n_nationkey, '{DATA}region/' || n_regionkey from nation", after=lambda df: df.select("p", F.col("o.lex").alias("o")))


def _edges(spark: SparkSession, sf_dir: str, table: str, key: str, target: str) -> Engine:
    """A catalog with one more class: nodes of a key with an edge `t:next`."""
    from tessera.sources.catalog import ClassMap, Ref

    cat = tables_catalog(spark, sf_dir)
    cat.tables["edges"] = cat.table(table).select(F.col(key).cast("bigint").alias("id"), F.expr(target).alias("next"))
    cat.maps.append(ClassMap(T.NodeOfEdge, "edges", f"{DATA}node/", "id", {T.id: "id", T.next: Ref("next", f"{DATA}node/")}))
    return Engine(cat, PREFIXES)


def _numbers(df: DataFrame) -> DataFrame:
    return df.select(*[F.regexp_extract(n, r"(\d+)$", 1).cast("bigint").alias(n) for n in df.columns])


_TREE = ("customer", "c_custkey", "case when c_custkey > 1 then cast(floor(c_custkey / 2) as bigint) end")
_CYCLE = ("nation", "n_nationkey", "cast((7 * n_nationkey + 1) % 25 as bigint)")
_TREE_SQL = "e as (select c_custkey as a, c_custkey // 2 as b from customer where c_custkey > 1)"
plain("path_plus_tree", lambda s, d: _numbers(_edges(s, d, *_TREE).dataframe("SELECT ?x ?y WHERE { ?x t:next+ ?y }")), f"with recursive {_TREE_SQL}, r as (select a, b from e union select r.a, e.b from r join e on r.b = e.a) select a as x, b as y from r")
plain("path_star_tree", lambda s, d: _numbers(_edges(s, d, *_TREE).dataframe("SELECT ?x ?y WHERE { ?x t:id ?i . ?x t:next* ?y }")), f"with recursive {_TREE_SQL}, r as (select c_custkey as a, c_custkey as b from customer union select r.a, e.b from r join e on r.b = e.a) select a as x, b as y from r")
add("path_star_free", "SELECT ?x ?y WHERE { ?x t:region* ?y }", f"with n as (select '{DATA}nation/' || n_nationkey as x from nation union select '{DATA}region/' || n_regionkey from nation union select n_nationkey::varchar from nation union select n_regionkey::varchar from nation union select n_name from nation union select '{T.Nation}') select x, x as y from n union all select '{DATA}nation/' || n_nationkey, '{DATA}region/' || n_regionkey from nation", after=lambda df: df.select(F.col("x.lex").alias("x"), F.col("y.lex").alias("y")), only=["nation"])
plain("path_plus_cycle", lambda s, d: _numbers(_edges(s, d, *_CYCLE).dataframe("SELECT ?x ?y WHERE { ?x t:next+ ?y }")), "with recursive e as (select n_nationkey::bigint as a, ((7 * n_nationkey + 1) % 25)::bigint as b from nation), r as (select a, b from e union select r.a, e.b from r join e on r.b = e.a) select a as x, b as y from r")
plain("path_plus_to_const", lambda s, d: _numbers(_edges(s, d, *_TREE).dataframe(f"SELECT ?x WHERE {{ ?x t:next+ <{DATA}node/3> }}")), f"with recursive {_TREE_SQL}, r as (select a from e where b = 3 union select e.a from r join e on e.b = r.a) select a as x from r")

# --- graphs
_GRAPHS = {"customer": f"{DATA}g1", "supplier": f"{DATA}g2"}
add("graph_named", "SELECT ?g ?n WHERE { GRAPH ?g { ?x t:c_name|t:s_name ?n } }", f"select '{DATA}g1' as g, c_name as n from customer union all select '{DATA}g2', s_name from supplier", graphs=_GRAPHS)
add("graph_const", f"SELECT ?n WHERE {{ GRAPH <{DATA}g2> {{ ?x t:s_name ?n }} }}", "select s_name as n from supplier", graphs=_GRAPHS)
add("from_named", f"SELECT ?g ?n FROM NAMED <{DATA}g1> WHERE {{ GRAPH ?g {{ ?x t:c_name|t:s_name ?n }} }}", f"select '{DATA}g1' as g, c_name as n from customer", graphs=_GRAPHS)
add("from_merge", f"SELECT ?n FROM <{DATA}g1> FROM <{DATA}g2> WHERE {{ ?x t:c_name|t:s_name ?n }}", "select c_name as n from customer union all select s_name from supplier", graphs=_GRAPHS)

# --- forms
add("ask", "ASK { ?c t:c_acctbal ?b FILTER(?b > 9000) }", "select exists (select 1 from customer where c_acctbal > 9000) as boolean")


def _spo(df: DataFrame) -> DataFrame:
    return df.select(F.col("s.lex").alias("s"), "p", F.col("o.lex").alias("o"))


add("construct", "CONSTRUCT { ?c t:inRegion ?rn . ?c t:named ?cn } WHERE { ?c t:c_name ?cn ; t:c_nation/t:region/t:r_name ?rn }", f"select '{DATA}customer/' || c_custkey as s, 'http://example.org/tables#inRegion' as p, r_name as o from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey union all select '{DATA}customer/' || c_custkey, 'http://example.org/tables#named', c_name from customer join nation on c_nationkey = n_nationkey", after=_spo)
add("describe", f"DESCRIBE <{DATA}region/2>", f"select '{DATA}region/2' as s, p, o from (select 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' as p, 'http://example.org/tables#Region' as o union all select 'http://example.org/tables#r_regionkey', '2' union all select 'http://example.org/tables#r_name', (select r_name from region where r_regionkey = 2) union all select 'http://www.w3.org/2000/01/rdf-schema#label', (select r_name from region where r_regionkey = 2))", after=_spo)
add("json_event", "SELECT ?k ?j WHERE { ?e t:event_id ?k ; t:props ?s BIND(STRDT(?s, rdf:JSON) AS ?j) }", "select event_id as k, props as j from events", after=lambda df: df.select("k", F.col("j.lex").alias("j")))


# --- updates: the statements of nation and region as quads, changed, read back
def quads_of_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    z, cat = Compiler(PREFIXES), tables_catalog(spark, sf_dir, only=["nation", "region"])
    rel = z.group(b.select("*").where("?s ?p ?o").query().where, Active(cat))
    out = rel.df.select(F.lit(None).cast("string").alias("g"), c.lift(rel.val("s")).col.alias("s"), F.col(rel.vars["p"][0]).alias("p"), c.lift(rel.val("o")).col.alias("o"))
    names = rel.df.sparkSession.createDataFrame([], f"g string, s {TERM}, p string, o {TERM}")
    return names.unionByName(out)


def _updated(update: str, query: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = Engine(Catalog(spark, quads=quads_of_tables(spark, sf_dir)), PREFIXES)
        e.update(f"PREFIX t: <{T}> PREFIX d: <{DATA}> {update}")
        df = e.dataframe(query)
        return df.select(*[F.col(f"{n}.lex").alias(n) if "struct" in k else F.col(n) for n, k in df.dtypes])

    return run


_NAMES = "SELECT ?s ?n WHERE { ?s t:n_name ?n }"
_N = f"select '{DATA}nation/' || n_nationkey as s, n_name as n from nation"
plain("update_insert", _updated("INSERT DATA { d:x t:n_name 'Atlantis' . d:x t:n_name 'Atlantis' }", _NAMES), f"{_N} union all select '{DATA}x', 'Atlantis'")
plain("update_delete_data", _updated("DELETE DATA { <http://example.org/data/nation/3> t:n_name 'none' }; INSERT DATA { d:x t:n_name 'a', 'b' }; DELETE DATA { d:x t:n_name 'a' }", _NAMES), f"{_N} union all select '{DATA}x', 'b'")
plain("update_delete_where", _updated("DELETE WHERE { ?s t:n_name ?n ; t:region <http://example.org/data/region/1> }", _NAMES), f"{_N} where n_regionkey <> 1")
plain("update_modify", _updated("DELETE { ?s t:n_name ?n } INSERT { ?s t:n_name ?m } WHERE { ?s t:n_name ?n ; t:n_regionkey 2 BIND(LCASE(?n) AS ?m) }", _NAMES), f"select '{DATA}nation/' || n_nationkey as s, case when n_regionkey = 2 then lower(n_name) else n_name end as n from nation")
_G = "INSERT { GRAPH d:g1 { ?s t:n_name ?n } } WHERE { ?s t:n_name ?n ; t:n_regionkey 1 } ; INSERT { GRAPH d:g2 { ?s t:n_name ?n } } WHERE { ?s t:n_name ?n ; t:n_regionkey 2 } ; "
_IN = "SELECT ?g ?s ?n WHERE { GRAPH ?g { ?s t:n_name ?n } }"


def _in(pairs: str) -> str:
    return f"select '{DATA}' || g as g, '{DATA}nation/' || n_nationkey as s, n_name as n from nation join (values {pairs}) v(g, r) on n_regionkey = r"


plain("update_insert_graph", _updated(_G, _IN), _in("('g1', 1), ('g2', 2)"))
plain("update_clear", _updated(_G + "CLEAR GRAPH d:g1", _IN), _in("('g2', 2)"))
plain("update_clear_default", _updated(_G + "CLEAR DEFAULT", "SELECT ?s WHERE { { ?s t:n_name ?n } UNION { GRAPH ?g { ?s t:n_name ?n } } }"), f"select '{DATA}nation/' || n_nationkey as s from nation where n_regionkey in (1, 2)")
plain("update_drop", _updated(_G + "DROP NAMED", "SELECT (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?s ?p ?o } }"), "select 0::bigint as n")
plain("update_create", _updated(_G + "CREATE GRAPH d:g3 ; CREATE SILENT GRAPH d:g1", _IN), _in("('g1', 1), ('g2', 2)"))
plain("update_copy", _updated(_G + "COPY d:g1 TO d:g2", _IN), _in("('g1', 1), ('g2', 1)"))
plain("update_move", _updated(_G + "MOVE d:g1 TO d:g2", _IN), _in("('g2', 1)"))
plain("update_add", _updated(_G + "ADD d:g1 TO d:g2", _IN), _in("('g1', 1), ('g2', 2), ('g2', 1)"))
plain("update_with", _updated(_G + "WITH d:g1 DELETE { ?s t:n_name ?n } INSERT { ?s t:n_name 'gone' } WHERE { ?s t:n_name ?n }", _IN), f"select '{DATA}g1' as g, '{DATA}nation/' || n_nationkey as s, 'gone' as n from nation where n_regionkey = 1 union all " + _in("('g2', 2)"))


def _load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements written as N-Triples in the shared folder, loaded into a graph, read back."""
    from uuid import uuid4

    from tessera.operators.lineage import folder
    from tessera.sources.rdf import write_ntriples

    path = f"{folder(spark)}/triples-{uuid4().hex}"
    write_ntriples(quads_of_tables(spark, sf_dir).select("s", "p", "o"), path)
    e = Engine(Catalog(spark), PREFIXES)
    e.update(p_load(path))
    df = e.dataframe(f"SELECT ?s ?n WHERE {{ GRAPH <{DATA}loaded> {{ ?s t:n_name ?n }} }}")
    return df.select(F.col("s.lex").alias("s"), F.col("n.lex").alias("n"))


def p_load(path: str) -> Any:
    from tessera.operators.updates import UpdateBuilder

    return UpdateBuilder().load(path.replace(" ", "%20"), into=f"{DATA}loaded")


plain("update_load", _load, _N)


# --- services
def _uris(table: str, keys: range) -> list[str]:
    return [f"{DATA}{table}/{k}" for k in keys]


plain("labels", lambda s, d: engine(s, d).labels_df(_uris("nation", range(30)) + _uris("region", range(3))), f"select '{DATA}nation/' || n_nationkey as uri, n_name as label from nation union all select '{DATA}region/' || r_regionkey, r_name from region where r_regionkey < 3")
plain("properties", lambda s, d: engine(s, d).properties_df(_uris("nation", range(10)), {"name": "t:n_name", "rk": "t:n_regionkey"}), f"select '{DATA}nation/' || n_nationkey as uri, n_name as name, n_regionkey::varchar as rk from nation where n_nationkey < 10")
plain("expand", lambda s, d: engine(s, d).expand_df(_uris("nation", range(20, 30)), {"rk": "t:n_regionkey"}), f"select u as position, '{DATA}nation/' || (u + 20) as uri, n_name as label, n_regionkey::varchar as rk from range(10) t(u) left join nation on n_nationkey = u + 20")


def _service(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, only=["nation"])
    e.catalog.endpoints["http://example.org/suppliers"] = tables_catalog(spark, sf_dir, only=["supplier"])
    return e.dataframe("SELECT ?sn ?nn WHERE { ?n t:n_name ?nn ; t:n_nationkey ?k SERVICE <http://example.org/suppliers> { ?s t:s_name ?sn ; t:s_nationkey ?k } SERVICE SILENT <http://example.org/none> { ?a ?b ?c } }")


plain("service_local", _service, "select s_name as sn, n_name as nn from supplier join nation on s_nationkey = n_nationkey")


# --- more of the language
add("select_star", "SELECT * WHERE { ?n t:n_name ?nn ; t:region [ t:r_name ?rn ] }", f"select '{DATA}nation/' || n_nationkey as n, n_name as nn, r_name as rn from nation join region on n_regionkey = r_regionkey")
add("values_trailing", "SELECT ?k ?n WHERE { ?x t:n_nationkey ?k ; t:n_name ?n } VALUES ?k { 3 5 7 99 }", "select n_nationkey::bigint as k, n_name as n from nation where n_nationkey in (3, 5, 7, 99)")
add("agg_sum_distinct", "SELECT ?br (SUM(DISTINCT ?s) AS ?d) (COUNT(DISTINCT ?s) AS ?n) (GROUP_CONCAT(DISTINCT ?s; SEPARATOR='|') AS ?g) WHERE { ?p t:p_brand ?br ; t:p_size ?s } GROUP BY ?br", "select p_brand as br, sum(distinct p_size)::bigint as d, count(distinct p_size) as n, string_agg(distinct p_size::varchar, '|' order by p_size::varchar) as g from part group by all")
add("having_order_aggregate", "SELECT ?s WHERE { ?c t:c_mktsegment ?s ; t:c_acctbal ?b } GROUP BY ?s HAVING (MAX(?b) > 0 && COUNT(*) > 1) ORDER BY DESC(COUNT(?b)) ?s LIMIT 3", "select c_mktsegment as s from customer group by c_mktsegment having max(c_acctbal) > 0 and count(*) > 1 order by count(*) desc, s limit 3")
add("subquery_scope", "SELECT ?k ?m WHERE { ?c t:c_custkey ?k ; t:c_mktsegment ?s ; t:c_acctbal ?b { SELECT ?s (MAX(?b) AS ?m) WHERE { ?x t:c_mktsegment ?s ; t:c_acctbal ?b } GROUP BY ?s } FILTER(?b = ?m) }", "select c_custkey as k, m from customer join (select c_mktsegment as s, max(c_acctbal) as m from customer group by all) on s = c_mktsegment where c_acctbal = m")
add("path_nested", "SELECT ?a ?b WHERE { ?a t:c_name ?x ; (t:c_nation/t:region)/(t:r_name|rdfs:label) ?b FILTER(STRENDS(?x, '7')) }", f"with r as (select c_custkey as k, r_name as n from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where ends_with(c_name, '7')) select '{DATA}customer/' || k as a, n as b from r union all select '{DATA}customer/' || k, n from r")
add("ask_false", "ASK { ?c t:c_acctbal ?b FILTER(?b > 1e12) }", "select false as boolean")
add("construct_blank", "CONSTRUCT { ?n t:place [ t:inside ?r ] } WHERE { ?n t:region ?r }", "select 2 * count(*) as n, count(*) as nodes from nation", after=lambda df: df.agg(F.count("*").alias("n"), F.count_distinct(F.when(F.col("s.kind") == 0, F.col("s.lex"))).alias("nodes")))
add("describe_var", "DESCRIBE ?r WHERE { ?r t:r_regionkey 1 }", f"select '{DATA}region/1' as s, p, o from (select 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' as p, 'http://example.org/tables#Region' as o union all select 'http://example.org/tables#r_regionkey', '1' union all select 'http://example.org/tables#r_name', (select r_name from region where r_regionkey = 1) union all select 'http://www.w3.org/2000/01/rdf-schema#label', (select r_name from region where r_regionkey = 1))", after=_spo)
plain("quoted_triple", _updated("INSERT { << ?n t:region ?r >> t:certainty ?k } WHERE { ?n t:region ?r ; t:n_nationkey ?k }", "SELECT ?n ?k WHERE { << ?n t:region <http://example.org/data/region/2> >> t:certainty ?k }"), f"select '{DATA}nation/' || n_nationkey as n, n_nationkey::varchar as k from nation where n_regionkey = 2")
plain("rel_properties", _updated("INSERT { ?n t:region ?r . _:e a rdf:Statement ; rdf:subject ?n ; rdf:predicate t:region ; rdf:object ?r ; t:weight ?k ; t:kind 'edge' } WHERE { ?n t:region ?r ; t:n_nationkey ?k }", select(["?n", "?k"]).where(p.match(p.rel(p.node("n"), "t:region", p.node("r").prop("t:r_name", "ASIA")).with_.props({"t:weight": v("k")}).and_.prop("t:kind", "edge")))), f"select '{DATA}nation/' || n_nationkey as n, n_nationkey::varchar as k from nation join region on n_regionkey = r_regionkey where r_name = 'ASIA'")
plain("rdf_list", _updated("INSERT DATA { d:x t:items (10 20 30) }", f"SELECT ?i WHERE {{ <{DATA}x> t:items/rdf:rest*/rdf:first ?i }}"), "select unnest(['10', '20', '30']) as i")
plain("update_using", _updated(_G + "INSERT { ?s t:seen ?n } USING d:g1 USING d:g2 WHERE { ?s t:n_name ?n }", "SELECT ?s ?n WHERE { ?s t:seen ?n }"), f"{_N} where n_regionkey in (1, 2)")
plain("path_both_ways", lambda s, d: _numbers(_edges(s, d, *_CYCLE).dataframe(f"SELECT ?y WHERE {{ <{DATA}node/3> (t:next|^t:next)* ?y }}")), "with recursive e as (select n_nationkey::bigint as a, ((7 * n_nationkey + 1) % 25)::bigint as b from nation), f as (select a, b from e union select b, a from e), r as (select 3::bigint as y union select f.b from r join f on r.y = f.a) select y from r")


def _json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON of events as records, to triples, matched."""
    from tessera.sources.catalog import quads_of
    from tessera.sources.json_etl import Entity, json_triples

    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.from_json("props", "k long").alias("props"))
    triples = json_triples(events, [Entity("event/{event_id}", (T.Event,), values={T.k: ("props.k", "http://www.w3.org/2001/XMLSchema#integer")})], DATA)
    df = Engine(Catalog(spark, quads=quads_of(triples)), PREFIXES).dataframe("SELECT ?e ?k WHERE { ?e a t:Event ; t:k ?k FILTER(?k > 50) }")
    return df.select(F.col("e.lex").alias("e"), F.col("k.lex").cast("bigint").alias("k"))


plain("json_etl", _json, f"select '{DATA}event/' || event_id as e, (props->>'k')::bigint as k from events where (props->>'k')::bigint > 50")


def _ontology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances of a class as rows of the record type that an ontology gives it."""
    from tessera.ontology import read_ontology, records

    e = Engine(Catalog(spark, quads=quads_of_tables(spark, sf_dir)), PREFIXES)
    e.update(f"PREFIX t: <{T}> INSERT DATA {{ t:Nation a owl:Class . t:n_name a owl:DatatypeProperty , owl:FunctionalProperty ; rdfs:domain t:Nation ; rdfs:range xsd:string . t:n_regionkey a owl:DatatypeProperty , owl:FunctionalProperty ; rdfs:domain t:Nation ; rdfs:range xsd:integer }}")
    return records(e, read_ontology(e)[T.Nation])


plain("ontology_records", _ontology, f"select '{DATA}nation/' || n_nationkey as iri, n_name, n_regionkey::bigint as n_regionkey from nation")
