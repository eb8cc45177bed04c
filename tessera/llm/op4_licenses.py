"""License scans with DataFrame functions only: sparse TF-IDF cosine to templates, then directory inheritance.

1. Lines of every text are candidates where they hold a term of the templates (the cosine of all others is zero).  A line
   with one such term can't have a larger cosine than that term's share of a template, so it is scored only where the
   share reaches `THRESHOLD`; this bound loses nothing, and the SQL has no such rule.  Terms are
   runs of letters and digits, A-Z lower-cased, without `STOP` words.  Document frequencies of the
   templates' terms are counted over all documents; a term outside the templates counts as one that occurs in no
   document, so its weight needs no table.
2. A text's own licence is the template with the largest cosine of any of its lines, at least `THRESHOLD`
   (a tie: the template of the lesser name).
3. A directory's licence is that of most of its licensed files (a tie: the lesser name).  A file without its own
   takes the licence of its nearest ancestor directory that has one: distinct directories are expanded into their
   ancestors, joined to the licensed directories on the path, and the deepest ancestor wins.

Texts never move: the scan is one narrow pass, sums are combined before the shuffle, and paths are joined at the
level of distinct directories.  The only data on the driver are frequencies of the templates' own terms.

Defined cases: null and empty texts have no own licence; a null path has no directory and inherits nothing; a path
without a slash lies in the root directory ""; repeated rows are scanned alike; very long lines and texts are scanned
whole; an empty table gives an empty result; other columns, whatever their names, are passed on untouched by `scan`, but
for such as have the name of one that it adds, which are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.tables import broadcast_if_small, lower_az, stored, table

THRESHOLD = 0.5
STOP = ("the", "of", "and", "to", "in", "a", "is", "for", "or", "by", "with", "this", "that", "be", "as", "are", "on", "an", "it", "at", "not", "may", "you", "any", "all", "from", "was", "if", "de", "la", "en", "per", "und", "der", "un", "el")
#: Short notices as they stand in headers and licence files.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "MIT": "Released under the MIT License",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}


def terms(text: str) -> list[str]:
    import re

    return [t for t in re.findall(r"[a-z0-9]+", text.lower()) if t not in STOP]


def _terms(line: Column) -> Column:
    words = F.split(lower_az(line), r"[^a-z0-9\x{80}-\x{10FFFF}]+")
    return F.filter(words, lambda w: (w != "") & ~w.isin(*STOP))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def frequencies(docs: DataFrame, vocabulary: list[str], text: str = "text") -> tuple[int, dict[str, int]]:
    """Number of documents, and for each term of the vocabulary the number that contain it."""
    hits = docs.select(F.explode(F.array_intersect(F.array_distinct(_terms(F.coalesce(F.col(text), F.lit("")))), F.array(*map(F.lit, vocabulary)))).alias("term"))
    return docs.count(), {r["term"]: r["count"] for r in hits.groupBy("term").count().collect()}  # at most len(vocabulary) rows


def own_license(docs: DataFrame, text: str = "text", templates: dict[str, str] = TEMPLATES) -> Column:
    """struct(cosine, name) of the best line, null where no line reaches the threshold."""
    bags = {name: terms(t) for name, t in templates.items()}
    vocabulary = sorted({t for b in bags.values() for t in b})
    n, df = frequencies(docs, vocabulary, text)
    idf = {t: math.log((n + 1) / (df.get(t, 0) + 1)) + 1 for t in vocabulary}
    rare = math.log(n + 1) + 1
    known = F.create_map(*[x for t in vocabulary for x in (F.lit(t), F.lit(idf[t]))])
    anchors = F.array(*map(F.lit, vocabulary))

    def product(of: Column):
        return lambda s, x: s + F.coalesce(of[x["w"]], F.lit(0.0)) * x["tf"] * F.coalesce(known[x["w"]], F.lit(rare))

    def cosines(line: Column) -> Column:
        words = _terms(line)
        shared = F.array_intersect(words, anchors)
        counts = F.transform(F.array_distinct(words), lambda w: F.struct(w.alias("w"), F.size(F.filter(words, lambda x: x == w)).cast("double").alias("tf")))
        norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + F.pow(x["tf"] * F.coalesce(known[x["w"]], F.lit(rare)), 2)))
        best = []
        for name in sorted(bags):
            bag = {t: bags[name].count(t) * idf[t] for t in bags[name]}
            size = math.sqrt(sum(v * v for v in bag.values()))
            of = F.create_map(*[x for t, v in sorted(bag.items()) for x in (F.lit(t), F.lit(v))])
            dot = F.aggregate(counts, F.lit(0.0), product(of))
            best.append(F.struct(F.round(dot / (norm * size), 6).alias("cosine"), F.lit(name).alias("name")))
        return F.when(F.size(shared) > 0, F.array(*best))

    sizes = {name: math.sqrt(sum((bag.count(t) * idf[t]) ** 2 for t in set(bag))) for name, bag in bags.items()}
    strong = sorted({t for name, bag in bags.items() for t in bag if bag.count(t) * idf[t] >= (THRESHOLD - 1e-5) * sizes[name]})
    alone = F.array(*map(F.lit, strong)) if strong else F.array().cast("array<string>")
    candidate = F.filter(_lines(F.col(text)), lambda line: (F.size(F.array_intersect(_terms(line), anchors)) > 1) | F.arrays_overlap(_terms(line), alone))
    scored = F.flatten(F.transform(candidate, cosines))
    enough = F.filter(scored, lambda s: s["cosine"] >= THRESHOLD)
    return F.aggregate(enough, F.lit(None).cast("struct<cosine:double,name:string>"), lambda a, s: F.when(a.isNull() | (s["cosine"] > a["cosine"]) | ((s["cosine"] == a["cosine"]) & (s["name"] < a["name"])), s).otherwise(a))


def directory(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"(?s)^(.*)/", 1), "/+$", "")


def scan(docs: DataFrame, path: str = "path", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default: all but the text) with own_license, cosine, license_dir and license."""
    made = ("own_license", "cosine", "license_dir", "license")
    names = [c for c in (keep or docs.columns) if c.lower() not in made and (keep or c != text)]
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in names] or [F.lit(0)]).alias("_l_row"), F.col(path).alias("_l_path"), F.col(text).alias("_l_text"))
    found = docs.select("_l_row", "_l_path", own_license(docs, "_l_text").alias("_l_own"))
    found = stored(found.withColumn("_l_dir", F.when(F.col("_l_path").isNotNull(), directory(F.col("_l_path")))))  # scored once, without the texts
    votes = found.filter("_l_own is not null and _l_dir is not null").groupBy("_l_dir", F.col("_l_own.name").alias("name")).count()
    # most files first, then the lesser name
    licensed = votes.groupBy("_l_dir").agg(F.min(F.struct((-F.col("count")).alias("n"), "name")).alias("v")).select(F.col("_l_dir").alias("at"), F.col("v.name").alias("name"))
    dirs = found.select("_l_dir").filter("_l_dir is not null").distinct()
    parts = F.split("_l_dir", "/")
    above = dirs.select("_l_dir", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth")).withColumn("at", F.array_join(F.slice(F.split("_l_dir", "/"), F.lit(1), F.col("depth")), "/"))
    near = above.join(licensed, "at").groupBy("_l_dir").agg(F.max(F.struct("depth", "at", "name")).alias("near"))
    near = broadcast_if_small(near.select(F.col("_l_dir").alias("_l_key"), "near"))
    # the second key gives both sides an exchange of their own where they are shuffled, so that a large directory can be split
    out = found.join(near, (F.col("_l_dir") == F.col("_l_key")) & (F.hash("_l_dir") == F.hash("_l_key")), "left")
    own = F.col("_l_own.name")
    return out.select(*[F.col("_l_row")[c].alias(c) for c in names], own.alias("own_license"), F.col("_l_own.cosine").alias("cosine"), F.when(own.isNull(), F.col("near.at")).alias("license_dir"), F.coalesce(own, F.col("near.name")).alias("license"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files `source/lang/doc_id`: a document without a notice takes the licence of its directories."""
    docs = table(spark, sf_dir, "documents")
    docs = docs.withColumn("path", F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return scan(docs, keep=["doc_id", "path"])


def oracle() -> str:
    bags = {name: terms(t) for name, t in TEMPLATES.items()}
    rows = ", ".join(f"('{name}', '{t}', {bag.count(t)})" for name, bag in sorted(bags.items()) for t in sorted(set(bag)))
    stop = ", ".join(f"'{s}'" for s in STOP)
    return rf"""
with tpl(name, term, tf) as (values {rows}),
vocab as (select distinct term from tpl),
docs as (select row_number() over () as rid, doc_id, coalesce(text, '') as text, concat_ws('/', coalesce(source, ''), coalesce(lang, ''), coalesce(doc_id::varchar, '')) as path from documents),
lines as (select rid, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as no from docs),
tok as (select rid, no, term, count(*) as tf from (
    select rid, no, unnest(regexp_split_to_array(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9\x{{80}}-\x{{10FFFF}}]+')) as term from lines)
  where term <> '' and term not in ({stop}) group by all),
n as (select count(*) as n from docs),
df as (select term, count(distinct rid) as df from tok where term in (select term from vocab) group by term),
idf as (select term, ln((select n from n) + 1.0) - ln(coalesce(df, 0) + 1.0) + 1 as w from vocab left join df using (term)),
cand as (select rid, no from tok where term in (select term from vocab) group by all),
wt as (select rid, no, term, tf * coalesce(w, ln((select n from n) + 1.0) + 1) as x from tok semi join cand using (rid, no) left join idf using (term)),
norm as (select rid, no, sqrt(sum(x * x)) as size from wt group by all),
tw as (select name, term, tf * w as y from tpl join idf using (term)),
tnorm as (select name, sqrt(sum(y * y)) as tsize from tw group by name),
cosines as (select rid, no, name, round(sum(x * y) / (any_value(size) * any_value(tsize)), 6) as cosine
  from wt join tw using (term) join norm using (rid, no) join tnorm using (name) group by rid, no, name),
own as (select rid, name, cosine from cosines where cosine >= {THRESHOLD}
  qualify row_number() over (partition by rid order by cosine desc, name) = 1),
f as (select d.rid, doc_id, path, regexp_replace(regexp_extract(path, '^(.*)/', 1), '/+$', '') as dir, own.name as own, cosine from docs d left join own using (rid)),
votes as (select dir, own, count(*) as c from f where own is not null group by all),
lic as (select dir as spot, own as name from votes qualify row_number() over (partition by dir order by c desc, own) = 1),
dirs as (select distinct dir from f),
near as (select dir, spot, name from dirs join lic on spot = '' or dir = spot or starts_with(dir, spot || '/')
  qualify row_number() over (partition by dir order by length(spot) desc) = 1)
select doc_id, path, own as own_license, cosine, case when own is null then spot end as license_dir, coalesce(own, near.name) as license
from f left join near using (dir)
"""


ORACLE = oracle()
