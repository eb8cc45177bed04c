"""URL filters: host-suffix and path-prefix expressions, short hash prefixes, full digests, rule precedence.

A rule is (action, "host/path").  It fits its host and all subdomains if the url's path starts with the rule's;
the longest fitting rule wins, and no rule means allow.  The method:

1. every distinct url is expanded into host suffixes (at each label) x path prefixes (at each path length that
   some rule has);
2. expressions meet the rules in an equi-join on the first `SHORT` hex digits of their SHA-256;
3. survivors are confirmed by the full digest and ordered by rule length (a tie: the longer host, then block).

Distinct urls are combined before the shuffle, so a hot url is one row a task; the join back to pages has a second key
that gives both sides an exchange of their own, so that adaptive execution can split the rows of a hot url.  Urls that
no rule can fit (null, or without host and path) pass by the join.  The rules are broadcast when a count shows that
they are few.

Defined cases: a null url, or one without "://", has empty host and path and is allowed; hosts keep ports and
user info as they stand; very long urls are judged whole; where rules of equal length fit, the longer host wins, then
block; repeated rows are judged alike; an empty table gives an empty result; other columns of pages are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.tables import broadcast_if_small, lower_az, table

RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
SHORT = 8
DEFAULT = "allow"


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    df = spark.createDataFrame([(a, r) for a, r in rules], "action string, rule string")
    return (
        df.withColumn("r_host", F.regexp_extract("rule", r"^([^/]*)", 1))
        .withColumn("r_path", F.expr("substring(rule, char_length(r_host) + 1)"))
        .withColumn("r_digest", F.sha2(_expression(F.col("r_host"), F.col("r_path")), 256))
        .withColumn("r_short", F.substring("r_digest", 1, SHORT))
        .withColumn("r_rank", F.struct(F.char_length("rule"), F.char_length("r_host"), (F.col("action") == "block").cast("int"), F.col("rule"), F.col("action")))
    )


def _expression(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit("\x00"), path)


def host_of(url: Column) -> Column:
    return lower_az(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", id_col: str = "page_id") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages."""
    # at most as many numbers as the longest rule has characters
    lengths = [r[0] for r in rules.select(F.char_length("r_path").alias("n")).distinct().orderBy("n").collect()]
    urls = pages.select(F.col(url).alias("url")).filter("url is not null").distinct()
    parts = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).filter("host <> '' or path <> ''")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    expanded = (
        parts.withColumn("suffix", F.explode(suffixes))
        .withColumn("r_len", F.explode(F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.char_length("path"))))
        .withColumn("digest", F.sha2(_expression(F.col("suffix"), F.expr("substring(path, 1, r_len)")), 256))
        .withColumn("short", F.substring("digest", 1, SHORT))
    )
    hits = expanded.join(broadcast_if_small(rules), F.col("short") == F.col("r_short")).filter(F.col("digest") == F.col("r_digest"))
    best = hits.groupBy("url").agg(F.max("r_rank").alias("best")).select(F.col("url").alias("b_url"), F.col("best.rule").alias("b_rule"), F.col("best.action").alias("b_action"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url).alias("url"))
    judged = F.coalesce(F.col("url").contains("://"), F.lit(False))
    out = rows.filter(judged).join(best, (F.col("url") == F.col("b_url")) & (F.hash("url") == F.hash("b_url")), "left")
    out = out.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("b_rule").alias("rule"), F.coalesce("b_action", F.lit(DEFAULT)).alias("verdict"))
    empty, none = F.lit(""), F.lit(None).cast("string")
    return out.unionByName(rows.filter(~judged).select("page_id", empty.alias("host"), empty.alias("path"), none.alias("rule"), F.lit(DEFAULT).alias("verdict")))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), rules_table(spark))


ORACLE = r"""
with u as (
  select page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
  from pages),
r(action, rule, h, p) as (values ('block', 'com/en/', 'com', '/en/'), ('allow', 'example.com/en/7', 'example.com', '/en/7'),
  ('allow', 'net/de/', 'net', '/de/'), ('block', 'example.net/de/8', 'example.net', '/de/8'), ('block', 'org/es/', 'org', '/es/'))
select page_id, host, path,
  (select r.rule from r where (u.host = r.h or ends_with(u.host, '.' || r.h)) and starts_with(u.path, r.p) order by length(r.rule) desc limit 1) as rule,
  coalesce((select r.action from r where (u.host = r.h or ends_with(u.host, '.' || r.h)) and starts_with(u.path, r.p) order by length(r.rule) desc limit 1), 'allow') as verdict
from u
"""
