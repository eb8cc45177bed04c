"""Mixing sources to target weights over a domain - language - source tree.

1. One pass counts the words (tokens) and rows of each leaf.
2. Budgets go down the tree: a node's budget is shared among its children in proportion to their weights, but a
   child takes at most what its leaves hold in `EPOCHS` epochs.  What a short child leaves goes to its siblings (the
   weights' common level rises until the budget is used), and only what a whole subtree can't take goes to the
   siblings of its ancestor.  This is done by window functions over the children of each node.
3. A leaf with budget A and T tokens is read in whole epochs while A lasts; the last epoch is a prefix, in the order of a
   hash of (seed, epoch, doc_id), of whole documents whose running tokens stay within the rest.

A prefix needs no sort of a leaf: the hash range of a leaf of n rows is cut into about sqrt(n) buckets, bucket sums
show in which bucket the prefix ends, and only that bucket's rows are ordered.  So a source with a third of all rows is no
hot spot.  Leaf facts are broadcast when a count shows that they are few, else joined.

Defined cases: null language or source is the leaf part ""; null and empty texts have no tokens and follow their
place in the order; a null doc_id is ordered as ""; rows with the same doc_id share a place and are taken or left
together; nodes without a weight have `DEFAULT_WEIGHT`; weight zero takes nothing; an empty table gives an empty
result; very long texts count whole; `mix` passes on all columns, whatever their names, and adds `epoch` (in place of a
column of that name).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.tables import broadcast_if_small, checkpoint, fresh, table

#: Share of all tokens that the mixture has, epochs at most, and the seed.
SHARE, EPOCHS, SEED = 0.5, 2, 17
DEFAULT_WEIGHT = 1.0
#: Weights of nodes by their path from the root.
WEIGHTS = {
    "d0": 3.0, "d1": 2.0, "d2": 1.0,
    "d0/en": 4.0, "d1/en": 2.0, "d2/en": 1.0, "d0/de": 2.0, "d1/fr": 2.0,
    "d0/en/src0": 2.0, "d1/en/src1": 3.0, "d2/fr/src2": 0.5,
}
LEAF = ["_m_domain", "_m_lang", "_m_source"]
SPAN = float(1 << 60)


def domain_of(source: Column) -> Column:
    """The domain of a source: its trailing number modulo 3."""
    number = F.regexp_extract(source, r"([0-9]+)$", 1)
    return F.concat(F.lit("d"), F.coalesce(F.try_to_number(number, F.lit("999999999")).cast("bigint") % 3, F.lit(0)).cast("string"))


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def place(epoch: Column, id_col: Column, seed: int = SEED) -> Column:
    """Place in the order of an epoch, 0 to 2**60 - 1."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(id_col.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("bigint")


def leaves_of(docs: DataFrame) -> list[Column]:
    lang, source = F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit(""))
    return [domain_of(source).alias(LEAF[0]), lang.alias(LEAF[1]), source.alias(LEAF[2])]


def share_out(children: DataFrame, parent: list[str], order: list[str]) -> DataFrame:
    """children with cap, weight, and the parent's budget; adds alloc (bigint), the water-filling share.

    In order of cap / weight the first children are filled up to their caps, and the rest share what is left by
    weight.
    """
    by = W.partitionBy(*parent).orderBy("_fill", *order)
    before = by.rowsBetween(W.unboundedPreceding, -1)
    after = by.rowsBetween(W.currentRow, W.unboundedFollowing)
    x = children.withColumn("_fill", F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(F.lit(float("inf"))))
    x = x.withColumn("_used", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("_w", F.sum("weight").over(after))
    x = x.withColumn("_level", F.when(F.col("_w") > 0, (F.col("budget") - F.col("_used")) / F.col("_w")))
    x = x.withColumn("_open", F.col("_fill") > F.coalesce("_level", F.lit(0.0)))
    x = x.withColumn("_common", F.min(F.when(F.col("_open"), F.struct("_fill", *order, "_level"))).over(W.partitionBy(*parent)))
    alloc = F.when(F.col("weight") <= 0, F.lit(0)).when(F.col("_open"), F.floor(F.col("weight") * F.col("_common._level"))).otherwise(F.col("cap"))
    return x.withColumn("alloc", alloc.cast("bigint")).drop("_fill", "_used", "_w", "_level", "_open", "_common")


def weights_table(spark: SparkSession, weights: dict[str, float]) -> DataFrame:
    """(node, w), made by expressions: rows from Python would start Python workers on the executors."""
    rows = [F.struct(F.lit(n).alias("node"), F.lit(float(w)).alias("w")) for n, w in (weights or {"": DEFAULT_WEIGHT}).items()]
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*rows)))


def budgets(leaves: DataFrame, weights: dict[str, float] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """leaves (LEAF, tokens, docs) with alloc, the tokens that each takes."""
    spark = leaves.sparkSession
    w = F.broadcast(weights_table(spark, weights))
    leaves = leaves.withColumn("cap", F.col("tokens") * epochs)
    out = None
    for depth in (1, 2, 3):
        keys = LEAF[:depth]
        nodes = leaves.groupBy(*keys).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
        nodes = nodes.join(w, F.concat_ws("/", *keys) == F.col("node"), "left").withColumn("weight", F.coalesce("w", F.lit(DEFAULT_WEIGHT))).drop("w", "node")
        if out is None:
            nodes = nodes.withColumn("_root", F.lit(0)).withColumn("budget", F.floor(F.sum("tokens").over(W.partitionBy("_root")) * F.lit(share)).cast("bigint"))
            parent = ["_root"]
        else:
            parent = LEAF[: depth - 1]
            nodes = nodes.join(out.select(*parent, F.col("alloc").alias("budget")), parent)
        out = share_out(nodes, parent, [LEAF[depth - 1]]).select(*keys, "alloc", "weight", "budget")
    return leaves.drop("cap").join(out.select(*LEAF, "alloc"), LEAF)


def plan(narrow: DataFrame, weights: dict[str, float] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """One row for each leaf: whole epochs, the rest, buckets, the bucket where the prefix ends, tokens before it.

    narrow: LEAF, id, tokens of every row.
    """
    leaves = narrow.groupBy(*LEAF).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"))
    facts = budgets(leaves, weights, share, epochs)
    facts = facts.withColumn("whole", F.when(F.col("tokens") > 0, F.floor(F.col("alloc") / F.col("tokens"))).otherwise(0).cast("int"))
    facts = facts.withColumn("rest", F.col("alloc") - F.col("whole") * F.col("tokens")).withColumn("buckets", F.ceil(F.sqrt("docs")).cast("bigint"))
    facts = checkpoint(facts.select(*LEAF, "tokens", "alloc", "whole", "rest", "buckets"))
    rows = narrow.join(broadcast_if_small(facts.drop("tokens")), LEAF).withColumn("bucket", bucket_of(place(F.col("whole"), F.col("id"), seed), F.col("buckets")))
    sums = rows.groupBy(*LEAF, "bucket", "rest").agg(F.sum("tokens").alias("t"))
    run = W.partitionBy(*LEAF).orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    ends = sums.withColumn("upto", F.sum("t").over(run)).filter("upto > rest").groupBy(*LEAF).agg(F.min(F.struct("bucket", (F.col("upto") - F.col("t")).alias("before"))).alias("cut"))
    return facts.join(ends, LEAF, "left").select(*LEAF, "tokens", "alloc", "whole", "rest", "buckets", F.col("cut.bucket").alias("cut"), F.col("cut.before").alias("before"))


def bucket_of(p: Column, buckets: Column) -> Column:
    return F.floor(p / F.lit(SPAN) * buckets).cast("bigint")


def take(docs: DataFrame, leaves: list[Column], facts: DataFrame, id_col: str, tokens: Column, seed: int = SEED) -> DataFrame:
    """docs (leaves give their LEAF) once for each epoch that takes the row, numbered in `epoch`."""
    names = [*LEAF, "whole", "rest", "buckets", "cut", "before"]
    named = dict(zip(names, fresh(docs, *[f"m_{n}" for n in names]), strict=True))
    facts = facts.select(*[F.col(n).alias(named[n]) for n in names])
    epoch, at, bucket, run = fresh(docs, "m_epoch", "m_place", "m_bucket", "m_run")
    col = lambda n: F.col(named[n])
    mine = fresh(docs, *[f"mine{n}" for n in LEAF])
    x = docs.select("*", *[c.alias(n) for c, n in zip(leaves, mine, strict=True)])
    same = reduce(lambda p, q: p & q, [F.col(n) == col(m) for n, m in zip(mine, LEAF, strict=True)])
    x = x.join(broadcast_if_small(facts), same)
    whole = x.filter(col("whole") > 0).withColumn(epoch, F.explode(F.sequence(F.lit(0), col("whole") - 1)))
    last = x.withColumn(epoch, col("whole")).withColumn(at, place(col("whole"), F.col(id_col), seed)).withColumn(bucket, bucket_of(F.col(at), col("buckets")))
    inside = last.filter((col("rest") > 0) & (col("cut").isNull() | (F.col(bucket) < col("cut"))))
    before = W.partitionBy(*mine).orderBy(at).rangeBetween(W.unboundedPreceding, W.currentRow)
    edge = last.filter((col("rest") > 0) & (F.col(bucket) == col("cut"))).withColumn(run, F.sum(tokens).over(before) + col("before")).filter(F.col(run) <= col("rest"))
    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "epoch"]
    parts = [y.select(*own, F.col(epoch).cast("int").alias("epoch")) for y in (whole, inside, edge)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def narrow_of(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    return checkpoint(docs.select(F.col(id_col).alias("id"), *leaves_of(docs), tokens_of(F.col(text)).alias("tokens")))


def mix(docs: DataFrame, weights: dict[str, float] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with all their columns, repeated by epochs, and the column `epoch`."""
    facts = plan(narrow_of(docs, id_col, text), weights, share, epochs, seed)
    return take(docs, leaves_of(docs), facts, id_col, tokens_of(F.col(text)), seed)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, domain, lang, source, tokens, epoch of every row that the mixture takes."""
    narrow = narrow_of(table(spark, sf_dir, "documents"))
    rows = narrow.select("id", "tokens", *[F.col(n).alias(m) for n, m in zip(LEAF, ("domain", "lang", "source"), strict=True)])
    out = take(rows, [F.col(n) for n in ("domain", "lang", "source")], plan(narrow), "id", F.col("tokens"))
    return out.withColumnRenamed("id", "doc_id")


def oracle() -> str:
    nodes = ", ".join(f"('{k}', {v})" for k, v in WEIGHTS.items())

    def level(depth: int) -> str:
        keys = ["d", "l", "s"][:depth]
        path = " || '/' || ".join(keys)
        parent = keys[:-1]
        budget = f"floor(sum(tokens) over () * {SHARE})::bigint" if depth == 1 else f"p.alloc"
        join = "" if depth == 1 else f"join a{depth - 1} p using ({', '.join(parent)})"
        part = f"partition by {', '.join(parent)}" if parent else ""
        return f"""
n{depth} as (select {', '.join(keys)}, cap, {budget} as budget, coalesce(w, {DEFAULT_WEIGHT}) as weight from (select {', '.join(keys)}, sum(tokens)::bigint * {EPOCHS} as cap, sum(tokens)::bigint as tokens from leaves group by all) c
  left join wt on {path} = node {join}),
f{depth} as (select *, case when weight > 0 then cap / weight else 'infinity'::double end as fill from n{depth}),
u{depth} as (select *, coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0) as used, sum(weight) over (o rows between current row and unbounded following) as wr from f{depth} window o as ({part} order by fill, {keys[-1]})),
v{depth} as (select *, case when wr > 0 then (budget - used) / wr end as lvl from u{depth}),
a{depth} as (select {', '.join(keys)}, (case when weight <= 0 then 0 when fill > coalesce(lvl, 0) then floor(weight * first_value(lvl) over ({part} order by case when fill > coalesce(lvl, 0) then 0 else 1 end, fill, {keys[-1]})) else cap end)::bigint as alloc from v{depth})"""

    return f"""
with wt(node, w) as (values {nodes}),
x as (select doc_id, coalesce(lang, '') as l, coalesce(source, '') as s, length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+', chr(1), 'g'), '[\\x20\\x09-\\x0D]', '', 'g')) as tokens from documents),
y as (select *, 'd' || (coalesce(try_cast(regexp_extract(s, '([0-9]+)$', 1) as bigint), 0) % 3)::varchar as d from x),
leaves as (select d, l, s, sum(tokens)::bigint as tokens, count(*) as docs from y group by all),
{','.join(level(k) for k in (1, 2, 3))},
facts as (select d, l, s, alloc, tokens as total, case when tokens > 0 then alloc // tokens else 0 end as whole, alloc - case when tokens > 0 then alloc // tokens else 0 end * tokens as rest from leaves join a3 using (d, l, s)),
z as (select y.*, whole, rest, ('0x' || substr(md5('{SEED}:' || whole::varchar || ':' || coalesce(doc_id::varchar, '')), 1, 15))::bigint as place from y join facts using (d, l, s)),
r as (select *, sum(tokens) over (partition by d, l, s order by place range between unbounded preceding and current row) as run from z),
e as (select *, unnest(range(0, whole::int)) as epoch from z)
select doc_id, d as domain, l as lang, s as source, tokens::bigint as tokens, epoch::int as epoch from e
union all
select doc_id, d, l, s, tokens::bigint, whole::int from r where run <= rest and rest > 0
"""


ORACLE = oracle()
