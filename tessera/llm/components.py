"""Connected components of a link table, distributed: alternating large-star and small-star steps.

A table of at most `ONE_TASK` links (16 bytes each, counted first) is solved by one task in bounded memory, which saves
the rounds.  Beyond that, every step is a grouped minimum (combined on the map side, so a node with very many links is no hot spot) and an
equi-join of links to those minima (which adaptive execution can split when one node holds many rows).  Links
and labels stay in tables; the driver sees one count and one checksum a round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.tables import checkpoint


#: Links that one task holds at most.
ONE_TASK = 2_000_000


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each linked node reaches. Nodes without a link don't appear.

    Links are undirected; self-links and repeats are harmless; null ends are ignored.  An empty table gives an
    empty table.  `rounds` is only a guard against a broken input; the loop ends at the fixed point, in a number
    of rounds about logarithmic in the longest path.
    """
    e = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null and u <> v")
    e = checkpoint(e)
    if e.count() <= ONE_TASK:
        return e.repartition(1).mapInArrow(_solve, "node bigint, component bigint")
    e = checkpoint(e.distinct())
    before = None
    for _ in range(rounds):
        e = checkpoint(_small_star(_large_star(e)))
        now = e.agg(F.count("*"), F.coalesce(F.sum(F.hash("u", "v").cast("bigint")), F.lit(0))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    labels = e.groupBy(F.greatest("u", "v").alias("node")).agg(F.min(F.least("u", "v")).alias("component"))
    return labels.unionByName(labels.select(F.col("component").alias("node"), "component").distinct())


def solve(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links, ascending, and the least node that each reaches."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    u, v = at[: len(u)], at[len(u) :]
    parent = np.arange(len(nodes))  # in order of the nodes, so the least position is the least node
    while len(u):
        low, high = np.minimum(parent[u], parent[v]), np.maximum(parent[u], parent[v])
        open_ = low != high
        u, v = u[open_], v[open_]
        np.minimum.at(parent, high[open_], low[open_])
        while (parent[parent] != parent).any():
            parent = parent[parent]
    return nodes, nodes[parent]


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not held:
        return
    nodes, least = solve(*(np.concatenate(x) for x in zip(*held, strict=True)))
    for s in range(0, len(nodes), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[s : s + (1 << 16)]), pa.array(least[s : s + (1 << 16)])], names=["node", "component"])


def _large_star(e: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest of itself and its neighbours."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    out = _joined(both.filter("v > u"), low)
    return out.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours, and itself, to the smallest of them."""
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    out = _joined(down, low).select(F.explode(F.array("v", "u")).alias("x"), "m")
    return out.select(F.col("x").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _joined(e: DataFrame, low: DataFrame) -> DataFrame:
    """e with m. The second key gives both sides an exchange of their own, so that a hot node's links can be split."""
    low = low.select(F.col("u").alias("node"), "m")
    return e.join(low, (F.col("u") == F.col("node")) & (F.hash("u") == F.hash("node")))
