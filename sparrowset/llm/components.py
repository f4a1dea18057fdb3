"""Connected components of a distributed list of links, by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowset.llm.common import checkpointed

#: A task keeps so many links before it gives them away.
HELD_LINKS = 500_000


class UnionFind:
    """Sets of numbers that join() has connected; the least one stands for each."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up, top = self.up, x
        while (above := up.get(top, top)) != top:
            top = above
        while x != top:
            x, up[x] = up[x], top
        return top

    def join(self, x: int, y: int) -> bool:
        """Whether they were apart."""
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def thinned(batches):
    """Arrow batches (u, v) of those links that connect something new among the links that this task holds."""
    import pyarrow as pa

    held, tie = [], UnionFind()
    for batch in batches:
        held += [(a, b) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if tie.join(a, b)]
        if len(held) >= HELD_LINKS:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*held, strict=True)], ["u", "v"])
            held, tie = [], UnionFind()
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*held, strict=True)], ["u", "v"])


def least_connected(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, roots): every node of the links, ascending, and the least node that it is connected to."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return nodes, nodes[root]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while ((further := root[root]) != root).any():
            root = further


def few_roots(links: DataFrame, few: int) -> DataFrame | None:
    """s, root of all nodes of the links (u, v: long), found on the driver; None where there are more than `few` links.

    links should be checkpointed: they are read twice. Rounds of joins cost the driver more memory than so few links."""
    if links.limit(few + 1).count() > few:
        return None
    import pyarrow as pa

    held = links.select("u", "v").toArrow()
    nodes, roots = least_connected(*(held.column(c).to_numpy().astype(np.int64) for c in ("u", "v")))
    return links.sparkSession.createDataFrame(pa.table({"s": nodes, "root": roots}))


def _stars(links: DataFrame, least: DataFrame) -> DataFrame:
    """(v, m, u) for each link (u, v), where m is the least node beside u.

    The join is by struct(u), not u, so that both sides have an exchange of their own: adaptive execution can then split
    the links of a hub over many tasks.
    """
    least = least.select(F.struct("u").alias("own"), "m")
    return links.join(least, F.struct("u") == F.col("own")).select("v", "m", "u")


def components(links: DataFrame, max_rounds: int = 60, few: int = 0) -> DataFrame:
    """u, root: for every node that has a link to another node and isn't the least, the least node it is connected to.

    links: u, v (orderable, not null). Each round is two aggregations with partial minima and two joins; it is written
    to the shared folder, so lineage stays short. Rounds end when the links are stars that no round changes; their
    number grows with the logarithm of the longest path. Only a count and a checksum reach the driver; but up to `few`
    links, of long nodes, are joined there.
    """
    now = checkpointed(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    if few and (roots := few_roots(now, few)) is not None:
        return roots.filter("s <> root").select(F.col("s").alias("u"), "root")
    state = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _stars(both, least).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        # what u is linked to below itself moves to the least of it, as does u
        small = _stars(large, least).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        now = checkpointed(small)
        seen = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        if (seen["n"], seen["h"]) == state:
            return now.select("u", F.col("v").alias("root"))
        state = (seen["n"], seen["h"])
    raise RuntimeError(f"components are not settled after {max_rounds} rounds")
