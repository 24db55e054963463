"""Connected components of an edge table: union-find within partitions, then one bounded task, or star contraction between them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staging

#: What is left of the edges after each partition's union-find is finished by one task up to so many; beyond it rounds of stars run.
_FEW = 500_000


class UnionFind(dict):
    """Roots by node; the smaller node is the root."""

    def find(self, x):
        root = x
        while (up := self.get(root, root)) != root:
            root = up
        while x != root:
            self[x], x = root, self.get(x, x)
        return root

    def join(self, a, b) -> bool:
        """Unite two nodes; False if they were one already."""
        a, b = self.find(a), self.find(b)
        if a != b:
            self[max(a, b)] = min(a, b)
        return a != b


def _forest(batches):
    """The edges of one partition as a star on each of its components: at most one for each node."""
    known = UnionFind()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            known.join(a, b)
    nodes = list(known)
    roots = [known.find(x) for x in nodes]
    for k in range(0, len(nodes), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[k : k + (1 << 16)], pa.int64()), pa.array(roots[k : k + (1 << 16)], pa.int64())], names=["hi", "lo"])


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """``edges`` (u, v) with m, the least of u and all that it is linked to.

    Nodes of very many edges are broadcast with their m (at most some 5,000,
    the bound grows with ``total``), so that no task gathers a hub.
    """
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    bound = max(4_000, total // 5_000)
    if total <= bound:
        return edges.join(least.drop("n"), "u")
    hubs = F.broadcast(least.where(F.col("n") > bound).drop("n"))
    others = edges.join(hubs.select("u"), "u", "left_anti").join(least.where(F.col("n") <= bound).drop("n"), "u")
    return edges.join(hubs, "u").unionByName(others)


def _mark(edges: DataFrame) -> tuple:
    """Number and fingerprint of edges."""
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("hi", "lo")), F.lit(0))).first())


def _solved(batches):
    """(node, component) of all nodes of the edges."""
    known = UnionFind()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            known.join(a, b)
    nodes = list(known.keys() | known.values())
    roots = [known.find(x) for x in nodes]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], names=["node", "component"])


def connected_components(edges: DataFrame, staging: Staging, name: str, *, few: int = _FEW) -> DataFrame:
    """(node, component) for every node of ``edges`` (a long, b long); the component is its smallest node.

    Each partition is first reduced to a spanning forest. Up to ``few`` edges
    that this leaves are joined by one task, which so holds a bounded number
    of nodes. More take rounds of large and small stars, which link every node
    to the smallest node it can see, until no round changes anything. Minima
    are summed by partial aggregation and those of hubs are broadcast, so no
    task holds a whole component. Every round is written to the shared
    checkpoint folder. Null ends and loops are ignored; no edges give no rows.
    """
    pairs = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    stars = staging.save(pairs.mapInArrow(_forest, "hi long, lo long"), f"{name}-0")
    if 0 < stars.count() <= few:
        solved = staging.save(stars.coalesce(1).mapInArrow(_solved, "node long, component long"), f"{name}-solved")
        staging.drop(f"{name}-0")
        return solved
    k, mark = 0, _mark(stars)
    while mark[0]:
        both = stars.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(stars.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        large = _with_least(both, 2 * mark[0]).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = (
            _with_least(large, 2 * mark[0])
            .select(F.explode(F.array(F.struct(F.col("u").alias("hi"), F.col("m").alias("lo")), F.struct(F.col("v").alias("hi"), F.col("m").alias("lo")))).alias("e"))
            .select("e.hi", "e.lo")
            .where("hi <> lo")
            .distinct()
        )
        k += 1
        stars = staging.save(small, f"{name}-{k}")
        staging.drop(f"{name}-{k - 1}")
        last, mark = mark, _mark(stars)
        if mark == last:
            break
    return stars.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        stars.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )
