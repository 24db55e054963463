"""Candidate pairs from sorted keys and their exact verification, without pairs of whole groups.

``neighbour_pairs`` looks along rows sorted by (key, deep, node): rows with one
key are a region. Regions longer than its window are named, and
``crowded_links`` and ``region_links`` hold all their members against each
other in blocks, confirm links there and give a forest. ``verified_links`` sends the texts of candidate pairs block by
block and keeps, of the pairs that pass the exact test, a spanning forest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staging, partitions
from .components import UnionFind, connected_components

_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Nodes of up to so many are broadcast to what they meet; beyond it they are joined by shuffle.
_FEW = 200_000


def mixed(h: np.ndarray) -> np.ndarray:
    """A fixed scrambling of 64-bit values (uint64 in and out)."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA3B195354A39B70D)
    return h ^ (h >> np.uint64(32))


class RangeHash:
    """64-bit hashes of any ranges of an integer array from running sums (polynomial modulo 2**64)."""

    _up = np.ones(1, np.uint64)
    _down = np.ones(1, np.uint64)

    def __init__(self, codes: np.ndarray):
        n = len(codes) + 1
        cls = type(self)
        if len(cls._up) < n:
            size = 1 << int(n).bit_length()
            base = np.uint64(0x5851F42D4C957F2D)
            inverse = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))
            cls._up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, base)]), dtype=np.uint64)
            cls._down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, inverse)]), dtype=np.uint64)
        values = mixed(codes.astype(np.uint64) + _STEP)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(values * cls._up[: n - 1], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self._down[starts] + (ends - starts).astype(np.uint64))

    def windows(self, width: int) -> np.ndarray:
        """Hashes of all ranges of ``width`` in order, as ``of`` gives them."""
        n = max(len(self.sums) - width, 0)
        return mixed((self.sums[width : width + n] - self.sums[:n]) * self._down[:n] + np.uint64(width))


def word_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, longest: int = 256) -> np.ndarray:
    """64-bit hashes of words in a byte array.

    Running sums modulo 2**64 serve words of up to ``longest`` bytes; beyond
    that there are texts that collide by their form, so a digest is taken.
    """
    out = RangeHash(codes).of(starts, ends)
    for k in np.flatnonzero(ends - starts > longest).tolist():
        out[k] = np.frombuffer(hashlib.blake2b(codes[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), np.uint64)[0]
    return out


def portions(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes together; a longer text is a portion of its own."""
    at = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > most:
            yield at, k
            at, size = k, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def common_prefixes(equal: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """Length of the run of equal values that a pair shares at the start of each order (pairs x orders)."""
    agree = np.concatenate([equal[:, orders], np.zeros((len(equal), len(orders), 1), bool)], axis=2)
    return agree.argmin(2)


def neighbour_pairs(rows: DataFrame, *, window: int, keep: int = 0, least: float = 0.0, orders: np.ndarray | None = None) -> DataFrame:
    """Pairs (a < b) of nodes in one region of the sorted rows, and a row (key, null) for every region not searched whole.

    ``rows``: key long, node long, and optionally deep (any sortable), sig
    binary of equal lengths and part long. With ``sig``, a pair needs a share
    of at least ``least`` equal signature bytes, and ``keep`` pairs of a node
    are enough (those with the largest shares); a node with more is reported
    by a row (node, node), for another round. With ``orders`` and a column
    ``tree`` (the order of a row), a pair is given only by the orders in which
    it shares a prefix within one of its longest; it shares those regions too.
    With ``part``, pairs within one part are left out.

    Rows are dealt by ranges of (key, deep, node), so a region of any size
    spreads over tasks; a task keeps ``window`` + 1 rows from batch to batch.
    A row that repeats a (key, node) is dropped. Regions of more than
    ``window`` + 1 nodes, and those that a range boundary may cut, are named
    for ``region_links`` or ``crowded_links``; all others give all their pairs.
    With ``sig`` a node of a longer region gives its best pair within the
    window all the same, which links most of what is alike before that search.
    """
    names = [c for c in ("key", "deep", "node", "sig", "tree", "part") if c in rows.columns]
    order = [c for c in ("key", "deep", "node") if c in names]
    dealt = rows.select(*names).repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    dealt = dealt.drop("deep")

    def named(keys):
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.nulls(len(keys), pa.int64())], names=["a", "b"])

    def ranked(lo, hi, share):
        """The pairs, best first, and each one's better place among those of its ends."""
        order = np.lexsort((hi, lo, -share))
        lo, hi = lo[order], hi[order]
        ends = np.concatenate([lo, hi])
        by_node = np.lexsort((np.tile(np.arange(len(lo)), 2), ends))
        starts = np.flatnonzero(np.r_[True, ends[by_node][1:] != ends[by_node][:-1]])
        place = np.empty(len(ends), np.int64)
        place[by_node] = np.arange(len(ends)) - np.repeat(starts, np.diff(np.r_[starts, len(ends)]))
        return lo, hi, np.minimum(place[: len(lo)], place[len(lo) :])

    def scan(batches):
        held, begun = None, False
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            key, node = batch.column("key").to_numpy(zero_copy_only=False), batch.column("node").to_numpy(zero_copy_only=False)
            sig = part = tree = None
            if "sig" in names:
                sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint8).reshape(n, -1)
            if "tree" in names:
                tree = batch.column("tree").to_numpy(zero_copy_only=False)
            if "part" in names:
                part = batch.column("part").to_numpy(zero_copy_only=False)
            carried = 0
            if held is not None:
                carried = len(held[0])
                key, node = np.concatenate([held[0], key]), np.concatenate([held[1], node])
                sig = None if sig is None else np.concatenate([held[2], sig])
                part = None if part is None else np.concatenate([held[3], part])
                tree = None if tree is None else np.concatenate([held[4], tree])
            fresh = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]
            key, node, sig, part, tree = (None if x is None else x[fresh] for x in (key, node, sig, part, tree))
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[starts, len(key)])
            long = np.repeat(sizes > window + 1, sizes)
            whole = key[starts[sizes > window + 1]]
            if not begun:
                begun, whole = True, np.append(whole, key[0])
            if len(whole):
                yield named(whole)
            found = []
            for s in range(1, min(window, len(key) - 1) + 1):
                first = max(0, carried - s)
                at = np.flatnonzero(key[first:-s] == key[first + s :]) + first
                if not len(at):
                    break
                at = at[~long[at]] if sig is None else at
                if part is not None:
                    at = at[part[at] != part[at + s]]
                share = np.ones(len(at))
                if sig is not None:
                    share = np.concatenate([(sig[x] == sig[x + s]).mean(1) for x in np.array_split(at, max(1, len(at) >> 13))])
                    at, share = at[share >= least], share[share >= least]
                    if orders is not None and len(at):
                        near = []
                        for x in np.array_split(at, max(1, len(at) >> 11)):
                            run = common_prefixes(sig[x] == sig[x + s], orders)
                            near.append(run[np.arange(len(x)), tree[x]] >= run.max(1) - 1)
                        near = np.concatenate(near)
                        at, share = at[near], share[near]
                if len(at):
                    found.append((node[at], node[at + s], share, long[at]))
            held = [None if x is None else x[-window - 1 :] for x in (key, node, sig, part, tree)]
            if not found:
                continue
            a, b, share, far = (np.concatenate(x) for x in zip(*found, strict=True))
            lo, hi = np.minimum(a, b), np.maximum(a, b)
            if keep:
                x, y, rank = ranked(lo[far], hi[far], share[far])
                lo, hi, place = ranked(lo[~far], hi[~far], share[~far])
                full = place >= keep
                more = np.unique(np.concatenate([lo[full], hi[full]]))
                lo, hi = np.concatenate([x[rank < 1], lo[~full], more]), np.concatenate([y[rank < 1], hi[~full], more])
            both = np.unique(np.stack([lo, hi]), axis=1) if len(lo) else np.empty((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])
        if held is not None:
            yield named(held[0][-1:])

    return dealt.mapInArrow(scan, "a long, b long").distinct()


def crowded_rows(rows: DataFrame, found: DataFrame, staging: Staging, name: str) -> DataFrame:
    """The distinct rows (by key and node) of the regions that ``neighbour_pairs`` named in ``found``, written."""
    keys = staging.save(found.where("b is null").select(F.col("a").alias("key")), f"{name}-keys")
    few = F.broadcast(keys) if keys.count() < 2_000_000 else keys
    return staging.save(rows.join(few, "key", "left_semi").dropDuplicates(["key", "node"]), name)


def _block_pairs(rows: DataFrame, block: int, chars: int) -> DataFrame:
    """``rows`` (key, node, n, ...) once for each pair (x, y) of blocks of its region in which its own block takes part, sorted by it.

    Of regions that hold the same rows one is taken. A region is cut by hash into blocks of about ``block`` rows and ``chars``
    of the sum of n; every two of its rows meet in some pair of blocks.
    """
    members = [F.bit_xor(F.xxhash64("node", F.lit(k))) for k in (1, 2)]
    sums = rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("total"), members[0].alias("m1"), members[1].alias("m2")).where("rows > 1")
    sums = sums.groupBy("rows", "total", "m1", "m2").agg(F.min("key").alias("key"))
    sums = sums.select("key", F.expr(f"cast(greatest(ceil(rows / {block}), ceil(total / {chars}), 1) as int)").alias("blocks"))
    own = rows.join(sums, "key").withColumn("own", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
    others = F.expr("if(blocks = 1, array(0), filter(sequence(0, blocks - 1), i -> i <> own))")
    met = own.withColumn("o", F.explode(others)).withColumn("x", F.least("own", "o")).withColumn("y", F.greatest("own", "o")).drop("own", "o", "blocks", "n")
    return met.repartition(partitions(rows.sparkSession), "key", "x", "y").sortWithinPartitions("key", "x", "y", "node")


def _by_region(batches) -> Iterator[pa.Table]:
    """Sorted rows as one table for each (key, x, y)."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        if held is not None:
            rows = pa.concat_tables([held, rows])
        marks = [rows.column(c).to_numpy() for c in ("key", "x", "y")]
        cuts = np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0)) + 1
        for a, b in zip(np.r_[0, cuts[:-1]], cuts, strict=True) if len(cuts) else ():
            yield rows.slice(a, b - a)
        held = rows.slice(int(cuts[-1]) if len(cuts) else 0)
    if held is not None:
        yield held


def linked_within(sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``sets``: each set meets all that no link has reached yet."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    left, links = np.ones(len(sets), bool), []
    if len(sets) * len(values) <= 1 << 22:
        held = np.zeros((len(sets), len(values)), np.float32)
        held[owner, ids] = 1
        shared = (held @ held.T).astype(np.int64)
        alike = (shared > 0) & (den * shared >= num * (size[:, None] + size - shared))
        for seed in range(len(sets)):
            waiting = [seed] if left[seed] else []
            left[seed] = False
            while waiting:
                i = waiting.pop()
                now = np.flatnonzero(alike[i] & left)
                left[now] = False
                links += [(i, int(j)) for j in now]
                waiting += now.tolist()
        return links
    order = np.argsort(ids, kind="stable")
    holders, bounds = owner[order], np.searchsorted(ids[order], np.arange(ids.max(initial=-1) + 2))
    own = np.split(ids, np.cumsum(size)[:-1])
    left, links = np.ones(len(sets), bool), []
    for seed in range(len(sets)):
        waiting = [seed] if left[seed] else []
        left[seed] = False
        while waiting:
            i = waiting.pop()
            if not left.any():
                return links
            met = [holders[bounds[t] : bounds[t + 1]] for t in own[i]]
            common = np.bincount(np.concatenate(met), minlength=len(sets)) if met else np.zeros(len(sets), np.int64)
            now = np.flatnonzero(left & (common > 0) & (den * common >= num * (size[i] + size - common)))
            left[now] = False
            links += [(i, int(j)) for j in now]
            waiting += now.tolist()
    return links


def crowded_links(
    rows: DataFrame, texts: DataFrame, to_sets: Callable[[list[str]], list[np.ndarray]], *, num: int, den: int, block: int = 2_000, chars: int = 4_000_000
) -> DataFrame:
    """Links (a, b) that connect what exact links among all members of each region of ``rows`` (key, node) connect."""

    def run(batches):
        for region in _by_region(batches):
            nodes = region.column("node").to_pylist()
            links = linked_within(list(to_sets(region.column("text").to_pylist())), num, den)
            yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i, _ in links], pa.int64()), pa.array([nodes[j] for _, j in links], pa.int64())], names=["a", "b"])

    whole = rows.select("key", "node").join(texts.select("node", "text"), "node").withColumn("n", F.length("text").cast("long"))
    return _block_pairs(whole, block, chars).mapInArrow(run, "a long, b long").distinct()


def _meetings(rows: DataFrame, block: int, far_block: int, most: int) -> DataFrame:
    """``rows`` (key, node, part, n, ...) of regions of several parts, once for each meeting (x, y) in which they take part.

    Rows outside the part that has most of a region's rows are ``far``. They
    are cut by hash into ``x`` and all rows into ``y``, blocks of at most about
    ``far_block`` and ``block`` rows and ``most`` of the sum of n; ``seeks``
    marks the rows that take part by ``x``. Every far row meets every row.
    """
    by_part = rows.groupBy("key", "part").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("t"))
    sums = by_part.groupBy("key").agg(F.max(F.struct("c", "t", "part")).alias("main"), F.sum("c").alias("c"), F.sum("t").alias("t"), F.count(F.lit(1)).alias("parts"))
    blocks = "cast(greatest(ceil({c} / {size}), ceil({t} / {most}), 1) as int)"
    sums = sums.where("parts > 1").select(
        "key", F.col("main.part").alias("main"), F.expr(blocks.format(c="c", t="t", size=block, most=most)).alias("ys"),
        F.expr(blocks.format(c="(c - main.c)", t="(t - main.t)", size=far_block, most=most)).alias("xs"),
    )
    own = rows.join(sums, "key").withColumn("far", F.col("part") != F.col("main"))
    own = own.withColumns({"fx": F.expr("cast(pmod(xxhash64(node, 1), xs) as int)"), "fy": F.expr("cast(pmod(xxhash64(node, 2), ys) as int)")})
    met = "transform(sequence(0, {n} - 1), i -> named_struct('x', {x}, 'y', {y}, 'seeks', {seeks}))"
    found, seeking = met.format(n="xs", x="i", y="fy", seeks="false"), met.format(n="ys", x="fx", y="i", seeks="true")
    own = own.withColumn("m", F.explode(F.expr(f"if(far, concat({found}, {seeking}), {found})")))
    return own.select(*rows.columns, "far", "m.x", "m.y", "m.seeks")


def region_links(
    rows: DataFrame, texts: DataFrame, to_sets: Callable[[list[str]], list[np.ndarray]], staging: Staging, name: str, *,
    num: int, den: int, least: float, orders: np.ndarray, block: int = 500, far_block: int = 2_000, most: int = 500_000,
) -> DataFrame:
    """Links (a, b), confirmed on full sets, that join the parts of each region of ``rows`` (key, node, sig, tree, n, part).

    All pairs of a region's rows of different parts are held against each
    other; those with a share of at least ``least`` of equal signature bytes,
    for which this order (``tree``) is the first with their longest common
    prefix, are confirmed where they meet, best first, unless links connect
    them already. So a region of any size gives a forest for each meeting, and
    its pairs are never listed. Texts (node, text) travel only to meetings in
    which their node has such a pair. ``n`` is the size of a node's set.
    """
    dealt = lambda df: df.repartition(partitions(rows.sparkSession), "key", "x", "y").sortWithinPartitions("key", "x", "y", "node", "seeks")

    def pairs(region):
        """Seeking and other row of each candidate pair of a meeting, best first."""
        cols = {c: region.column(c).to_numpy() for c in ("node", "part", "n", "far", "seeks", "tree")}
        sig = np.frombuffer(b"".join(region.column("sig").to_pylist()), np.uint8).reshape(region.num_rows, -1)
        u, v = np.flatnonzero(cols["seeks"]), np.flatnonzero(~cols["seeks"])
        columns, needed = np.ascontiguousarray(sig[v].T), least * sig.shape[1] - 1e-9
        out = [(np.empty(0, np.int64),) * 3]
        for some in np.array_split(u, max(1, len(u) >> 7)) if len(u) and len(v) else ():
            equal = np.zeros((len(some), len(v)), np.uint8)
            for c, column in enumerate(columns):
                equal += sig[some, c][:, None] == column
            i, j = np.nonzero((equal >= needed) & (cols["part"][some][:, None] != cols["part"][v]))
            share, i, j = equal[i, j].astype(np.int64), some[i], v[j]
            low, high = np.minimum(cols["n"][i], cols["n"][j]), np.maximum(cols["n"][i], cols["n"][j])
            fit = (den * low >= num * high) & (~cols["far"][j] | (cols["node"][i] < cols["node"][j]))  # two far rows meet twice
            share, i, j = share[fit], i[fit], j[fit]
            if len(i):
                longest = [common_prefixes(sig[i[x]] == sig[j[x]], orders).argmax(1) for x in np.array_split(np.arange(len(i)), max(1, len(i) >> 11))]
                here = np.concatenate(longest) == cols["tree"][i]
                out.append((share[here], i[here], j[here]))
        share, i, j = (np.concatenate(x) for x in zip(*out, strict=True))
        best = np.argsort(-share, kind="stable")
        return i[best], j[best]

    def named(batches):
        for region in _by_region(batches):
            at = np.unique(np.concatenate(pairs(region)))
            if len(at):
                yield from region.select(["key", "x", "y", "seeks", "node"]).take(pa.array(at)).to_batches()

    def confirmed(batches):
        for region in _by_region(batches):
            i, j = pairs(region)
            node, part = region.column("node").to_pylist(), region.column("part").to_pylist()
            sets = [frozenset(x.tolist()) for x in to_sets(region.column("text").to_pylist())]
            known, links = UnionFind(), []
            for a, b in zip(i.tolist(), j.tolist(), strict=True):
                if known.find(part[a]) != known.find(part[b]):
                    common = len(sets[a] & sets[b])
                    if den * common >= num * (len(sets[a]) + len(sets[b]) - common) > 0:
                        known.join(part[a], part[b])
                        links.append((node[a], node[b]))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["a", "b"])

    met = _meetings(rows, block, far_block, most)
    needed = staging.save(dealt(met).mapInArrow(named, "key long, x int, y int, seeks boolean, node long"), f"{name}-needed")
    whole = met.join(needed, ["key", "x", "y", "seeks", "node"], "left_semi").join(texts.select("node", "text"), "node")
    return dealt(whole).mapInArrow(confirmed, "a long, b long").distinct()


def linked_pairs(pairs: DataFrame, texts: DataFrame, to_sets: Callable[[list[str]], list[np.ndarray]], *, num: int, den: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets pass den * intersection >= num * union; for short ``texts`` (node, text), which travel with each pair."""

    def run(batches):
        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            first, second = batch.column("first").to_pylist(), batch.column("second").to_pylist()
            linked = np.zeros(len(a), bool)
            for i, j in portions([x + y for x, y in zip(first, second, strict=True)]):
                sets = list(to_sets(first[i:j] + second[i:j]))
                for k, (x, y) in enumerate(zip(sets[: j - i], sets[j - i :], strict=True)):
                    least, most = sorted((len(x), len(y)))
                    if den * least >= num * most:
                        common = len(np.intersect1d(x, y, assume_unique=True))
                        linked[i + k] = den * common >= num * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([pa.array(a[linked]), pa.array(b[linked])], names=["a", "b"])

    side = lambda c, t: texts.select(F.col("node").alias(c), F.col("text").alias(t))
    return pairs.join(side("a", "first"), "a").join(side("b", "second"), "b").select("a", "b", "first", "second").mapInArrow(run, "a long, b long")


def verified_links(
    pairs: DataFrame,
    texts: DataFrame,
    to_sets: Callable[[list[str]], list[np.ndarray]],
    staging: Staging,
    name: str,
    *,
    num: int,
    den: int,
    block_chars: int = 1_000_000,
) -> DataFrame:
    """Links (a, b) among ``pairs`` whose sets pass den * intersection >= num * union, exactly.

    ``texts``: (node, text) of the nodes in ``pairs`` at least, best a written
    table. Nodes of one candidate group are hashed into blocks of about
    ``block_chars`` characters, and each pair of blocks meets in one task
    with both blocks' texts: a text travels once for each partner block, not
    once for each pair. Within a task, pairs that links already connect are
    passed over, so the links are a spanning forest there.
    """
    groups = connected_components(pairs, staging, f"{name}-groups")
    near = F.broadcast if groups.count() <= _FEW else lambda df: df
    sized = staging.save(texts.select("node", F.length("text").cast("long").alias("n")).join(near(groups), "node"), f"{name}-sizes")
    total = sized.agg(F.sum("n")).first()[0] or 0
    tasks = max(1, -(-int(total) // block_chars))
    sums = sized.groupBy("component").agg(F.sum("n").alias("total"))
    nodes = sized.join(near(sums), "component").select(
        "node", "component", F.expr(f"pmod(xxhash64(node), cast(ceil((total + 1) / {block_chars}) as bigint))").alias("block")
    )
    nodes = staging.save(nodes, f"{name}-nodes")
    x, y = nodes.alias("x"), nodes.alias("y")
    placed = (
        pairs.join(near(x), F.col("a") == F.col("x.node"))
        .join(near(y), F.col("b") == F.col("y.node"))
        .select("a", "b", F.expr(f"pmod(xxhash64(x.component, least(x.block, y.block), greatest(x.block, y.block)), {tasks})").alias("task"))
    )
    placed = staging.save(placed, f"{name}-placed")
    needed = placed.select(F.col("task").alias("into"), F.explode(F.array("a", "b")).alias("node")).distinct().join(texts.select("node", "text"), "node")

    def verify(pair_rows: pa.Table, text_rows: pa.Table) -> pa.Table:
        nodes = text_rows.column("node").to_pylist()
        sets = dict(zip(nodes, (set(s.tolist()) for s in to_sets(text_rows.column("text").to_pylist())), strict=True))
        links, known = [], UnionFind()
        for a, b in zip(pair_rows.column("a").to_pylist(), pair_rows.column("b").to_pylist(), strict=True):
            if known.find(a) == known.find(b) or a not in sets or b not in sets:
                continue
            common = len(sets[a] & sets[b])
            union = len(sets[a]) + len(sets[b]) - common
            if union and den * common >= num * union:
                known.join(a, b)
                links.append((a, b))
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    links = placed.groupBy("task").cogroup(needed.groupBy("into")).applyInArrow(verify, "a long, b long")
    links = staging.save(links, f"{name}-links")
    staging.drop(f"{name}-sizes", f"{name}-nodes", f"{name}-placed")
    return links
