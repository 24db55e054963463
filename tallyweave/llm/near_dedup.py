"""Near-duplicate documents: LSH forest over MinHash signatures, exact Jaccard verification, components."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staging, join_counted
from .components import connected_components
from .similarity import crowded_rows, mixed, neighbour_pairs, portions, region_links, verified_links, word_hashes

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_HASHES, _TREES, _FIRST, _DEPTH = 192, 24, 5, 12
_RNG = np.random.default_rng(20240607)
_MULTIPLY = _RNG.integers(0, 1 << 63, _HASHES, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_XOR = _RNG.integers(0, 1 << 63, _HASHES, dtype=np.uint64)
_ORDERS = np.stack([_RNG.permutation(_HASHES)[:_DEPTH] for _ in range(_TREES)])


def estimate_floor(threshold: float, loss: float = 1e-5) -> float:
    """Largest share of equal values that a pair at ``threshold`` falls short of with a probability below ``loss`` (exact binomial)."""
    below = 0.0
    for c in range(_HASHES + 1):
        below += math.comb(_HASHES, c) * threshold**c * (1 - threshold) ** (_HASHES - c)
        if below >= loss:
            return c / _HASHES
    return 1.0


def _sequence(words: np.ndarray) -> np.uint64:
    h = np.array([len(words)], np.uint64)
    for k in range(len(words)):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + words[k : k + 1])
    return h[0]


def shingle_sets(texts: list[str | None], words_each: int) -> Iterator[np.ndarray]:
    """For every text the sorted distinct 64-bit hashes of its word shingles (A-Z lower-cased)."""
    raws = [(t or "").encode().lower() for t in texts]
    for a, b in portions(raws, 1 << 18):
        codes = np.frombuffer(b" " + b" ".join(raws[a:b]) + b" ", np.uint8)
        space = _SPACE[codes]
        starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
        words = word_hashes(codes, starts, ends)
        bounds = np.searchsorted(starts, np.cumsum([1] + [len(r) + 1 for r in raws[a:b]]))
        n = len(words) - words_each + 1
        rolled = np.zeros(max(n, 0), np.uint64)
        for k in range(words_each if n > 0 else 0):
            rolled = rolled * np.uint64(0x2545F4914F6CDD1D) + mixed(words[k : k + n] + np.uint64(k + 1))
        rolled = mixed(rolled)
        for i, j in zip(bounds[:-1], bounds[1:], strict=True):
            if j - i >= words_each:
                yield np.unique(rolled[i : j - words_each + 1])
            else:
                yield np.array([_sequence(words[i:j])] if j > i else [], np.uint64)


def minhash(values: np.ndarray) -> np.ndarray:
    """One byte of the minimum under each of the fixed hash functions."""
    least = np.full(_HASHES, np.iinfo(np.uint64).max)
    for k in range(0, len(values), 4096):
        np.minimum(least, ((values[k : k + 4096, None] ^ _XOR) * _MULTIPLY).min(0), out=least)
    return (mixed(least) >> np.uint64(56)).astype(np.uint8)


def _tree_keys(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each document and order: the region (first values, hashed with the order) and the next values as a number."""
    taken = sig[:, _ORDERS].astype(np.uint64)
    key = np.broadcast_to(np.arange(1, _TREES + 1, dtype=np.uint64), taken.shape[:2])
    for k in range(_FIRST):
        key = key * np.uint64(257) + taken[:, :, k]
    deep = np.zeros(taken.shape[:2], np.uint64)
    for k in range(_FIRST, _DEPTH):
        deep = deep << np.uint64(8) | taken[:, :, k]
    return mixed(key).view(np.int64), deep.view(np.int64)


def signatures(docs: DataFrame, shingle_words: int) -> DataFrame:
    """doc, mark (of the text), n (set size), d1, d2 (digest of the set), sig, keys, deeps for (doc_id, text); nulls where the set is empty."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                part = batch.slice(k, 2048)
                size, digest, sig = [], [], []
                for values in shingle_sets(part.column("text").to_pylist(), shingle_words):
                    size.append(len(values))
                    digest.append(np.frombuffer(hashlib.blake2b(values.tobytes(), digest_size=16).digest(), np.int64) if len(values) else None)
                    sig.append(minhash(values))
                keys, deeps = _tree_keys(np.stack(sig))
                empty = [not n for n in size]
                lists = [
                    pa.array([None if e else x for x, e in zip(m.tolist(), empty, strict=True)], pa.list_(pa.int64())) for m in (keys, deeps)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), part.column("mark"), pa.array(size, pa.int64()),
                        pa.array([None if d is None else int(d[0]) for d in digest], pa.int64()),
                        pa.array([None if d is None else int(d[1]) for d in digest], pa.int64()),
                        pa.array([None if e else s.tobytes() for s, e in zip(sig, empty, strict=True)], pa.binary()), *lists,
                    ],
                    names=["doc", "mark", "n", "d1", "d2", "sig", "keys", "deeps"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark")).mapInArrow(
        run, "doc long, mark long, n long, d1 long, d2 long, sig binary, keys array<long>, deeps array<long>"
    )


def near_duplicates(
    docs: DataFrame, *, shingle_words: int = 5, num: int = 80, den: int = 100, window: int = 64, staging: Staging | None = None
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of (doc_id, text).

    Documents are linked where den * intersection >= num * union of their sets
    of distinct word shingles. ``component_id`` is the smallest doc_id that
    links reach, and the document with it is kept.

    LSH forest: each of 24 orders of the MinHash values sorts the signatures;
    documents that agree on an order's first five values form a region, and
    all pairs of a region are compared by their share of equal values (of
    192): in the sorted order where it has at most ``window`` + 1 documents,
    in blocks where it has more. Candidates are those whose share a pair at
    the threshold falls short of with a probability below 1e-5. A document first gives the likeliest
    candidate of an order within the window, and one with more in a short region gives all of them in a second round,
    against other components only. The rows of a long region that are outside
    its largest component then meet all its rows, and links are confirmed
    where they meet. All links are confirmed on the full sets. A pair at 0.85 shares a region of some order
    with a probability of 1 - 1e-6 (at 0.8: 1 - 1e-4). Equal sets are one node from the start, so
    that copies cost nothing.

    Texts with fewer words than a shingle count as one shingle; null, empty
    and blank texts have none and are linked with nothing. A row with a null
    doc_id is linked with nothing, has a null component and is kept. Rows that
    repeat a doc_id are documents of their own: each gets the component of its
    own set. No rows give no rows; further columns of ``docs`` are not looked at.
    """
    return _decided(docs, shingle_words, num, den, window, staging).drop("mark")


def _decided(docs: DataFrame, shingle_words: int, num: int, den: int, window: int, staging: Staging | None) -> DataFrame:
    """``near_duplicates`` with ``mark``, the hash of a row's text.

    Sets are nodes, named by the smallest doc_id that has them; sets that would
    share a name, as rows repeat a doc_id, are named by their digests.
    """
    spark = docs.sparkSession
    staging = staging or Staging(spark, "near")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = staging.save(signatures(docs, shingle_words), "signed")
    known = signed.where("doc is not null and d1 is not null").groupBy("d1", "d2").agg(F.min("doc").alias("rep"))
    known = staging.save(known, "known")
    twice = staging.save(known.groupBy("rep").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("rep", F.lit(True).alias("twice")), "twice")
    repeated = not twice.isEmpty()
    node = F.when(F.col("twice"), F.col("d1")).otherwise(F.col("rep")) if repeated else F.col("rep")
    equal = known.join(twice, "rep", "left").select("d1", "d2", "rep", node.alias("node")) if repeated else known.withColumn("node", node)
    equal = staging.save(equal, "equal") if repeated else equal
    first = equal.select(F.col("rep").alias("doc"), "d1", "d2", "node")
    reps = signed.join(first, ["doc", "d1", "d2"])
    regions = reps.select("node", F.explode("keys").alias("key"))
    shared = regions.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    near = regions.join(shared, "key", "left_semi").select("node").distinct()
    active = staging.save(reps.select("node", "doc", "mark", "n", "sig", "keys", "deeps").dropDuplicates(["node"]).join(near, "node", "left_semi"), "active")

    marked = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("mark"), "text")
    bodies = staging.save(active.select("node", "doc", "mark").join(marked, ["doc", "mark"]).select("node", "text").dropDuplicates(["node"]), "bodies")
    active = active.drop("doc", "mark")
    to_sets = lambda t: list(shingle_sets(t, shingle_words))
    least = estimate_floor(num / den)
    links, parts, todo, crowded, searched = None, None, active, None, None
    for k, keep in enumerate((1, 2 * window * _TREES)):  # a node of short regions has fewer pairs than the second
        rows = todo.select("node", "n", "sig", *(["part"] if k else []), F.posexplode(F.arrays_zip("keys", "deeps")).alias("tree", "z"))
        rows = rows.select("*", F.col("z.keys").alias("key"), F.col("z.deeps").alias("deep")).drop("z")
        rows = rows.join(searched, "key", "left_anti") if k else rows
        near = staging.save(neighbour_pairs(rows, window=window, keep=keep, least=least, orders=_ORDERS), f"near-{k}")
        new = verified_links(near.where("a <> b"), bodies, to_sets, staging, f"verify-{k}", num=num, den=den)
        links = links.unionByName(new) if k else new
        parts = connected_components(links, staging, f"parts-{k}")
        now = crowded_rows(rows.select("key", "node", "n", "sig", "tree"), near, staging, f"crowded-{k}")
        crowded = crowded.unionByName(now) if k else now
        more = near.where("a = b").select(F.col("a").alias("node"))
        if more.isEmpty():
            break
        searched = near.where("b is null").select(F.col("a").alias("key"))
        todo = active.join(more, "node", "left_semi").join(parts, "node", "left").withColumn("part", F.coalesce("component", "node"))
    crowded = crowded.join(parts, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
    new = staging.save(region_links(crowded, bodies, to_sets, staging, "regions", num=num, den=den, least=least, orders=_ORDERS), "regions")
    staging.drop("near-0", "near-1", "crowded-0", "crowded-1", "crowded-0-keys", "crowded-1-keys", "regions-needed")
    if not new.isEmpty():
        parts = connected_components(links.unionByName(new), staging, "joined")
    parts = parts.withColumn("least", F.col("component"))
    if repeated:  # a component's smallest node need not be its smallest doc_id
        linked = staging.save(parts.drop("least").join(equal.select("node", "rep"), "node"), "linked")
        least = staging.save(linked.groupBy("component").agg(F.min("rep").alias("least"), F.count(F.lit(1)).alias("of")), "least")
        parts = join_counted(linked.drop("rep"), least, "component", "of")
    return (
        signed.select("doc", "mark", "n", "d1", "d2")
        .join(equal, ["d1", "d2"], "left")
        .join(parts.select("node", "least"), "node", "left")
        .select(
            F.col("doc").alias("doc_id"),
            "mark",
            F.col("n").alias("n_shingles"),
            F.when(F.col("doc").isNotNull(), F.coalesce("least", "rep", "doc")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def keep_one_of_each(docs: DataFrame, *, shingle_words: int = 5, num: int = 80, den: int = 100, window: int = 64, staging: Staging | None = None) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, with all their columns, whatever their names."""
    gone = _decided(docs.select("doc_id", "text"), shingle_words, num, den, window, staging).where("not kept").select(F.col("doc_id").alias("doc"), "mark").distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("mark"))
    return rows.join(gone, ["doc", "mark"], "left_anti").select("row.*")
