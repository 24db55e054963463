"""Approximate nearest neighbours by an inverted multi-index, reranked exactly."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from .common import Staging, hash32


@dataclass
class Codebooks:
    """Centroids of the two vector halves (each k x half the dimensions)."""

    first: np.ndarray
    second: np.ndarray

    @property
    def dims(self) -> int:
        return self.first.shape[1] + self.second.shape[1]


def usable(vectors: list, dims: int) -> list[int]:
    """Places of the vectors that take part: of ``dims`` finite components, not all zero."""
    out = []
    for k, v in enumerate(vectors):
        if v is not None and len(v) == dims and None not in v:
            x = np.asarray(v, np.float64)
            if np.isfinite(x).all() and x.any():
                out.append(k)
    return out


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def fit_codebooks(vectors: DataFrame, *, vector_col: str, centroids: int = 128, sample: int = 20_000, seed: int = 9) -> Codebooks | None:
    """Centroids of each half by k-means in numpy over a hash sample of about ``sample`` rows (the bound on what is sent to the driver)."""
    shape = vectors.where(F.col(vector_col).isNotNull()).groupBy(F.size(vector_col).alias("d")).count().orderBy(F.desc("count"), "d").first()
    if shape is None or shape["d"] < 1:
        return None
    chance = hash32(F.concat(F.lit("ann:"), F.to_json(F.struct(vector_col)))) / F.lit(4294967296.0)
    rows = vectors.where(F.size(vector_col) == shape["d"]).where(chance < min(1.0, sample / shape["count"])).select(vector_col).toArrow().column(0).to_pylist()
    x = np.array([rows[k] for k in usable(rows, shape["d"])], np.float64)
    if not len(x):
        return None
    x = x[np.lexsort(x.T)]
    rng, half = np.random.default_rng(seed), shape["d"] // 2
    return Codebooks(_kmeans(x[:, :half], centroids, rng), _kmeans(x[:, half:], centroids, rng))


def _cells(x: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    half = books.first.shape[1]
    near = lambda part, c: ((c**2).sum(1) - 2 * part @ c.T).argmin(1) if c.shape[1] else np.zeros(len(part), int)
    return near(x[:, :half], books.first), near(x[:, half:], books.second)


def build_index(vectors: DataFrame, books: Codebooks, *, id_col: str, vector_col: str) -> DataFrame:
    """id, vector (double), c1, c2: every vector that takes part under its pair of centroids."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        for batch in batches:
            rows = batch.column("vector").to_pylist()
            at = usable(rows, shared.value.dims)
            x = np.array([rows[k] for k in at], np.float64).reshape(len(at), shared.value.dims)
            c1, c2 = _cells(x, shared.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(at, pa.int64())), pa.array(list(x), pa.list_(pa.float64())), pa.array(c1, pa.int32()), pa.array(c2, pa.int32())],
                names=["id", "vector", "c1", "c2"],
            )

    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return rows.mapInArrow(run, "id long, vector array<double>, c1 int, c2 int")


def walk(query: np.ndarray, books: Codebooks, counts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Filled pairs of centroids by falling sum of the halves' inner products.

    The multi-sequence walk: both halves are sorted, and a pair enters the
    heap once its two predecessors are out.
    """
    half = books.first.shape[1]
    a, b = books.first @ query[:half], books.second @ query[half:]
    ia, ib = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
    filled = counts[np.ix_(ia, ib)].astype(bool).tolist()
    a, b, ia, ib = (-a[ia]).tolist(), (-b[ib]).tolist(), ia.tolist(), ib.tolist()
    heap = [(a[0] + b[0], 0, 0)]
    passed = [-1] * len(ia)
    while heap:
        _, i, j = heapq.heappop(heap)
        passed[i] = j
        if filled[i][j]:
            yield ia[i], ib[j]
        if i + 1 < len(ia) and passed[i + 1] == j - 1:
            heapq.heappush(heap, (a[i + 1] + b[j], i + 1, j))
        if j + 1 < len(ib) and (i == 0 or passed[i - 1] >= j + 1):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))


def probe_order(query: np.ndarray, books: Codebooks, counts: np.ndarray, wanted: int) -> list[tuple[int, int]]:
    """The first cells of the walk, until they hold ``wanted`` entries."""
    out, have = [], 0
    for cell in walk(query, books, counts):
        if have >= wanted:
            break
        out.append(cell)
        have += counts[cell]
    return out


def _best(ids: np.ndarray, score: np.ndarray, k: int, unique: bool) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id, an id once (with its best score)."""
    at = np.arange(len(ids))
    if unique and len(at) > k:
        at = np.flatnonzero(score >= np.partition(score, -k)[-k])
    at = at[np.lexsort((ids[at], -score[at]))]
    if not unique:
        at = at[np.sort(np.unique(ids[at], return_index=True)[1])]
    return at[:k]


def entries_needed(index: DataFrame, queries: DataFrame, books: Codebooks, counts: np.ndarray, *, k: int, recall: float, trials: int) -> int:
    """How many entries a walk must reach so that a share ``recall`` of true neighbours is among them.

    Measured on a hash sample of about ``trials`` queries (the bound on what
    is sent to the driver and broadcast): their k true neighbours are found
    by brute force over all entries, and for each the entries that the walk
    reaches up to its cell are counted.
    """
    n = queries.count()
    chance = hash32(F.concat(F.lit("trial:"), F.col("id").cast("string"))) / F.lit(4294967296.0)
    rows = queries.where(chance < min(1.0, trials / max(1, n))).select("id", "vector").toArrow()
    if not rows.num_rows:
        return int(counts.sum())
    asked, x = rows.column("id").to_numpy(), np.array(rows.column("vector").to_pylist(), np.float64)
    shared = index.sparkSession.sparkContext.broadcast((asked, x))

    def run(batches):
        asked, x = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("id").to_numpy()
            c1, c2 = batch.column("c1").to_numpy(), batch.column("c2").to_numpy()
            score = batch.column("vector").flatten().to_numpy().reshape(len(ids), -1) @ x.T
            for q in range(len(asked)):
                other = np.flatnonzero(ids != asked[q])
                at = other[_best(ids[other], score[other, q], k, False)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), q, np.int32)), pa.array(ids[at]), pa.array(score[at, q]), pa.array(c1[at]), pa.array(c2[at])],
                    names=["q", "id", "score", "c1", "c2"],
                )

    found = index.mapInArrow(run, "q int, id long, score double, c1 int, c2 int").dropDuplicates(["q", "id"])
    best = W.partitionBy("q").orderBy(F.desc("score"), "id")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("q", "c1", "c2").collect()
    cells: dict[int, list] = {}
    for r in found:
        cells.setdefault(r["q"], []).append((r["c1"], r["c2"]))
    reached = []
    for q, wanted in cells.items():
        have, left = 0, set(wanted)
        for cell in walk(x[q], books, counts):
            have += int(counts[cell])
            if cell in left:
                reached += [have] * wanted.count(cell)
                left.discard(cell)
                if not left:
                    break
    return int(np.quantile(reached, recall, method="higher")) if reached else int(counts.sum())


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    return vectors.combine_chunks().flatten().to_numpy().reshape(len(vectors), -1)


def _nearest_of_cells(entries: pa.Table, queries: pa.Table, k: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query id, entry id, score: the k best entries in the opened cells of each query.

    Of equal vectors only the k + 1 smallest ids can be among anyone's k
    nearest, so the others are put aside first. A matrix product over some
    queries at a time finds the entries near the k-th score; those few are
    scored again one by one, so that equal vectors get equal scores.
    """
    if not entries.num_rows or not queries.num_rows:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    ids, c2, x = entries.column("id").to_numpy(), entries.column("c2").to_numpy(), _matrix(entries.column("vector"))
    same = np.unique(x, axis=0, return_inverse=True)[1].ravel()
    order = np.lexsort((ids, same))
    order = order[np.r_[True, (np.diff(ids[order]) != 0) | (np.diff(same[order]) != 0)]]
    place = np.arange(len(order)) - np.searchsorted(same[order], same[order])
    order = order[place <= k]
    order = order[np.argsort(ids[order], kind="stable")]
    ids, c2, x = ids[order], c2[order], x[order]
    starts = np.flatnonzero(np.r_[True, np.diff(ids) != 0])
    longest = np.sqrt((x**2).sum(1)).max()

    asked, v = queries.column("query_id").to_numpy(), _matrix(queries.column("query"))
    cells = queries.column("cells").combine_chunks()
    opened = np.zeros((len(asked), width), bool)
    opened[np.repeat(np.arange(len(asked)), cells.value_lengths().to_numpy()), cells.flatten().to_numpy()] = True

    out, step = [], max(1, 1_000_000 // len(ids))
    for at in range(0, len(asked), step):
        q, some = v[at : at + step], asked[at : at + step]
        s = np.where(opened[at : at + step][:, c2] & (some[:, None] != ids), q @ x.T, -np.inf)
        per_id = s if len(starts) == len(ids) else np.maximum.reduceat(s, starts, axis=1)
        least = np.partition(per_id, -k, axis=1)[:, -k] if per_id.shape[1] > k else np.full(len(q), -np.inf)
        slack = 1e-12 * longest * np.sqrt((q**2).sum(1))
        j, e = np.nonzero((s >= (least - slack)[:, None]) & (s > -np.inf))
        score = (x[e] * q[j]).sum(1)
        by = np.lexsort((ids[e], -score, j))
        if len(starts) < len(ids):
            pair = j[by] * len(ids) + np.searchsorted(ids, ids[e[by]])
            by = by[np.sort(np.unique(pair, return_index=True)[1])]
        by = by[np.arange(len(by)) - np.searchsorted(j[by], j[by]) < k]
        out.append((some[j[by]], ids[e[by]], score[by]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def nearest_neighbours(
    vectors: DataFrame, queries: DataFrame, *, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = 0.96, trials: int = 256, centroids: int = 128, sample: int = 20_000, staging: Staging | None = None
) -> DataFrame:
    """query_id, rank, vec_id, score: the k entries of largest inner product for each row of ``queries``.

    Both tables have ``id_col`` and ``vector_col``. Codebooks come from a
    bounded sample; every row is indexed. A query opens the most promising
    pairs of centroids and reranks their entries by the inner product in
    double precision, ties to the smaller id. How many entries it opens
    follows the table: as many as reach a share ``recall`` of the true
    neighbours of about ``trials`` queries (``entries_needed``), and at least
    4 * k. Entries with the query's id are left out; a query with fewer than
    k others gets them all.

    Entries of a first-half centroid meet its queries in tasks of bounded
    size: a crowded centroid is cut by hash into blocks of entries and blocks
    of queries. Vectors that are null, zero, of another length than most, or
    hold null or non-finite components take no part, nor do null ids. Of
    queries that repeat an id the smallest vector counts; an entry id that
    repeats is given once, with its best score.
    """
    empty = "query_id long, rank int, vec_id long, score double"
    spark = vectors.sparkSession
    books = fit_codebooks(vectors, vector_col=vector_col, centroids=centroids, sample=sample)
    if books is None:
        return spark.createDataFrame([], empty)
    staging = staging or Staging(spark, "ann")
    index = staging.save(build_index(vectors, books, id_col=id_col, vector_col=vector_col), "index")
    counts = np.zeros((len(books.first), len(books.second)), np.int64)
    for r in index.groupBy("c1", "c2").count().collect():  # at most centroids squared rows
        counts[r["c1"], r["c2"]] = r["count"]
    asked = build_index(queries, books, id_col=id_col, vector_col=vector_col).groupBy("id").agg(F.min("vector").alias("vector"))
    asked = staging.save(asked, "queries")
    walkers = max(1, -(-asked.count() // 256))
    wanted_entries = max(4 * k, entries_needed(index, asked, books, counts, k=k, recall=recall, trials=trials))
    shared = spark.sparkContext.broadcast((books, counts))

    def probe(batches):
        books, counts = shared.value
        for batch in batches:
            ids, vecs, c1s, c2s = [], [], [], []
            for i, v in zip(batch.column("id").to_pylist(), batch.column("vector").to_pylist(), strict=True):
                cells: dict[int, list[int]] = {}
                for a, b in probe_order(np.asarray(v), books, counts, wanted_entries):
                    cells.setdefault(a, []).append(b)
                for a, b in cells.items():
                    ids.append(i)
                    vecs.append(v)
                    c1s.append(a)
                    c2s.append(b)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(vecs, pa.list_(pa.float64())), pa.array(c1s, pa.int32()), pa.array(c2s, pa.list_(pa.int32()))],
                names=["query_id", "query", "c1", "cells"],
            )

    probes = staging.save(asked.repartition(walkers, "id").mapInArrow(probe, "query_id long, query array<double>, c1 int, cells array<int>"), "probes")
    per_task = {r["c1"]: max(1, -(-r["count"] // 4_000)) for r in probes.groupBy("c1").count().collect()}
    pieces = {c: max(1, -(-int(n) // 20_000)) for c, n in enumerate(counts.sum(1)) if n}
    cuts = lambda of: F.create_map(*[F.lit(int(x)) for kv in (of or {0: 1}).items() for x in kv])[F.col("c1")]
    q_cuts, e_cuts = F.coalesce(cuts(per_task), F.lit(0)), F.coalesce(cuts(pieces), F.lit(1))
    entries = index.withColumn("e", F.pmod(F.xxhash64("id"), e_cuts)).withColumn("q", F.explode(F.transform(F.array_repeat(F.lit(0), q_cuts), lambda _, i: i)))
    wanted = probes.withColumn("q", F.pmod(F.xxhash64("query_id"), q_cuts).cast("int")).withColumn("e", F.explode(F.transform(F.array_repeat(F.lit(0), e_cuts), lambda _, i: i)))
    keys = lambda df, p: df.withColumn(f"{p}_task", F.xxhash64(F.col("c1").cast("long"), F.col("e").cast("long"), F.col("q").cast("long")))

    def rerank(entry_rows: pa.Table, query_rows: pa.Table) -> pa.Table:
        asked, ids, score = _nearest_of_cells(entry_rows, query_rows, k, len(shared.value[0].second))
        return pa.table({"query_id": pa.array(asked, pa.int64()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(score, pa.float64())})

    found = (
        keys(entries.select("id", "vector", "c1", "c2", "e", "q"), "e").groupBy("e_task")
        .cogroup(keys(wanted, "q").groupBy("q_task")).applyInArrow(rerank, "query_id long, vec_id long, score double")
    )
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
