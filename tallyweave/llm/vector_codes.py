"""Vector code compression: product codes from exact integer Lloyd rounds over pairs of trees.

Tasks cut vectors into blocks and build, for each part position, a tree of
boxes with the sum and number of the parts below every node; these are written
once. A round walks that tree together with a tree over the codebook: bounds
between boxes drop entries that cannot be nearest, a node with one entry left
is assigned whole by its cached sum, and only leaves with several left compare
single parts. All numbers are integers, so blocks and partitions do not matter.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staging, join_counted

_BLOCK, _LEAF = 4096, 32
_WIDE = (np.float64(2) ** 62).item()


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles; Python integers where 64 bits do not hold the result."""
    scaled = np.floor(values * float(scale))
    if not scaled.size or np.abs(scaled).max() < _WIDE:
        return scaled.astype(np.int64)
    return np.array([[int(x) for x in row] for row in scaled.tolist()], object)


def _top(points: np.ndarray) -> int:
    return int(np.abs(points).max()) if points.size else 0


def build_tree(points: np.ndarray, leaf: int) -> dict:
    """A balanced tree of boxes over points (n x m): places in leaf order (negative: filling) and lo, hi, sum, count by level."""
    n, m = points.shape
    depth = 0
    while (n >> depth) > leaf or (n > leaf << depth):
        depth += 1
    each = -(-n // (1 << depth))
    at = np.minimum(np.arange(each << depth), n - 1)
    real = np.arange(each << depth) < n
    for k in range(depth):
        boxes = points[at].reshape(1 << k, -1, m)
        axis = (boxes.max(1) - boxes.min(1)).argmax(1) if m else np.zeros(1 << k, int)
        order = (np.take_along_axis(boxes, axis[:, None, None], 2)[:, :, 0] if m else boxes.sum(2)).argsort(axis=1, kind="stable")
        at = np.take_along_axis(at.reshape(1 << k, -1), order, 1).ravel()
        real = np.take_along_axis(real.reshape(1 << k, -1), order, 1).ravel()
    held = points[at]
    weighed = held * real[:, None]
    levels = []
    for k in range(depth + 1):
        boxes = held.reshape(1 << k, -1, m)
        levels.append((boxes.min(1), boxes.max(1), weighed.reshape(1 << k, -1, m).sum(1), real.reshape(1 << k, -1).sum(1)))
    return {"at": np.where(real, at, ~at).astype(np.int32), "points": held, "levels": levels}


def _bounds(lo, hi, other_lo, other_hi):
    """Least and largest squared distance between boxes, all against all."""
    lo, hi = lo[:, None], hi[:, None]
    gap = np.maximum(np.maximum(lo - other_hi, other_lo - hi), 0)
    reach = np.maximum(hi - other_lo, other_hi - lo)
    return (gap * gap).sum(2), (reach * reach).sum(2)


def _exact(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances, points x entries."""
    out = np.zeros((len(points), len(book)), points.dtype)
    for k in range(book.shape[1]):
        d = points[:, k][:, None] - book[:, k][None, :]
        out += d * d
    return out


def walk(tree: dict, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict]:
    """Nearest entry of every place of ``tree`` (ties to the lower index), sums and counts by entry, and how nodes were settled."""
    entries = build_tree(book, 1)
    leaf_entry = np.where(entries["at"] >= 0, entries["at"], 0)
    depth, deep = len(tree["levels"]) - 1, len(entries["levels"]) - 1
    each = len(tree["at"]) >> depth
    m = book.shape[1]
    code = np.zeros(len(tree["at"]), np.int64)
    sums, counts = np.zeros(book.shape, tree["points"].dtype), np.zeros(len(book), np.int64)
    nodes, alive = np.zeros(1, np.int64), np.ones((1, 1), bool)
    level = e = 0
    settled = {"whole": 0, "single": 0, "pruned": 0}
    while len(nodes):
        lo, hi, total, number = (x[nodes] for x in tree["levels"][level])
        entry_lo, entry_hi, _, filled = entries["levels"][e]
        alive &= filled > 0
        least, most = _bounds(lo, hi, entry_lo, entry_hi)
        bound = np.where(alive, most, most.max() + 1).min(1)
        settled["pruned"] += int((alive & (least > bound[:, None])).sum())
        alive &= least <= bound[:, None]
        if e == deep:
            one = alive.sum(1) == 1
            width = each << (depth - level)
            if one.any():
                best = leaf_entry[alive[one].argmax(1)]
                np.add.at(sums, best, total[one])
                np.add.at(counts, best, number[one])
                code[(nodes[one][:, None] * width + np.arange(width)).ravel()] = np.repeat(best, width)
                settled["whole"] += int(number[one].sum())
            nodes, alive = nodes[~one], alive[~one]
            if level == depth and len(nodes):
                at = (nodes[:, None] * each + np.arange(each)).ravel()
                points, real = tree["points"][at], tree["at"][at] >= 0
                able = np.zeros((len(nodes), len(book)), bool)
                for k in np.flatnonzero(filled):
                    able[:, leaf_entry[k]] = alive[:, k]
                d = _exact(points, book)
                best = np.where(np.repeat(able, each, axis=0), d, d.max() + 1).argmin(1)
                code[at] = best
                np.add.at(sums, best[real], points[real].reshape(-1, m))
                counts += np.bincount(best[real], minlength=len(book))
                settled["single"] += int(real.sum())
                break
        if level < depth:
            level, nodes, alive = level + 1, (2 * nodes[:, None] + np.arange(2)).ravel(), np.repeat(alive, 2, axis=0)
        if e < deep:
            e, alive = e + 1, np.repeat(alive, 2, axis=1)
    return code, sums, counts, settled


def _packed(points: np.ndarray, parts: int) -> bytes:
    trees = []
    for part in np.split(points, parts, axis=1):
        tree = build_tree(part, _LEAF)
        if tree["points"].dtype != object and _top(part) < 1 << 31:
            tree["points"] = tree["points"].astype(np.int32)
            tree["levels"] = [(lo.astype(np.int32), hi.astype(np.int32), s, c) for lo, hi, s, c in tree["levels"]]
        trees.append(tree)
    return pickle.dumps(trees, protocol=5)


def _unpacked(raw: bytes, books: list[np.ndarray]) -> list[tuple[dict, np.ndarray]]:
    """Trees with their codebooks, in 64 bits where no squared distance passes them."""
    out = []
    for tree, book in zip(pickle.loads(raw), books, strict=True):
        most = max(_top(tree["points"]), _top(book))
        kind = np.int64 if (2 * most + 1) ** 2 * max(1, book.shape[1]) * _BLOCK < 1 << 62 else object
        tree["points"] = tree["points"].astype(kind)
        tree["levels"] = [(lo.astype(kind), hi.astype(kind), s.astype(kind), c) for lo, hi, s, c in tree["levels"]]
        out.append((tree, book.astype(kind)))
    return out


def _blocks(rows: DataFrame, parts: int, scale: int) -> DataFrame:
    """ids, labels and trees of up to 4,096 vectors each."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, _BLOCK):
                part = batch.slice(k, _BLOCK)
                flat = part.column("vector").flatten().to_numpy(zero_copy_only=False)
                trees = _packed(integers(flat.astype(np.float64).reshape(part.num_rows, -1), scale), parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.column(c).to_pylist()], pa.list_(t)) for c, t in (("vec_id", pa.int64()), ("label", pa.string()))] + [pa.array([trees], pa.binary())],
                    names=["ids", "labels", "trees"],
                )

    return rows.mapInArrow(run, "ids array<long>, labels array<string>, trees binary")


def _round(blocks: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round; only sums by entry leave the tasks."""

    def run(batches):
        sums, counts = [np.zeros(b.shape, object) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for raw in batch.column("trees").to_pylist():
                for k, (tree, book) in enumerate(_unpacked(raw, books)):
                    _, s, c, _ = walk(tree, book)
                    sums[k], counts[k] = sums[k] + s, counts[k] + c
        rows = [
            (k, entry, at, x)
            for k in range(len(books)) for entry in np.flatnonzero(counts[k]).tolist()
            for at, x in enumerate([int(counts[k][entry]), *map(int, sums[k][entry])])
        ]
        kinds = (("part", pa.int32()), ("entry", pa.int32()), ("at", pa.int32()), ("total", pa.decimal128(38, 0)))
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])

    found = blocks.select("trees").mapInArrow(run, "part int, entry int, at int, total decimal(38,0)").groupBy("part", "entry", "at").agg(F.sum("total").alias("total"))
    totals = {(r.part, r.entry, r.at): int(r.total) for r in found.collect()}  # entries x components, whatever the number of vectors
    out = []
    for k, book in enumerate(books):
        new = book.astype(object)
        for entry in range(len(book)):
            if n := totals.get((k, entry, 0)):
                new[entry] = [totals[k, entry, at + 1] // n for at in range(book.shape[1])]
        out.append(new if book.dtype == object or _top(new) >= 1 << 62 else new.astype(np.int64))
    return out


def _coded(blocks: DataFrame, books: list[np.ndarray]) -> DataFrame:
    def run(batches):
        for batch in batches:
            for ids, labels, raw in zip(*(batch.column(c).to_pylist() for c in ("ids", "labels", "trees")), strict=True):
                codes, error = np.zeros((len(ids), len(books)), np.int64), np.zeros(len(ids), object)
                for k, (tree, book) in enumerate(_unpacked(raw, books)):
                    code, real = walk(tree, book)[0], tree["at"] >= 0
                    at, mine = tree["at"][real], code[real]
                    codes[at, k] = mine
                    off = tree["points"][real] - book[mine]
                    error[at] += (off * off).sum(1).astype(object)
                text = ["".join(f"{x:02x}" for x in row) for row in codes.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.string()), pa.array(text, pa.string()), pa.array(error.tolist(), pa.int64())], names=["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(run, "vec_id long, label string, code string, error long")


def compress_vectors(
    vectors: DataFrame, *, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, staging: Staging | None = None
) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for every whole vector of (vec_id, embedding, label).

    Components become floor(``scale`` * x); a vector is cut into ``parts``
    equal parts. Each position's codebook starts as that part of the
    ``entries`` vectors with the smallest vec_ids (all of them, if fewer) and
    goes through ``rounds`` Lloyd rounds; unused entries stay. ``code`` has two
    hex digits for each part, ``error`` is the sum of the squared distances,
    ``label_error`` that sum over all rows of the label (nulls together).

    Codebooks are entries x components and go through the driver each round;
    vectors never do and are never shuffled. Rounds end early when a round
    changes nothing. Labels of any share of the rows are summed by partial
    aggregation.

    Vectors that are null or hold null or non-finite components are left out,
    and an empty table gives no rows. Repeated rows count each; of equal
    vec_ids the lesser vector comes first, null vec_ids come last. Vectors of
    several lengths, or of a length that ``parts`` does not divide (no
    components included), raise a ValueError, an error beyond 64 bits an
    overflow error. Other columns are not looked at.
    """
    if not 0 < entries <= 256:
        raise ValueError("two hex digits name at most 256 entries")
    spark = vectors.sparkSession
    staging = staging or Staging(spark, "codes")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    kept = rows.where("vector is not null and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")
    lengths = kept.agg(F.min(F.size("vector")), F.max(F.size("vector"))).first()
    if lengths[0] is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    if lengths[0] != lengths[1] or lengths[0] % parts or not lengths[0]:
        raise ValueError(f"vectors of {lengths[0]} to {lengths[1]} components cannot be cut into {parts} equal parts")
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select("vector").limit(entries).collect()
    books = np.split(integers(np.array([r.vector for r in first]), scale), parts, axis=1)
    blocks = staging.save(_blocks(kept, parts, scale), "blocks")
    for _ in range(rounds):
        new = _round(blocks, books)
        same = all(np.array_equal(a, b) for a, b in zip(books, new, strict=True))
        books = new
        if same:
            break
    digest = hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()
    coded = staging.save(_coded(blocks, books).withColumn("key", F.coalesce(F.concat(F.lit("="), "label"), F.lit(""))).drop("label"), "coded")
    sums = staging.save(coded.groupBy("key").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("of_label")), "labels")
    return join_counted(coded, sums, "key", "of_label").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
