"""Fuzzy line dedup: character-shingle MinHash, banding, exact Jaccard verification, union-find."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staging, join_counted
from .components import connected_components
from .similarity import RangeHash, crowded_links, crowded_rows, linked_pairs, mixed, neighbour_pairs

_BANDS, _ROWS = 12, 4
_HASHES = _BANDS * _ROWS
_RNG = np.random.default_rng(20240611)
_MULTIPLY = _RNG.integers(0, 1 << 63, _HASHES, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_XOR = _RNG.integers(0, 1 << 63, _HASHES, dtype=np.uint64)
_TOP = np.iinfo(np.uint64).max
#: Lines remembered as already signed by a task; beyond it the memory starts anew and a line may be signed twice.
_SEEN = 500_000
#: Candidate lines and links of up to so many rows are broadcast; beyond it they are joined by shuffle.
_FEW = 1_000_000
_PORTION = 1 << 17


def _spaced(line: str) -> str:
    """Runs of white space as one space, none at the ends; the space is the only printable white space."""
    return line.strip(" ") if line.isprintable() and "  " not in line else " ".join(line.split())


def normal_form(line: str) -> str:
    """Lower case, runs of white space as one space, none at the ends."""
    return _spaced(line.lower())


def _codes(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all lines one after the other, and where each line begins and ends."""
    codes = np.frombuffer("\n".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]) if len(lines) else sizes
    return codes, starts, starts + sizes


def _shingles(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, chars: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every shingle and the line it is from; a line shorter than a shingle is one shingle."""
    hashes = RangeHash(codes)
    last = np.maximum(ends - chars, starts)
    every = np.zeros(len(codes) + 1, np.uint64)
    whole = hashes.windows(chars)
    every[: len(whole)] = whole
    short = ends - starts < chars
    every[starts[short]] = hashes.of(starts[short], ends[short])
    step = np.zeros(len(codes) + 2, np.int8)
    step[starts] += 1
    step[last + 1] -= 1
    return every[np.cumsum(step, dtype=np.int8)[:-1].view(bool)], np.repeat(np.arange(len(starts)), last - starts + 1)


def shingle_sets(lines: list[str], chars: int) -> list[np.ndarray]:
    """The distinct character-shingle hashes of every (raw) line, whole."""
    codes, starts, ends = _codes([normal_form(x) for x in lines])
    h, line = _shingles(codes, starts, ends, chars)
    bounds = np.searchsorted(line, np.arange(len(lines) + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        h[a:b].sort()
    fresh = np.r_[True, (h[1:] != h[:-1]) | (line[1:] != line[:-1])] if len(h) else np.zeros(0, bool)
    h, cuts = h[fresh], np.r_[0, np.cumsum(fresh)][bounds].tolist()
    return [h[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _band_keys(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, chars: int) -> np.ndarray:
    """Band keys (lines x bands).

    Lines of many shingles deal them into one bin for each hash function and
    take each bin's minimum; an empty bin borrows from the next filled one.
    Lines of few shingles take the minimum under every function.
    """
    h, line = _shingles(codes, starts, ends, chars)
    count = np.bincount(line, minlength=len(starts))
    least = np.full((len(starts), _HASHES), _TOP)
    many = np.repeat(count >= 2 * _HASHES, count)
    big = np.flatnonzero(count >= 2 * _HASHES)
    if len(big):
        # (line, value) in order; the top bits of a value choose its bin, so the first of each bin is its minimum
        packed = np.repeat(np.arange(len(big), dtype=np.uint64) << np.uint64(44), count[big])
        packed |= (h if many.all() else h[many]) >> np.uint64(20)
        packed.sort()
        slot = ((packed >> np.uint64(12) & np.uint64(0xFFFFFFFF)) * np.uint64(_HASHES) >> np.uint64(32)).astype(np.uint8)
        first = np.r_[True, slot[1:] != slot[:-1]]
        first[np.cumsum(count[big])[:-1]] = True
        first = np.flatnonzero(first)
        bins = np.full(len(big) * _HASHES, _TOP)
        bins[(packed[first] >> np.uint64(44)).astype(np.int64) * _HASHES + slot[first]] = packed[first] & np.uint64((1 << 44) - 1)
        least[big] = bins.reshape(-1, _HASHES)
    table = least[big]
    for step in range(1, _HASHES):
        hole = least[big] == _TOP if step == 1 else hole & (table == _TOP)
        if not hole.any():
            break
        lent = np.roll(least[big], -step, axis=1)
        fill = hole & (lent != _TOP)
        table[fill] = mixed(lent[fill] + np.uint64(step))
    least[big] = table
    small = np.flatnonzero((count > 0) & (count < 2 * _HASHES))
    if len(small):
        few = np.flatnonzero(~many)
        cuts = np.flatnonzero(np.r_[True, line[few][1:] != line[few][:-1]])
        for k in range(_HASHES):
            least[small, k] = np.minimum.reduceat((h[few] ^ _XOR[k]) * _MULTIPLY[k], cuts)
    keys = np.broadcast_to(np.arange(1, _BANDS + 1, dtype=np.uint64), (len(starts), _BANDS))
    for k in range(_ROWS):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + least[:, k::_ROWS])
    return keys.view(np.int64)


def line_table(docs: DataFrame, chars: int) -> DataFrame:
    """doc_id, which, line_no, line, check, bands, text for every line of (doc_id, text); blank lines are left out.

    ``which`` tells texts of one doc_id apart; ``line`` and ``check`` are the
    halves of a 128-bit digest of the normal form. ``bands`` and ``text`` (the
    normal form) stand where a task meets a line first, so that a line that
    repeats everywhere is signed and shuffled once for each task.
    """
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string()]
    names = ["doc_id", "which", "line_no", "line", "check", "bands", "text"]

    def run(batches):
        seen: set[bytes] = set()

        def portion(owner, which, number, lines):
            digests = [hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=16).digest() for x in lines]
            new = []
            for k, d in enumerate(digests):
                if d not in seen:
                    if len(seen) >= _SEEN:
                        seen.clear()
                    seen.add(d)
                    new.append(k)
            signed, texts = np.zeros(len(lines), bool), [None] * len(lines)
            signed[new] = True
            keys = np.empty((0, _BANDS), np.int64)
            if new:
                fresh = [lines[k] for k in new]
                keys = _band_keys(*_codes(fresh), chars)
                for k, x in zip(new, fresh, strict=True):
                    texts[k] = x
            ends = np.r_[0, np.cumsum(signed) * _BANDS].astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()), mask=pa.array(~signed))
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            cols = (owner, which, number, np.ascontiguousarray(halves[:, 0]), np.ascontiguousarray(halves[:, 1]), bands, texts)
            return pa.RecordBatch.from_arrays([c if c is bands else pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

        for batch in batches:
            held, size = ([], [], [], []), 0
            for doc_id, which, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "which", "text")), strict=True):
                for k, raw in enumerate((text or "").lower().split("\n")):
                    line = _spaced(raw)  # the normal form
                    if line:
                        for c, v in zip(held, (doc_id, which, k, line), strict=True):
                            c.append(v)
                        size += len(line) + 1
                        if size > _PORTION:
                            yield portion(*held)
                            held, size = ([], [], [], []), 0
            if size:
                yield portion(*held)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("which"), "text")
    return rows.mapInArrow(run, "doc_id long, which long, line_no int, line long, check long, bands array<long>, text string")


def _settled(lines: DataFrame, staging: Staging) -> DataFrame:
    """``lines`` with keys that differ wherever the digests do.

    Two digests may share their first half once there are billions of lines:
    all but the one with the smallest second half get another key, until none
    is shared.
    """
    k = 0
    while True:
        halves = lines.groupBy("line").agg(F.min("check").alias("low"), F.max("check").alias("high"))
        shared = staging.save(halves.where("low <> high").select("line", "low"), f"shared-{k}")
        if shared.isEmpty():
            return lines
        other = F.when(F.col("low").isNotNull() & (F.col("check") != F.col("low")), F.xxhash64("line", "check", F.lit(k))).otherwise(F.col("line"))
        lines = staging.save(lines.join(shared, "line", "left").withColumn("line", other).drop("low"), f"settled-{k}")
        k += 1


def repeated_lines(
    docs: DataFrame, *, chars: int = 8, num: int = 80, den: int = 100, window: int = 6, staging: Staging | None = None
) -> DataFrame:
    """(doc_id, which, line_no) of every line that is not the first of its component; ``which`` is xxhash64 of the text.

    Lines are compared in normal form (lower case, single spaces); blank lines
    are never touched. Two lines are linked where den * intersection >= num *
    union of their sets of 8-character shingles (a shorter line is one
    shingle), confirmed on whole lines; equal lines (by a 128-bit digest) are
    one node from the start. Of every component the line with the smallest
    (doc_id, which, line_no) stays.

    Candidates share one of 12 bands of 4 MinHash values: a pair at 0.8 does
    with a probability of 0.998, at 0.9 of 0.99999. Within a band's bucket rows
    are made distinct by line; one of more than ``window`` + 1 lines is not
    listed as pairs: all its lines are held against each other exactly, in
    blocks, so a bucket of any size gives at most one link for each line and
    pair of blocks. Neither depends on how rows are dealt to partitions.

    Null and empty texts have no lines, and rows without a doc_id take no
    part. Rows that repeat a doc_id and text are one document; those that
    repeat a doc_id with another text are documents of their own. No rows give
    no rows.
    """
    staging = staging or Staging(docs.sparkSession, "lines")
    few = lambda df: F.broadcast(df) if df.count() <= _FEW else df
    lines = staging.save(line_table(docs.where("doc_id is not null").select("doc_id", "text"), chars), "lines", compression="zstd", level=1)
    lines = _settled(lines, staging)
    signed = lines.where("bands is not null")
    rows = signed.select(F.explode("bands").alias("key"), F.col("line").alias("node"))
    found = staging.save(neighbour_pairs(rows, window=window), "found")
    crowded = crowded_rows(rows, found, staging, "crowded")
    found = found.where("b is not null")
    nodes = staging.save(found.select(F.explode(F.array("a", "b")).alias("node")).unionByName(crowded.select("node")).distinct(), "nodes")
    texts = signed.select(F.col("line").alias("node"), "text").join(few(nodes), "node", "left_semi").dropDuplicates(["node"])
    bodies = staging.save(texts, "bodies", compression="zstd")
    to_sets = lambda t: shingle_sets(t, chars)
    links = linked_pairs(found, bodies, to_sets, num=num, den=den)
    links = links.unionByName(crowded_links(crowded, bodies, to_sets, num=num, den=den))
    links = staging.save(links, "links")  # else one task feeds two Python workers, and all of them live on
    parts = connected_components(links, staging, "parts").withColumnRenamed("node", "line")
    grouped = lines.select("doc_id", "which", "line_no", "line").join(few(parts), "line", "left")
    grouped = staging.save(grouped.select("doc_id", "which", "line_no", F.coalesce("component", "line").alias("group")), "grouped")
    staging.drop("lines", "settled-0", "found", "nodes", "bodies", "crowded", "links")
    place = F.struct("doc_id", "which", "line_no")
    leaders = grouped.groupBy("group").agg(F.min(place).alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1")
    leaders = staging.save(leaders, "leaders")
    return join_counted(grouped, leaders, "group", "n").where(place != F.col("leader")).select("doc_id", "which", "line_no").distinct()


def _with_gone(docs: DataFrame, **options) -> DataFrame:
    """row (all columns of ``docs``), text and gone, the numbers of a row's repeated lines (null for none)."""
    gone = repeated_lines(docs.select("doc_id", "text"), **options)
    gone = gone.groupBy(F.col("doc_id").alias("owner"), "which").agg(F.array_sort(F.collect_set("line_no")).alias("gone"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("owner"), F.xxhash64("text").alias("which"), "text")
    return rows.join(gone, ["owner", "which"], "left").select("row", "text", "gone")


def drop_repeated_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with repeated lines cut from the texts; all rows and columns stay, whatever their names, a text may become empty, a null one stays null."""
    kept = F.expr("array_join(filter(split(text, '\\n'), (x, i) -> not array_contains(gone, i)), '\\n')")
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept)
    return _with_gone(docs, **options).select(*[text.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def line_decisions(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (line numbers from 0) for every row."""
    joined = _with_gone(docs.select("doc_id", "text"), **options)
    removed = F.coalesce("gone", F.array().cast("array<int>"))
    n_lines = F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long")
    return joined.select("row.doc_id", F.greatest(n_lines, F.lit(0)).alias("n_lines"), F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))
