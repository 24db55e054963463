"""Substring dedup by difference-cover anchors: passages that a smaller document also holds are cut out.

Positions modulo 7 lie in the difference cover {0, 1, 3} or not, and any two
positions reach it together within six steps. So two documents that share a
window of 13 words share, inside it, seven words that start at a cover position
in both: hashes of seven words at three of seven positions find every match.
Around shared anchors alone the windows of 13 words are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staging
from .similarity import RangeHash, mixed, portions, word_hashes

#: Difference covers: period -> positions. Any difference modulo the period is one of two positions.
_COVERS = {7: (0, 1, 3), 3: (0, 1), 2: (0, 1), 1: (0,)}
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_OTHER = np.uint64(0x94D049BB133111EB)
_BUFFER = 1 << 20


def cover_for(window: int) -> tuple[int, tuple[int, ...], int]:
    """Period, cover and anchor width for windows of so many words; anchors are at least half a window."""
    period = next(p for p in sorted(_COVERS, reverse=True) if window - p + 1 > window // 2)
    return period, _COVERS[period], window - period + 1


def _worded(raws: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """(index, word hashes) of every text."""
    for a, b in portions(raws):
        codes = np.frombuffer(b" " + b" ".join(raws[a:b]) + b" ", np.uint8)
        space = _SPACE[codes]
        starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
        words = word_hashes(codes, starts, ends)
        bounds = np.searchsorted(starts, np.cumsum([1] + [len(r) + 1 for r in raws[a:b]]))
        for k, (i, j) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            yield a + k, words[i:j]


def _anchors(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of one text."""
    period, cover, width = cover_for(window)
    if len(words) < window:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    hashes = RangeHash(words).windows(width)
    at = np.flatnonzero(np.isin(np.arange(period), cover)[np.arange(len(hashes)) % period])
    return at, hashes[at]


def _near_anchors(words: np.ndarray, known: np.ndarray, window: int) -> np.ndarray:
    """Starts of the windows that hold an anchor of ``known``."""
    at, hashes = _anchors(words, window)
    at = at[np.isin(hashes, known)]
    n = len(words) - window + 1
    edge = np.zeros(n + window, np.int64)
    np.add.at(edge, np.maximum(at - (cover_for(window)[0] - 1), 0), 1)
    np.add.at(edge, np.minimum(at + 1, n), -1)
    return np.flatnonzero(np.cumsum(edge[:n]) > 0)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


_KINDS = {"dest": pa.int64(), "key": pa.int64(), "doc": pa.int64(), "kind": pa.int8()}
_ROW = "dest long, key long, doc long, kind byte"
_FOUND, _ONE, _SHARED = 0, 1, 2


def _rows(dest, key, doc, kind: int) -> pa.RecordBatch:
    cols = (dest.view(np.int64), key.view(np.int64), doc, np.full(len(doc), kind, np.int8))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _KINDS.values(), strict=True)], names=list(_KINDS))


def _anchor_rows(docs: DataFrame, window: int) -> DataFrame:
    """Anchors to be dealt by ``dest``.

    A task combines what it holds: of an anchor of several documents, these
    are found at once (dealt by document) and one row stands for them, so that
    an anchor has one row for each task at most, however many documents hold it.
    """

    def combined(hashes, docs):
        h, doc = np.concatenate(hashes), np.concatenate(docs)
        order = h.argsort(kind="stable")
        h, doc = h[order], doc[order]
        at = _runs(h, doc)
        h, doc = h[at], doc[at]
        first = _runs(h)
        low, high = np.minimum.reduceat(doc, first), np.maximum.reduceat(doc, first)
        shared = low < high
        many = np.flatnonzero(np.repeat(shared, np.diff(np.r_[first, len(h)])))
        many = many[doc[many].argsort(kind="stable")]  # rows of one document together compress better
        none = np.zeros(len(first), np.uint64)
        yield _rows(h[first][~shared], none[~shared], low[~shared], _ONE)
        yield _rows(h[first][shared], none[shared], low[shared], _SHARED)
        yield _rows(mixed(doc[many].view(np.uint64)), h[many], doc[many], _FOUND)

    def run(batches):
        hashes, docs, held = [], [], 0
        for batch in batches:
            ids, raws = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for k, words in _worded(raws):
                h = _anchors(words, window)[1]
                hashes.append(h)
                docs.append(np.full(len(h), ids[k], np.int64))
                held += len(h)
                if held >= _BUFFER:
                    yield from combined(hashes, docs)
                    hashes, docs, held = [], [], 0
        if held:
            yield from combined(hashes, docs)

    return docs.mapInArrow(run, _ROW)


def _hits(rows: DataFrame) -> DataFrame:
    """(doc, key) of anchors that another document holds too, from rows sorted by ``dest``; state is one row."""

    def run(batches):
        last = None
        for batch in batches:
            dest, key, doc, kind = (batch.column(c).to_numpy(zero_copy_only=False) for c in _KINDS)
            found = kind == _FOUND
            out = [(doc[found], key[found])]
            dest, doc, kind = dest[~found], doc[~found], kind[~found]
            if len(dest):
                if last is not None:
                    dest, doc, kind = (np.r_[x, y] for x, y in zip(last, (dest, doc, kind), strict=True))
                first = _runs(dest)
                shared = (np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first)) | (np.maximum.reduceat(kind, first) == _SHARED)
                give = np.repeat(shared, np.diff(np.r_[first, len(dest)])) & (kind == _ONE)
                out.append((doc[give], dest[give]))
                last = dest[-1:], doc[-1:], np.array([_SHARED if shared[-1] else _ONE], np.int8)
            doc, key = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(key)], names=["doc", "key"])

    return rows.mapInArrow(run, "doc long, key long")


def _window_rows(docs: DataFrame, window: int) -> DataFrame:
    """Windows around shared anchors, to be dealt by ``dest``; combined as anchors are, the smallest document standing for all."""

    def combined(ones, others, docs):
        one, other, doc = np.concatenate(ones), np.concatenate(others), np.concatenate(docs)
        order = np.lexsort((doc, other, one))
        one, other, doc = one[order], other[order], doc[order]
        at = _runs(one, other, doc)
        one, other, doc = one[at], other[at], doc[at]
        first = _runs(one, other)
        rest = np.ones(len(one), bool)
        rest[first] = False
        yield _rows(one[first], other[first], doc[first], _ONE)
        rest = np.flatnonzero(rest)
        rest = rest[doc[rest].argsort(kind="stable")]  # rows of one document together compress better
        yield _rows(mixed(doc[rest].view(np.uint64)), one[rest], doc[rest], _FOUND)

    def run(batches):
        held = ([], [], [])
        size = 0
        for batch in batches:
            ids, raws, known = (batch.column(c) for c in ("doc_id", "text", "keys"))
            ids = ids.to_pylist()
            for k, words in _worded(raws.to_pylist()):
                if len(words) < window:
                    continue
                at = _near_anchors(words, known[k].values.to_numpy(zero_copy_only=False).view(np.uint64), window)
                for into, x in zip(held, (RangeHash(words).windows(window)[at], RangeHash(mixed(words ^ _OTHER)).windows(window)[at] >> np.uint64(32), np.full(len(at), ids[k], np.int64)), strict=True):
                    into.append(x)
                size += len(at)
                if size >= _BUFFER:
                    yield from combined(*held)
                    held, size = ([], [], []), 0
        if size:
            yield from combined(*held)

    return docs.mapInArrow(run, _ROW)


def _repeats(rows: DataFrame) -> DataFrame:
    """(doc, key) of windows that a smaller document holds, from rows sorted by (dest, key, doc); state is one row."""

    def run(batches):
        last = None
        for batch in batches:
            dest, key, doc, kind = (batch.column(c).to_numpy(zero_copy_only=False) for c in _KINDS)
            found = kind == _FOUND
            out = [(doc[found], key[found])]
            dest, key, doc = dest[~found], key[~found], doc[~found]
            if len(dest):
                if last is not None:
                    dest, key, doc = (np.r_[x, y] for x, y in zip(last, (dest, key, doc), strict=True))
                first = _runs(dest, key)
                least = np.repeat(doc[first], np.diff(np.r_[first, len(dest)]))
                out.append((doc[doc > least], dest[doc > least]))
                last = dest[-1:], key[-1:], least[-1:]
            doc, key = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(key)], names=["doc", "key"])

    return rows.mapInArrow(run, "doc long, key long")


def _by_document(found: DataFrame) -> DataFrame:
    return found.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list("key").alias("keys"))


def _cut(docs: DataFrame, window: int) -> DataFrame:
    """n_words, n_removed and what is left of every text; ``keys`` are hashes of the windows to cut."""

    def run(batches):
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("keys")
            raws = [t or b"" for t in batch.column("text").to_pylist()]
            n_words, n_removed, left = [], [], []
            cut = [k for k in range(len(raws)) if keys[k].is_valid]
            covered = {}
            for k, words in _worded([raws[k] for k in cut]):
                edge = np.zeros(len(words) + 1, np.int64)
                if len(words) >= window:
                    at = np.flatnonzero(np.isin(RangeHash(words).windows(window), keys[cut[k]].values.to_numpy(zero_copy_only=False).view(np.uint64)))
                    edge[at] += 1
                    edge[at + window] -= 1
                covered[cut[k]] = np.cumsum(edge[:-1]) > 0
            for k, raw in enumerate(raws):
                words = raw.split()
                gone = covered.get(k)
                n_words.append(len(words))
                n_removed.append(0 if gone is None else int(gone.sum()))
                left.append(b" ".join(words if gone is None else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]).decode())
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(left, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"]
            )

    return docs.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string")


def remove_repeated_passages(docs: DataFrame, *, window: int = 13, staging: Staging | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text for every row of (doc_id, text).

    A word (a run of characters other than ASCII white space, unchanged) goes
    if a window of ``window`` words that covers it also starts in a document
    with a smaller doc_id; windows are judged on the whole input, not on what
    is left. ``kept_text`` is the remaining words, joined by one space.

    Windows are known by 96 bits of two hashes of their words' 64-bit hashes.
    Anchors and windows are combined in each task before they are shuffled, so
    that a passage of any number of documents gives one row for each task, and
    the pairs of its documents are never formed.

    Null and empty texts have no words. A null doc_id is smaller than none and
    loses nothing. Rows that repeat a doc_id cut nothing from each other; a
    window that goes for one of them goes for all. Texts of any length are
    whole; those of fewer words than a window lose nothing. No rows give no
    rows; other columns are not looked at.
    """
    staging = staging or Staging(docs.sparkSession, "passages")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    able = docs.where("doc_id is not null and text is not null")
    dealt = _anchor_rows(able, window).repartition("dest").sortWithinPartitions("dest")
    hits = staging.save_tidy(_by_document(_hits(dealt)), "hits")
    dealt = _window_rows(able.join(hits, "doc_id"), window).repartition("dest").sortWithinPartitions("dest", "key", "doc")
    gone = staging.save_tidy(_by_document(_repeats(dealt)), "gone")
    staging.drop("hits")
    return _cut(docs.join(gone, "doc_id", "left"), window)
