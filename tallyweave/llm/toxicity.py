"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, distance-weighted votes."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hash32, in_fold

_TERM = re.compile(r"\w+")
_BLOCK = 64
#: Texts scored together, and postings that are summed at once: they bound a task's memory, not results.
_TEXTS = 256
_POSTS = 1 << 18


def terms_of(text: str | None) -> list[str]:
    return _TERM.findall((text or "").lower())


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All places of the ranges, one range after the other."""
    sizes = ends - starts
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


@dataclass
class LabelledIndex:
    """Unit TF-IDF vectors of labelled examples, inverted, in blocks of 64 examples.

    Each block holds the weights of the most frequent terms as a matrix, with
    each term's peak in the block; all other terms have posting lists (term t
    from ``post_at[t]`` to ``post_at[t + 1]``).
    """

    terms: dict[str, int]
    idf: np.ndarray
    unknown: float
    ids: np.ndarray
    labels: np.ndarray
    votes: np.ndarray
    post_at: np.ndarray
    places: np.ndarray
    weights: np.ndarray
    column: np.ndarray
    dense: np.ndarray
    peaks: np.ndarray
    neighbours: int
    base: float
    slope: float = 1.0
    shift: float = 0.0

    def vector(self, counts: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the text's known terms, rising, and their weights at unit length of the whole text.

        A term that no example holds counts in the length like one of a single document.
        """
        at = np.fromiter(map(self.terms.get, counts, repeat(-1)), np.int64, len(counts))
        tf = 1 + np.log(np.fromiter(counts.values(), np.float64, len(counts)))
        known = np.flatnonzero(at >= 0)
        known = known[np.argsort(at[known])]
        w = tf[known] * self.idf[at[known]]
        norm = math.sqrt(float(w @ w) + self.unknown**2 * float((tf[at < 0] ** 2).sum()))
        return at[known], w / norm if norm else w

    def nearest(self, counts: list[dict[str, int]], leave_out: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text places and cosines of its nearest examples, nearest first, ties to the smaller place; exact.

        A block's bound is the largest sum over posting lists of one of its
        examples plus the frequent terms' weights times their peaks. A text
        opens its most promising blocks, and then all that can still reach
        its last place.
        """
        n, blocks = len(counts), len(self.dense) // _BLOCK
        if not blocks or not n:
            return [(np.zeros(0, np.int64), np.zeros(0))] * n
        vectors = [self.vector(c) for c in counts]
        doc = np.repeat(np.arange(n), [len(v[0]) for v in vectors])
        term, w = np.concatenate([v[0] for v in vectors]), np.concatenate([v[1] for v in vectors])
        column = self.column[term]
        often = column >= 0
        query = np.zeros((n, self.dense.shape[1]), np.float32)
        query[doc[often], column[often]] = w[often]
        owner, held = doc[~often], w[~often]
        first, last = self.post_at[term[~often]], self.post_at[term[~often] + 1]
        score, of_doc = np.zeros((n, len(self.dense))), np.searchsorted(owner, np.arange(n + 1))
        upto = np.r_[0, np.cumsum(last - first)][of_doc]
        a = 0
        while a < n:  # texts of some _POSTS postings together, or one text
            b = max(a + 1, int(np.searchsorted(upto, upto[a] + _POSTS, "right")) - 1)
            at = slice(of_doc[a], of_doc[b])
            size, posts = last[at] - first[at], _ranges(first[at], last[at])
            key = np.repeat(owner[at] - a, size) * len(self.dense) + self.places[posts]
            score[a:b] = np.bincount(key, self.weights[posts] * np.repeat(held[at], size), minlength=(b - a) * len(self.dense)).reshape(b - a, -1)
            a = b
        bound = score.reshape(n, blocks, _BLOCK).max(2) + query @ self.peaks
        exact, k = np.zeros_like(score), self.neighbours + (leave_out is not None)
        few = min(blocks, 2 + k // _BLOCK)
        need = np.zeros((n, blocks), bool)
        need[np.arange(n)[:, None], np.argpartition(-bound, few - 1, axis=1)[:, :few]] = True
        done = np.zeros_like(need)
        while (now := need & ~done).any():
            for b in np.flatnonzero(now.any(0)).tolist():
                rows, at = np.flatnonzero(now[:, b]), slice(b * _BLOCK, (b + 1) * _BLOCK)
                exact[rows, at] = score[rows, at] + query[rows] @ self.dense[at].T
            done |= now
            lowest = np.partition(exact, -min(k, exact.shape[1]), axis=1)[:, -min(k, exact.shape[1])]
            need = (bound >= lowest[:, None] - 1e-6) & (bound > 0)
        out = []
        for row, gone in zip(exact, leave_out or [-1] * n, strict=True):
            if gone >= 0:
                row[gone] = 0
            found = np.flatnonzero(row > 0)
            if len(found) > self.neighbours:
                found = found[row[found] >= np.partition(row[found], -self.neighbours)[-self.neighbours]]
            found = found[np.lexsort((found, -row[found]))][: self.neighbours]
            out.append((found, np.minimum(row[found], 1.0)))
        return out

    def raw(self, at: np.ndarray, cosine: np.ndarray) -> float:
        """Log-odds of the vote: an example votes by its cosine over its distance, one vote stands for the base rate."""
        if not len(at):
            return math.log(self.base / (1 - self.base))
        w = self.votes[at] * cosine / (1.05 - cosine)
        p = (w @ self.labels[at] + 0.5 * self.base) / (w.sum() + 0.5)
        p = min(max(p, 1e-6), 1 - 1e-6)
        return math.log(p / (1 - p))

    def score(self, counts: list[dict[str, int]]) -> list[tuple[float, list[tuple[int, float]]]]:
        """Calibrated score and the five nearest examples (id, cosine) of each text."""
        out = []
        for at, cosine in self.nearest(counts):
            z = self.slope * self.raw(at, cosine) + self.shift if len(at) else self.raw(at, cosine)
            evidence = [(int(i), float(c)) for i, c in zip(self.ids[at[:5]], cosine[:5], strict=True)]
            out.append((1 / (1 + math.exp(-min(max(z, -8.0), 8.0))), evidence))
        return out


def _idf(docs: DataFrame, terms: dict[str, int]) -> tuple[np.ndarray, float]:
    """ln((1 + n) / (1 + df)) + 1 of each term over all documents, and of a term of one document."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        terms, rows = shared.value, 0
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            rows += batch.num_rows
            for text in batch.column(0).to_pylist():
                total[[k for t in set(terms_of(text)) if (k := terms.get(t)) is not None]] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at]), pa.array(np.r_[rows, total[at]])], names=["term", "n"])

    counts = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    shared.destroy()
    at, found = counts.column("term").to_numpy(), counts.column("n").to_numpy()
    n, df = int(found[at < 0].sum()), np.zeros(len(terms))
    df[at[at >= 0]] = found[at >= 0]
    return np.log((1 + n) / (1 + df)) + 1, math.log((1 + n) / 2) + 1


def _ratio(own: np.ndarray, other: np.ndarray, n_own: int, n_other: int) -> np.ndarray:
    """Log-likelihood ratio of each term's uses in two classes of n_own and n_other uses."""
    share = n_own / max(1, n_own + n_other)
    part = lambda n, expected: n * np.log(np.where(n > 0, n, 1) / np.where(n > 0, expected, 1))
    return np.maximum(0, 2 * (part(own, (own + other) * share) + part(other, (own + other) * (1 - share))))


def telling_factor(entries: np.ndarray, after: np.ndarray, toxic: np.ndarray, owner: np.ndarray, size: int, strength: float) -> np.ndarray:
    """1 + log-likelihood ratio / ``strength`` of each term: the lesser of that by documents and that by the words it follows.

    So copies of a text don't make its words telling. ``entries``: the term of
    each use, ``after`` a hash of the word before it, ``toxic`` its example's
    label, ``owner`` its example.
    """
    if not len(entries):
        return np.ones(size)
    ratios = []
    for key in (owner, after):
        kind = key.astype(np.int64) - int(key.min())
        kinds = int(kind.max()) + 1
        if size * kinds >= 1 << 62:
            kind = np.unique(kind, return_inverse=True)[1]
            kinds = int(kind.max()) + 1
        # in place, as the driver holds a use of every term here
        uses = entries.astype(np.int64)
        uses *= kinds
        uses += kind
        del kind
        uses *= 2
        uses += toxic
        uses.sort()
        uses = uses[np.r_[True, uses[1:] != uses[:-1]]]
        term = uses // (2 * kinds)
        own, other = (np.bincount(term[uses % 2 == y], minlength=size).astype(float) for y in (1, 0))
        totals = [len(np.unique(owner[toxic == y])) for y in (1, 0)] if key is owner else [int((uses % 2 == y).sum()) for y in (1, 0)]
        ratios.append(_ratio(own, other, *totals))
    return 1 + np.minimum(*ratios) / strength


def _calibrate(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit of y on z (Newton steps, lightly held to slope 1)."""
    x, beta = np.stack([z, np.ones_like(z)], 1), np.array([1.0, 0.0])
    prior = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (weight * (p - y)) + (beta - prior)
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(2)
        step = np.linalg.solve(h, g)
        beta = beta - step
        if np.abs(step).max() < 1e-8:
            break
    return float(max(beta[0], 1e-3)), float(beta[1])


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, per_class: int = 2_500, neighbours: int = 25, strength: float = 10.0, frequent: int = 512) -> LabelledIndex:
    """Build the index from ``labels`` (doc_id, toxic 0/1) outside the held-out fold.

    ``per_class`` bounds the labelled examples of each class (a hash sample of
    about that many; votes are weighted back to the classes' true shares) and
    so what reaches the driver and is broadcast. All terms of the sampled
    texts of both classes are indexed. A term's weight is its inverse document
    frequency over all documents, times a factor that grows with how unevenly
    the classes use it (``telling_factor``; an infinite ``strength`` gives
    plain TF-IDF). The ``frequent`` most frequent terms are held as matrices,
    which changes no result. Scores are calibrated by a logistic fit on the examples,
    each left out of its own neighbours. Rows with a null id or label are not
    learned from; of an id with several labels the largest counts. Without
    examples of both classes the index is empty and scores its base rate (0.01
    without any label).
    """
    known = labels.where(~in_fold(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = {y: min(1.0, per_class / max(1, counts.get(y, 0))) for y in (0, 1)}
    chance = hash32(F.concat(F.lit("toxic:"), F.col("doc_id").cast("string"))) / F.lit(4294967296.0)
    sample = known.where(chance < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"), "text")
    prior = (counts.get(1, 0) + 0.1) / (sum(counts.values()) + 10)

    def run(batches):
        for batch in batches:
            words = [terms_of(t) for t in batch.column("text").to_pylist()]
            uses = [sorted(Counter(zip(w, ["", *w], strict=False)).items()) for w in words]
            after = [np.array([zlib.crc32(b.encode("utf-8", "surrogatepass")) for (_, b), _ in u], np.uint32).view(np.int32) for u in uses]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("toxic"), pa.array([[t for (t, _), _ in u] for u in uses], pa.list_(pa.string())), pa.array(after, pa.list_(pa.int32())), pa.array([[n for _, n in u] for u in uses], pa.list_(pa.int32()))],
                names=["doc_id", "toxic", "terms", "after", "n"],
            )

    found = rows.mapInArrow(run, "doc_id long, toxic int, terms array<string>, after array<int>, n array<int>").toArrow()
    found = found.sort_by([("doc_id", "ascending"), ("toxic", "ascending")])
    ids, labels_of = found.column("doc_id").to_numpy(), found.column("toxic").to_numpy().astype(np.int64)
    if len(set(labels_of.tolist())) < 2:
        none, real = np.zeros(0, np.int64), np.zeros(0)
        return LabelledIndex({}, real, 1.0, none, real, real, np.zeros(1, np.int64), none, real, none, np.zeros((0, 0), np.float32), np.zeros((0, 0), np.float32), neighbours, prior)
    lists = found.column("terms").combine_chunks()
    owner = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(lists.offsets.to_numpy()))
    coded = lists.flatten().dictionary_encode()
    entries = coded.indices.to_numpy().copy()
    after, times = (found.column(c).combine_chunks().flatten().to_numpy() for c in ("after", "n"))
    terms = {t: k for k, t in enumerate(coded.dictionary.to_pylist())}
    del coded, lists, found
    pa.default_memory_pool().release_unused()
    idf, unknown = _idf(docs, terms)
    idf = idf * telling_factor(entries, after, labels_of.astype(np.int8)[owner], owner, len(terms), strength)
    del after

    # one weight for each (example, term); examples stand by their heaviest frequent term, so that a block's bounds are tight
    held = owner.astype(np.int64)
    held *= len(terms)
    held += entries
    del owner, entries
    place = np.argsort(held, kind="stable")
    held, times = held[place], times[place]
    del place
    fresh = np.ones(len(held), bool)
    fresh[1:] = held[1:] != held[:-1]
    uses = np.add.reduceat(times, np.flatnonzero(fresh), dtype=np.int64) if len(held) else times
    held = held[fresh]
    who, term = held // max(1, len(terms)), held % max(1, len(terms))
    weight = (1 + np.log(uses)) * idf[term]
    del held, times, fresh, uses
    weight /= np.sqrt(np.bincount(who, weight**2, minlength=len(ids)))[who]
    uses = np.bincount(term, minlength=len(terms))
    column = np.full(len(terms), -1)
    often = np.lexsort((np.arange(len(terms)), -uses))[:frequent]
    column[often] = np.arange(len(often))
    common = np.flatnonzero(column[term] >= 0)
    common = common[np.lexsort((-weight[common], who[common]))]
    first = np.r_[True, np.diff(who[common]) > 0] if len(common) else np.zeros(0, bool)
    heaviest = np.full(len(ids), -1)
    heaviest[who[common[first]]] = column[term[common[first]]]
    order = np.lexsort((ids, heaviest))
    at = np.empty(len(ids), np.int64)
    at[order] = np.arange(len(ids))
    dense = np.zeros((-(-len(ids) // _BLOCK) * _BLOCK, len(often)), np.float32)
    dense[at[who[common]], column[term[common]]] = weight[common]
    rare = np.flatnonzero(column[term] < 0)
    rare = rare[np.lexsort((at[who[rare]], term[rare]))]
    votes = np.array([1 / share[y] for y in labels_of.tolist()])[order]
    index = LabelledIndex(
        terms, idf, unknown, ids[order], labels_of[order].astype(float), votes, np.searchsorted(term[rare], np.arange(len(terms) + 1)), at[who[rare]].astype(np.int32),
        weight[rare].astype(np.float32), column, dense, np.ascontiguousarray(dense.reshape(-1, _BLOCK, len(often)).max(1).T), neighbours, prior,
    )
    shared = docs.sparkSession.sparkContext.broadcast(index)
    where = docs.sparkSession.sparkContext.broadcast(dict(zip(zip(index.ids.tolist(), index.labels.astype(int).tolist(), strict=True), range(len(ids)), strict=True)))

    def left_out(batches):
        index, place = shared.value, where.value
        for whole in batches:
            for k in range(0, whole.num_rows, _TEXTS):
                batch = whole.slice(k, _TEXTS)
                keys = zip(batch.column("doc_id").to_pylist(), batch.column("toxic").to_pylist(), strict=True)
                counts = [Counter(terms_of(t)) for t in batch.column("text").to_pylist()]
                z = [index.raw(*x) for x in index.nearest(counts, [place[x] for x in keys])]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(z, pa.float64())], names=["doc_id", "toxic", "z"])

    fit = rows.repartition(max(8, docs.sparkSession.sparkContext.defaultParallelism), "doc_id").mapInArrow(left_out, "doc_id long, toxic int, z double").toArrow()
    fit = fit.sort_by([("doc_id", "ascending"), ("z", "ascending")])
    y = fit.column("toxic").to_numpy()
    index.slope, index.shift = _calibrate(fit.column("z").to_numpy(), y.astype(float), np.array([1 / share[k] for k in y.tolist()]))
    shared.destroy()
    where.destroy()
    return index


def score_toxicity(df: DataFrame, index: LabelledIndex, *, text_col: str = "text") -> DataFrame:
    """Add ``toxicity`` (0 to 1), ``toxic_predicted`` (1 from 0.5 on) and ``evidence`` (nearest examples, cosines) to every row.

    Whole texts are scored. Null and empty texts, and texts without a term of
    any example, get the classes' base rate and no evidence. Rows that repeat
    get a row each. Input columns with these names are replaced.
    """
    added = ["toxicity", "toxic_predicted", "evidence"]
    df = df.drop(*added)
    pair = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("cosine", T.DoubleType())])
    schema = T.StructType([*df.schema.fields, T.StructField("toxicity", T.DoubleType()), T.StructField("toxic_predicted", T.IntegerType()), T.StructField("evidence", T.ArrayType(pair))])
    shared = df.sparkSession.sparkContext.broadcast(index)
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64())]))

    def run(batches):
        index = shared.value
        for whole in batches:
            for k in range(0, whole.num_rows, _TEXTS):
                batch = whole.slice(k, _TEXTS)
                found = index.score([Counter(terms_of(t)) for t in batch.column(text_col).to_pylist()])
                scores = [s for s, _ in found]
                evidence = [[{"doc_id": i, "cosine": c} for i, c in e] for _, e in found]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(evidence, kind)],
                    names=[*batch.schema.names, *added],
                )

    return df.mapInArrow(run, schema)
