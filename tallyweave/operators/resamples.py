"""AUROCs of many resamples at once: a row carries its record's weights in all replicates, so rows are shuffled once and not once for each replicate."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scoring import join_ranges, score_range

#: The number of distinct draws of a Poisson(1) by its distribution function.
POISSON_ONE = [0.367879, 0.735759, 0.919699, 0.981012, 0.996340, 0.999406]
_SLICE, _SIGNS = 2048, 128
_SINES = (np.abs(np.sin(np.arange(1, 65, dtype=np.float64))) * 2.0**32).astype(np.uint64).astype(np.uint32)
_TURNS = [*[7, 12, 17, 22] * 4, *[5, 9, 14, 20] * 4, *[4, 11, 16, 23] * 4, *[6, 10, 15, 21] * 4]
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]


def _md5_heads(words: np.ndarray) -> np.ndarray:
    """The first 32 bits of the MD5 of messages of one block each; ``words`` has a row for each of its 16 words."""
    a, b, c, d = (np.full(words.shape[1], x, np.uint32) for x in _START)
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f = f + a + _SINES[i] + words[g]
        turn = np.uint32(_TURNS[i])
        a, d, c, b = d, c, b, b + ((f << turn) | (f >> np.uint32(32 - _TURNS[i])))
    return (a + _START[0]).byteswap()


def poisson_weights(keys: list[bytes], replicates: int, seed: str) -> np.ndarray:
    """``subgroups.poisson_weight`` of seed:replicate:key for each key (rows) and replicate."""
    heads = np.empty((len(keys), replicates), np.uint32)
    fronts = [f"{seed}:{r}:".encode() for r in range(replicates)]
    for front in sorted({len(f) for f in fronts}):
        reps = [r for r, f in enumerate(fronts) if len(f) == front]
        lead = np.frombuffer(b"".join(fronts[r] for r in reps), np.uint8).reshape(len(reps), front)
        for size in {len(k) for k in keys}:
            own = [i for i, k in enumerate(keys) if len(k) == size]
            if front + size > 55:  # more than a block
                for i in own:
                    heads[i, reps] = [int.from_bytes(hashlib.md5(fronts[r] + keys[i], usedforsecurity=False).digest()[:4], "big") for r in reps]
                continue
            for at in range(0, len(own), _SIGNS):
                some = own[at : at + _SIGNS]
                block = np.zeros((len(some), len(reps), 64), np.uint8)
                block[:, :, :front] = lead
                block[:, :, front : front + size] = np.frombuffer(b"".join(keys[i] for i in some), np.uint8).reshape(len(some), 1, size)
                block[:, :, front + size] = 0x80
                block[:, :, 56:60] = np.frombuffer((8 * (front + size)).to_bytes(4, "little"), np.uint8)
                words = np.ascontiguousarray(block.reshape(-1, 64).view("<u4").T)
                heads[np.ix_(some, reps)] = _md5_heads(words).reshape(len(some), len(reps))
    return np.searchsorted(POISSON_ONE, heads / 2.0**32, side="right")


def pack(weights: np.ndarray) -> list[bytes]:
    """Each row as bits: a weight is so many ones and a zero; ones fill the last byte. 200 weights take about 50 bytes."""
    ends = np.cumsum(weights + 1, axis=1)
    sizes = -(-ends[:, -1] // 8)
    bits = np.ones((len(weights), int(sizes.max(initial=0)) * 8), np.uint8)
    np.put_along_axis(bits, ends - 1, 0, axis=1)
    return [row[:n].tobytes() for row, n in zip(np.packbits(bits, axis=1), sizes, strict=True)]


def unpack(rows: list[bytes], replicates: int) -> np.ndarray:
    zeros = np.flatnonzero(np.unpackbits(np.frombuffer(b"".join(rows), np.uint8)) == 0).reshape(len(rows), replicates)
    starts = 8 * np.cumsum([0, *map(len, rows[:-1])])
    return np.diff(zeros, axis=1, prepend=starts[:, None] - 1) - 1


class _Sums:
    """Sums over a range of scores of a group by replicate, from rows in the order of their scores; the last score waits for rows that tie with it."""

    def __init__(self, replicates: int):
        self.won = np.zeros(replicates)
        self.pos, self.neg = np.zeros(replicates, np.int64), np.zeros(replicates, np.int64)
        self.tie = None

    def add(self, score: np.ndarray, y: np.ndarray, w: np.ndarray) -> None:
        same = (score[1:] == score[:-1]) | (np.isnan(score[1:]) & np.isnan(score[:-1]))
        starts = np.r_[0, np.flatnonzero(~same) + 1]
        pos, neg = np.add.reduceat(w * y[:, None], starts, axis=0), np.add.reduceat(w * (1 - y)[:, None], starts, axis=0)
        if self.tie is not None:
            last, p, n = self.tie
            if last == score[0] or (np.isnan(last) and np.isnan(score[0])):
                pos[0] += p
                neg[0] += n
            else:
                pos, neg = np.vstack([p, pos]), np.vstack([n, neg])
        self.tie = (score[-1], pos[-1], neg[-1])
        self._take(pos[:-1], neg[:-1])

    def _take(self, pos: np.ndarray, neg: np.ndarray) -> None:
        below = np.cumsum(neg, axis=0)
        self.won += (pos * (self.neg + below - 0.5 * neg)).sum(0)
        self.pos += pos.sum(0)
        self.neg += neg.sum(0)

    def done(self) -> list[np.ndarray]:
        self._take(self.tie[1][None], self.tie[2][None])
        return [self.won, self.pos, self.neg]


def resampled_auroc(df: DataFrame, by: list[str], replicates: int, scores: tuple[str, ...] = ("p",), seed: str = "boot") -> DataFrame:
    """The columns of ``scoring.auroc`` by ``of`` (the name of the score), group and ``rep``, under Poisson weights of records; replicates in which a group has no row are left out.

    Rows (record_id, y, the scores, ``by``) get their weights in packed form:
    drawn once for rows of a record that stand together. Then they are dealt
    by group and range of scores and sorted; a task adds up its ranges as
    rows pass, with ``replicates`` numbers for each of three sums, whatever the
    size of a group. Only those sums go on.
    """
    rows = df.where("record_id is not null").select(*by, "y", *scores, F.col("record_id").cast("string").alias("_key"))
    schema = rows.drop("_key").schema.add("_w", "binary")

    def drawn(batches):
        for batch in batches:
            key = batch.column(batch.schema.get_field_index("_key")).dictionary_encode()
            packed = pack(poisson_weights([k.encode() for k in key.dictionary.to_pylist()], replicates, seed)) if batch.num_rows else []
            rest = [batch.column(batch.schema.get_field_index(f.name)) for f in schema.fields[:-1]]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(packed, pa.binary()).take(key.indices)], names=schema.names)

    groups = ["of", *by, "_range"]
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("of"), F.col(s).cast("double").alias("_score")) for s in scores])).alias("s")
    dealt = rows.mapInArrow(drawn, schema).select(*by, F.col("y").cast("long").alias("y"), "_w", each).select(*by, "y", "_w", "s.*")
    dealt = dealt.withColumn("_range", F.floor(score_range(F.col("_score")) / 32)).repartition(*groups).sortWithinPartitions(*groups, "_score")
    out = dealt.select(*groups).schema.add("rep", "long").add("won", "double").add("pos", "long").add("neg", "long")

    def summed(batches):
        def piece():
            keys = [pa.array([k] * replicates, t) for k, t in zip(key, types, strict=True)]
            return pa.RecordBatch.from_arrays([*keys, pa.array(range(replicates), pa.int64()), *map(pa.array, sums.done())], names=out.names)

        key = sums = types = None
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                column = lambda c: part.column(part.schema.get_field_index(c))  # noqa: B023, E731
                code = np.stack([column(c).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for c in groups])
                score, y = (column(c).to_numpy(zero_copy_only=False) for c in ("_score", "y"))
                w = unpack(column("_w").to_pylist(), replicates)
                bounds = np.r_[0, np.flatnonzero((code[:, 1:] != code[:, :-1]).any(0)) + 1, part.num_rows]
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    now = tuple(column(c)[a].as_py() for c in groups)
                    if now != key:
                        if sums is not None:
                            yield piece()
                        key, sums, types = now, _Sums(replicates), [column(c).type for c in groups]
                    sums.add(score[a:b], y[a:b], w[a:b])
        if sums is not None:
            yield piece()

    pieces = dealt.mapInArrow(summed, out).where("pos + neg > 0")
    return join_ranges(pieces, ["of", *by, "rep"])
