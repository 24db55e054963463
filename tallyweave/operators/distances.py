"""Distances between vector sets, and resampled, filtered and augmented signals."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.portable import uniform

#: Query vectors that meet a pass over the reference together.
_BLOCK = 4_096


def nearest_distance(queries: DataFrame, reference: DataFrame) -> DataFrame:
    """(id, distance) of each query to its nearest reference row, both (id, vector).

    Queries come in blocks of about 4,096 (by hash of the id); a block is
    broadcast to one pass over the reference, whose tasks give one minimum for
    each query. Null vectors take no part.
    """
    queries, reference = (d.where("vector is not null").select("id", F.col("vector").cast("array<double>").alias("vector")) for d in (queries, reference))
    blocks, out = max(1, -(-queries.count() // _BLOCK)), None
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow()
        ids, x = rows.column("id").to_pylist(), np.array(rows.column("vector").to_pylist(), np.float64)
        if not ids:
            continue
        shared = queries.sparkSession.sparkContext.broadcast((ids, x))

        def run(batches, shared=shared):
            ids, x = shared.value
            best = np.full(len(ids), np.inf)
            for batch in batches:
                if batch.num_rows:
                    y = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
                    for k in range(0, len(y), 512):
                        part = y[k : k + 512]
                        square = (x**2).sum(1)[:, None] + (part**2).sum(1) - 2 * x @ part.T
                        best = np.minimum(best, np.maximum(square, 0).min(1))
            some = np.isfinite(best)
            yield pa.RecordBatch.from_arrays([pa.array([i for i, s in zip(ids, some, strict=True) if s], pa.int64()), pa.array(np.sqrt(best[some]))], names=["id", "distance"])

        found = reference.select("vector").mapInArrow(run, "id long, distance double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return queries.select("id", F.lit(0.0).alias("distance")).limit(0)
    return out.groupBy("id").agg(F.min("distance").alias("distance"))


def memorisation(synthetic: DataFrame, held_out: DataFrame, train: DataFrame) -> DataFrame:
    """Median nearest distance of synthetic rows to the training rows over that of held-out rows."""
    middle = lambda d, name: nearest_distance(d, train).agg(F.percentile("distance", 0.5).alias(name))
    j = middle(synthetic, "synthetic").crossJoin(middle(held_out, "held_out"))
    return j.withColumn("ratio", F.when(F.col("held_out") > 0, F.col("synthetic") / F.col("held_out")))


def diversity(rows: DataFrame, by: str, most: int = 128) -> DataFrame:
    """Mean pairwise distance within each group's hash sample of ``most`` rows (the feature) of (id, vector)."""
    order = W.partitionBy(by).orderBy(F.md5(F.col("id").cast("string")), "id")
    few = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most)
    a, b = few.alias("a"), few.alias("b")
    square = F.aggregate(F.zip_with("a.vector", "b.vector", lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)
    j = a.join(b, (F.col(f"a.{by}") == F.col(f"b.{by}")) & (F.col("a._n") < F.col("b._n")))
    return j.groupBy(F.col(f"a.{by}").alias(by)).agg(F.avg(F.sqrt(square)).alias("mean_distance"), F.count("*").alias("pairs"))


def _around(value: Column, k: int) -> Column:
    """The value ``k`` rows on (or back) in time; the nearest row's at the ends."""
    order = W.partitionBy("record_id", "lead").orderBy("t")
    ends = F.first(value).over(order) if k < 0 else F.last(value).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return F.coalesce(F.lag(value, -k).over(order) if k < 0 else F.lead(value, k).over(order), ends)


def taps(cut: float, half: int) -> list[float]:
    """Weights of a symmetric low-pass: a sinc of ``cut`` (share of the rate) under a Hann window, summing to one."""
    raw = [(2 * cut if k == 0 else math.sin(2 * math.pi * cut * k) / (math.pi * k)) * (0.5 + 0.5 * math.cos(math.pi * k / (half + 1))) for k in range(-half, half + 1)]
    return [x / sum(raw) for x in raw]


def fir(samples: DataFrame, weights: list[float]) -> DataFrame:
    """Signals (record_id, lead, t, value) under symmetric weights, so without a shift; the ends repeat."""
    half = len(weights) // 2
    parts = samples.select("*", *[_around(F.col("value"), k).alias(f"_{k + half}") for k in range(-half, half + 1) if k])
    parts = parts.withColumn(f"_{half}", F.col("value"))
    total = sum((F.lit(w) * F.col(f"_{k}") for k, w in enumerate(weights)), F.lit(0.0))
    return parts.select("record_id", "lead", "t", total.alias("value"))


def low_pass(samples: DataFrame, cut: float = 0.2, half: int = 4) -> DataFrame:
    """Zero-phase low-pass of (record_id, lead, t, value)."""
    return fir(samples, taps(cut, half))


def resample(samples: DataFrame, size: int, new_size: int) -> DataFrame:
    """Signals of ``size`` samples on a grid of ``new_size``: a three-point average, then linear interpolation; unchanged if equal."""
    if size == new_size:
        return samples.select("record_id", "lead", "t", "value")
    smooth = samples.select("record_id", "lead", "t", ((_around(F.col("value"), -1) + F.col("value") + _around(F.col("value"), 1)) / 3).alias("value"))
    ahead = smooth.withColumn("next", _around(F.col("value"), 1))
    low, high = F.ceil(F.col("t") * new_size / size), F.ceil((F.col("t") + 1) * new_size / size) - 1
    grid = F.when(high >= low, F.sequence(low.cast("int"), high.cast("int"))).otherwise(F.array().cast("array<int>"))
    points = ahead.withColumn("i", F.explode(grid))
    share = F.col("i") * size / new_size - F.col("t")
    return points.select("record_id", "lead", F.col("i").alias("t"), (F.col("value") * (1 - share) + F.col("next") * share).alias("value"))


def augment(samples: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """A seeded gain (0.8 to 1.2), circular shift (up to a quarter) and lead drop (1 in 10, to zero) for each record."""
    u = lambda step, *more: uniform(F.concat_ws(":", F.lit(f"{seed}:{step}"), F.col("record_id").cast("string"), *more))
    moved = (F.col("t") + F.floor(u("shift") * (size // 4)).cast("int")) % size
    kept = F.when(u("drop", F.col("lead")) < 0.1, 0.0).otherwise(1.0)
    return samples.select("record_id", "lead", moved.cast("int").alias("t"), (F.col("value") * (0.8 + 0.4 * u("gain")) * kept).alias("value"))


# Probabilities and ranges of the changes that a recording session may bring.
CHANCES = {"gain": 0.5, "warp": 0.3, "shift": 0.5, "drift": 0.5, "mains": 0.2, "noise": 0.5, "drop": 0.15}
GAIN, WARP, SHIFT_S, DRIFT, DRIFT_HZ, MAINS, MAINS_HZ, NOISE = (0.85, 1.15), 0.05, 0.25, 0.10, (0.05, 0.5), 0.03, 50.0, 0.02
_KNOTS = 8


def augment_recordings(samples: DataFrame, size: int, fs: float, seed: int = 0, copies: int = 1) -> DataFrame:
    """``copies`` changed versions (copy, record_id, lead, t, value) of every record of ``size`` samples.

    Each of these happens by its chance, in this order: gain; a smooth time
    warp that keeps the duration; circular shift of up to a quarter second;
    drift (0.05 to 0.5 Hz, of another size on each lead); mains hum; noise;
    one lead set to zero. All draws hang on seed, copy, record and step (noise
    also on lead and sample), so reruns and partitions do not matter. Normal
    numbers are sums of twelve uniform ones less six.

    The warp moves sample i to a place w(i) that rises with i; the value at a
    whole place comes from the two samples whose places enclose it. A record
    stays in one task: its rows are dealt once.
    """
    rows = samples.select("record_id", "lead", "t", "value").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).repartition("copy", "record_id")
    key = lambda step, *more: F.concat_ws(":", F.lit(f"{seed}:{step}"), F.col("copy").cast("string"), F.col("record_id").cast("string"), *more)
    u = lambda step, *more: uniform(key(step, *more))
    happens = lambda step: u(f"{step}?") < CHANCES[step]
    within = lambda step, low, high: F.lit(low) + F.lit(high - low) * u(step)
    normal = lambda step, *more: sum((u(step, F.lit(str(k)), *more) for k in range(1, 12)), u(step, F.lit("0"), *more)) - 6.0
    scaled = rows.withColumn("value", F.col("value") * F.when(happens("gain"), within("gain", *GAIN)).otherwise(1.0))

    # places of the warp, once for each copy and record, from slopes at eight knots
    records = scaled.select("copy", "record_id").distinct()
    records = records.withColumn("knots", F.when(happens("warp"), F.array(*[F.lit(WARP) * normal("warp", F.lit(f"k{k}")) for k in range(_KNOTS)])))
    x = f"(i * {_KNOTS - 1} / {size - 1}D)"
    slope = f"(1 + knots[int(floor({x}))] + ({x} - floor({x})) * (knots[least({_KNOTS - 1}, int(floor({x})) + 1)] - knots[int(floor({x}))]))"
    places = records.where("knots is not null").select("copy", "record_id", F.posexplode(F.expr(f"transform(sequence(0, {size - 1}), i -> {slope})")).alias("t", "step"))
    own = W.partitionBy("copy", "record_id")
    ahead = own.orderBy("t")
    places = places.withColumn("sum", F.sum("step").over(ahead)).withColumn("start", F.first("sum").over(ahead)).withColumn("end", F.max("sum").over(own))
    places = places.select("copy", "record_id", "t", ((F.col("sum") - F.col("start")) / (F.col("end") - F.col("start")) * (size - 1)).alias("place"))
    by_lead = W.partitionBy("copy", "record_id", "lead").orderBy("t")
    met = scaled.join(places, ["copy", "record_id", "t"], "left")
    met = met.withColumn("next", F.lead("place").over(by_lead)).withColumn("after", F.lead("value").over(by_lead))
    # the whole places from this sample's to before the next one's
    low, high = F.ceil(F.col("place") - 1e-12), F.when(F.col("next").isNull(), F.lit(size - 1)).otherwise(F.ceil(F.col("next") - 1e-12) - 1)
    taken = F.when(F.col("place").isNull(), F.array(F.col("t").cast("int"))).when(high >= low, F.sequence(low.cast("int"), high.cast("int"))).otherwise(F.array().cast("array<int>"))
    share = (F.col("i") - F.col("place")) / (F.col("next") - F.col("place"))
    value = F.when(F.col("place").isNull() | F.col("next").isNull() | (F.col("i") <= F.col("place")), F.col("value")).otherwise(F.col("value") + share * (F.col("after") - F.col("value")))
    warped = met.withColumn("i", F.explode(taken)).select("copy", "record_id", "lead", F.col("i").alias("t"), value.alias("value"))

    most = int(SHIFT_S * fs)
    by = F.when(happens("shift"), F.floor(F.lit(2.0 * most) * u("shift")).cast("int") - most).otherwise(0)
    turn = lambda hz, phase: F.sin(2 * math.pi * hz * F.col("t") / fs + 2 * math.pi * phase)
    drift = F.lit(DRIFT) * within("drift size", 0.4, 1.0) * turn(within("drift hz", *DRIFT_HZ), u("drift phase")) * (0.5 + 0.5 * u("drift lead", F.col("lead")))
    mains = F.lit(MAINS) * turn(F.lit(MAINS_HZ), u("mains phase"))
    noise = F.lit(NOISE) * normal("noise", F.col("lead"), F.col("t").cast("string"))
    added = sum((F.when(happens(n), v).otherwise(0.0) for n, v in (("mains", mains), ("noise", noise))), F.when(happens("drift"), drift).otherwise(0.0))
    moved = warped.withColumn("t", F.pmod(F.col("t") + by, F.lit(size)).cast("int")).withColumn("value", F.col("value") + added)
    # the lead that drops is the one whose draw is smallest
    draw = moved.withColumn("draw", u("drop", F.col("lead"))).withColumn("least", F.min("draw").over(own))
    lost = happens("drop") & (F.col("draw") == F.col("least"))
    return draw.select("copy", "record_id", "lead", "t", F.when(lost, 0.0).otherwise(F.col("value")).alias("value"))
