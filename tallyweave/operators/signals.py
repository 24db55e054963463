"""Signal tables: (record_id, lead, t, value) in long form, and sample arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

KEY = ["record_id", "lead"]


def zscore(df: DataFrame) -> DataFrame:
    """(x - mean) / (population deviation + 1e-8) by record and lead."""
    w = W.partitionBy(*KEY)
    return df.withColumn("value", (F.col("value") - F.avg("value").over(w)) / (F.stddev_pop("value").over(w) + 1e-8))


def robust_scale(df: DataFrame) -> DataFrame:
    """(x - median) / (interquartile range + 1e-8), linear percentiles."""
    q = df.groupBy(*KEY).agg(F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    return df.join(q, KEY).withColumn("value", (F.col("value") - F.col("q")[1]) / (F.col("q")[2] - F.col("q")[0] + 1e-8)).drop("q")


def fixed_length(samples: Column, n: int) -> Column:
    """The centre n samples, or the samples with zeros after them."""
    size = F.size(samples)
    cut = F.slice(samples, F.floor((size - n) / 2).cast("int") + 1, F.lit(n))
    zero = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.lit(0.0).cast("float"))
    return F.when(size >= n, cut).otherwise(F.slice(F.concat(samples, zero), 1, n))


def sliding_windows(df: DataFrame, samples: str, size: int, stride: int) -> DataFrame:
    """Overlapping windows; a signal shorter than one gives a single short window."""
    last = F.greatest(F.lit(0), F.size(samples) - size)
    starts = df.withColumn("start", F.explode(F.sequence(F.lit(0), last, F.lit(stride))))
    return starts.withColumn("window", F.slice(samples, F.col("start") + 1, F.lit(size))).drop(samples)


def remove_baseline(df: DataFrame, near: int, far: int) -> DataFrame:
    """Minus a rolling median of a rolling median (half-widths in samples); windows are cut at the edges."""
    w = lambda k: W.partitionBy(*KEY).orderBy("t").rowsBetween(-k, k)
    first = df.withColumn("m1", F.percentile("value", F.lit(0.5)).over(w(near)))
    return first.withColumn("value", F.col("value") - F.percentile("m1", F.lit(0.5)).over(w(far))).drop("m1")


def beat_candidates(df: DataFrame, width: int) -> DataFrame:
    """Local maxima of the moving average of the squared derivative."""
    w = W.partitionBy(*KEY).orderBy("t")
    d = df.withColumn("d", F.col("value") - F.lag("value").over(w)).withColumn("d", F.coalesce(F.col("d") * F.col("d"), F.lit(0.0)))
    e = d.withColumn("energy", F.round(F.avg("d").over(w.rowsBetween(-width + 1, 0)), 9))
    up, down = F.lag("energy").over(w), F.lead("energy").over(w)
    return e.withColumn("peak", (F.col("energy") > up) & (F.col("energy") >= down)).where("peak").select(*KEY, "t", "energy")


def beat_rates(beats: DataFrame, ms: float = 1.0) -> DataFrame:
    """Mean rate from beat spacing (null under two beats), relative variation of it (null under three)."""
    rr = (F.col("t") - F.lag("t").over(W.partitionBy("record_id").orderBy("t"))) * ms
    g = beats.withColumn("rr", rr).groupBy("record_id").agg(F.count("*").alias("beats"), F.avg("rr").alias("mean_rr"), F.stddev_pop("rr").alias("sd"))
    return g.select("record_id", "beats", F.when(F.col("beats") >= 2, 60000.0 / F.col("mean_rr")).alias("rate"), F.when(F.col("beats") >= 3, F.col("sd") / F.col("mean_rr")).alias("rr_cv"))


def segments(samples: DataFrame, beats: DataFrame, before: int, after: int, bucket: int = 64) -> DataFrame:
    """The samples around each beat by offset; beats that run off either end are left out.

    A range join with an equality on record, lead and time bucket.
    """
    near = beats.select(*KEY, F.col("t").alias("beat")).withColumn("b", F.explode(F.sequence(F.floor((F.col("beat") - before) / bucket), F.floor((F.col("beat") + after) / bucket))))
    s = samples.withColumn("b", F.floor(F.col("t") / bucket))
    j = near.join(s, [*KEY, "b"]).where((F.col("t") >= F.col("beat") - before) & (F.col("t") <= F.col("beat") + after)).withColumn("offset", F.col("t") - F.col("beat")).drop("b")
    full = F.count("*").over(W.partitionBy(*KEY, "beat")) == before + after + 1
    return j.withColumn("full", full).where("full").select(*KEY, "beat", "offset", "value")


def median_beat(segs: DataFrame, least_corr: float = 0.8, least: int = 3) -> DataFrame:
    """Median by offset of the beats that agree with a first median; all beats where fewer than ``least`` agree, null with fewer than ``least`` at all."""
    first = segs.groupBy(*KEY, "offset").agg(F.percentile("value", F.lit(0.5)).alias("m"))
    corr = segs.join(first, [*KEY, "offset"]).groupBy(*KEY, "beat").agg(F.corr("value", "m").alias("c"))
    good = corr.withColumn("good", F.coalesce(F.round("c", 9) >= least_corr, F.lit(False)))
    w = W.partitionBy(*KEY)
    use = good.withColumn("n", F.count("*").over(w)).withColumn("n_good", F.count_if("good").over(w)).where((F.col("n_good") < least) | F.col("good"))
    m = segs.join(use.select(*KEY, "beat", "n"), [*KEY, "beat"])
    return m.groupBy(*KEY, "offset").agg(F.when(F.max("n") >= least, F.percentile("value", F.lit(0.5))).alias("value"))


def intervals(obs: DataFrame) -> DataFrame:
    """Corrected QT by both rules; values out of range become null with a note, never clipped."""
    rr = F.col("rr") / 1000.0
    df = obs.withColumn("qtc_b", F.col("qt") / F.sqrt(rr)).withColumn("qtc_f", F.col("qt") / F.cbrt(rr))
    bounds = {"pr": (80, 400), "qt": (200, 700), "qtc_b": (280, 700), "qtc_f": (280, 700)}
    notes = F.array_compact(F.array(*[F.when(~F.col(c).between(*b), F.lit(f"{c} out of range")) for c, b in bounds.items()]))
    df = df.withColumn("notes", notes)
    for c, b in bounds.items():
        df = df.withColumn(c, F.when(F.col(c).between(*b), F.col(c)))
    return df


def fidelity(df: DataFrame, other: DataFrame, lags: int = 4) -> DataFrame:
    """Best correlation of two signals over lags, by record and lead, and the lag."""
    moved = other.withColumn("lag", F.explode(F.sequence(F.lit(-lags), F.lit(lags)))).select(*KEY, (F.col("t") + F.col("lag")).alias("t"), "lag", F.col("value").alias("other"))
    c = df.join(moved, [*KEY, "t"]).groupBy(*KEY, "lag").agg(F.round(F.corr("value", "other"), 6).alias("corr"))
    return c.groupBy(*KEY).agg(F.max("corr").alias("corr"), F.max_by("lag", F.struct("corr", -F.abs("lag"), "lag")).alias("lag"))


def pair_fidelity(df: DataFrame, other: DataFrame, size: int, lags: int = 4, margin: int = 6) -> DataFrame:
    """record_id, corr, error: means over leads of the best correlation over circular lags and of the relative error at that lag.

    The correlation leaves out ``margin`` samples at either end and is 0 for a
    flat signal; the smallest of equally good lags counts. The error is the
    root mean square difference of all samples over the deviation of ``df``
    (over 1 where that is 0).
    """
    moved = other.withColumn("lag", F.explode(F.sequence(F.lit(-lags), F.lit(lags)))).select(*KEY, F.pmod(F.col("t") + F.col("lag"), F.lit(size)).alias("t"), "lag", F.col("value").alias("other"))
    inside = F.col("t").between(margin, size - margin - 1)
    d = F.col("value") - F.col("other")
    c = df.join(moved, [*KEY, "t"]).groupBy(*KEY, "lag").agg(
        F.round(F.coalesce(F.nanvl(F.corr(F.when(inside, F.col("value")), F.when(inside, F.col("other"))), F.lit(0.0)), F.lit(0.0)), 9).alias("corr"),
        (F.sqrt(F.avg(d * d)) / F.coalesce(F.nullif(F.stddev_pop("value"), F.lit(0.0)), F.lit(1.0))).alias("error"),
    )
    best = c.groupBy(*KEY).agg(F.max_by(F.struct("corr", "error"), F.struct("corr", -F.col("lag"))).alias("b"))
    return best.groupBy("record_id").agg(F.avg("b.corr").alias("corr"), F.avg("b.error").alias("error"))
