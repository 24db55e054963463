"""Wave regions of signals: readings of a median beat, mass by region, and verdicts on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .signals import KEY, median_beat

#: Regions from the strongest claim on a sample to the weakest.
PRIORITY = ("qrs", "st", "t_wave", "p")
REGIONS = (*PRIORITY, "baseline")


def split_half(segs: DataFrame) -> DataFrame:
    """Median beats of the odd and of the even beats of a record and lead, as two studies (column ``half``)."""
    nth = F.dense_rank().over(W.partitionBy(*KEY).orderBy("beat"))
    halves = segs.withColumn("lead", F.struct("lead", F.when(nth % 2 == 1, "odd").otherwise("even").alias("half")))
    return median_beat(halves).select("record_id", F.col("lead.lead").alias("lead"), F.col("lead.half").alias("half"), "offset", "value")


def beat_readings(beat: DataFrame, before: tuple[int, int], level_at: int, peak: tuple[int, int]) -> DataFrame:
    """Level at an offset and largest excursion within ``peak``, both from the mean of the offsets ``before`` (ends included).

    Ties of the excursion go to the earlier offset.
    """
    base = F.avg(F.when(F.col("offset").between(*before), F.col("value")))
    at = F.max(F.when(F.col("offset") == level_at, F.col("value")))
    g = beat.join(beat.groupBy(*KEY).agg(base.alias("base"), at.alias("at")), KEY).withColumn("x", F.col("value") - F.col("base"))
    top = F.max_by("x", F.when(F.col("offset").between(*peak), F.struct(F.round(F.abs("x"), 9), -F.col("offset"))))
    return g.groupBy(*KEY).agg((F.first("at") - F.first("base")).alias("level"), top.alias("peak"))


def region_mass(samples: DataFrame, beats: DataFrame, windows: dict[str, tuple[int, int]]) -> DataFrame:
    """Share of the absolute signal in each region, and the number of beats, by record and lead.

    ``windows`` gives for each region its offsets from a beat, the first
    included and the last not. A sample in several windows belongs to the
    first region of ``PRIORITY``; outside all it is baseline. Without beats
    all shares are 0 and without mass all of it is baseline. Beats meet
    samples by equality of time: each beat names its few samples.
    """
    offsets = [(p, o) for p, r in enumerate(PRIORITY) for o in range(*windows[r])]
    claim = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(o).alias("o")) for p, o in offsets]))
    claims = beats.select(*KEY, "t", claim.alias("c")).groupBy(*KEY, (F.col("t") + F.col("c.o")).alias("t")).agg(F.min("c.p").alias("p"))
    mass = F.abs("value")
    of = lambda k: F.coalesce(F.sum(F.when(F.col("p") == k, mass)), F.lit(0.0))
    g = samples.join(claims, [*KEY, "t"], "left").groupBy(*KEY).agg(F.sum(mass).alias("total"), *[of(k).alias(r) for k, r in enumerate(PRIORITY)])
    g = g.join(beats.groupBy(*KEY).agg(F.count("*").alias("n_beats")), KEY, "left").withColumn("n_beats", F.coalesce("n_beats", F.lit(0).cast("long")))
    some = (F.col("total") > 0) & (F.col("n_beats") > 0)
    share = [F.when(some, F.col(r) / F.col("total")).otherwise(0.0).alias(r) for r in PRIORITY]
    rest = F.when(some, (F.col("total") - sum((F.col(r) for r in PRIORITY), F.lit(0.0))) / F.col("total")).when(F.col("total") > 0, 0.0).otherwise(1.0)
    return g.select(*KEY, *share, rest.alias("baseline"), "n_beats")


def region_verdict(family: Column, least_beats: int = 3, margin: float = 1.2) -> Column:
    """Consistent, inconsistent or inconclusive for a row of ``region_mass``.

    Repolarisation (ST and T) has to beat P by the margin and be the largest;
    an irregular rhythm must not lie mostly on P. Other families and records
    of few beats are inconclusive. Shares are compared to six digits.
    """
    p, qrs, st, t, base = (F.round(F.col(r), 6) for r in ("p", "qrs", "st", "t_wave", "baseline"))
    repol = F.round(F.col("st") + F.col("t_wave"), 6)
    shown = (repol >= margin * F.greatest(p, F.lit(1e-6))) & (repol >= F.greatest(qrs, p))
    on_p = (p > 0) & (p >= margin * F.greatest(qrs, st, t, base))
    return (
        F.when(F.col("n_beats") < least_beats, "inconclusive")
        .when(family == "repolarization", F.when(shown, "consistent").when(p > repol, "inconsistent").otherwise("inconclusive"))
        .when(family == "rhythm_irregular", F.when(on_p, "inconsistent").otherwise("consistent"))
        .otherwise("inconclusive")
    )


def verdict_summary(verdicts: DataFrame) -> DataFrame:
    """By family: rows, conclusive and consistent ones, their rate (null without conclusive rows), and mean shares."""
    checked, good = F.count_if(F.col("verdict") != "inconclusive"), F.count_if(F.col("verdict") == "consistent")
    return verdicts.groupBy("family").agg(
        F.count("*").alias("n_total"), checked.alias("n_checked"), good.alias("n_consistent"), (good / F.nullif(checked, F.lit(0))).alias("rate"), *[F.avg(r).alias(f"mean_{r}") for r in REGIONS]
    )
