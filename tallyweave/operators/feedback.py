"""Reviewer feedback: surfacing with exploration, tallies, agreement and threshold updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.portable import ratio, uniform


def select_findings(df: DataFrame, thresholds: DataFrame, key: Column, floor: float = 0.2, rate: float = 0.05) -> DataFrame:
    """Findings over their label's threshold (0.5 by default), and below it, from ``floor`` on, a hash share as exploratory ones."""
    j = df.join(F.broadcast(thresholds), "label", "left").withColumn("t", F.coalesce("threshold", F.lit(0.5)))
    shown, tried = F.col("p") >= F.col("t"), (F.col("p") >= floor) & (uniform(key) < rate)
    return j.where(shown | tried).select("record_id", "label", F.col("p").alias("confidence"), (~shown).alias("exploratory"))


def tallies(ratings: DataFrame, missed: DataFrame) -> DataFrame:
    """Verdict counts and reported misses by label; labels seen in either table."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    r = ratings.groupBy("label").agg(n("correct").alias("correct"), n("incorrect").alias("incorrect"), n("uncertain").alias("uncertain"), F.sum(1 / F.col("sampling_rate")).alias("weight"))
    m = missed.groupBy("label").agg(F.count("*").alias("missed"))
    zero = F.lit(0).cast("long")
    j = r.join(m, "label", "full")
    return j.select("label", *[F.coalesce(c, zero).alias(c) for c in ("correct", "incorrect", "uncertain", "missed")], F.coalesce("weight", F.lit(0.0)).alias("weight"))


def missed_confidences(missed: DataFrame) -> DataFrame:
    """Sorted confidences of reported misses by label."""
    return missed.where("confidence is not null").groupBy("label").agg(F.array_sort(F.collect_list("confidence")).alias("confidences"))


def store_summary(ratings: DataFrame, missed: DataFrame) -> DataFrame:
    """One row of counts over the feedback tables."""
    r = ratings.agg(
        F.count("*").alias("ratings"), F.count_if("exploratory").alias("exploratory"), F.count_distinct("reviewer_id").alias("reviewers"), F.count_distinct("label").alias("labels"),
        F.count_if(F.col("verdict") == "correct").alias("correct"), F.count_if(F.col("verdict") == "incorrect").alias("incorrect"), F.count_if(F.col("verdict") == "uncertain").alias("uncertain"),
    )
    return r.crossJoin(missed.agg(F.count("*").alias("missed")))


def rater_agreement(ratings: DataFrame) -> DataFrame:
    """Findings with two or more ratings, and the share of them with one verdict."""
    g = ratings.groupBy("finding_id").agg(F.count("*").alias("n"), F.count_distinct("verdict").alias("v")).where("n >= 2")
    return g.agg(F.count("*").alias("rated_twice"), F.avg((F.col("v") == 1).cast("int")).alias("agreement"))


def weighted_f1(ratings: DataFrame) -> DataFrame:
    """Importance-weighted F1 and evidence of each label at 19 thresholds; uncertain verdicts don't count.

    Ratings collapse to (label, score step, verdict) sums before they meet the grid.
    """
    step = F.least(F.floor(F.col("confidence") * 20 + 1e-9), F.lit(19))
    known = ratings.where("verdict <> 'uncertain'")
    sums = known.groupBy("label", step.alias("step"), "verdict").agg(F.sum(F.round(1 / F.col("sampling_rate"), 6)).alias("w"))
    grid = ratings.sparkSession.range(1, 20).withColumnRenamed("id", "k")
    hit, good = F.col("step") >= F.col("k"), F.col("verdict") == "correct"
    total = lambda c: F.sum(F.when(c, F.col("w")).otherwise(0.0))
    g = sums.crossJoin(F.broadcast(grid)).groupBy("label", "k").agg(total(hit & good).alias("tp"), total(hit & ~good).alias("fp"), total(~hit & good).alias("fn"))
    f = F.coalesce(ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    return g.select("label", "k", (F.col("k") * 5 / 100.0).alias("t"), F.round(f, 9).alias("f1"), (F.col("tp") + F.col("fp")).alias("evidence"))


def decide_thresholds(ratings: DataFrame, current: float = 0.5, least: int = 20, most_step: float = 0.1, gain: float = 1e-6) -> DataFrame:
    """New threshold by label under the F1 objective, with a reason.

    Hold under ``least`` informative ratings; else the lowest threshold of
    best F1 with some evidence, if it beats the current one; a move is at
    most ``most_step`` and the result stays within 0.05 to 0.95.
    """
    n = ratings.groupBy("label").agg(F.count_if(F.col("verdict") != "uncertain").alias("n"))
    f = weighted_f1(ratings)
    best = f.where("evidence >= 1").groupBy("label").agg(F.min(F.struct((-F.col("f1")).alias("f"), "t")).alias("b"))
    now = f.where(F.abs(F.col("t") - current) < 1e-9).select("label", F.col("f1").alias("now_f1"))
    j = n.join(best, "label", "left").join(now, "label", "left")
    better = (-F.col("b.f")) > F.coalesce("now_f1", F.lit(0.0)) + gain
    moved = F.greatest(F.lit(0.05), F.least(F.lit(0.95), F.round(F.lit(current) + F.greatest(F.lit(-most_step), F.least(F.lit(most_step), F.col("b.t") - current)), 6)))
    reason = F.when(F.col("n") < least, "few ratings").when(F.col("b").isNull(), "no evidence").when(~better, "no better threshold").otherwise("moved")
    return j.select("label", F.when(reason == "moved", moved).otherwise(F.lit(current)).alias("threshold"), reason.alias("reason"))


def exploration_rates(counts: DataFrame, base: float = 0.05, most: float = 0.25) -> DataFrame:
    """Base rate, raised with reported misses up to a bound."""
    return counts.select("label", F.round(F.least(F.lit(most), base * (1 + F.col("missed"))), 4).alias("rate"))


def macro_scores(df: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Macro recall and F1 over present labels, macro precision only over labels that predict."""
    j = df.join(F.broadcast(thresholds), "label", "left").withColumn("hit", F.col("p") >= F.coalesce("threshold", F.lit(0.5)))
    g = j.groupBy("label").agg(*[F.count_if(c).alias(n) for n, c in (("tp", F.col("hit") & (F.col("y") == 1)), ("fp", F.col("hit") & (F.col("y") == 0)), ("fn", ~F.col("hit") & (F.col("y") == 1)))])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return g.agg(F.avg(F.when(tp + fp > 0, tp / (tp + fp))).alias("precision"), F.avg(F.when(tp + fn > 0, tp / (tp + fn))).alias("recall"), F.avg(F.when(tp + fn > 0, 2 * tp / (2 * tp + fp + fn))).alias("f1"))
