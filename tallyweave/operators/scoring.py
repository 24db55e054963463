"""Scores of a long prediction table (record_id, label, y, p[, z]): ranking, calibration, thresholds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.portable import r6, ratio


def score_range(score: Column) -> Column:
    """The number of a score's range: rises with the score, whatever its scale; some thousands between the usual smallest and largest."""
    x = score.cast("double")
    return F.floor(F.signum(x) * F.log2(1 + F.abs(x) * 1024) * 256).cast("int")


def auroc(df: DataFrame, by: list[str], score: str = "p", y: str = "y", weight: Column | None = None) -> DataFrame:
    """Rank statistic by group, tied scores at mid-rank; null with one class only.

    Rows collapse to one per distinct score. Ranks come from two levels of
    prefix sums: within a range of scores of a group, and over the sums of the
    group's ranges, of which there are some thousands at most. So no task
    sorts all scores of a label.
    """
    w = F.lit(1) if weight is None else weight
    tied = df.withColumn("_range", score_range(F.col(score))).groupBy(*by, "_range", score).agg(F.sum(w * F.col(y)).alias("pos"), F.sum(w * (1 - F.col(y))).alias("neg"))
    won = F.col("pos") * (_before("neg", score, *by, "_range") + 0.5 * F.col("neg"))
    ranges = tied.withColumn("won", won).groupBy(*by, "_range").agg(F.sum("won").alias("won"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return join_ranges(ranges, by)


def _before(c: str, order: str, *part: str) -> Column:
    return F.coalesce(F.sum(c).over(W.partitionBy(*part).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def join_ranges(ranges: DataFrame, by: list[str]) -> DataFrame:
    """The AUROC of a group from the sums of its ranges: ``_range``, pos, neg, and won, the pairs won within the range."""
    ranges = ranges.withColumn("won", F.col("won") + F.col("pos") * _before("neg", "_range", *by))
    g = ranges.groupBy(*by).agg(F.sum("won").alias("won"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return g.select(*by, "n_pos", "n_neg", ratio(F.col("won"), F.col("n_pos") * F.col("n_neg")).alias("auroc"))


def macro(scores: DataFrame, value: str = "auroc", by: list[str] = ()) -> DataFrame:
    """Mean over the labels where the score is defined."""
    return scores.groupBy(*by).agg(F.avg(value).alias(f"macro_{value}"), F.count(value).alias("n_labels"))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """2tp / (2tp + fp + fn), 0 where nothing is present or predicted."""
    return F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0))


def confusion(df: DataFrame, by: list[str], predicted: Column, y: str = "y") -> DataFrame:
    hit = predicted.cast("boolean")
    return df.groupBy(*by).agg(
        F.count_if(hit & (F.col(y) == 1)).alias("tp"), F.count_if(hit & (F.col(y) == 0)).alias("fp"), F.count_if(~hit & (F.col(y) == 1)).alias("fn")
    )


def f1_scores(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Macro and micro F1 in one row, from one pass by label."""
    c = confusion(df, ["label"], F.col("p") >= threshold)
    return c.agg(F.avg(f1(F.col("tp"), F.col("fp"), F.col("fn"))).alias("macro_f1"), f1(F.sum("tp"), F.sum("fp"), F.sum("fn")).alias("micro_f1"))


def threshold_grid(spark) -> DataFrame:
    """19 thresholds from 0.05 to 0.95."""
    return spark.range(1, 20).select((F.col("id") * 5 / 100.0).alias("t"))


def tune_thresholds(df: DataFrame) -> DataFrame:
    """Threshold of best F1 by label, the lowest of equals, 0.5 where none scores.

    Rows collapse to (label, score step, y) counts before they meet the grid,
    which is a broadcast of 19 rows.
    """
    step = F.least(F.floor(F.col("p") * 20 + 1e-9), F.lit(19))
    counts = df.groupBy("label", step.alias("step"), "y").agg(F.count("*").alias("n"))
    grid = df.sparkSession.range(1, 20).withColumnRenamed("id", "k")
    hit = F.col("step") >= F.col("k")
    c = counts.crossJoin(F.broadcast(grid)).groupBy("label", "k").agg(
        *[F.sum(F.when(cond, F.col("n")).otherwise(0)).alias(name) for name, cond in (("tp", hit & (F.col("y") == 1)), ("fp", hit & (F.col("y") == 0)), ("fn", ~hit & (F.col("y") == 1)))]
    )
    scored = c.withColumn("f1", r6(f1(F.col("tp"), F.col("fp"), F.col("fn"))))
    best = W.partitionBy("label").orderBy(F.desc("f1"), "k")
    top = scored.withColumn("rn", F.row_number().over(best)).where("rn = 1")
    return top.select("label", F.when(F.col("f1") > 0, F.col("k") * 5 / 100.0).otherwise(0.5).alias("threshold"), "f1")


def bin_of(p: Column, n: int) -> Column:
    """Equal-width bin of a probability; the last bin is closed."""
    return F.least(F.floor(p * n + 1e-9), F.lit(n - 1)).cast("int")


def reliability(df: DataFrame, n: int = 15, by: list[str] = ()) -> DataFrame:
    """Per bin count, mean score and share of positives; empty bins are left out."""
    g = df.groupBy(*by, bin_of(F.col("p"), n).alias("bin"))
    return g.agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("mean_y"))


def exact_quantiles(df: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """One row with ``quantiles``, the exact quantiles of a column, between neighbours by distance; an array of nulls for no rows.

    Counts by range of values say in which ranges the wanted places lie; only
    the rows of these are then counted by value. So no task sorts all values.
    """
    known = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v")).withColumn("range", score_range(F.col("v")))
    below = lambda c, *by: F.coalesce(F.sum(c).over(W.partitionBy(*by).orderBy("v" if by else "range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = known.groupBy("range").agg(F.count("*").alias("n")).withColumn("before", below("n")).withColumn("total", F.sum("n").over(W.partitionBy()))
    at = lambda q: (F.col("total") - 1) * F.lit(float(q))
    places = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(up).alias("up"), (F.ceil(at(q)) if up else F.floor(at(q))).alias("place"), (at(q) - F.floor(at(q))).alias("part")) for k, q in enumerate(shares) for up in (0, 1)])
    wanted = ranges.select("range", "n", "before", F.explode(places).alias("w")).where("w.place >= before and w.place < before + n").select("range", "before", "w.*")
    few = known.join(F.broadcast(wanted.select("range").distinct()), "range", "left_semi")  # at most two ranges for each share
    values = few.groupBy("range", "v").agg(F.count("*").alias("c")).withColumn("local", below("c", "range"))
    met = values.join(F.broadcast(wanted), "range").where("place >= before + local and place < before + local + c")
    each = met.groupBy("k").agg(F.max(F.when(F.col("up") == 0, F.col("v"))).alias("low"), F.max(F.when(F.col("up") == 1, F.col("v"))).alias("high"), F.max("part").alias("part"))
    found = each.agg(F.collect_list(F.struct("k", (F.col("low") + F.col("part") * (F.col("high") - F.col("low"))).alias("q"))).alias("all"))
    pick = lambda k: F.get(F.filter("all", lambda x: x["k"] == k), F.lit(0))["q"]
    return found.select(F.array(*[pick(k) for k in range(len(shares))]).alias("quantiles"))


def quantile_reliability(df: DataFrame, n: int = 10) -> DataFrame:
    """Bins of equal counts; edges are the distinct quantiles with the ends at 0 and 1."""
    inner = exact_quantiles(df, "p", [k / n for k in range(1, n)])
    edges = inner.select(F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0)), "quantiles"))).alias("edges"))
    placed = df.crossJoin(F.broadcast(edges)).withColumn("bin", F.size(F.filter("edges", lambda e: e <= F.col("p"))) - 1)
    return placed.groupBy("bin").agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("mean_y"))


def calibration_error(curve: DataFrame, by: list[str] = ()) -> DataFrame:
    """Count-weighted mean gap (ECE) and largest gap (MCE) of a reliability curve."""
    gap = F.abs(F.col("mean_p") - F.col("mean_y"))
    return curve.groupBy(*by).agg((F.sum(gap * F.col("n")) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"))


def classwise_error(df: DataFrame, n: int = 15, least_positives: int = 10) -> DataFrame:
    """ECE of each label with enough positives."""
    enough = df.groupBy("label").agg(F.sum("y").alias("pos")).where(F.col("pos") >= least_positives)
    return calibration_error(reliability(df.join(F.broadcast(enough.select("label")), "label", "left_semi"), n, ["label"]), ["label"])


def accuracy_style_error(df: DataFrame, n: int = 15) -> DataFrame:
    """The older variant: confidence against correctness, the last bin open, so that a score of 1 is left out."""
    conf = F.greatest(F.col("p"), 1 - F.col("p"))
    right = ((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("int")
    rows = df.select(conf.alias("c"), right.alias("r"), F.floor(conf * n + 1e-9).alias("bin")).where(F.col("bin") < n)
    total = df.agg(F.count("*").alias("total"))
    g = rows.groupBy("bin").agg(F.count("*").alias("n"), F.avg("c").alias("c"), F.avg("r").alias("r"))
    return g.crossJoin(F.broadcast(total)).agg(F.sum(F.col("n") * F.abs(F.col("c") - F.col("r")) / F.col("total")).alias("ece"))


def cross_entropy(p: Column, y: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-7)), F.lit(1 - 1e-7))
    return -(y * F.log(q) + (1 - y) * F.log(1 - q))


def brier_and_nll(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """Mean squared error and mean cross-entropy."""
    return df.groupBy(*by).agg(F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("brier"), F.avg(cross_entropy(F.col("p"), F.col("y"))).alias("nll"))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def _best_temperature(hist: DataFrame, grid: DataFrame, by: list[str]) -> DataFrame:
    loss = F.sum(F.col("n") * cross_entropy(sigmoid(F.col("z") / F.col("t")), F.col("y"))) / F.sum("n")
    scored = hist.join(grid, by) if by and set(by) <= set(grid.columns) else hist.crossJoin(F.broadcast(grid))
    return scored.groupBy(*by, "t").agg(F.round(loss, 9).alias("nll")).groupBy(*by).agg(F.min(F.struct("nll", "t")).alias("best")).select(*by, "best.t", "best.nll")


def temperatures(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """Temperature of least cross-entropy: 60 log steps from 0.25 to 12, then 40 linear steps around the best.

    Logits are rounded to two digits and counted first, so the grids meet a
    bounded histogram.
    """
    by = list(by)
    spark = df.sparkSession
    hist = df.groupBy(*by, F.round("z", 2).alias("z"), "y").agg(F.count("*").alias("n"))
    coarse = spark.range(60).select((0.25 * F.pow(F.lit(48.0), F.col("id") / 59.0)).alias("t"))
    first = _best_temperature(hist, coarse, by)
    fine = first.select(*by, F.explode(F.transform(F.sequence(F.lit(0), F.lit(39)), lambda k: F.col("t") * (0.8 + k * (0.45 / 39.0)))).alias("t"))
    return _best_temperature(hist, fine, by)


def label_temperatures(df: DataFrame, least: int = 10) -> DataFrame:
    """Label, t, nll; a label of under ``least`` positives, or of positives alone, takes the global temperature."""
    n = df.groupBy("label").agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    whole = temperatures(df).select(F.col("t").alias("all_t"))
    enough = (F.col("pos") >= least) & (F.col("pos") < F.col("n"))
    j = temperatures(df, ["label"]).join(F.broadcast(n), "label").crossJoin(F.broadcast(whole))
    return j.select("label", F.when(enough, F.col("t")).otherwise(F.col("all_t")).alias("t"), F.when(enough, F.col("nll")).alias("nll"))


def _affine(z: np.ndarray, y: np.ndarray, n: np.ndarray, rounds: int = 60) -> tuple[float, float, float]:
    """a, b and mean cross-entropy of the best sigmoid(a z + b) by damped Newton steps; 1e-3 <= a <= 100, |b| <= 100."""

    def loss(w: np.ndarray) -> float:
        x = w[0] * z + w[1]
        return float((n * (np.logaddexp(0.0, x) - y * x)).sum() / n.sum())

    at, low, high = np.array([1.0, 0.0]), np.array([1e-3, -100.0]), np.array([100.0, 100.0])
    best, design = loss(at), np.stack([z, np.ones_like(z)])
    for _ in range(rounds):
        q = 1.0 / (1.0 + np.exp(-np.clip(at[0] * z + at[1], -500, 500)))
        slope = design @ (n * (q - y)) / n.sum()
        bend = (design * (n * q * (1 - q))) @ design.T / n.sum() + 1e-9 * np.eye(2)
        move, size = np.linalg.solve(bend, slope), 1.0
        while size > 1e-6 and loss(np.clip(at - size * move, low, high)) >= best:
            size /= 2
        new = np.clip(at - size * move, low, high)
        if best - loss(new) < 1e-12:
            break
        at, best = new, loss(new)
    return float(at[0]), float(at[1]), best


def label_affine(df: DataFrame, least: int = 10) -> DataFrame:
    """Label, a, b, nll of sigmoid(a z + b); a label of under ``least`` positives, or of positives alone, takes the fit over all labels (nll null).

    Logits are rounded to three digits and counted first, so a fit meets a
    histogram whose size the clipped scores bound, whatever the rows. The
    optimum is found by Newton steps, so it is at or below one searched on a
    grid of steps. Rows with a null z or y are left out.
    """
    hist = df.where("z is not null and y is not null").groupBy("label", F.round("z", 3).alias("z"), F.col("y").cast("double").alias("y")).agg(F.count("*").cast("double").alias("n"))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        a, b, nll = _affine(rows["z"].to_numpy(), rows["y"].to_numpy(), rows["n"].to_numpy())
        return pd.DataFrame({"label": rows["label"].iloc[:1], "a": [a], "b": [b], "nll": [nll]})

    out = "label string, a double, b double, nll double"
    own = hist.groupBy("label").applyInPandas(fit, out)
    whole = hist.groupBy("z", "y").agg(F.sum("n").alias("n")).withColumn("label", F.lit("")).groupBy("label").applyInPandas(fit, out)
    counts = hist.groupBy("label").agg(F.sum(F.col("y") * F.col("n")).alias("pos"), F.sum("n").alias("n"))
    j = own.join(F.broadcast(counts), "label").crossJoin(F.broadcast(whole.select(F.col("a").alias("all_a"), F.col("b").alias("all_b"))))
    enough = (F.col("pos") >= least) & (F.col("pos") < F.col("n"))
    return j.select("label", F.when(enough, F.col("a")).otherwise(F.col("all_a")).alias("a"), F.when(enough, F.col("b")).otherwise(F.col("all_b")).alias("b"), F.when(enough, F.col("nll")).alias("nll"))


def apply_temperature(df: DataFrame, fitted: DataFrame, by: list[str] = ()) -> DataFrame:
    """Calibrated score p_cal from a table of temperatures; order within a label stays."""
    joined = df.join(F.broadcast(fitted.select(*by, "t")), list(by), "left") if by else df.crossJoin(F.broadcast(fitted.select("t")))
    return joined.withColumn("p_cal", sigmoid(F.col("z") / F.coalesce("t", F.lit(1.0)))).drop("t")


def effect_table(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Over-flags and misses per record, recall and F1 before (p) and after (p2)."""
    long = df.select("record_id", "label", "y", F.explode(F.array(F.struct(F.lit("before").alias("arm"), F.col("p").alias("q")), F.struct(F.lit("after").alias("arm"), F.col("p2").alias("q")))).alias("a")).select("record_id", "label", "y", "a.*")
    c = confusion(long, ["arm", "label"], F.col("q") >= threshold)
    n = df.agg(F.count_distinct("record_id").alias("records"))
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    g = c.groupBy("arm").agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.avg(f1(F.col("tp"), F.col("fp"), F.col("fn"))).alias("macro_f1"))
    g = g.crossJoin(F.broadcast(n))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return g.select("arm", ratio(fp, F.col("records")).alias("over_flags"), ratio(fn, F.col("records")).alias("misses"), ratio(tp, tp + fn).alias("recall"), f1(tp, fp, fn).alias("micro_f1"), "macro_f1")


def pool_superclasses(df: DataFrame, dictionary: DataFrame, how: str = "max") -> DataFrame:
    """Record x superclass: largest truth and largest (or mean) score of its diagnostic members."""
    d = F.broadcast(dictionary.where("diagnostic").select(F.col("code").alias("label"), "superclass"))
    return df.join(d, "label").groupBy("record_id", F.col("superclass").alias("label")).agg(F.max("y").alias("y"), (F.max if how == "max" else F.avg)("p").alias("p"))


def label_table(df: DataFrame, k: int = 10) -> DataFrame:
    """Support, AUROC and F1 by label, with the places from the best and from the weakest, among the k at either end."""
    a = auroc(df, ["label"]).select("label", F.col("n_pos").alias("support"), F.round("auroc", 6).alias("auroc"))
    c = confusion(df, ["label"], F.col("p") >= 0.5).select("label", r6(f1(F.col("tp"), F.col("fp"), F.col("fn"))).alias("f1"))
    best, weak = W.orderBy(F.desc_nulls_last("auroc"), "label"), W.orderBy(F.asc_nulls_last("auroc"), "label")  # one row per label
    j = a.join(c, "label").withColumn("best", F.row_number().over(best)).withColumn("weakest", F.row_number().over(weak))
    return j.where((F.col("best") <= k) | (F.col("weakest") <= k))


def agreement(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """How two scores p and p2 agree: mean distance, share on one side, the same among the positives of p."""
    same = ((F.col("p") >= threshold) == (F.col("p2") >= threshold)).cast("int")
    return df.agg(F.avg(F.abs(F.col("p") - F.col("p2"))).alias("mean_gap"), F.avg(same).alias("same_side"), F.avg(F.when(F.col("p") >= threshold, same)).alias("same_among_positives"))


def leaderboard(runs: DataFrame, published: DataFrame) -> DataFrame:
    """Runs and published rows (name, test, val) ranked by test score, by validation score without one; rows without either come last.

    Places count distinct scores by range first, then within a range, so no
    task ranks all rows.
    """
    every = runs.select("name", "test", "val", F.lit(False).alias("published")).unionByName(published.select("name", "test", "val", F.lit(True).alias("published")))
    scored = every.withColumn("score", F.coalesce("test", "val")).withColumn("range", F.coalesce(-score_range(F.col("score")), F.lit(2**31 - 1)))
    ranges = scored.groupBy("range").agg(F.count_distinct(F.coalesce(F.col("score").cast("double"), F.lit(0.0))).alias("n"))
    ranges = ranges.select("range", F.coalesce(F.sum("n").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("above"))
    place = F.dense_rank().over(W.partitionBy("range").orderBy(F.desc_nulls_last("score")))
    return scored.withColumn("place", place).join(ranges, "range").select("name", "test", "val", "published", "score", (F.col("above") + F.col("place")).alias("place"))


def target_gate(metrics: DataFrame, targets: DataFrame) -> DataFrame:
    """(metric, value) against (metric, direction min|max, bound): passed or not, null without a value."""
    ok = F.when(F.col("direction") == "min", F.col("value") >= F.col("bound")).otherwise(F.col("value") <= F.col("bound"))
    return F.broadcast(targets).join(metrics, "metric", "left").select("metric", "value", "direction", "bound", ok.alias("passed"))
