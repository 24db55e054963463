"""Subgroup and uncertainty analysis over prediction tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.portable import clip, ratio, uniform
from .resamples import POISSON_ONE, resampled_auroc
from .scoring import auroc

#: Half-open age bands.
AGE_BANDS = [(18, 40, "18-39"), (40, 60, "40-59"), (60, 75, "60-74"), (75, 200, "75+")]


def age_band(age: Column) -> Column:
    """half-open bands; null for missing, not positive, the sentinel 300, and ages outside the bands."""
    out = F.lit(None).cast("string")
    for low, high, name in reversed(AGE_BANDS):
        out = F.when((age >= low) & (age < high), name).otherwise(out)
    return F.when((age > 0) & (age != 300), out)


def evaluable_labels(df: DataFrame, group: str) -> DataFrame:
    """labels with both classes in a group."""
    g = df.groupBy(group, "label").agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    return g.where("pos > 0 and pos < n").select(group, "label")


def common_labels(df: DataFrame, group: str) -> DataFrame:
    """labels evaluable in every group."""
    groups = df.select(group).distinct().agg(F.count(F.col(group)).alias("groups"))
    per = evaluable_labels(df.where(F.col(group).isNotNull()), group).groupBy("label").agg(F.count("*").alias("c"))
    return per.crossJoin(F.broadcast(groups)).where("c = groups").select("label")


def breakdown(df: DataFrame, group: str, least: int = 50) -> DataFrame:
    """records, macro AUROC over the common labels, number of labels, reliable or not, by group."""
    rows = df.where(F.col(group).isNotNull())
    common = F.broadcast(common_labels(df, group))
    per = auroc(rows.join(common, "label", "left_semi"), [group, "label"])
    n = rows.groupBy(group).agg(F.count_distinct("record_id").alias("n"))
    out = per.groupBy(group).agg(F.avg("auroc").alias("macro_auroc"), F.count("auroc").alias("n_labels"))
    return n.join(out, group, "left").withColumn("reliable", F.col("n") >= least)


def breakdown_intervals(df: DataFrame, group: str, least: int = 50, replicates: int = 200) -> DataFrame:
    """``breakdown`` with low and high, the interval of a group's macro AUROC over resamples of its records."""
    rows = df.where(F.col(group).isNotNull())
    common = F.broadcast(common_labels(df, group))
    ci = bootstrap_macro(rows.join(common, "label", "left_semi"), [group], replicates).select(group, "low", "high")
    return breakdown(df, group, least).join(ci, group, "left")


def poisson_weight(key: Column) -> Column:
    """A Poisson(1) count from the hash of a key, by table."""
    u = uniform(key)
    return sum(((u >= t).cast("int") for t in POISSON_ONE), F.lit(0))


def replicate(df: DataFrame, replicates: int, seed: str = "boot") -> DataFrame:
    """Every row once per replicate with the weight of its record; a record keeps one weight within a replicate."""
    reps = df.sparkSession.range(replicates).select(F.col("id").alias("rep"))
    records = df.select("record_id").distinct().crossJoin(F.broadcast(reps))
    w = records.withColumn("w", poisson_weight(F.concat_ws(":", F.lit(seed), F.col("rep").cast("string"), F.col("record_id").cast("string")))).where("w > 0")
    return df.join(w, "record_id")


def interval(values: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    q = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    return values.groupBy(*by).agg(F.avg(value).alias("mean"), q.alias("q"), F.count(value).alias("replicates")).select(*by, "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "replicates")


def bootstrap_macro(df: DataFrame, by: list[str] = (), replicates: int = 200) -> DataFrame:
    """percentile interval of the macro AUROC over record resamples."""
    per = resampled_auroc(df, [*by, "label"], replicates)
    return interval(per.groupBy(*by, "rep").agg(F.avg("auroc").alias("macro")), "macro", list(by))


def bootstrap_gap(df: DataFrame, group: str, a: str, b: str, replicates: int = 200) -> DataFrame:
    """macro AUROC of group a minus that of b, resampled within each."""
    rows = df.where(F.col(group).isin(a, b))
    per = resampled_auroc(rows, [group, "label"], replicates)
    m = per.groupBy("rep", group).agg(F.avg("auroc").alias("m")).groupBy("rep").agg(
        (F.max(F.when(F.col(group) == a, F.col("m"))) - F.max(F.when(F.col(group) == b, F.col("m")))).alias("gap")
    )
    return interval(m, "gap")


def label_gaps(df: DataFrame, group: str, a, b, replicates: int = 400, least: int = 20, least_positives: int = 10) -> DataFrame:
    """gap by label with interval, two-sided p-value from the replicates, and whether both groups have enough positives."""
    rows = df.where(F.col(group).isin(a, b))
    side = lambda c, v: F.max(F.when(F.col(group) == v, F.col(c)))
    per = resampled_auroc(rows, [group, "label"], replicates)
    gaps = per.groupBy("label", "rep").agg((side("auroc", a) - side("auroc", b)).alias("gap")).where("gap is not null")
    below = F.avg((F.col("gap") <= 0).cast("int"))
    g = gaps.groupBy("label").agg(F.least(F.lit(1.0), 2 * F.least(below, 1 - below)).alias("p_value"), F.count("*").alias("usable"), F.percentile("gap", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    point = auroc(rows, [group, "label"]).groupBy("label").agg(
        (side("auroc", a) - side("auroc", b)).alias("gap"), (F.least(side("n_pos", a), side("n_pos", b)) >= least_positives).alias("powered")
    )
    enough = F.col("usable") >= least
    joined = point.join(g, "label", "left").withColumn("p_value", F.when(enough, F.col("p_value")))
    return joined.withColumn("low", F.when(enough, F.col("q")[0])).withColumn("high", F.when(enough, F.col("q")[1])).drop("q")


def step_up(df: DataFrame, p: str = "p_value") -> DataFrame:
    """false-discovery q-values; null p-values stay null and don't count. One row per test comes in."""
    known = df.where(F.col(p).isNotNull())
    m = F.count("*").over(W.partitionBy())
    order = W.orderBy(p, "label")
    ranked = known.withColumn("raw", F.col(p) * m / F.row_number().over(order))
    q = ranked.withColumn("q_value", F.least(F.lit(1.0), F.min("raw").over(order.rowsBetween(0, W.unboundedFollowing)))).drop("raw")
    return q.unionByName(df.where(F.col(p).isNull()).withColumn("q_value", F.lit(None).cast("double")))


def largest_gap(groups: DataFrame) -> DataFrame:
    """largest minus smallest macro AUROC of the reliable groups; null under two."""
    r = groups.where("reliable")
    return r.agg(F.when(F.count("macro_auroc") >= 2, F.max("macro_auroc") - F.min("macro_auroc")).alias("max_gap"))


def group_label_table(df: DataFrame, group: str, values: list, least_positives: int = 10) -> DataFrame:
    """AUROC by label with one column per group, null under enough positives."""
    a = auroc(df.where(F.col(group).isin(*values)), ["label", group])
    a = a.withColumn("auroc", F.when(F.col("n_pos") >= least_positives, F.round("auroc", 6)))
    return a.groupBy("label").pivot(group, values).agg(F.max("auroc"))


def coverage(records: DataFrame, group: str) -> DataFrame:
    """counts and shares of each group in all, training and test records, and the youngest valid age."""
    total = records.agg(F.count("*").alias("all_n"))
    g = records.groupBy(group).agg(
        F.count("*").alias("n"), F.count_if(F.col("fold") <= 8).alias("n_train"), F.count_if(F.col("fold") == 10).alias("n_test"),
        F.min(F.when((F.col("age") > 0) & (F.col("age") != 300), F.col("age"))).alias("youngest"),
    )
    return g.crossJoin(F.broadcast(total)).withColumn("share", ratio(F.col("n"), F.col("all_n"))).drop("all_n")


def auroc_error(a: Column, n_pos: Column, n_neg: Column) -> Column:
    """Hanley-McNeil standard error of an AUROC, which is held within 1e-6 of 0 and 1; null without both classes."""
    a = clip(a)
    q1, q2 = a / (2 - a), 2 * a * a / (1 + a)
    var = (a * (1 - a) + (n_pos - 1) * (q1 - a * a) + (n_neg - 1) * (q2 - a * a)) / (n_pos * n_neg)
    return F.when((n_pos > 0) & (n_neg > 0), F.sqrt(F.greatest(var, F.lit(0.0))))


def leverage(df: DataFrame) -> DataFrame:
    """largest change of a label's AUROC when one positive is dropped, in closed form; null under two positives."""
    tied = df.groupBy("label", "p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    below = W.partitionBy("label").orderBy("p").rowsBetween(W.unboundedPreceding, -1)
    t = tied.withColumn("rank", F.coalesce(F.sum("neg").over(below), F.lit(0)) + 0.5 * F.col("neg"))
    s = t.groupBy("label").agg(
        F.sum("pos").alias("np"), F.sum("neg").alias("nn"), F.sum(F.col("pos") * F.col("rank")).alias("won"),
        F.min(F.when(F.col("pos") > 0, F.col("rank"))).alias("lo"), F.max(F.when(F.col("pos") > 0, F.col("rank"))).alias("hi"),
    )
    whole = F.col("won") / (F.col("np") * F.col("nn"))
    without = lambda r: F.abs((F.col("won") - F.col(r)) / ((F.col("np") - 1) * F.col("nn")) - whole)
    return s.select("label", F.when((F.col("np") >= 2) & (F.col("nn") > 0), F.greatest(without("lo"), without("hi"))).alias("leverage"))


def power_table(df: DataFrame, train: DataFrame, replicates: int = 200) -> DataFrame:
    """training and test positives, AUROC, analytic and resampled interval width, and leverage by label."""
    a = auroc(df, ["label"])
    se = auroc_error(F.col("auroc"), F.col("n_pos"), F.col("n_neg"))
    n = train.groupBy("label").agg(F.sum("y").alias("n_train"))
    out = a.select("label", F.col("n_pos").alias("n_test"), "auroc", (2 * 1.96 * se).alias("width"))
    per = resampled_auroc(df, ["label"], replicates)
    boot = interval(per, "auroc", ["label"]).select("label", (F.col("high") - F.col("low")).alias("boot_width"))
    return out.join(leverage(df), "label", "left").join(boot, "label", "left").join(n, "label", "left")


def power_medians(table: DataFrame, targets: list[str], rare: int) -> DataFrame:
    """medians of the widths and the leverage of ``power_table`` over rare labels (under ``rare`` training positives), the targets, and all labels; one row per label comes in.

    A set without any label keeps its row, with 0 labels and null medians.
    """
    sets = {"rare": F.col("n_train") < rare, "target": F.col("label").isin(*targets), "all": F.lit(True)}
    kinds = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in sets.items()]))
    t = table.withColumn("kind", F.explode(kinds))
    m = t.groupBy("kind").agg(F.count("*").alias("n_labels"), *[F.percentile(c, F.lit(0.5)).alias(c) for c in ("width", "boot_width", "leverage")])
    every = table.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, sets))).alias("kind"))
    return every.join(m, "kind", "left").withColumn("n_labels", F.coalesce("n_labels", F.lit(0)))


def paired_delta(df: DataFrame, replicates: int = 200) -> DataFrame:
    """macro AUROC of p2 minus that of p on the same resamples."""
    m = resampled_auroc(df, ["label"], replicates, ("p", "p2")).groupBy("rep", "of").agg(F.avg("auroc").alias("m"))
    side = lambda c: F.max(F.when(F.col("of") == c, F.col("m")))
    return interval(m.groupBy("rep").agg((side("p2") - side("p")).alias("delta")), "delta")


def target_vs_rest(df: DataFrame, targets: DataFrame) -> DataFrame:
    """F16: AUROC of each target label, and the macro over the other labels that have positives."""
    a = auroc(df, ["label"])
    own = a.join(F.broadcast(targets), "label", "left_semi").select("label", "auroc")
    rest = a.join(F.broadcast(targets), "label", "left_anti").where("n_pos > 0").agg(F.lit("(others)").alias("label"), F.avg("auroc").alias("auroc"))
    return own.unionByName(rest)


def _stirling_error(k: Column) -> Column:
    """ln(k!) minus Stirling's formula for it, for k >= 1: a table to 15, then a series whose error is under 1e-13."""
    exact = [math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) for n in range(1, 16)]
    x = k.cast("double")
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * x * x)) / (x * x)) / (x * x)) / x
    return F.when(k <= 15, F.get(F.array(*map(F.lit, exact)), (k - 1).cast("int"))).otherwise(series)


def half_binomial(i: Column, n: Column) -> Column:
    """Probability of i heads in n throws of a fair coin, n >= 1, from logarithms of ratios near one: ln(n!) itself loses digits where n is large."""
    a, b = i.cast("double"), (n - i).cast("double")
    m = n / F.lit(2.0)
    far = a * F.log1p((a - m) / m) + b * F.log1p((b - m) / m)
    inner = _stirling_error(n) - _stirling_error(i) - _stirling_error(n - i) - far + 0.5 * F.log(n / (2 * math.pi * a * b))
    return F.when((i == 0) | (i == n), F.exp(-n * math.log(2.0))).otherwise(F.exp(inner))


def mcnemar(df: DataFrame, a: Column, b: Column, block: int = 65_536) -> DataFrame:
    """exact test on the discordant counts of two boolean columns.

    The terms of the tail are listed in blocks of ``block``, each is found by
    itself: the work grows with the smaller count, and no list is longer.
    """
    n = df.agg(F.count_if(a & ~b).alias("b"), F.count_if(~a & b).alias("c"))
    total, low = F.col("b") + F.col("c"), F.least("b", "c")
    ends = F.explode_outer(F.when(total > 0, F.sequence(F.lit(0).cast("long"), low, F.lit(block).cast("long")))).alias("at")
    blocks = n.select("b", "c", ends)
    each = blocks.withColumn("i", F.explode_outer(F.sequence("at", F.least(F.col("at") + (block - 1), low))))
    tail = F.sum(F.when(F.col("i").isNotNull(), half_binomial(F.col("i"), total)))
    return each.groupBy("b", "c").agg(tail.alias("tail")).select("b", "c", F.when(total == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.col("tail"))).alias("p_value"))
