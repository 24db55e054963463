"""Mapped codes, integrity of exported bundles, review samples, prompts, and checks of systems against their own scores."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .scoring import auroc


def code_mapping(codes: DataFrame, mapping: DataFrame) -> DataFrame:
    """Every code of a record with its target, tier and evidence; null where the mapping lacks it."""
    return codes.join(F.broadcast(mapping), "code", "left").select("record_id", "code", "target", "tier", "evidence")


def bundle_faults(entries: DataFrame, targets: DataFrame, values: list[str]) -> DataFrame:
    """(url, fault) of entries (url, ref, kind, value) whose value is outside its set or whose reference resolves to nothing or to another kind."""
    wrong = entries.where(~F.col("value").isin(*values)).select("url", F.lit("value").alias("fault"))
    j = entries.join(targets.select(F.col("url").alias("ref"), F.col("kind").alias("found")), "ref", "left")
    lost = j.where("found is null").select("url", F.lit("unresolved").alias("fault"))
    other = j.where("found is not null and found <> kind").select("url", F.lit("wrong kind").alias("fault"))
    return wrong.unionByName(lost).unionByName(other)


def terminology_drift(mapping: DataFrame, release: DataFrame) -> DataFrame:
    """(code, fault) of mapped (code, display) against a release (code, display): missing, another display, or with children (not billable)."""
    r = release.select("code", F.col("display").alias("now"))
    j = mapping.join(r, "code", "left")
    missing = j.where("now is null").select("code", F.lit("missing").alias("fault"))
    differs = j.where("now is not null and now <> display").select("code", F.lit("display").alias("fault"))
    parents = release.where("code like '%.%'").select(F.substring_index("code", ".", 1).alias("code")).distinct()
    return missing.unionByName(differs).unionByName(mapping.join(parents, "code", "left_semi").select("code", F.lit("has children").alias("fault")))


def review_sample(rows: DataFrame, buckets: list[tuple[str, Column]], key: Column, k: int) -> DataFrame:
    """Up to ``k`` records of each bucket in order, none twice: a record falls through to a later bucket only if an earlier one is full."""
    left, out = rows.withColumn("_place", key), None
    for name, test in buckets:
        order = W.orderBy("_place", "record_id")
        few = left.where(test).orderBy("_place", "record_id").limit(k)  # the feature: k of a bucket
        taken = few.withColumn("rank", F.row_number().over(order)).select("record_id", F.lit(name).alias("bucket"), "rank")
        out = taken if out is None else out.unionByName(taken)
        left = left.join(F.broadcast(taken.select("record_id")), "record_id", "left_anti")
    return out


def one_of_each(rows: DataFrame, category: str, acceptable: Column, most: int = 40) -> DataFrame:
    """The first acceptable record of each category among its first ``most``."""
    first = W.partitionBy(category).orderBy("record_id")
    tried = rows.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most)
    return tried.where(acceptable).groupBy(category).agg(F.min("record_id").alias("record_id"))


def prompt_rows(rows: DataFrame, language: str | None = None) -> DataFrame:
    """(record_id, prompt, completion) from (record_id, age, sex, codes, context): structured input, language rule and context block."""
    sex = F.when(F.col("sex") == 0, "male").when(F.col("sex") == 1, "female").otherwise("unknown")
    age = F.when((F.col("age") > 0) & (F.col("age") < 200), F.concat(F.col("age").cast("int").cast("string"), F.lit(" y"))).otherwise(F.lit("age unknown"))
    head = F.concat(F.lit("Patient: "), age, F.lit(", "), sex, F.lit("\nCodes: "), F.array_join("codes", ", "))
    rule = F.lit(f"\nAnswer in {language}." if language else "")
    block = F.when(F.col("context").isNotNull() & (F.col("context") != ""), F.concat(F.lit("\nContext:\n"), "context")).otherwise(F.lit(""))
    done = F.concat(F.lit("Findings: "), F.array_join("codes", "; "), F.lit("."))
    return rows.select("record_id", F.concat(head, rule, block).alias("prompt"), done.alias("completion"))


def answered_auroc(df: DataFrame, least: int = 20) -> DataFrame:
    """AUROC by label over rows with a score; null under ``least`` of them or without both classes."""
    a = auroc(df.where("p is not null"), ["label"])
    n = F.col("n_pos") + F.col("n_neg")
    return a.select("label", n.alias("answered"), F.when(n >= least, F.col("auroc")).alias("auroc"))


def self_contradiction(asserted: DataFrame, scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Of records whose text asserts something, the share with an assertion that their own score denies; also both counts."""
    j = asserted.join(scores, ["record_id", "label"])
    r = j.groupBy("record_id").agg(F.max((F.col("p") < threshold).cast("int")).alias("denied"))
    return r.agg(F.count("*").alias("asserting"), F.sum("denied").alias("contradicted"), F.avg("denied").alias("rate"))


def measure_separation(rows: DataFrame, sign: float = 1.0, least: int = 20, least_positives: int = 8) -> DataFrame:
    """AUROC of ``measure`` (times ``sign``) for each label, with medians of both classes; null under the least numbers."""
    known = rows.where("measure is not null")
    a = auroc(known.withColumn("p", sign * F.col("measure")), ["label"])
    m = known.groupBy("label").agg(
        F.percentile(F.when(F.col("y") == 1, F.col("measure")), 0.5).alias("median_pos"), F.percentile(F.when(F.col("y") == 0, F.col("measure")), 0.5).alias("median_neg")
    )
    enough = (F.col("n_pos") + F.col("n_neg") >= least) & (F.col("n_pos") >= least_positives)
    return a.join(m, "label").select("label", F.when(enough, F.col("auroc")).alias("auroc"), "median_pos", "median_neg")


def _beta_share(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(1 - x, b, a)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    f = d
    for m in range(1, 200):
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + t * d), 1 + t / c
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * f


def beta_quantile(q: float, a: float, b: float) -> float:
    """The x below which a Beta(a, b) variable lies with probability q."""
    low, high = 0.0, 1.0
    for _ in range(60):
        x = (low + high) / 2
        low, high = (x, high) if _beta_share(x, a, b) < q else (low, x)
    return (low + high) / 2


@F.pandas_udf(DoubleType())
def _lower_bound(good: pd.Series, bad: pd.Series, mean: pd.Series) -> pd.Series:
    m = mean.clip(0.001, 0.999)
    return pd.Series([beta_quantile(0.05, 20 * x + g, 20 * (1 - x) + w) for g, w, x in zip(good, bad, m, strict=True)], dtype="float64")


def precision_bounds(sums: DataFrame) -> DataFrame:
    """The 5 % quantile of Beta(20 m + correct, 20 (1 - m) + incorrect) for (label, correct, incorrect, mean), m within 0.001 and 0.999."""
    return sums.withColumn("lower", _lower_bound(F.col("correct").cast("double"), F.col("incorrect").cast("double"), F.col("mean")))


def updated_thresholds(previous: DataFrame, decided: DataFrame) -> DataFrame:
    """The next table of thresholds: only rated labels move; where each value is from, and which labels need work."""
    d = decided.select("label", F.col("threshold").alias("new"), "reason")
    j = previous.join(d, "label", "full")
    moved = F.col("reason") == "moved"
    return j.select(
        "label", F.when(moved, F.col("new")).otherwise(F.coalesce("threshold", "new")).alias("threshold"),
        F.when(F.coalesce(moved, F.lit(False)), "feedback").when(F.col("threshold").isNotNull(), "previous").otherwise("default").alias("provenance"),
        F.coalesce(F.col("reason") == "no evidence", F.lit(False)).alias("needs_work"),
    )


def last_of_each(runs: DataFrame, name: str, order: list[str]) -> DataFrame:
    """The last row of each run name."""
    last = W.partitionBy(name).orderBy(*[F.desc(c) for c in order])
    return runs.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def run_comparison(runs: DataFrame) -> DataFrame:
    """The best plain run, its matched control (same device group), their gap, and the relative loss to the best central run; runs: name, arm, device, value."""
    best = lambda arm, name: runs.where(F.col("arm") == arm).agg(F.max_by(F.struct("name", "device", "value"), F.struct("value", "name")).alias(name))
    plain, central = best("plain", "b"), best("central", "c")
    control = runs.where("arm = 'control'").groupBy("device").agg(F.max("value").alias("control"))
    j = plain.crossJoin(central).select("b.*", F.col("c.value").alias("central")).join(control, "device", "left")
    return j.select("name", "device", "value", "control", (F.col("value") - F.col("control")).alias("gap"), ((F.col("central") - F.col("value")) / F.col("central")).alias("loss"))
