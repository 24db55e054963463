"""Surfacing, cohorts and reliability checks by set operations over records and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.portable import ratio

#: Distance below the threshold that counts as a near miss, and the score below which a finding is of low confidence.
NEAR_MISS, LOW_CONFIDENCE = 0.15, 0.7


def surfaced(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Findings at or over the threshold with their confidence."""
    return df.where(F.col("p") >= threshold).select("record_id", "label", F.col("p").alias("confidence"))


def record_outcomes(df: DataFrame, urgent: list[str], threshold: float = 0.5) -> DataFrame:
    """Misses, false positives, urgent and near misses, largest score and likeliest missed label of each record."""
    hit, real = F.col("p") >= threshold, F.col("y") == 1
    names = lambda cond: F.array_sort(F.collect_set(F.when(cond, F.col("label"))))
    return df.groupBy("record_id").agg(
        names(real & ~hit).alias("misses"), names(~real & hit).alias("false_positives"), names(real & ~hit & F.col("label").isin(*urgent)).alias("urgent_misses"),
        names(real & ~hit & (F.col("p") >= threshold - NEAR_MISS)).alias("near_misses"), F.max("p").alias("max_p"), F.max(F.when(real & ~hit, F.col("p"))).alias("top_missed_p"),
    )


def parse_affected(cell: Column) -> Column:
    """Tokens of a noise cell; one that says 'alles' means ALL, an empty or null one nothing."""
    text = F.lower(F.trim(F.coalesce(cell, F.lit(""))))
    tokens = F.filter(F.transform(F.split(text, r"[,;\s]+"), lambda x: F.upper(x)), lambda x: x != "")
    return F.when(text.contains("alles"), F.array(F.lit("ALL"))).otherwise(tokens)


def artifact_profile(df: DataFrame, columns: list[str], burst: list[str]) -> DataFrame:
    """Whole-record noise, number of noise types, burst noise, and whether any of them matters."""
    cells = {c: parse_affected(F.col(c)) for c in columns}
    whole = F.lit(False)
    kinds, bursts = F.lit(0), F.lit(False)
    for c, tokens in cells.items():
        whole = whole | F.array_contains(tokens, "ALL")
        kinds = kinds + (F.size(tokens) > 0).cast("int")
        bursts = bursts | (F.size(tokens) > 0) if c in burst else bursts
    return df.withColumn("whole", whole).withColumn("kinds", kinds).withColumn("burst", bursts).withColumn("significant", whole | (kinds >= 2) | bursts)


def borderline(df: DataFrame, threshold: float = 0.5, band: float = 0.1) -> DataFrame:
    """Records with a present label within the band around the threshold, ends included."""
    return df.where((F.col("y") == 1) & (F.abs(F.col("p") - threshold) <= band + 1e-9)).select("record_id").distinct()


def multi_condition(df: DataFrame, k: int = 3) -> DataFrame:
    """Records with at least k present labels."""
    return df.where("y = 1").groupBy("record_id").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("record_id")


def rarest_labels(train: DataFrame, k: int, least: int) -> DataFrame:
    """The k labels of fewest training rows, of those with enough; ties by name."""
    return train.where("y = 1").groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy("n", "label").limit(k)


def carriers(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Records that carry any of the labels."""
    return df.where("y = 1").join(F.broadcast(labels), "label", "left_semi").select("record_id").distinct()


def only_superclass(supers: DataFrame, name: str) -> DataFrame:
    """Records whose superclass list is exactly one name."""
    return supers.where(F.col("superclasses") == F.array(F.lit(name))).select("record_id")


def over_flag_rate(cohort: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Records of a cohort, those with a false positive, and their share (null for an empty cohort)."""
    j = cohort.select("record_id").join(outcomes.select("record_id", "false_positives"), "record_id")
    flagged = F.count_if(F.size("false_positives") > 0)
    return j.agg(F.count("*").alias("n"), flagged.alias("over_flagged"), F.round(ratio(flagged, F.count("*")), 4).alias("rate"))


def cohort_metrics(outcomes: DataFrame, present: DataFrame, cohorts: DataFrame) -> DataFrame:
    """Metrics of each (cohort, record_id) cohort; a record may be in several. Rates are null without a present label."""
    n = present.where("y = 1").groupBy("record_id").agg(F.count("*").alias("n_present"))
    j = cohorts.join(outcomes, "record_id").join(n, "record_id", "left").withColumn("n_present", F.coalesce("n_present", F.lit(0)))
    size = lambda c: F.sum(F.size(c))
    return j.groupBy("cohort").agg(
        F.count("*").alias("n"), F.round(1 - ratio(size("misses"), F.sum("n_present")), 4).alias("label_recall"),
        F.round(ratio(size("false_positives"), F.count("*")), 4).alias("over_flags"), F.count_if(F.size("misses") > 0).alias("with_miss"),
        F.count_if(F.size("false_positives") > 0).alias("with_over_flag"), F.round(F.avg((F.size("urgent_misses") > 0).cast("int")), 4).alias("urgent_miss_rate"),
        size("near_misses").alias("near_misses"), F.round(F.avg(((F.size("misses") == 0) & (F.size("false_positives") == 0)).cast("int")), 4).alias("clean_rate"),
    )


def low_confidence(found: DataFrame) -> DataFrame:
    """Surfaced findings under the confidence bound."""
    return found.where(F.col("confidence") < LOW_CONFIDENCE)


def exclusive_pairs(found: DataFrame, rules: DataFrame) -> DataFrame:
    """Surfaced pairs (a < b) of one record that a rule (a, b) excludes; a record's labels are listed once and meet the rules there."""
    sets = found.groupBy("record_id").agg(F.collect_set("label").alias("labels"))
    a = sets.select("record_id", "labels", F.explode("labels").alias("a"))
    return a.join(F.broadcast(rules), "a").where(F.array_contains("labels", F.col("b"))).select("record_id", "a", "b")


def routed(found: DataFrame, rules: DataFrame, n_records: int) -> DataFrame:
    """Share of records with a finding of low confidence or an excluded pair."""
    ids = low_confidence(found).select("record_id").union(exclusive_pairs(found, rules).select("record_id")).distinct()
    return ids.agg(F.count("*").alias("routed"), F.round(F.count("*") / F.lit(n_records), 6).alias("rate"))


def unsupported(asserted: DataFrame, found: DataFrame) -> DataFrame:
    """Asserted labels that were not surfaced."""
    return asserted.join(found.select("record_id", "label"), ["record_id", "label"], "left_anti")


def consistency_rate(asserted: DataFrame, found: DataFrame, records: DataFrame) -> DataFrame:
    """Share of records without an unsupported assertion."""
    bad = unsupported(asserted, found).select("record_id").distinct().withColumn("bad", F.lit(1))
    return records.select("record_id").join(bad, "record_id", "left").agg(F.round(1 - F.avg(F.coalesce("bad", F.lit(0))), 6).alias("consistency_rate"))


def hallucinations(asserted: DataFrame, found: DataFrame, grounded: DataFrame) -> DataFrame:
    """Asserted labels with whether they are unsupported, or supported but not grounded. The rate counts unsupported ones only."""
    key = ["record_id", "label"]
    flag = lambda df, name: df.select(*key, F.lit(True).alias(name))
    j = asserted.select(*key).join(flag(found, "s"), key, "left").join(flag(grounded, "g"), key, "left")
    return j.select(*key, F.col("s").isNull().alias("unsupported"), (F.col("s").isNotNull() & F.col("g").isNull()).alias("ungrounded"))


def cited_conflicts(cites: DataFrame, importance: DataFrame, bottom: int = 3) -> DataFrame:
    """Cited leads that rank among the ``bottom`` least important of their record and code."""
    w = W.partitionBy("record_id", "code").orderBy(F.desc("importance"), "lead")
    size = F.count("*").over(W.partitionBy("record_id", "code"))
    ranked = importance.withColumn("rank", F.row_number().over(w)).withColumn("leads", size)
    return ranked.where(F.col("rank") > F.col("leads") - bottom).where("leads > " + str(bottom)).join(cites, ["record_id", "code", "lead"]).select("record_id", "code", "lead", "rank")


def flag_summary(flags: DataFrame, n_records: int) -> DataFrame:
    """Records and count by flag type, and their share of all records; a last row for any flag."""
    n = F.lit(n_records)
    agg = [F.count("*").alias("flags"), F.count_distinct("record_id").alias("records")]
    per = flags.groupBy("type").agg(*agg).unionByName(flags.agg(*agg).withColumn("type", F.lit("any")))
    return per.withColumn("rate", F.round(F.col("records") / n, 6))


def report_rows(found: DataFrame, flags: DataFrame) -> DataFrame:
    """One nested row per record: findings with their flags, and whether review is recommended.

    A finding needs review under 0.5 or with a flag; a record with any such finding does.
    """
    per = flags.groupBy("record_id", "label").agg(F.array_sort(F.collect_set("type")).alias("flags"))
    j = found.join(per, ["record_id", "label"], "left").withColumn("flags", F.coalesce("flags", F.array().cast("array<string>")))
    j = j.withColumn("needs_review", (F.col("confidence") < 0.5) | (F.size("flags") > 0))
    item = F.struct("label", "confidence", "flags", "needs_review")
    return j.groupBy("record_id").agg(F.array_sort(F.collect_list(item)).alias("findings"), F.bool_or("needs_review").alias("review"))


def severity(labels: Column, review: Column, urgent: list[str]) -> Column:
    """Red with an urgent label, else yellow for review, else green."""
    return F.when(F.arrays_overlap(labels, F.array(*[F.lit(u) for u in urgent])), "red").when(review, "yellow").otherwise("green")
