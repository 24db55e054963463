"""Serial comparison: consecutive records of one entity, gaps, set differences, noise floors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.portable import ratio


def repeat_records(records: DataFrame) -> DataFrame:
    """Records of patients with two or more."""
    n = F.count("*").over(W.partitionBy("patient_id"))
    return records.withColumn("n", n).where("n >= 2").drop("n")


def elapsed_seconds(a: Column, b: Column) -> Column:
    return b.cast("timestamp").cast("long") - a.cast("timestamp").cast("long")


def gap_bucket(seconds: Column) -> Column:
    """Named span between two records; a day is 24 elapsed hours."""
    days = F.floor(seconds / 86400)
    return F.when(seconds < 86400, "<24h").when(days <= 7, "1-7d").when(days <= 30, "8-30d").when(days <= 365, "31-365d").otherwise(">1y")


def gap_phrase(seconds: Column) -> Column:
    """Minutes under an hour, hours under 24, days under 60, months under 730 days, else years."""
    days = F.floor(seconds / 86400)
    word = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"))
    return (
        F.when(seconds < 3600, word(F.floor(seconds / 60), "minute")).when(seconds < 86400, word(F.floor(seconds / 3600), "hour"))
        .when(days < 60, word(days, "day")).when(days < 730, word(F.floor(days / 30), "month")).otherwise(word(F.floor(days / 365), "year"))
    )


def pair_codes(pairs: DataFrame, codes: DataFrame) -> DataFrame:
    """New, resolved and persistent codes of each pair, and whether the sets are equal."""
    sets = codes.groupBy("record_id").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    side = lambda name: sets.select(F.col("record_id").alias(f"{name}_id"), F.col("codes").alias(f"{name}_codes"))
    none = F.array().cast("array<string>")
    j = pairs.join(side("prior"), "prior_id", "left").join(side("current"), "current_id", "left")
    p, c = F.coalesce("prior_codes", none), F.coalesce("current_codes", none)
    return j.select(
        *pairs.columns, F.array_except(c, p).alias("new"), F.array_except(p, c).alias("resolved"), F.array_intersect(p, c).alias("persistent"), (p == c).alias("stable")
    )


def null_cohort(pairs: DataFrame, max_seconds: int = 86400, stable_only: bool = False) -> DataFrame:
    """Pairs under a day (or a given span) apart."""
    near = pairs.where(elapsed_seconds(F.col("prior_ts"), F.col("current_ts")) < max_seconds)
    return near.where("stable") if stable_only else near


def cited_prior(notes: DataFrame, records: DataFrame) -> DataFrame:
    """(record_id, patient_id, rec_ts, note): the latest earlier record of the patient on the date that the note cites.

    Without a date, 'earlier today' stands for the record's own day. An as-of
    join: equality on patient and day, inequality on time, latest by window.
    """
    cited = F.try_to_date(F.regexp_extract("note", r"(\d{4}-\d{2}-\d{2})", 1))
    day = F.coalesce(cited, F.when(F.col("note").contains("earlier today"), F.to_date("rec_ts")))
    n = notes.withColumn("day", day).where("day is not null")
    r = records.select(F.col("patient_id").alias("pid"), F.col("record_id").alias("prior_id"), F.col("rec_ts").alias("prior_ts"), F.to_date("rec_ts").alias("pday"))
    j = n.join(r, (F.col("patient_id") == F.col("pid")) & (F.col("day") == F.col("pday")) & (F.col("prior_ts") < F.col("rec_ts")))
    last = W.partitionBy("record_id").orderBy(F.desc("prior_ts"), F.desc("prior_id"))
    return j.withColumn("rn", F.row_number().over(last)).where("rn = 1").select("record_id", "prior_id", "prior_ts")


def cohort_summary(pairs: DataFrame) -> DataFrame:
    """Pairs, patients, same-day and stable pairs, change rate, median gap in days."""
    sec = elapsed_seconds(F.col("prior_ts"), F.col("current_ts"))
    return pairs.agg(
        F.count("*").alias("pairs"), F.count_distinct("patient_id").alias("patients"), F.count_if(sec < 86400).alias("same_day"), F.count_if("stable").alias("stable"),
        F.round(F.avg((~F.col("stable")).cast("int")), 6).alias("change_rate"), F.percentile(sec / 86400.0, F.lit(0.5)).alias("median_days"),
    )


def paired_differences(pairs: DataFrame, measures: DataFrame, names: list[str], keep: dict[str, str] | None = None) -> DataFrame:
    """Current minus prior of each measure that both records have, in long form.

    Pairs meet whole records, and their rows become long where they are.
    ``keep`` names columns of both records to take along: {"p": "p_detected"} gives prior_p and current_p.
    """
    keep = keep or {}
    side = lambda s: measures.select(F.col("record_id").alias(f"{s}_id"), F.struct(*names).alias(f"_{s}"), *[F.col(c).alias(f"{s}_{k}") for k, c in keep.items()])
    j = pairs.join(side("prior"), "prior_id").join(side("current"), "current_id")
    item = lambda n: F.struct(F.lit(n).alias("measure"), F.col(f"_prior.{n}").cast("double").alias("prior_value"), F.col(f"_current.{n}").cast("double").alias("current_value"))
    long = j.withColumn("_m", F.explode(F.array(*map(item, names)))).select(*[c for c in j.columns if c not in ("_prior", "_current")], "_m.*")
    return long.where("prior_value is not null and current_value is not null").withColumn("diff", F.col("current_value") - F.col("prior_value"))


def repeatability(diffs: DataFrame, z: float = 1.96, least: int = 20) -> DataFrame:
    """Z * 1.4826 * median absolute deviation by measure, null under enough values, and 1.96 standard deviations."""
    mid = diffs.groupBy("measure").agg(F.percentile("diff", F.lit(0.5)).alias("mid"), F.count("*").alias("n"), F.stddev_samp("diff").alias("sd"))
    j = diffs.join(F.broadcast(mid), "measure")
    mad = j.groupBy("measure").agg(F.percentile(F.abs(F.col("diff") - F.col("mid")), F.lit(0.5)).alias("mad"))
    out = mid.join(mad, "measure")
    return out.select("measure", "n", F.when(F.col("n") >= least, z * 1.4826 * F.col("mad")).alias("rc"), (1.96 * F.col("sd")).alias("rc_sd"))


def noise_floors(rc: DataFrame, step: float = 5.0, default: float = 20.0) -> DataFrame:
    """P10: repeatability rounded up to a step, a default where none could be fitted."""
    return rc.select("measure", F.coalesce(F.ceil(F.round(F.col("rc") / step, 9)) * F.lit(step), F.lit(default)).alias("floor"))


def gated_changes(diffs: DataFrame, floors: DataFrame, measures: DataFrame | None = None) -> DataFrame:
    """Changes beyond the floor (strict); a PR change counts only where P is seen in both records: by ``measures``, or by prior_p and current_p of ``diffs``."""
    j = diffs.join(F.broadcast(floors), "measure")
    if measures is not None:
        seen = lambda s: measures.select(F.col("record_id").alias(f"{s}_id"), F.col("p_detected").alias(f"{s}_p"))
        j = j.join(seen("prior"), "prior_id", "left").join(seen("current"), "current_id", "left")
    why = F.when((F.col("measure") == "pr") & ~(F.coalesce("prior_p", F.lit(False)) & F.coalesce("current_p", F.lit(False))), F.lit("no P wave"))
    big = F.abs("diff") > F.col("floor")
    j = j.withColumn("suppressed", why).withColumn("significant", big & F.col("suppressed").isNull())
    return j.withColumn("direction", F.when(F.col("significant"), F.when(F.col("diff") > 0, "longer").otherwise("shorter")))


def finding_changes(pairs: DataFrame, scores: DataFrame, threshold: float = 0.5, least: float = 0.25, persistent: bool = False) -> DataFrame:
    """New and resolved findings: the threshold is crossed and the score moves by more than ``least``.

    With ``persistent`` also those that are over the threshold in both records.
    """
    side = lambda s: scores.select(F.col("record_id").alias(f"{s}_id"), "label", F.col("p").alias(f"{s}_p"))
    a = pairs.select("prior_id", "current_id").join(side("prior"), "prior_id")
    b = pairs.select("prior_id", "current_id").join(side("current"), "current_id")
    return moved_findings(a.join(b, ["prior_id", "current_id", "label"], "full"), threshold, least, persistent)


def moved_findings(j: DataFrame, threshold: float = 0.5, least: float = 0.25, persistent: bool = False) -> DataFrame:
    """``finding_changes`` of rows that have the scores of both records: prior_id, current_id, label, prior_p, current_p."""
    p, c = F.coalesce("prior_p", F.lit(0.0)), F.coalesce("current_p", F.lit(0.0))
    moved = F.abs(c - p) > least
    state = F.when((p < threshold) & (c >= threshold) & moved, "new").when((p >= threshold) & (c < threshold) & moved, "resolved")
    state = state.when((p >= threshold) & (c >= threshold), "persistent") if persistent else state
    return j.withColumn("change", state).where("change is not null").select("prior_id", "current_id", "label", "change")


def range_labels(df: DataFrame, group: str, number: str) -> DataFrame:
    """Runs of consecutive numbers as 'a-b' (gaps and islands)."""
    island = F.col(number) - F.row_number().over(W.partitionBy(group).orderBy(number))
    runs = df.select(group, number).distinct().withColumn("island", island).groupBy(group, "island").agg(F.min(number).alias("a"), F.max(number).alias("b"))
    word = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string")))
    return runs.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", word.alias("w")))), lambda x: x["w"]), ",").alias("runs"))


def bias_table(pairs: DataFrame, diffs: DataFrame) -> DataFrame:
    """P20: by span: pairs, share changed, and the spread of differences over all and over stable pairs."""
    bucket = gap_bucket(elapsed_seconds(F.col("prior_ts"), F.col("current_ts")))
    d = diffs.withColumn("bucket", bucket)
    return d.groupBy("bucket", "measure").agg(
        F.count("*").alias("n"), F.round(100 * F.avg((~F.col("stable")).cast("int")), 4).alias("percent_changed"),
        F.stddev_samp("diff").alias("sd_all"), F.stddev_samp(F.when(F.col("stable"), F.col("diff"))).alias("sd_stable"),
    )


def change_detection(predicted: DataFrame, annotated: DataFrame) -> DataFrame:
    """Micro precision, recall and F1 of predicted against annotated changes (prior_id, current_id, label, change)."""
    key = ["prior_id", "current_id", "label", "change"]
    j = predicted.select(*key).distinct().withColumn("p", F.lit(1)).join(annotated.select(*key).distinct().withColumn("a", F.lit(1)), key, "full")
    n = j.agg(F.count_if(F.col("p").isNotNull() & F.col("a").isNotNull()).alias("tp"), F.count_if(F.col("a").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return n.select("tp", "fp", "fn", F.round(ratio(tp, tp + fp), 6).alias("precision"), F.round(ratio(tp, tp + fn), 6).alias("recall"), F.round(ratio(2 * tp, 2 * tp + fp + fn), 6).alias("f1"))
