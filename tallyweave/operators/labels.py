"""Label tables: presence, roll-ups, prevalence, manifests and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.portable import ratio

#: Fixed value: the age that stands for "over 89" in the record table.
AGE_SENTINEL = 300.0


def present_codes(likelihoods: Column) -> Column:
    """The sorted keys of a code map; a key counts whatever its value."""
    return F.array_sort(F.map_keys(likelihoods))


def multi_hot(keys: Column, space: Column) -> Column:
    """0/1 for each code of an ordered label space; other codes are ignored."""
    return F.transform(space, lambda c: F.array_contains(keys, c).cast("int"))


def code_maps(codes: DataFrame) -> DataFrame:
    """(record_id, code[, likelihood]) rows as one map per record."""
    likelihood = F.col("likelihood") if "likelihood" in codes.columns else F.lit(0.0)
    return codes.groupBy("record_id").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("code", likelihood.alias("likelihood"))))).alias("codes"))


def category_members(dictionary: DataFrame, flags: list[str]) -> DataFrame:
    """The codes under each flag of the dictionary, sorted."""
    long = dictionary.unpivot(["code"], flags, "category", "flag").where("flag")
    return long.groupBy("category").agg(F.array_sort(F.collect_set("code")).alias("members"))


def superclasses(codes: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Per record the sorted distinct superclasses of its diagnostic codes."""
    d = F.broadcast(dictionary.where("diagnostic").select("code", "superclass"))
    return codes.join(d, "code").groupBy("record_id").agg(F.array_sort(F.collect_set("superclass")).alias("superclasses"))


def code_prevalence(codes: DataFrame, dictionary: DataFrame, n_records: int | Column) -> DataFrame:
    """Count and percent of records for every code of the label space, zeros kept."""
    n = codes.groupBy("code").agg(F.count("*").alias("n"))
    total = n_records if isinstance(n_records, Column) else F.lit(n_records)
    df = dictionary.join(n, "code", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return df.select("code", "superclass", "diagnostic", "rhythm", "n", F.round(100.0 * F.col("n") / total, 3).alias("percent"))


def superclass_prevalence(codes: DataFrame, dictionary: DataFrame, n_records: int) -> DataFrame:
    """Records per superclass, all superclasses kept."""
    d = dictionary.select("code", "superclass", "diagnostic")
    n = codes.join(F.broadcast(d.where("diagnostic")), "code").groupBy("superclass").agg(F.count_distinct("record_id").alias("n"))
    df = d.select("superclass").distinct().join(n, "superclass", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return df.withColumn("percent", F.round(100.0 * F.col("n") / F.lit(n_records), 2))


def labels_per_record(codes: DataFrame, records: DataFrame) -> DataFrame:
    """Histogram of codes per record, records without a code included."""
    n = codes.groupBy("record_id").agg(F.count("*").alias("n_codes"))
    per = records.select("record_id").join(n, "record_id", "left").withColumn("n_codes", F.coalesce("n_codes", F.lit(0).cast("long")))
    return per.groupBy("n_codes").agg(F.count("*").alias("n_records"))


def records_per_patient(records: DataFrame) -> DataFrame:
    """One row: patients, patients with several records, most records of one."""
    n = records.groupBy("patient_id").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("patients"), F.count_if(F.col("n") > 1).alias("several"), F.max("n").alias("most"))


def clean_age(age: Column) -> Column:
    """A number, or null for what is none and for the sentinel."""
    return F.nullif(age.try_cast("double"), F.lit(AGE_SENTINEL))


def demographics(records: DataFrame) -> DataFrame:
    """One row of counts, ages, sexes, devices and sites."""
    age = clean_age(F.col("age"))
    return records.agg(
        F.count("*").alias("n"), F.count_distinct("patient_id").alias("patients"), F.percentile(age, F.lit(0.5)).alias("median_age"),
        F.round(F.avg(age), 6).alias("mean_age"), F.count_if(F.col("age") == AGE_SENTINEL).alias("sentinel_ages"), F.count_if(age.isNull()).alias("missing_ages"),
        F.count_if(F.col("sex") == 0).alias("sex0"), F.count_if(F.col("sex") == 1).alias("sex1"),
        F.count_distinct("device").alias("devices"), F.count_distinct("site").alias("sites"),
    )


def missingness(df: DataFrame) -> DataFrame:
    """Percent of nulls of each column that has any; one pass over the table."""
    one = df.agg(*[F.round(100.0 * F.count_if(F.col(c).isNull()) / F.count("*"), 2).alias(c) for c in df.columns])
    return one.unpivot([], df.columns, "column", "percent_null").where("percent_null > 0")


def split_of(fold: Column) -> Column:
    """Folds 1-8 train, 9 val, 10 test; anything else is an error."""
    wrong = F.raise_error(F.concat(F.lit("no split for fold "), F.coalesce(fold.cast("string"), F.lit("null"))))
    return F.when(fold.between(1, 8), "train").when(fold == 9, "val").when(fold == 10, "test").otherwise(wrong)


def manifest(records: DataFrame, codes: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Record columns with split, code list, superclass list and one flag per superclass."""
    lists = codes.groupBy("record_id").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    supers = superclasses(codes, dictionary)
    names = sorted(r[0] for r in dictionary.select("superclass").distinct().collect())  # the label space, a fixed small set
    df = records.join(lists, "record_id", "left").join(supers, "record_id", "left")
    empty = F.array().cast("array<string>")
    df = df.withColumn("codes", F.coalesce("codes", empty)).withColumn("superclasses", F.coalesce("superclasses", empty))
    flags = [F.array_contains("superclasses", s).cast("int").alias(f"is_{s.lower().replace(' ', '_')}") for s in names]
    return df.select("record_id", "patient_id", "fold", split_of(F.col("fold")).alias("split"), "codes", "superclasses", *flags)


def group_leaks(df: DataFrame, group: str, part: str) -> DataFrame:
    """Groups that stand in more than one part."""
    return df.groupBy(group).agg(F.count_distinct(part).alias("parts")).where("parts > 1")


def assert_no_leak(df: DataFrame, group: str = "patient_id", part: str = "split") -> None:
    """L14 as an action: fails and names up to five offenders."""
    bad = [r[0] for r in group_leaks(df, group, part).orderBy(group).limit(5).collect()]
    if bad:
        raise ValueError(f"{group} in several values of {part}: {bad}")


def split_balance(manifest_rows: DataFrame) -> DataFrame:
    """Mean of each flag by split."""
    flags = [c for c in manifest_rows.columns if c.startswith("is_")]
    return manifest_rows.groupBy("split").agg(*[F.round(F.avg(c), 6).alias(c) for c in flags])


def positive_weights(predictions: DataFrame, cap: float = 20.0) -> DataFrame:
    """min(negatives / positives, cap) by label; 1 where all or none are positive."""
    g = predictions.groupBy("label").agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    w = F.when((F.col("pos") == 0) | (F.col("pos") == F.col("n")), 1.0).otherwise(F.least(ratio(F.col("n") - F.col("pos"), F.col("pos")), F.lit(cap)))
    return g.select("label", F.round(w, 6).alias("weight"))


def input_gate(signals: DataFrame, leads: int = 12, least_seconds: float = 5.0) -> DataFrame:
    """(record_id, fs, signal array<array>) with ok, reliable, errors and warnings."""
    sizes = F.transform("signal", lambda s: F.size(s))
    shortest, longest = F.array_min(sizes), F.array_max(sizes)
    note = lambda bad, text: F.when(bad, F.lit(text))
    errors = F.array_compact(
        F.array(
            note(F.size("signal") != leads, f"not {leads} leads"), note(~(F.col("fs") > 0) | F.col("fs").isNull(), "no sampling rate"),
            note((F.size("signal") > 0) & (shortest != longest), "ragged leads"), note(F.coalesce(longest, F.lit(0)) <= 0, "no samples"),
        )
    )
    df = signals.withColumn("errors", errors)
    df = df.withColumn("warnings", F.array_compact(F.array(note((F.col("fs") > 0) & (longest / F.col("fs") < least_seconds), "shorter than the least length"))))
    return df.withColumn("ok", F.size("errors") == 0).withColumn("reliable", F.col("ok") & (F.size("warnings") == 0))
