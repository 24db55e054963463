"""Partitioned populations, weighted averaging, and rare-class sample sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.portable import ratio, uniform


def natural_partition(records: DataFrame, by: str, least: int = 100) -> DataFrame:
    """Client of each record by a column; null is 'unknown', small groups are pooled into 'other', none is dropped."""
    named = records.withColumn("client", F.coalesce(F.col(by).cast("string"), F.lit("unknown")))
    n = F.count("*").over(W.partitionBy("client"))
    return named.withColumn("client", F.when(n < least, F.lit("other")).otherwise(F.col("client")))


def matched_partition(records: DataFrame, clients: DataFrame, seed: str = "iid") -> DataFrame:
    """Records in hash order dealt into shards of exactly the clients' sizes.

    ``clients`` (client, n) is small; places come from per-bucket counts, so
    the records are never ordered in one task.
    """
    ends = clients.withColumn("hi", F.sum("n").over(W.orderBy(F.desc("n"), "client"))).withColumn("lo", F.col("hi") - F.col("n"))
    u = uniform(F.concat(F.lit(f"{seed}:"), F.col("record_id").cast("string")))
    keyed = records.withColumn("u", u).withColumn("bucket", F.floor(F.col("u") * 256).cast("int"))
    sizes = keyed.groupBy("bucket").agg(F.count("*").alias("c"))
    first = sizes.withColumn("first", F.sum("c").over(W.orderBy("bucket")) - F.col("c")).drop("c")
    place = keyed.join(F.broadcast(first), "bucket").withColumn("place", F.col("first") + F.row_number().over(W.partitionBy("bucket").orderBy("u", "record_id")) - 1)
    return place.join(F.broadcast(ends), (F.col("place") >= F.col("lo")) & (F.col("place") < F.col("hi"))).select("record_id", "client")


def label_mix(df: DataFrame, by: list[str]) -> DataFrame:
    """Share of each label among the positives of a group."""
    n = df.where("y = 1").groupBy(*by, "label").agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy(*by))
    return n.withColumn("share", F.col("n") / total)


def label_skew(df: DataFrame) -> DataFrame:
    """Total variation between each client's label mix and that of all."""
    clients, labels = df.select("client").distinct(), df.select("label").distinct()
    every = label_mix(df, []).select("label", F.col("share").alias("all_share"))
    own = label_mix(df, ["client"]).select("client", "label", "share")
    grid = clients.crossJoin(F.broadcast(labels)).join(own, ["client", "label"], "left").join(F.broadcast(every), "label", "left")
    gap = F.abs(F.coalesce("share", F.lit(0.0)) - F.coalesce("all_share", F.lit(0.0)))
    return grid.groupBy("client").agg((0.5 * F.sum(gap)).alias("skew"))


def size_inequality(clients: DataFrame) -> DataFrame:
    """Gini of the client sizes, largest share, largest to smallest."""
    k = F.row_number().over(W.orderBy("n", "client"))  # one row per client
    r = clients.withColumn("k", k)
    return r.agg(
        (2 * F.sum(F.col("k") * F.col("n")) / (F.count("*") * F.sum("n")) - (F.count("*") + 1) / F.count("*")).alias("gini"),
        ratio(F.max("n"), F.sum("n")).alias("largest_share"), ratio(F.max("n"), F.min("n")).alias("max_to_min"),
    )


def partition_summary(df: DataFrame) -> DataFrame:
    """By client: records, labels with a positive and with ten, labels per record."""
    per = df.groupBy("client", "label").agg(F.sum("y").alias("pos"))
    a = per.groupBy("client").agg(F.count_if(F.col("pos") >= 1).alias("labels_1"), F.count_if(F.col("pos") >= 10).alias("labels_10"), F.sum("pos").alias("positives"))
    n = df.groupBy("client").agg(F.count_distinct("record_id").alias("n"))
    return a.join(n, "client").select("client", "n", "labels_1", "labels_10", ratio(F.col("positives"), F.col("n")).alias("labels_per_record"))


def misaligned(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two tables has, repeats counted, with the side that has them."""
    return a.exceptAll(b).withColumn("only_in", F.lit("first")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("second")))


def weighted_average(params: DataFrame, integer_keys: list = ()) -> DataFrame:
    """(client, key, idx, value, n) to the n-weighted mean of each (key, idx); entries of integer keys are rounded."""
    mean = F.sum(F.col("n") * F.col("value")) / F.sum("n")
    g = params.groupBy("key", "idx").agg(mean.alias("value"))
    return g.withColumn("value", F.when(F.col("key").isin(*integer_keys), F.round("value")).otherwise(F.col("value"))) if integer_keys else g


def client_drift(params: DataFrame) -> DataFrame:
    """Mean over clients of |w - average| / |average|."""
    avg = weighted_average(params).withColumnRenamed("value", "avg")
    d = params.join(avg, ["key", "idx"]).groupBy("client").agg(F.sqrt(F.sum((F.col("value") - F.col("avg")) ** 2)).alias("d"), F.sqrt(F.sum(F.col("avg") ** 2)).alias("a"))
    return d.agg(F.avg(ratio(F.col("d"), F.col("a"))).alias("drift"))


def sample_clients(clients: DataFrame, fraction: float, seed: int) -> DataFrame:
    """max(1, half-even round of the fraction) clients without replacement, by hash."""
    u = uniform(F.concat_ws(":", F.lit(str(seed)), F.col("client")))
    k = F.row_number().over(W.orderBy(u, "client"))  # one row per client
    wanted = F.greatest(F.lit(1), F.bround(F.lit(fraction) * F.count("*").over(W.partitionBy()), 0))
    return clients.withColumn("k", k).withColumn("wanted", wanted).where("k <= wanted").select("client")


def make_rare(df: DataFrame, targets: list[str], keep: int, seed: str = "rare") -> DataFrame:
    """Of each target's positives only ``keep`` stay, by hash; the others become 0."""
    u = uniform(F.concat_ws(":", F.lit(seed), F.col("label"), F.col("record_id").cast("string")))
    pos = df.where((F.col("y") == 1) & F.col("label").isin(*targets)).withColumn("k", F.row_number().over(W.partitionBy("label").orderBy(u, "record_id")))
    drop = pos.where(F.col("k") > keep).select("record_id", "label", F.lit(1).alias("gone"))
    return df.join(drop, ["record_id", "label"], "left").withColumn("y", F.when(F.col("gone") == 1, 0).otherwise(F.col("y"))).drop("gone")


def oversample(df: DataFrame, when: Column, factor: int) -> DataFrame:
    """Rows that meet a condition ``factor`` times, others once."""
    times = F.when(when, factor).otherwise(1)
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), times)))


def equal_arm(df: DataFrame, targets: list[str], n: int, seed: str) -> DataFrame:
    """Exactly n draws with replacement per target among its positives (target, draw, record_id)."""
    pos = df.where((F.col("y") == 1) & F.col("label").isin(*targets))
    numbered = pos.select("label", "record_id", (F.row_number().over(W.partitionBy("label").orderBy("record_id")) - 1).alias("k"))
    size = numbered.groupBy("label").agg(F.count("*").alias("c"))
    draws = size.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n))))
    draws = draws.withColumn("k", F.floor(uniform(F.concat_ws(":", F.lit(seed), F.col("label"), F.col("draw").cast("string"))) * F.col("c")).cast("int"))
    return draws.join(numbered, ["label", "k"]).select("label", "draw", "record_id")


def compare_measures(measures: DataFrame, group: str, names: list[str]) -> DataFrame:
    """By group and measure: rows, share measurable, median."""
    long = measures.unpivot([group], names, "measure", "value")
    return long.groupBy(group, "measure").agg(F.count("*").alias("n"), F.round(F.avg(F.col("value").isNotNull().cast("int")), 6).alias("measurable"), F.percentile("value", F.lit(0.5)).alias("median"))
