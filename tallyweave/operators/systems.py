"""Comparison of answering systems: coverage, latency, cost, and code mappings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.portable import ratio


def coverage(cells: DataFrame, by: str = "system") -> DataFrame:
    """Answered cells of all cells."""
    return cells.groupBy(by).agg(ratio(F.count("p"), F.count("*")).alias("coverage"))


def latency(calls: DataFrame) -> DataFrame:
    """p50 and p95 over successful calls."""
    q = F.percentile("latency_s", F.array(F.lit(0.5), F.lit(0.95)))
    return calls.where("ok").groupBy("system").agg(q.alias("q")).select("system", F.col("q")[0].alias("p50"), F.col("q")[1].alias("p95"))


def cost_per_1000(calls: DataFrame, prices: DataFrame, per_hour: float = 0.1) -> DataFrame:
    """Hosted calls by mean tokens and list price (null for an unknown model), local ones by mean latency and hourly rate."""
    j = calls.where("ok").join(F.broadcast(prices), "model", "left")
    hosted = F.col("tokens_in") * F.col("price_in") / 1e6 + F.col("tokens_out") * F.col("price_out") / 1e6
    cost = F.when(F.col("hosting") == "hosted", hosted).otherwise(F.col("latency_s") / 3600 * per_hour)
    return j.groupBy("system").agg(F.when(F.count(cost) == F.count("*"), 1000 * F.avg(cost)).alias("cost"))


def system_summary(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """One row per system: calls, errors, latency, cost."""
    n = calls.groupBy("system").agg(F.count("*").alias("calls"), F.count_if(~F.col("ok")).alias("errors"))
    return n.join(latency(calls), "system", "left").join(cost_per_1000(calls, prices), "system", "left")


def suggestions(codes: DataFrame, mapping: DataFrame) -> DataFrame:
    """Mapped targets of a record: the first source code of each target, definitional ones first."""
    j = codes.join(F.broadcast(mapping.where("target is not null")), "code")
    first = W.partitionBy("record_id", "target").orderBy("code")
    one = j.withColumn("rn", F.row_number().over(first)).where("rn = 1")
    item = F.struct(F.when(F.col("tier") == "definitional", 0).otherwise(1).alias("r"), "target", "code")
    return one.groupBy("record_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["target"]).alias("targets"))


def mapping_audit(mapping: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Faults of a mapping: codes without a row, rows without a code, targets of the wrong form, candidates without evidence."""
    gap = dictionary.join(mapping, "code", "left_anti").select("code", F.lit("not mapped").alias("fault"))
    extra = mapping.join(dictionary, "code", "left_anti").select("code", F.lit("unknown code").alias("fault"))
    form = mapping.where("target is not null and not target rlike '^[A-Z][0-9]{2}(\\\\.[0-9]+)?$'").select("code", F.lit("wrong form").alias("fault"))
    bare = mapping.where("tier = 'candidate' and evidence is null").select("code", F.lit("no evidence").alias("fault"))
    return gap.unionByName(extra).unionByName(form).unionByName(bare)


def split_counts(rows: DataFrame, codes: DataFrame, k: int = 15) -> DataFrame:
    """Records by split, and the k most frequent codes."""
    a = rows.groupBy(F.col("split").alias("item")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("split"))
    b = codes.groupBy(F.col("code").alias("item")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "item").limit(k).withColumn("kind", F.lit("code"))
    return a.unionByName(b)
