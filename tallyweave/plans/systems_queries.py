"""Queries over system calls and code mappings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import labels as L
from ..operators import systems as X
from ..operators import views as V
from .registry import query
from .subgroups_queries import rounded

_PRICES = "(SELECT 'model-a' AS model, 2.5::DOUBLE AS price_in, 10.0::DOUBLE AS price_out)"
_LAT = "(SELECT system, quantile_cont(latency_s, 0.5) AS p50, quantile_cont(latency_s, 0.95) AS p95 FROM v_calls WHERE ok GROUP BY system)"
_COST = f"""(SELECT system, CASE WHEN count(c) = count(*) THEN 1000 * avg(c) END AS cost FROM (SELECT system, CASE WHEN hosting = 'hosted' THEN tokens_in * price_in / 1e6 + tokens_out * price_out / 1e6 ELSE latency_s / 3600 * 0.1::DOUBLE END AS c FROM v_calls LEFT JOIN {_PRICES} USING (model) WHERE ok) GROUP BY system)"""
_MAP = """(SELECT code, CASE WHEN code_idx % 6 = 0 THEN NULL WHEN code_idx % 11 = 1 THEN 'bad' ELSE 'I' || (40 + code_idx % 7)::VARCHAR END AS target, CASE WHEN code_idx % 2 = 0 THEN 'definitional' ELSE 'candidate' END AS tier, CASE WHEN code_idx % 3 = 0 THEN 'seen' END AS evidence FROM v_dict WHERE code_idx <> 3 UNION ALL SELECT 'ZZZ', NULL, 'definitional', NULL)"""


def prices(spark):
    return spark.range(1).select(F.lit("model-a").alias("model"), F.lit(2.5).alias("price_in"), F.lit(10.0).alias("price_out"))


def mapping(spark, sf):
    k = F.col("code_idx")
    target = F.when(k % 6 == 0, None).when(k % 11 == 1, "bad").otherwise(F.concat(F.lit("I"), (40 + k % 7).cast("string")))
    m = V.dictionary(spark, sf).where("code_idx <> 3").select("code", target.alias("target"), F.when(k % 2 == 0, "definitional").otherwise("candidate").alias("tier"), F.when(k % 3 == 0, "seen").alias("evidence"))
    none = F.lit(None).cast("string")
    return m.unionByName(spark.range(1).select(F.lit("ZZZ").alias("code"), none.alias("target"), F.lit("definitional").alias("tier"), none.alias("evidence")))


@query("X02_coverage", "SELECT o_orderpriority AS system, round(count(CASE WHEN o_orderstatus <> 'P' THEN 1 END)::DOUBLE / count(*), 6) AS coverage FROM orders GROUP BY 1")
def coverage(spark, sf):
    return rounded(X.coverage(V.calls(spark, sf).withColumn("p", F.when(F.col("ok"), F.col("latency_s")))))


@query("X04_latency", f"SELECT system, round(p50, 6) AS p50, round(p95, 6) AS p95 FROM {_LAT}")
def latency(spark, sf):
    return rounded(X.latency(V.calls(spark, sf)))


@query("X05_cost", f"SELECT system, round(cost, 6) AS cost FROM {_COST}")
def cost(spark, sf):
    return rounded(X.cost_per_1000(V.calls(spark, sf), prices(spark)))


@query("X06_system_summary", f"SELECT system, calls, errors, round(p50, 6) AS p50, round(p95, 6) AS p95, round(cost, 6) AS cost FROM (SELECT system, count(*) AS calls, count(*) FILTER (NOT ok) AS errors FROM v_calls GROUP BY system) LEFT JOIN {_LAT} USING (system) LEFT JOIN {_COST} USING (system)")
def summary(spark, sf):
    return rounded(X.system_summary(V.calls(spark, sf), prices(spark)))


@query("E02_suggestions", f"""SELECT record_id, list(target ORDER BY r, target, code) AS targets FROM (SELECT *, CASE WHEN tier = 'definitional' THEN 0 ELSE 1 END AS r, row_number() OVER (PARTITION BY record_id, target ORDER BY code) AS rn FROM v_codes JOIN {_MAP} USING (code) WHERE target IS NOT NULL) WHERE rn = 1 GROUP BY record_id""")
def suggestions(spark, sf):
    return X.suggestions(V.codes(spark, sf), mapping(spark, sf))


@query("E05_mapping_audit", f"""SELECT code, 'not mapped' AS fault FROM v_dict WHERE code NOT IN (SELECT code FROM {_MAP}) UNION ALL SELECT code, 'unknown code' FROM {_MAP} WHERE code NOT IN (SELECT code FROM v_dict)
    UNION ALL SELECT code, 'wrong form' FROM {_MAP} WHERE target IS NOT NULL AND NOT regexp_full_match(target, '[A-Z][0-9]{{2}}(\\.[0-9]+)?') UNION ALL SELECT code, 'no evidence' FROM {_MAP} WHERE tier = 'candidate' AND evidence IS NULL""")
def audit(spark, sf):
    return X.mapping_audit(mapping(spark, sf), V.dictionary(spark, sf))


@query("E08_split_counts", """SELECT CASE WHEN fold <= 8 THEN 'train' WHEN fold = 9 THEN 'val' ELSE 'test' END AS item, count(*) AS n, 'split' AS kind FROM v_records GROUP BY 1 UNION ALL SELECT * FROM (SELECT code, count(*) AS n, 'code' FROM v_codes GROUP BY code ORDER BY n DESC, code LIMIT 15)""")
def card(spark, sf):
    r = V.records(spark, sf).withColumn("split", L.split_of(F.col("fold")))
    return X.split_counts(r, V.codes(spark, sf))
