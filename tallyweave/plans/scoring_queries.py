"""Queries over prediction tables (M01-M21) and the flagship label quality table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.portable import r6
from ..operators import labels as L
from ..operators import scoring as S
from ..operators import views as V
from .registry import query


def auroc_sql(table: str, by: str, score: str = "p") -> str:
    """DuckDB text of the rank statistic by group; by '' takes all rows."""
    part, lead = (f"PARTITION BY {by}", f"{by}, ") if by else ("", "")
    group = f"GROUP BY {by}" if by else ""
    return f"""SELECT {lead}sum(pos) AS n_pos, sum(neg) AS n_neg, CASE WHEN sum(pos) * sum(neg) > 0 THEN sum(won) / (sum(pos) * sum(neg))::DOUBLE END AS auroc FROM (
        SELECT *, pos * (coalesce(sum(neg) OVER ({part} ORDER BY {score} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 0.5::DOUBLE * neg) AS won FROM (
        SELECT {lead}{score}, sum(y) AS pos, sum(1 - y) AS neg FROM {table} GROUP BY {lead}{score})) {group}"""


def f1_sql(tp: str, fp: str, fn: str) -> str:
    return f"coalesce(2.0::DOUBLE * {tp} / nullif(2 * {tp} + {fp} + {fn}, 0), 0.0)"


_CONF = "count(*) FILTER ({0} >= 0.5 AND y = 1) AS tp, count(*) FILTER ({0} >= 0.5 AND y = 0) AS fp, count(*) FILTER ({0} < 0.5 AND y = 1) AS fn"
_BINS = "SELECT {by} least(floor(p * 15 + 1e-9), 14)::INT AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS mean_y FROM {t} GROUP BY ALL"
_ENT = "-(y * ln(least(greatest({0}, 1e-7::DOUBLE), 1 - 1e-7::DOUBLE)) + (1 - y) * ln(1 - least(greatest({0}, 1e-7::DOUBLE), 1 - 1e-7::DOUBLE)))"


@query("M01_label_auroc", f"SELECT label, n_pos::BIGINT AS n_pos, n_neg::BIGINT AS n_neg, round(auroc, 6) AS auroc FROM ({auroc_sql('v_pred', 'label')})")
def label_auroc(spark, sf):
    return S.auroc(V.predictions(spark, sf), ["label"]).withColumn("auroc", r6(F.col("auroc")))


@query("M02_macro_auroc", f"SELECT round(avg(auroc), 6) AS macro_auroc, count(auroc) AS n_labels FROM ({auroc_sql('v_pred', 'label')})")
def macro_auroc(spark, sf):
    return S.macro(S.auroc(V.predictions(spark, sf), ["label"])).withColumn("macro_auroc", r6(F.col("macro_auroc")))


@query("M03_f1", f"""SELECT round(avg({f1_sql('tp', 'fp', 'fn')}), 6) AS macro_f1, round({f1_sql('sum(tp)', 'sum(fp)', 'sum(fn)')}, 6) AS micro_f1
    FROM (SELECT label, {_CONF.format('p')} FROM v_pred GROUP BY label)""")
def f1_scores(spark, sf):
    return S.f1_scores(V.predictions(spark, sf)).select(r6(F.col("macro_f1")).alias("macro_f1"), r6(F.col("micro_f1")).alias("micro_f1"))


@query("M04_tuned_thresholds", f"""SELECT label, CASE WHEN f1 > 0 THEN k * 5 / 100.0::DOUBLE ELSE 0.5::DOUBLE END AS threshold, f1 FROM (
    SELECT *, row_number() OVER (PARTITION BY label ORDER BY f1 DESC, k) AS rn FROM (SELECT label, k, round({f1_sql('tp', 'fp', 'fn')}, 6) AS f1 FROM (
    SELECT label, k, count(*) FILTER (step >= k AND y = 1) AS tp, count(*) FILTER (step >= k AND y = 0) AS fp, count(*) FILTER (step < k AND y = 1) AS fn
    FROM (SELECT label, y, least(floor(p * 20 + 1e-9), 19) AS step FROM v_pred) CROSS JOIN (SELECT unnest(range(1, 20)) AS k) GROUP BY label, k))) WHERE rn = 1""")
def tuned(spark, sf):
    return S.tune_thresholds(V.predictions(spark, sf))


@query("M05_reliability", f"SELECT bin, n, round(mean_p, 6) AS mean_p, round(mean_y, 6) AS mean_y FROM ({_BINS.format(by='', t='v_pred')})")
def reliability(spark, sf):
    return S.reliability(V.predictions(spark, sf)).select("bin", "n", r6(F.col("mean_p")).alias("mean_p"), r6(F.col("mean_y")).alias("mean_y"))


@query("M06_quantile_reliability", """WITH e AS (SELECT list_sort(list_distinct(list_concat([0.0::DOUBLE], quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])))) AS edges FROM v_pred)
    SELECT bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS mean_y FROM (SELECT p, y, (len(list_filter(edges, lambda x: x <= p)) - 1)::INT AS bin FROM v_pred, e) GROUP BY bin""")
def quantile_reliability(spark, sf):
    return S.quantile_reliability(V.predictions(spark, sf)).select("bin", "n", r6(F.col("mean_p")).alias("mean_p"), r6(F.col("mean_y")).alias("mean_y"))


@query("M07_calibration_error", f"SELECT round(sum(n * abs(mean_p - mean_y)) / sum(n), 6) AS ece, round(max(abs(mean_p - mean_y)), 6) AS mce FROM ({_BINS.format(by='', t='v_pred')})")
def calibration_error(spark, sf):
    return S.calibration_error(S.reliability(V.predictions(spark, sf))).select(r6(F.col("ece")).alias("ece"), r6(F.col("mce")).alias("mce"))


@query("M08_classwise_error", f"""SELECT label, round(sum(n * abs(mean_p - mean_y)) / sum(n), 6) AS ece, round(max(abs(mean_p - mean_y)), 6) AS mce FROM ({_BINS.format(by='label,', t='v_pred')})
    WHERE label IN (SELECT label FROM v_pred GROUP BY label HAVING sum(y) >= 10) GROUP BY label""")
def classwise(spark, sf):
    return S.classwise_error(V.predictions(spark, sf)).select("label", r6(F.col("ece")).alias("ece"), r6(F.col("mce")).alias("mce"))


@query("M09_accuracy_style_error", """SELECT round(sum(n * abs(c - r) / (SELECT count(*) FROM v_pred)), 6) AS ece FROM (SELECT bin, count(*) AS n, avg(c) AS c, avg(r) AS r FROM (
    SELECT greatest(p, 1 - p) AS c, CASE WHEN (p >= 0.5) = (y = 1) THEN 1 ELSE 0 END AS r, floor(greatest(p, 1 - p) * 15 + 1e-9) AS bin FROM v_pred) WHERE bin < 15 GROUP BY bin)""")
def accuracy_style(spark, sf):
    return S.accuracy_style_error(V.predictions(spark, sf)).select(r6(F.col("ece")).alias("ece"))


@query("M10_brier_nll", f"SELECT label, round(avg((p - y) * (p - y)), 6) AS brier, round(avg({_ENT.format('p')}), 6) AS nll FROM v_pred GROUP BY label")
def brier(spark, sf):
    return S.brier_and_nll(V.predictions(spark, sf), ["label"]).select("label", r6(F.col("brier")).alias("brier"), r6(F.col("nll")).alias("nll"))


def _temperature_sql(by: str) -> str:
    lead, join = (f"{by}, ", f"USING ({by})") if by else ("", "")
    loss = f"round(sum(n * {_ENT.format('(1 / (1 + exp(-z / t)))')}) / sum(n), 9) AS nll"
    fine = f"{'JOIN' if by else 'CROSS JOIN'} f {join}"
    return f"""WITH h AS (SELECT {lead}round(z, 2) AS z, y, count(*) AS n FROM v_pred GROUP BY ALL),
        c AS (SELECT 0.25::DOUBLE * pow(48.0::DOUBLE, k / 59.0::DOUBLE) AS t FROM (SELECT unnest(range(60)) AS k)),
        a AS (SELECT {lead}t, {loss} FROM h CROSS JOIN c GROUP BY ALL), b AS (SELECT {lead}min([nll, t])[2] AS t FROM a GROUP BY ALL),
        f AS (SELECT {lead}t * (0.8::DOUBLE + k * (0.45::DOUBLE / 39.0::DOUBLE)) AS t FROM b CROSS JOIN (SELECT unnest(range(40)) AS k)),
        g AS (SELECT {lead}t, {loss} FROM h {fine} GROUP BY ALL)
        SELECT {lead}round(m[2], 6) AS t, round(m[1], 6) AS nll FROM (SELECT {lead}min([nll, t]) AS m FROM g GROUP BY ALL)"""


@query("M11_temperature", _temperature_sql(""))
def temperature(spark, sf):
    return S.temperatures(V.predictions(spark, sf)).select(r6(F.col("t")).alias("t"), r6(F.col("nll")).alias("nll"))


_LABEL_T = f"""SELECT label, CASE WHEN enough THEN t ELSE (SELECT t FROM ({_temperature_sql("")})) END AS t, CASE WHEN enough THEN nll END AS nll FROM ({_temperature_sql("label")})
    JOIN (SELECT label, sum(y) >= 10 AND sum(y) < count(*) AS enough FROM v_pred GROUP BY label) USING (label)"""


@query("M12_label_temperatures", _LABEL_T)
def label_temperatures(spark, sf):
    return S.label_temperatures(V.predictions(spark, sf)).select("label", r6(F.col("t")).alias("t"), r6(F.col("nll")).alias("nll"))


@query("M13_label_affine")
def label_affine(spark, sf):
    return S.label_affine(V.predictions(spark, sf)).select("label", *[F.round(c, 5).alias(c) for c in ("a", "b", "nll")])


@query("M14_apply_calibration", f"SELECT record_id, label, y, p, round(1 / (1 + exp(-z / t)), 5) AS p_cal FROM v_pred JOIN ({_LABEL_T}) USING (label)")
def calibrated(spark, sf):
    p = V.predictions(spark, sf)
    fitted = S.label_temperatures(p).select("label", r6(F.col("t")).alias("t"))
    return S.apply_temperature(p, fitted, ["label"]).select("record_id", "label", "y", "p", F.round("p_cal", 5).alias("p_cal"))


@query("M15_effect_table", f"""WITH l AS (SELECT 'before' AS arm, label, y, p AS q FROM v_two UNION ALL SELECT 'after', label, y, p2 FROM v_two),
    c AS (SELECT arm, label, {_CONF.format('q')} FROM l GROUP BY arm, label), g AS (SELECT arm, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, avg({f1_sql('tp', 'fp', 'fn')}) AS macro_f1 FROM c GROUP BY arm)
    SELECT arm, round(fp::DOUBLE / r, 6) AS over_flags, round(fn::DOUBLE / r, 6) AS misses, round(tp::DOUBLE / (tp + fn), 6) AS recall, round({f1_sql('tp', 'fp', 'fn')}, 6) AS micro_f1,
    round(macro_f1, 6) AS macro_f1 FROM g, (SELECT count(DISTINCT record_id) AS r FROM v_two)""")
def effect(spark, sf):
    e = S.effect_table(V.predictions(spark, sf, two=True))
    return e.select("arm", *[r6(F.col(c)).alias(c) for c in e.columns if c != "arm"])


_POOL = "(SELECT record_id, superclass AS label, max(y) AS y, max(p) AS p FROM v_pred JOIN v_dict ON code = label WHERE diagnostic GROUP BY ALL)"


@query("M16_superclass_pool", f"SELECT * FROM {_POOL}")
def pooled(spark, sf):
    return S.pool_superclasses(V.predictions(spark, sf), V.dictionary(spark, sf))


@query("M17_superclass_auroc", f"SELECT label, n_pos::BIGINT AS n_pos, n_neg::BIGINT AS n_neg, round(auroc, 6) AS auroc FROM ({auroc_sql(_POOL, 'label')})")
def superclass_auroc(spark, sf):
    return S.auroc(pooled(spark, sf), ["label"]).withColumn("auroc", r6(F.col("auroc")))


@query("M18_label_table", f"""SELECT * FROM (SELECT label, support, auroc, f1, row_number() OVER (ORDER BY auroc DESC NULLS LAST, label) AS best, row_number() OVER (ORDER BY auroc NULLS LAST, label) AS weakest
    FROM (SELECT label, n_pos::BIGINT AS support, round(auroc, 6) AS auroc FROM ({auroc_sql('v_pred', 'label')})) JOIN (SELECT label, round({f1_sql('tp', 'fp', 'fn')}, 6) AS f1 FROM
    (SELECT label, {_CONF.format('p')} FROM v_pred GROUP BY label)) USING (label)) WHERE best <= 10 OR weakest <= 10""")
def label_table(spark, sf):
    return S.label_table(V.predictions(spark, sf))


@query("M19_agreement", """SELECT round(avg(abs(p - p2)), 6) AS mean_gap, round(avg(CASE WHEN (p >= 0.5) = (p2 >= 0.5) THEN 1 ELSE 0 END), 6) AS same_side,
    round(avg(CASE WHEN (p >= 0.5) = (p2 >= 0.5) THEN 1 ELSE 0 END) FILTER (p >= 0.5), 6) AS same_among_positives FROM v_two""")
def agreement(spark, sf):
    a = S.agreement(V.predictions(spark, sf, two=True))
    return a.select(*[r6(F.col(c)).alias(c) for c in a.columns])


_RUNS = "SELECT o_custkey::VARCHAR AS name, max(o_totalprice) FILTER (o_orderstatus = 'F') AS test, max(o_totalprice) AS val FROM orders GROUP BY o_custkey"


@query("M20_leaderboard", f"""SELECT *, dense_rank() OVER (ORDER BY score DESC NULLS LAST) AS place FROM (SELECT *, coalesce(test, val) AS score FROM (
    SELECT *, false AS published FROM ({_RUNS}) UNION ALL SELECT 'published-' || c_custkey::VARCHAR, c_acctbal, NULL, true FROM customer))""")
def leaderboard(spark, sf):
    o, c = V.table(spark, sf, "orders"), V.table(spark, sf, "customer")
    runs = o.groupBy(F.col("o_custkey").cast("string").alias("name")).agg(F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("test"), F.max("o_totalprice").alias("val"))
    return S.leaderboard(runs, c.select(F.concat(F.lit("published-"), F.col("c_custkey").cast("string")).alias("name"), F.col("c_acctbal").alias("test"), F.lit(None).cast("double").alias("val")))


@query("M21_target_gate", """WITH m AS (SELECT label AS metric, round(avg((p - y) * (p - y)), 6) AS value FROM v_pred GROUP BY label)
    SELECT metric, value, CASE WHEN code_idx % 2 = 0 THEN 'max' ELSE 'min' END AS direction, 0.16::DOUBLE AS bound, CASE WHEN code_idx % 2 = 0 THEN value <= 0.16 ELSE value >= 0.16 END AS passed
    FROM v_dict LEFT JOIN m ON metric = code""")
def gate(spark, sf):
    m = brier(spark, sf).select(F.col("label").alias("metric"), F.col("brier").alias("value"))
    t = V.dictionary(spark, sf).select(F.col("code").alias("metric"), F.when(F.col("code_idx") % 2 == 0, "max").otherwise("min").alias("direction"), F.lit(0.16).alias("bound"))
    return S.target_gate(m, t)


@query("flagship_label_quality", f"""SELECT label, n, percent, auroc, ece, miss_rate FROM (SELECT code AS label, coalesce(n, 0)::BIGINT AS n,
      round(100.0::DOUBLE * coalesce(n, 0) / (SELECT count(*) FROM v_records), 3) AS percent FROM v_dict LEFT JOIN (SELECT code, count(*) AS n FROM v_codes GROUP BY code) USING (code))
    LEFT JOIN (SELECT label, round(auroc, 6) AS auroc FROM ({auroc_sql('v_pred', 'label')})) USING (label)
    LEFT JOIN (SELECT label, round(sum(n * abs(mean_p - mean_y)) / sum(n), 6) AS ece FROM ({_BINS.format(by='label,', t='v_pred')})
      WHERE label IN (SELECT label FROM v_pred GROUP BY label HAVING sum(y) >= 10) GROUP BY label) USING (label)
    LEFT JOIN (SELECT label, round(fn::DOUBLE / nullif(tp + fn, 0), 6) AS miss_rate FROM (SELECT label, {_CONF.format('p')} FROM v_pred GROUP BY label)) USING (label)""")
def flagship(spark, sf):
    """One row per label: prevalence, ranking, calibration and misses."""
    p = V.predictions(spark, sf)
    n = L.code_prevalence(V.codes(spark, sf), V.dictionary(spark, sf), V.records(spark, sf).count()).select(F.col("code").alias("label"), "n", "percent")
    c = S.confusion(p, ["label"], F.col("p") >= 0.5)
    miss = c.select("label", r6(F.when(F.col("tp") + F.col("fn") > 0, F.col("fn") / (F.col("tp") + F.col("fn")))).alias("miss_rate"))
    out = n.join(S.auroc(p, ["label"]).select("label", r6(F.col("auroc")).alias("auroc")), "label", "left")
    out = out.join(S.classwise_error(p).select("label", r6(F.col("ece")).alias("ece")), "label", "left").join(miss, "label", "left")
    return out.select("label", "n", "percent", "auroc", "ece", "miss_rate")
