"""Queries over feedback tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import feedback as B
from ..operators import views as V
from .registry import query
from .subgroups_queries import rounded

_T = "(SELECT code AS label, 0.3::DOUBLE + (code_idx % 5) / 10.0::DOUBLE AS threshold FROM v_dict WHERE code_idx % 3 <> 0)"
_U = "(('0x' || substr(md5({}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
_F1 = """(SELECT label, k, k * 5 / 100.0::DOUBLE AS t, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 9) AS f1, tp + fp AS evidence FROM (SELECT label, k, sum(CASE WHEN step >= k AND good THEN w ELSE 0 END) AS tp, sum(CASE WHEN step >= k AND NOT good THEN w ELSE 0 END) AS fp,
    sum(CASE WHEN step < k AND good THEN w ELSE 0 END) AS fn FROM (SELECT label, least(floor(confidence * 20 + 1e-9), 19) AS step, verdict = 'correct' AS good, round(1 / sampling_rate, 6) AS w FROM v_ratings WHERE verdict <> 'uncertain') CROSS JOIN (SELECT unnest(range(1, 20)) AS k) GROUP BY label, k))"""
_TALLY = """(SELECT label, coalesce(correct, 0) AS correct, coalesce(incorrect, 0) AS incorrect, coalesce(uncertain, 0) AS uncertain, coalesce(missed, 0) AS missed, coalesce(weight, 0.0) AS weight FROM (SELECT label, count(*) FILTER (verdict = 'correct') AS correct,
    count(*) FILTER (verdict = 'incorrect') AS incorrect, count(*) FILTER (verdict = 'uncertain') AS uncertain, sum(1 / sampling_rate) AS weight FROM v_ratings GROUP BY label) FULL JOIN (SELECT label, count(*) AS missed FROM v_missed GROUP BY label) USING (label))"""


def thresholds(spark, sf):
    k = F.col("code_idx")
    return V.dictionary(spark, sf).where(k % 3 != 0).select(F.col("code").alias("label"), (F.lit(0.3) + (k % 5) / 10.0).alias("threshold"))


@query("B01_select_findings", f"""SELECT record_id, label, p AS confidence, p < coalesce(threshold, 0.5) AS exploratory FROM v_pred LEFT JOIN {_T} t USING (label)
    WHERE p >= coalesce(threshold, 0.5) OR (p >= 0.2 AND {_U.format("'s:' || record_id::VARCHAR || ':' || label")} < 0.05)""")
def select(spark, sf):
    return B.select_findings(V.predictions(spark, sf), thresholds(spark, sf), F.concat_ws(":", F.lit("s"), F.col("record_id").cast("string"), "label"))


@query("B02_tallies", f"SELECT label, correct, incorrect, uncertain, missed, round(weight, 6) AS weight FROM {_TALLY}")
def tallies(spark, sf):
    return rounded(B.tallies(V.ratings(spark, sf), V.missed(spark, sf)))


@query("B03_missed_confidences", "SELECT label, list(confidence ORDER BY confidence) AS confidences FROM v_missed GROUP BY label")
def confidences(spark, sf):
    return B.missed_confidences(V.missed(spark, sf))


@query("B04_store_summary", """SELECT count(*) AS ratings, count(*) FILTER (exploratory) AS exploratory, count(DISTINCT reviewer_id) AS reviewers, count(DISTINCT label) AS labels, count(*) FILTER (verdict = 'correct') AS correct,
    count(*) FILTER (verdict = 'incorrect') AS incorrect, count(*) FILTER (verdict = 'uncertain') AS uncertain, (SELECT count(*) FROM v_missed) AS missed FROM v_ratings""")
def store(spark, sf):
    return B.store_summary(V.ratings(spark, sf), V.missed(spark, sf))


@query("B05_rater_agreement", "SELECT count(*) AS rated_twice, round(avg((v = 1)::INT), 6) AS agreement FROM (SELECT finding_id, count(*) AS n, count(DISTINCT verdict) AS v FROM v_ratings GROUP BY 1 HAVING count(*) >= 2)")
def agreement(spark, sf):
    return rounded(B.rater_agreement(V.ratings(spark, sf)))


@query("B06_weighted_f1", f"SELECT label, k, t, round(f1, 6) AS f1, round(evidence, 6) AS evidence FROM {_F1}")
def weighted(spark, sf):
    return rounded(B.weighted_f1(V.ratings(spark, sf)))


@query("B08_decide_thresholds", f"""SELECT label, CASE WHEN reason = 'moved' THEN greatest(0.05, least(0.95, round(0.5::DOUBLE + greatest(-0.1::DOUBLE, least(0.1::DOUBLE, bt - 0.5::DOUBLE)), 6))) ELSE 0.5 END::DOUBLE AS threshold, reason FROM (
    SELECT label, bt, CASE WHEN n < 20 THEN 'few ratings' WHEN bt IS NULL THEN 'no evidence' WHEN NOT bf > coalesce(now_f1, 0) + 1e-6 THEN 'no better threshold' ELSE 'moved' END AS reason
    FROM (SELECT label, count(*) FILTER (verdict <> 'uncertain') AS n FROM v_ratings GROUP BY label) LEFT JOIN (SELECT label, -min([-f1, t])[1] AS bf, min([-f1, t])[2] AS bt FROM {_F1} WHERE evidence >= 1 GROUP BY label) USING (label)
    LEFT JOIN (SELECT label, f1 AS now_f1 FROM {_F1} WHERE k = 10) USING (label))""")
def decide(spark, sf):
    return B.decide_thresholds(V.ratings(spark, sf))


@query("B10_exploration_rates", f"SELECT label, round(least(0.25::DOUBLE, 0.05::DOUBLE * (1 + missed)), 4) AS rate FROM {_TALLY}")
def rates(spark, sf):
    return B.exploration_rates(B.tallies(V.ratings(spark, sf), V.missed(spark, sf)))


@query("B11_macro_scores", f"""SELECT round(avg(CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) END), 6) AS precision, round(avg(CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) END), 6) AS recall, round(avg(CASE WHEN tp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) END), 6) AS f1
    FROM (SELECT label, count(*) FILTER (p >= t AND y = 1) AS tp, count(*) FILTER (p >= t AND y = 0) AS fp, count(*) FILTER (p < t AND y = 1) AS fn FROM (SELECT *, coalesce(threshold, 0.5) AS t FROM v_pred LEFT JOIN {_T} t USING (label)) GROUP BY label)""")
def macro(spark, sf):
    return rounded(B.macro_scores(V.predictions(spark, sf), thresholds(spark, sf)))
