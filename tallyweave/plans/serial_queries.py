"""Queries over consecutive records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import serial as P
from ..operators import views as V
from .registry import query
from .subgroups_queries import rounded

_SEC = "(epoch(current_ts)::BIGINT - epoch(prior_ts)::BIGINT)"
_BUCKET = f"CASE WHEN {_SEC} < 86400 THEN '<24h' WHEN floor({_SEC} / 86400) <= 7 THEN '1-7d' WHEN floor({_SEC} / 86400) <= 30 THEN '8-30d' WHEN floor({_SEC} / 86400) <= 365 THEN '31-365d' ELSE '>1y' END"
_SETS = "(SELECT record_id, list(code ORDER BY code) AS codes FROM v_codes GROUP BY record_id)"
_CODED = f"""(SELECT v_pairs.*, list_sort(list_filter(c, lambda x: NOT list_contains(p, x))) AS new, list_sort(list_filter(p, lambda x: NOT list_contains(c, x))) AS resolved,
    list_sort(list_filter(p, lambda x: list_contains(c, x))) AS persistent, p = c AS stable FROM (SELECT v_pairs.*, coalesce(a.codes, []) AS p, coalesce(b.codes, []) AS c FROM v_pairs
    LEFT JOIN {_SETS} a ON a.record_id = prior_id LEFT JOIN {_SETS} b ON b.record_id = current_id) v_pairs)"""
_CODED = f"(SELECT patient_id, prior_id, current_id, prior_ts, current_ts, new, resolved, persistent, stable FROM {_CODED})"
_LONG = "(SELECT record_id, unnest(['hr', 'pr', 'qrs', 'qt']) AS measure, unnest([hr, pr, qrs, qt]) AS value FROM v_obs)"
_DIFF = f"(SELECT c.*, a.measure, b.value - a.value AS diff FROM {_CODED} c JOIN {_LONG} a ON a.record_id = prior_id JOIN {_LONG} b ON b.record_id = current_id AND b.measure = a.measure WHERE a.value IS NOT NULL AND b.value IS NOT NULL)"
_RC = f"""(SELECT measure, n, CASE WHEN n >= 20 THEN 1.96::DOUBLE * 1.4826::DOUBLE * mad END AS rc, 1.96::DOUBLE * sd AS rc_sd FROM (SELECT measure, quantile_cont(diff, 0.5) AS mid, count(*) AS n, stddev_samp(diff) AS sd FROM {_DIFF} GROUP BY measure)
    JOIN (SELECT measure, quantile_cont(abs(diff - mid), 0.5) AS mad FROM {_DIFF} JOIN (SELECT measure, quantile_cont(diff, 0.5) AS mid FROM {_DIFF} GROUP BY measure) USING (measure) GROUP BY measure) USING (measure))"""
_FLOOR = f"(SELECT measure, coalesce(ceil(round(rc / 5, 9)) * 5.0::DOUBLE, 20.0::DOUBLE) AS floor FROM {_RC})"
MEASURES = ["hr", "pr", "qrs", "qt"]


def coded(spark, sf):
    return P.pair_codes(V.pairs(spark, sf), V.codes(spark, sf))


def diffs(spark, sf):
    return P.paired_differences(coded(spark, sf), V.observations(spark, sf), MEASURES)


def seen_diffs(spark, sf):
    """Differences with what gates them, of pairs without their codes."""
    return P.paired_differences(V.pairs(spark, sf).select("prior_id", "current_id"), V.observations(spark, sf), MEASURES, {"p": "p_detected"})


@query("P01_repeat_records", "SELECT record_id, patient_id FROM v_records WHERE patient_id IN (SELECT patient_id FROM v_records GROUP BY 1 HAVING count(*) >= 2)")
def repeats(spark, sf):
    return P.repeat_records(V.records(spark, sf)).select("record_id", "patient_id")


@query("P02_consecutive_pairs", "SELECT patient_id, prior_id, current_id FROM v_pairs")
def pairs(spark, sf):
    return V.pairs(spark, sf).select("patient_id", "prior_id", "current_id")


@query("P03_elapsed", f"""SELECT prior_id, current_id, {_SEC} AS seconds, {_BUCKET} AS bucket, CASE WHEN {_SEC} < 3600 THEN (s // 60)::VARCHAR || ' minute' || CASE WHEN s // 60 = 1 THEN '' ELSE 's' END
    WHEN s < 86400 THEN (s // 3600)::VARCHAR || ' hour' || CASE WHEN s // 3600 = 1 THEN '' ELSE 's' END WHEN s // 86400 < 60 THEN (s // 86400)::VARCHAR || ' day' || CASE WHEN s // 86400 = 1 THEN '' ELSE 's' END
    WHEN s // 86400 < 730 THEN (s // 86400 // 30)::VARCHAR || ' month' || CASE WHEN s // 86400 // 30 = 1 THEN '' ELSE 's' END ELSE (s // 86400 // 365)::VARCHAR || ' year' || CASE WHEN s // 86400 // 365 = 1 THEN '' ELSE 's' END END AS phrase
    FROM (SELECT *, {_SEC} AS s FROM v_pairs)""")
def elapsed(spark, sf):
    s = P.elapsed_seconds(F.col("prior_ts"), F.col("current_ts"))
    return V.pairs(spark, sf).select("prior_id", "current_id", s.alias("seconds"), P.gap_bucket(s).alias("bucket"), P.gap_phrase(s).alias("phrase"))


@query("P04_code_changes", f"SELECT prior_id, current_id, new, resolved, persistent, stable FROM {_CODED}")
def changes(spark, sf):
    return coded(spark, sf).select("prior_id", "current_id", "new", "resolved", "persistent", "stable")


@query("P05_null_cohort", f"SELECT prior_id, current_id FROM v_pairs WHERE {_SEC} < 20 * 86400")
def null_cohort(spark, sf):
    return P.null_cohort(V.pairs(spark, sf), 20 * 86400).select("prior_id", "current_id")


@query("P06_cited_prior", """WITH n AS (SELECT current_id AS record_id, patient_id, current_ts AS rec_ts, CASE WHEN current_id % 3 = 0 THEN prior_ts::DATE WHEN current_id % 3 = 1 THEN current_ts::DATE END AS day FROM v_pairs)
    SELECT record_id, prior_id FROM (SELECT n.record_id, r.record_id AS prior_id, row_number() OVER (PARTITION BY n.record_id ORDER BY r.rec_ts DESC, r.record_id DESC) AS rn FROM n JOIN v_records r ON r.patient_id = n.patient_id AND r.rec_ts::DATE = n.day AND r.rec_ts < n.rec_ts) WHERE rn = 1""")
def cited(spark, sf):
    k = F.col("current_id") % 3
    note = F.when(k == 0, F.concat(F.lit("compared with "), F.date_format("prior_ts", "yyyy-MM-dd"))).when(k == 1, "as earlier today").otherwise("no comparison")
    notes = V.pairs(spark, sf).select(F.col("current_id").alias("record_id"), "patient_id", F.col("current_ts").alias("rec_ts"), note.alias("note"))
    return P.cited_prior(notes, V.records(spark, sf)).select("record_id", "prior_id")


@query("P07_cohort_summary", f"""SELECT count(*) AS pairs, count(DISTINCT patient_id) AS patients, count(*) FILTER ({_SEC} < 86400) AS same_day, count(*) FILTER (stable) AS stable, round(avg((NOT stable)::INT), 6) AS change_rate,
    quantile_cont({_SEC} / 86400.0::DOUBLE, 0.5) AS median_days FROM {_CODED}""")
def summary(spark, sf):
    return P.cohort_summary(coded(spark, sf))


@query("P08_paired_differences", f"SELECT prior_id, current_id, measure, round(diff, 6) AS diff FROM {_DIFF}")
def differences(spark, sf):
    return rounded(diffs(spark, sf).select("prior_id", "current_id", "measure", "diff"))


@query("P09_repeatability", f"SELECT measure, n, round(rc, 6) AS rc, round(rc_sd, 6) AS rc_sd FROM {_RC}")
def repeatability(spark, sf):
    return rounded(P.repeatability(diffs(spark, sf)))


@query("P10_noise_floors", f"SELECT * FROM {_FLOOR}")
def floors(spark, sf):
    return P.noise_floors(P.repeatability(seen_diffs(spark, sf)))


@query("P11_gated_changes", f"""SELECT prior_id, current_id, measure, suppressed, significant, CASE WHEN significant THEN CASE WHEN diff > 0 THEN 'longer' ELSE 'shorter' END END AS direction FROM (SELECT d.prior_id, d.current_id, measure, diff,
    CASE WHEN measure = 'pr' AND NOT (a.p_detected AND b.p_detected) THEN 'no P wave' END AS suppressed, abs(diff) > floor AND NOT (measure = 'pr' AND NOT (a.p_detected AND b.p_detected)) AS significant
    FROM {_DIFF} d JOIN {_FLOOR} USING (measure) JOIN v_obs a ON a.record_id = prior_id JOIN v_obs b ON b.record_id = current_id)""")
def gated(spark, sf):
    g = P.gated_changes(seen_diffs(spark, sf), floors(spark, sf))
    return g.select("prior_id", "current_id", "measure", "suppressed", "significant", "direction")


_CHANGES = """(SELECT prior_id, current_id, a.label, CASE WHEN a.p < 0.5 AND b.p >= 0.5 THEN 'new' WHEN a.p >= 0.5 AND b.p < 0.5 THEN 'resolved' END AS change FROM v_pairs JOIN v_pred a ON a.record_id = prior_id
    JOIN v_pred b ON b.record_id = current_id AND b.label = a.label WHERE abs(b.p - a.p) > 0.25 AND ((a.p < 0.5 AND b.p >= 0.5) OR (a.p >= 0.5 AND b.p < 0.5)))"""
_TRUE = f"(SELECT prior_id, current_id, unnest(new) AS label, 'new' AS change FROM {_CODED} UNION ALL SELECT prior_id, current_id, unnest(resolved), 'resolved' FROM {_CODED})"


@query("P13_finding_changes", """SELECT prior_id, current_id, label, CASE WHEN a < 0.5 THEN 'new' ELSE 'resolved' END AS change FROM (SELECT prior_id, current_id, label, max(p) FILTER (side = 0) AS a, max(p) FILTER (side = 1) AS b FROM (
    SELECT prior_id, current_id, unnest([0, 1]) AS side, unnest([prior_id, current_id]) AS record_id FROM v_pairs) JOIN v_pred USING (record_id) GROUP BY ALL) WHERE abs(b - a) > 0.25 AND (a < 0.5) <> (b < 0.5)""")
def finding_changes(spark, sf):
    return P.moved_findings(V.paired_predictions(spark, sf))


@query("P13_finding_states", """SELECT prior_id, current_id, label, CASE WHEN a >= 0.5 AND b >= 0.5 THEN 'persistent' WHEN a < 0.5 THEN 'new' ELSE 'resolved' END AS change FROM (SELECT prior_id, current_id, label, max(p) FILTER (side = 0) AS a, max(p) FILTER (side = 1) AS b FROM (
    SELECT prior_id, current_id, unnest([0, 1]) AS side, unnest([prior_id, current_id]) AS record_id FROM v_pairs) JOIN v_pred USING (record_id) GROUP BY ALL) WHERE a >= 0.5 AND b >= 0.5 OR abs(b - a) > 0.25 AND (a < 0.5) <> (b < 0.5)""")
def finding_states(spark, sf):
    return P.moved_findings(V.paired_predictions(spark, sf), persistent=True)


@query("P15_range_labels", """SELECT record_id, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a::VARCHAR || '-' || b::VARCHAR END, ',' ORDER BY a) AS runs FROM (SELECT record_id, min(n) AS a, max(n) AS b FROM (
    SELECT record_id, n, n - row_number() OVER (PARTITION BY record_id ORDER BY n) AS i FROM (SELECT DISTINCT record_id, code_idx AS n FROM v_codes JOIN v_dict USING (code))) GROUP BY record_id, i) GROUP BY record_id""")
def ranges(spark, sf):
    c = V.codes(spark, sf).join(F.broadcast(V.dictionary(spark, sf).select("code", F.col("code_idx").alias("n"))), "code")
    return P.range_labels(c, "record_id", "n")


@query("P19_change_detection", f"""SELECT tp, fp, fn, round(tp::DOUBLE / nullif(tp + fp, 0), 6) AS precision, round(tp::DOUBLE / nullif(tp + fn, 0), 6) AS recall, round(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM (
    SELECT count(*) FILTER (p AND a) AS tp, count(*) FILTER (a IS NULL) AS fp, count(*) FILTER (p IS NULL) AS fn FROM (SELECT *, true AS p FROM {_CHANGES}) FULL JOIN (SELECT *, true AS a FROM {_TRUE}) USING (prior_id, current_id, label, change))""")
def detection(spark, sf):
    c = coded(spark, sf)
    side = lambda name: c.select("prior_id", "current_id", F.explode(name).alias("label"), F.lit(name).alias("change"))
    return P.change_detection(finding_changes(spark, sf), side("new").unionByName(side("resolved")))


@query("P20_bias_table", f"""SELECT {_BUCKET} AS bucket, measure, count(*) AS n, round(100 * avg((NOT stable)::INT), 4) AS percent_changed, round(stddev_samp(diff), 6) AS sd_all, round(stddev_samp(diff) FILTER (stable), 6) AS sd_stable FROM {_DIFF} GROUP BY ALL""")
def bias(spark, sf):
    return rounded(P.bias_table(coded(spark, sf), diffs(spark, sf)))
