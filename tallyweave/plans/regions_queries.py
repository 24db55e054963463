"""Queries over wave regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import regions as R
from ..operators import signals as G
from ..operators import views as V
from .registry import oracle_text, query
from .signals_queries import _BEATS, _SEG, beats
from .subgroups_queries import rounded

_WINDOWS = {"p": (-4, -1), "qrs": (-1, 2), "st": (2, 4), "t_wave": (4, 7)}


def _segments(spark, sf):
    return G.segments(V.samples(spark, sf), beats(spark, sf), 4, 6)


@query("G13_split_half", f"""WITH s AS (SELECT *, CASE WHEN dense_rank() OVER (PARTITION BY record_id, lead ORDER BY beat) % 2 = 1 THEN 'odd' ELSE 'even' END AS half FROM {_SEG}), f AS (SELECT record_id, lead, half, "offset", quantile_cont(value, 0.5) AS m FROM s GROUP BY ALL),
    c AS (SELECT record_id, lead, half, beat, coalesce(round(corr(value, m), 9) >= 0.8, false) AS good FROM s JOIN f USING (record_id, lead, half, "offset") GROUP BY ALL),
    u AS (SELECT *, count(*) OVER (PARTITION BY record_id, lead, half) AS n, count(*) FILTER (good) OVER (PARTITION BY record_id, lead, half) AS ng FROM c)
    SELECT record_id, lead, half, "offset", CASE WHEN max(n) >= 3 THEN round(quantile_cont(value, 0.5), 6) END AS value FROM s JOIN u USING (record_id, lead, half, beat) WHERE ng < 3 OR good GROUP BY record_id, lead, half, "offset" """)
def halves(spark, sf):
    return rounded(R.split_half(_segments(spark, sf)))


@query("G16_beat_readings", f"""WITH m AS ({oracle_text("G12_median_beat").replace("round(quantile_cont(value, 0.5), 6)", "quantile_cont(value, 0.5)")}),
    b AS (SELECT record_id, lead, avg(value) FILTER ("offset" BETWEEN -4 AND -2) AS base, max(value) FILTER ("offset" = 3) AS lvl FROM m GROUP BY ALL)
    SELECT record_id, lead, round(any_value(lvl - base), 6) AS level, round(arg_max(value - base, (round(abs(value - base), 9), -"offset")) FILTER ("offset" BETWEEN 4 AND 6 AND value IS NOT NULL), 6) AS peak FROM m JOIN b USING (record_id, lead) GROUP BY record_id, lead""")
def readings(spark, sf):
    return rounded(R.beat_readings(G.median_beat(_segments(spark, sf)), (-4, -2), 3, (4, 6)))


_CLAIM = "CASE " + " ".join(f"WHEN o BETWEEN {_WINDOWS[r][0]} AND {_WINDOWS[r][1] - 1} THEN {k}" for k, r in enumerate(R.PRIORITY)) + " END"
_SHARE = ", ".join(f"CASE WHEN total > 0 AND n_beats > 0 THEN m{k} / total ELSE 0 END AS {r}" for k, r in enumerate(R.PRIORITY))
_MASS = f"""(SELECT record_id, lead, {_SHARE}, CASE WHEN total > 0 AND n_beats > 0 THEN (total - (m0 + m1 + m2 + m3)) / total WHEN total > 0 THEN 0 ELSE 1 END AS baseline, n_beats
    FROM (SELECT record_id, lead, sum(abs(value)) AS total, {", ".join(f"coalesce(sum(abs(value)) FILTER (p = {k}), 0) AS m{k}" for k in range(4))}, coalesce(any_value(n_beats), 0) AS n_beats FROM v_samples
    LEFT JOIN (SELECT record_id, lead, t + o AS t, min({_CLAIM}) AS p FROM {_BEATS} CROSS JOIN (SELECT unnest(range(-4, 7)) AS o) GROUP BY ALL) USING (record_id, lead, t)
    LEFT JOIN (SELECT record_id, lead, count(*) AS n_beats FROM {_BEATS} GROUP BY ALL) USING (record_id, lead) GROUP BY record_id, lead))"""
_R6 = ", ".join(f"round({r}, 6) AS {r}" for r in R.REGIONS)
_FAMILY = "CASE record_id % 3 WHEN 0 THEN 'repolarization' WHEN 1 THEN 'rhythm_irregular' ELSE 'unknown' END"
_VERDICT = f"""(SELECT record_id, lead, {_FAMILY} AS family, CASE WHEN n_beats < 3 THEN 'inconclusive' WHEN record_id % 3 = 0 THEN CASE WHEN repol >= 1.2::DOUBLE * greatest(p, 0.000001::DOUBLE) AND repol >= greatest(qrs, p) THEN 'consistent' WHEN p > repol THEN 'inconsistent' ELSE 'inconclusive' END
    WHEN record_id % 3 = 1 THEN CASE WHEN p > 0 AND p >= 1.2::DOUBLE * greatest(qrs, st, t_wave, baseline) THEN 'inconsistent' ELSE 'consistent' END ELSE 'inconclusive' END AS verdict, p, qrs, st, t_wave, baseline
    FROM (SELECT record_id, lead, n_beats, round(st + t_wave, 6) AS repol, {_R6} FROM {_MASS}))"""


def _mass(spark, sf):
    return R.region_mass(V.samples(spark, sf), beats(spark, sf), _WINDOWS)


def _verdicts(spark, sf):
    k = F.col("record_id") % 3
    family = F.when(k == 0, "repolarization").when(k == 1, "rhythm_irregular").otherwise("unknown")
    return _mass(spark, sf).withColumn("family", family).withColumn("verdict", R.region_verdict(F.col("family")))


@query("G17_region_mass", f"SELECT record_id, lead, {_R6}, n_beats FROM {_MASS}")
def mass(spark, sf):
    return rounded(_mass(spark, sf))


@query("G18_region_verdict", f"SELECT record_id, lead, family, verdict FROM {_VERDICT}")
def verdict(spark, sf):
    return _verdicts(spark, sf).select("record_id", "lead", "family", "verdict")


@query("G19_verdict_summary", f"""SELECT family, count(*) AS n_total, count(*) FILTER (verdict <> 'inconclusive') AS n_checked, count(*) FILTER (verdict = 'consistent') AS n_consistent,
    round(count(*) FILTER (verdict = 'consistent') / nullif(count(*) FILTER (verdict <> 'inconclusive'), 0)::DOUBLE, 6) AS rate, {", ".join(f"round(avg({r}), 4) AS mean_{r}" for r in R.REGIONS)} FROM {_VERDICT} GROUP BY family""")
def summary(spark, sf):
    s = R.verdict_summary(_verdicts(spark, sf))
    return s.select("family", "n_total", "n_checked", "n_consistent", F.round("rate", 6).alias("rate"), *[F.round(f"mean_{r}", 4).alias(f"mean_{r}") for r in R.REGIONS])
