"""Queries over signal tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import signals as G
from ..operators import views as V
from .registry import query
from .subgroups_queries import rounded


@query("G01_zscore", "SELECT record_id, lead, t, round((value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-8), 6) AS value FROM v_samples WINDOW w AS (PARTITION BY record_id, lead)")
def zscore(spark, sf):
    return rounded(G.zscore(V.samples(spark, sf)))


@query("G02_robust_scale", """SELECT record_id, lead, t, round((value - q[2]) / (q[3] - q[1] + 1e-8), 6) AS value FROM v_samples JOIN (SELECT record_id, lead, quantile_cont(value, [0.25, 0.5, 0.75]) AS q FROM v_samples GROUP BY ALL) USING (record_id, lead)""")
def robust(spark, sf):
    return rounded(G.robust_scale(V.samples(spark, sf)))


@query("G03_fixed_length", """SELECT vec_id AS record_id, embedding[13:52] AS crop, list_concat(embedding, list_transform(range(6), lambda x: 0.0::FLOAT)) AS pad FROM embeddings""")
def fixed(spark, sf):
    e = V.table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("record_id"), G.fixed_length(F.col("embedding"), 40).alias("crop"), G.fixed_length(F.col("embedding"), 70).alias("pad"))


@query("G04_sliding_windows", """SELECT vec_id AS record_id, s::INT AS start, embedding[s + 1 : s + 24] AS "window" FROM embeddings CROSS JOIN (SELECT unnest(range(0, 41, 10)) AS s)""")
def sliding(spark, sf):
    e = V.table(spark, sf, "embeddings").select(F.col("vec_id").alias("record_id"), "embedding")
    return G.sliding_windows(e, "embedding", 24, 10)


@query("G06_remove_baseline", """SELECT record_id, lead, t, round(value - quantile_cont(m1, 0.5) OVER (PARTITION BY record_id, lead ORDER BY t ROWS BETWEEN 9 PRECEDING AND 9 FOLLOWING), 6) AS value FROM (
    SELECT *, quantile_cont(value, 0.5) OVER (PARTITION BY record_id, lead ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS m1 FROM v_samples)""")
def baseline(spark, sf):
    return rounded(G.remove_baseline(V.samples(spark, sf), 3, 9))


_BEATS = """(SELECT record_id, lead, t, energy FROM (SELECT *, lag(energy) OVER w AS up, lead(energy) OVER w AS down FROM (SELECT record_id, lead, t, round(avg(d) OVER (PARTITION BY record_id, lead ORDER BY t ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 9) AS energy FROM (
    SELECT record_id, lead, t, coalesce(power(value - lag(value) OVER (PARTITION BY record_id, lead ORDER BY t), 2), 0.0) AS d FROM v_samples)) WINDOW w AS (PARTITION BY record_id, lead ORDER BY t)) WHERE energy > up AND energy >= down)"""


def beats(spark, sf):
    return G.beat_candidates(V.samples(spark, sf), 4)


@query("G08_beat_candidates", f"SELECT record_id, lead, t, round(energy, 6) AS energy FROM {_BEATS}")
def candidates(spark, sf):
    return rounded(beats(spark, sf))


@query("G10_beat_rates", """SELECT record_id, count(*) AS beats, CASE WHEN count(*) >= 2 THEN round(60000.0::DOUBLE / avg(rr), 6) END AS rate, CASE WHEN count(*) >= 3 THEN round(stddev_pop(rr) / avg(rr), 6) END AS rr_cv
    FROM (SELECT user_id AS record_id, (floor(epoch(ts))::BIGINT - lag(floor(epoch(ts))::BIGINT) OVER (PARTITION BY user_id ORDER BY ts))::DOUBLE AS rr FROM events) GROUP BY record_id""")
def rates(spark, sf):
    e = V.table(spark, sf, "events").select(F.col("user_id").alias("record_id"), F.col("ts").cast("timestamp").cast("long").alias("t"))
    return rounded(G.beat_rates(e))


_SEG = f"""(SELECT * FROM (SELECT b.record_id, b.lead, b.t AS beat, s.t - b.t AS "offset", s.value, count(*) OVER (PARTITION BY b.record_id, b.lead, b.t) AS c FROM {_BEATS} b JOIN v_samples s ON s.record_id = b.record_id AND s.lead = b.lead AND s.t BETWEEN b.t - 4 AND b.t + 6) WHERE c = 11)"""


@query("G11_segments", f"""SELECT record_id, lead, beat, "offset", round(value, 6) AS value FROM {_SEG}""")
def segs(spark, sf):
    return rounded(G.segments(V.samples(spark, sf), beats(spark, sf), 4, 6))


@query("G12_median_beat", f"""WITH s AS {_SEG}, f AS (SELECT record_id, lead, "offset", quantile_cont(value, 0.5) AS m FROM s GROUP BY ALL),
    c AS (SELECT record_id, lead, beat, coalesce(round(corr(value, m), 9) >= 0.8, false) AS good FROM s JOIN f USING (record_id, lead, "offset") GROUP BY record_id, lead, beat),
    u AS (SELECT *, count(*) OVER (PARTITION BY record_id, lead) AS n, count(*) FILTER (good) OVER (PARTITION BY record_id, lead) AS ng FROM c)
    SELECT record_id, lead, "offset", CASE WHEN max(n) >= 3 THEN round(quantile_cont(value, 0.5), 6) END AS value FROM s JOIN u USING (record_id, lead, beat) WHERE ng < 3 OR good GROUP BY record_id, lead, "offset" """)
def median(spark, sf):
    return rounded(G.median_beat(G.segments(V.samples(spark, sf), beats(spark, sf), 4, 6)))


@query("G15_intervals", """WITH o AS (SELECT *, qt / sqrt(rr / 1000.0::DOUBLE) AS b, qt / cbrt(rr / 1000.0::DOUBLE) AS f FROM v_obs) SELECT record_id, CASE WHEN pr BETWEEN 80 AND 400 THEN round(pr, 6) END AS pr, CASE WHEN qt BETWEEN 200 AND 700 THEN qt END AS qt,
    CASE WHEN b BETWEEN 280 AND 700 THEN round(b, 4) END AS qtc_b, CASE WHEN f BETWEEN 280 AND 700 THEN round(f, 4) END AS qtc_f, (coalesce(pr NOT BETWEEN 80 AND 400, false)::INT + (qt NOT BETWEEN 200 AND 700)::INT + (b NOT BETWEEN 280 AND 700)::INT + (f NOT BETWEEN 280 AND 700)::INT)::BIGINT AS n_notes FROM o""")
def intervals(spark, sf):
    i = G.intervals(V.observations(spark, sf))
    return i.select("record_id", F.round("pr", 6).alias("pr"), "qt", F.round("qtc_b", 4).alias("qtc_b"), F.round("qtc_f", 4).alias("qtc_f"), F.size("notes").cast("long").alias("n_notes"))


@query("G20_fidelity", """WITH s AS (SELECT * FROM v_samples WHERE lead = 'I'), o AS (SELECT record_id, lead, t - 2 AS t, value + (t % 3) / 100.0::DOUBLE AS value FROM s),
    c AS (SELECT record_id, lead, lag, round(corr(s.value, o.value), 6) AS corr FROM (SELECT unnest(range(-4, 5)) AS lag) CROSS JOIN o JOIN s USING (record_id, lead) WHERE s.t = o.t + lag GROUP BY ALL)
    SELECT record_id, lead, max(corr) AS corr, arg_max(lag, [corr, -abs(lag), lag])::INT AS lag FROM c GROUP BY ALL""")
def fidelity(spark, sf):
    s = V.samples(spark, sf).where("lead = 'I'")
    return G.fidelity(s, s.select("record_id", "lead", (F.col("t") - 2).alias("t"), (F.col("value") + (F.col("t") % 3) / 100.0).alias("value")))


@query("G20_pair_fidelity", """WITH o AS (SELECT record_id, lead, (t + 62) % 64 AS t, value + (t % 3) / 100.0::DOUBLE AS value FROM v_samples),
    c AS (SELECT record_id, lead, lag, round(coalesce(CASE WHEN isnan(r) THEN 0 ELSE r END, 0), 9) AS corr, e AS error FROM (SELECT s.record_id, s.lead, lag, corr(s.value, o.value) FILTER (s.t BETWEEN 6 AND 57) AS r,
      sqrt(avg((s.value - o.value) * (s.value - o.value))) / coalesce(nullif(stddev_pop(s.value), 0), 1) AS e FROM (SELECT unnest(range(-4, 5)) AS lag) CROSS JOIN o JOIN v_samples s ON s.record_id = o.record_id AND s.lead = o.lead AND s.t = (o.t + lag + 64) % 64 GROUP BY ALL))
    SELECT record_id, round(avg(corr), 6) AS corr, round(avg(error), 6) AS error FROM (SELECT record_id, lead, max(corr) AS corr, arg_max(error, [corr, -lag]) AS error FROM c GROUP BY ALL) GROUP BY record_id""")
def pair_fidelity(spark, sf):
    s = V.samples(spark, sf)
    return rounded(G.pair_fidelity(s, s.select("record_id", "lead", ((F.col("t") + 62) % 64).alias("t"), (F.col("value") + (F.col("t") % 3) / 100.0).alias("value")), 64))
