"""Batch twins of the stream operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import views as V
from ..streaming import monitor as M
from ..streaming import state as S
from .registry import query
from .subgroups_queries import rounded


@query("W01_rolling_windows", """SELECT source, code, start, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS most FROM (SELECT user_id AS source, event_type AS code, value, date_trunc('day', ts) - unnest(range(10)) * INTERVAL 1 DAY AS start FROM events) GROUP BY ALL""")
def rolling(spark, sf):
    e = V.table(spark, sf, "events").select(F.col("user_id").alias("source"), F.col("event_type").alias("code"), "ts", "value")
    return rounded(M.rolling_windows(e, "10 days", "1 day"))


@query("W03_confirmations", """WITH f AS (SELECT DISTINCT source, hop, code FROM v_stream WHERE fired), g AS (SELECT b.source, b.code, t.hop, CASE WHEN f.code IS NULL THEN 0 ELSE 1 END AS hit FROM (SELECT source, code, min(hop) AS first FROM f GROUP BY ALL) b
    JOIN (SELECT DISTINCT source, hop FROM v_stream) t ON t.source = b.source AND t.hop >= b.first LEFT JOIN f ON f.source = b.source AND f.code = b.code AND f.hop = t.hop),
    h AS (SELECT *, sum(hit) OVER (PARTITION BY source, code ORDER BY hop ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS hits FROM g),
    s AS (SELECT *, coalesce(last_value(CASE WHEN hits >= 3 THEN 1 WHEN hits = 0 THEN 0 END IGNORE NULLS) OVER (PARTITION BY source, code ORDER BY hop ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS state FROM h)
    SELECT source, code, hop, CASE WHEN state = 1 THEN 'onset' ELSE 'offset' END AS event FROM (SELECT *, coalesce(lag(state) OVER (PARTITION BY source, code ORDER BY hop), 0) AS before FROM s) WHERE state <> before""")
def confirmed(spark, sf):
    return M.confirmations(V.stream_hops(spark, sf), 3, 5)


@query("W07_churn", """WITH c AS (SELECT source, hop, coalesce(list(DISTINCT code ORDER BY code) FILTER (fired), []) AS codes FROM v_stream GROUP BY ALL), d AS (SELECT *, (coalesce(lag(codes) OVER (PARTITION BY source ORDER BY hop), []) <> codes)::INT AS changed FROM c)
    SELECT source, hops, changes, coalesce(codes_ever, 0) AS codes_ever FROM (SELECT source, count(*) AS hops, sum(changed)::BIGINT AS changes FROM d GROUP BY source) LEFT JOIN (SELECT source, count(DISTINCT code) AS codes_ever FROM v_stream WHERE fired GROUP BY source) USING (source)""")
def churn(spark, sf):
    return M.churn(V.stream_hops(spark, sf))


@query("W08_request_metrics", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, id DESC) AS k FROM (SELECT user_id % 10 AS key, ts, event_id AS id, event_type <> 'error' AS ok, value AS latency FROM events))
    SELECT key, count(*) AS n, count(*) FILTER (NOT ok) AS errors, round(count(*) FILTER (NOT ok)::DOUBLE / count(*), 6) AS error_rate, round(quantile_cont(latency, 0.5) FILTER (k <= 2000), 6) AS p50, round(quantile_cont(latency, 0.95) FILTER (k <= 2000), 6) AS p95,
    round(quantile_cont(latency, 0.99) FILTER (k <= 2000), 6) AS p99, round(avg(latency) FILTER (k <= 2000), 6) AS mean, max(latency) FILTER (k <= 2000) AS most FROM r GROUP BY key""")
def metrics(spark, sf):
    e = V.table(spark, sf, "events").select((F.col("user_id") % 10).alias("key"), "ts", F.col("event_id").alias("id"), (F.col("event_type") != "error").alias("ok"), F.col("value").alias("latency"))
    return rounded(M.request_metrics(e))


def _states(by: str, source: str) -> str:
    return f"""(WITH f AS ({source}), g AS (SELECT b.*, t.hop, coalesce(f.fired, false)::INT AS hit, coalesce(f.value, 0.0)::DOUBLE AS value FROM (SELECT {by}, code, min(hop) AS first FROM f WHERE fired GROUP BY ALL) b
        JOIN (SELECT DISTINCT {by}, hop FROM f) t USING ({by}) LEFT JOIN f USING ({by}, code, hop) WHERE t.hop >= b.first),
        h AS (SELECT *, sum(hit) OVER (PARTITION BY {by}, code ORDER BY hop ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS hits FROM g),
        s AS (SELECT *, coalesce(last_value(CASE WHEN hits >= 3 THEN 1 WHEN hits = 0 THEN 0 END IGNORE NULLS) OVER (PARTITION BY {by}, code ORDER BY hop ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS state FROM h)
        SELECT *, coalesce(lag(state) OVER (PARTITION BY {by}, code ORDER BY hop), 0) AS before FROM s)"""


@query("W02_latest_due", "SELECT source, date_trunc('month', hop)::DATE AS chunk, max(hop) AS hop, count(DISTINCT hop) - 1 AS skipped FROM v_stream GROUP BY ALL")
def due(spark, sf):
    return M.latest_due(V.stream_hops(spark, sf).withColumn("chunk", F.trunc("hop", "month")))


@query("W04_events", f"SELECT source, code, hop, CASE WHEN state = 1 THEN 'onset' ELSE 'offset' END AS event, round(value, 6) AS confidence FROM {_states('source', 'SELECT * FROM v_stream')} WHERE state <> before")
def events(spark, sf):
    return rounded(M.confirmation_events(V.stream_hops(spark, sf), 3, 5))


_LISTED = "coalesce(list(code ORDER BY value DESC, code) FILTER ({}), [])"


@query("W05_panel", f"""SELECT source, hop, {_LISTED.format("state = 1")} AS confirmed, {_LISTED.format("state = 0 AND hits > 0")} AS pending, {_LISTED.format("hit = 1")} AS fired,
    {_LISTED.format("state = 1 AND hits < 3")} AS releasing, bool_or(state = 1 AND code = 'error') AS alarm FROM {_states("source", "SELECT * FROM v_stream")} GROUP BY source, hop""")
def panel(spark, sf):
    return M.panel(V.stream_hops(spark, sf), 3, 5, ["error"])


@query("W06_resets", f"""SELECT source, epoch, code, hop, CASE WHEN state = 1 THEN 'onset' ELSE 'offset' END AS event
    FROM {_states("source, epoch", "SELECT *, (dense_rank() OVER (PARTITION BY source ORDER BY date_trunc('month', hop)))::INT AS epoch FROM v_stream")} WHERE state <> before""")
def resets(spark, sf):
    hops = V.stream_hops(spark, sf)
    starts = hops.groupBy("source", F.trunc("hop", "month").alias("month")).agg(F.min("hop").alias("hop"))
    return M.confirmation_events(M.with_epochs(hops, starts), 3, 5, ("source", "epoch")).drop("confidence")


@query("W09_rate_limits", """WITH RECURSIVE e AS MATERIALIZED (SELECT user_id AS key, event_id AS id, floor(epoch(ts))::BIGINT AS t FROM events),
    o AS MATERIALIZED (SELECT a.key, a.t, b.t AS following FROM (SELECT DISTINCT key, t FROM e) a ASOF JOIN (SELECT DISTINCT key, t FROM e) b ON a.key = b.key AND a.t + 86400 <= b.t),
    s AS (SELECT key, min(t) AS start FROM e GROUP BY key UNION ALL SELECT s.key, o.following FROM s JOIN o ON o.key = s.key AND o.t = s.start),
    w AS (SELECT e.key, e.id, e.t, s.start, row_number() OVER (PARTITION BY e.key, s.start ORDER BY e.t, e.id) AS n FROM e ASOF JOIN s ON e.key = s.key AND e.t >= s.start)
    SELECT key, id, t::DOUBLE AS t, n <= 2 AS allowed, greatest(2 - n, 0) AS remaining, CASE WHEN n <= 2 THEN 0 ELSE greatest(start + 86400 - t, 0) END::DOUBLE AS retry_after FROM w""")
def limits(spark, sf):
    e = V.table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").cast("long").alias("t"), F.col("event_id").alias("id"))
    return M.rate_limits(e, 2, 86400.0)


_CHUNKS = """(SELECT user_id AS source, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, CASE WHEN event_id % 17 <> 0 THEN floor(value)::BIGINT % 90 END AS n, CASE WHEN value >= 40 THEN [event_type] ELSE [] END AS codes FROM events)"""


def chunk_rows(spark, sf):
    order = S.W.partitionBy("user_id").orderBy("ts", "event_id")
    e = V.table(spark, sf, "events")
    n = F.when(F.col("event_id") % 17 != 0, F.floor("value").cast("long") % 90)
    codes = F.when(F.col("value") >= 40, F.array("event_type")).otherwise(F.array().cast("array<string>"))
    return e.select(F.col("user_id").alias("source"), F.row_number().over(order).cast("long").alias("seq"), n.alias("n"), codes.alias("codes"))


_DUE = "CASE WHEN {0} >= 100 THEN ({0} - 100) // 40 + 1 ELSE 0 END"
_ANALYSED = f"""(SELECT source, epoch, seq, total, new - 1 AS skipped, codes FROM (SELECT *, {_DUE.format("total")} - {_DUE.format("(total - n)")} AS new FROM (SELECT *, (sum(n) OVER (PARTITION BY source, epoch ORDER BY seq))::BIGINT AS total FROM (
    SELECT *, sum((n IS NULL)::INT) OVER (PARTITION BY source ORDER BY seq) AS epoch FROM {_CHUNKS}) WHERE n IS NOT NULL)) WHERE new > 0)"""


@query("W02_due_analyses", f"SELECT source, seq, total, skipped FROM {_ANALYSED}")
def analyses(spark, sf):
    return S.due_analyses(chunk_rows(spark, sf), 100, 40)


@query("W06_monitor_events", f"""WITH a AS MATERIALIZED {_ANALYSED}, f AS (SELECT source, epoch, seq AS hop, unnest(codes) AS code, true AS fired, NULL::DOUBLE AS value FROM a UNION ALL SELECT source, epoch, seq, NULL, false, NULL FROM a WHERE len(codes) = 0)
    SELECT source, seq, 'analysis' AS event, NULL AS code, total, skipped FROM a UNION ALL SELECT source, seq, 'reset', NULL, 0, 0 FROM {_CHUNKS} WHERE n IS NULL
    UNION ALL SELECT s.source, hop, CASE WHEN state = 1 THEN 'onset' ELSE 'offset' END, code, a.total, 0 FROM {_states("source, epoch", "SELECT * FROM f")} s JOIN a ON a.source = s.source AND a.seq = s.hop WHERE state <> before""")
def monitored(spark, sf):
    """Batch twin of the stream monitor; tests hold the stream against it over a restart and resets."""
    return S.monitor_events(chunk_rows(spark, sf), window=100, hop=40, k=3, m=5)
