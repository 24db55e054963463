"""Queries over the beats of signals.

The stand-in signals are read at 32 samples a second (G14: median beats at 20).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import beats as B
from ..operators import distances as D
from ..operators import signals as G
from ..operators import views as V
from .distances_queries import _near
from .registry import oracle_text, query
from .signals_queries import beats as plain_candidates
from .subgroups_queries import rounded

_FS, _APART = 32, 6
_W = "WINDOW w AS (PARTITION BY record_id, lead ORDER BY t)"
_BAND = B.band_taps(5 / _FS, 15 / _FS, 8)


def _fir(source: str, weights: list[float]) -> str:
    half = len(weights) // 2
    return f"SELECT record_id, lead, t, {' + '.join(f'{w!r}::DOUBLE * {_near(k - half)}' for k, w in enumerate(weights))} AS value FROM {source} {_W}"


def _peaks(source: str, fs: int = _FS) -> str:
    """CTEs e (energy), p (spaced peaks) and b (beats) over signals of a common table ``source``."""
    wide, near, least = round(0.15 * fs), round(0.1 * fs), round(0.2 * fs)
    dd = lambda k: "d * d" if k == 0 else f"coalesce({'lag' if k < 0 else 'lead'}(d * d, {abs(k)}) OVER w, 0)"
    mean = " + ".join(dd(k) for k in range(-(wide // 2), (wide - 1) // 2 + 1))
    return f"""
e0 AS MATERIALIZED (SELECT record_id, lead, t, round(value, 9) AS filtered FROM ({_fir(source, B.band_taps(5 / fs, min(15, fs / 2 * 0.99) / fs, 8))})),
e1 AS (SELECT *, coalesce(filtered - lag(filtered) OVER w, 0) AS d, count(*) OVER (PARTITION BY record_id, lead) AS n,
  arg_max(t, (abs(filtered), -t)) OVER (PARTITION BY record_id, lead ORDER BY t ROWS BETWEEN {near} PRECEDING AND {near - 1} FOLLOWING) AS snap FROM e0 {_W}),
e2 AS (SELECT record_id, lead, t, snap, filtered, round(({mean}) / {wide}.0::DOUBLE, 9) AS energy FROM e1 WHERE n >= {fs // 2} {_W}),
e AS MATERIALIZED (SELECT *, round(0.25::DOUBLE * max(energy) FILTER (t < {2 * fs}) OVER v, 9) AS signal0, round(0.5::DOUBLE * avg(energy) FILTER (t < {2 * fs}) OVER v, 9) AS noise0 FROM e2 WINDOW v AS (PARTITION BY record_id, lead)),
l AS (SELECT *, coalesce(sum((energy <> before)::INT) OVER w, 0) AS level FROM (SELECT *, lag(energy) OVER w AS before FROM e {_W}) {_W}),
t AS (SELECT record_id, lead, (first + last) // 2 AS t FROM (SELECT record_id, lead, first, last, energy, lag(energy) OVER v AS up, lead(energy) OVER v AS down FROM
  (SELECT record_id, lead, level, min(t) AS first, max(t) AS last, min(energy) AS energy FROM l GROUP BY ALL) WINDOW v AS (PARTITION BY record_id, lead ORDER BY level)) WHERE up < energy AND down < energy),
n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY record_id, lead, run ORDER BY energy DESC, t DESC) AS k FROM (
  SELECT record_id, lead, t, energy, snap, signal0, noise0, sum((coalesce(t - back, {least}) >= {least})::INT) OVER w AS run FROM (SELECT e.*, lag(e.t) OVER (PARTITION BY e.record_id, e.lead ORDER BY e.t) AS back FROM e JOIN t USING (record_id, lead, t)) {_W})),
g AS (SELECT record_id, lead, run, k, [t] AS kept, true AS stays, t FROM n WHERE k = 1 UNION ALL
  SELECT n.record_id, n.lead, n.run, n.k, CASE WHEN o.ok THEN list_append(g.kept, n.t) ELSE g.kept END, o.ok, n.t FROM g JOIN n ON n.record_id = g.record_id AND n.lead = g.lead AND n.run = g.run AND n.k = g.k + 1,
  LATERAL (SELECT len(list_filter(g.kept, lambda x: abs(x - n.t) < {least})) = 0 AS ok) o),
p AS MATERIALIZED (SELECT *, row_number() OVER w AS k FROM (SELECT n.record_id, n.lead, n.t, energy, snap, signal0, noise0 FROM n JOIN g USING (record_id, lead, run, k) WHERE stays) {_W}),
f AS (SELECT DISTINCT record_id, lead, 0::BIGINT AS k, signal0 AS s, noise0 AS n, NULL::INT AS last, NULL::INT AS beat FROM p UNION ALL
  SELECT p.record_id, p.lead, p.k, CASE WHEN hit THEN 0.125::DOUBLE * p.energy + 0.875::DOUBLE * f.s ELSE f.s END, CASE WHEN hit THEN f.n ELSE 0.125::DOUBLE * p.energy + 0.875::DOUBLE * f.n END,
    CASE WHEN hit AND far THEN p.snap ELSE f.last END, CASE WHEN hit AND far THEN p.snap END
  FROM f JOIN p ON p.record_id = f.record_id AND p.lead = f.lead AND p.k = f.k + 1, LATERAL (SELECT p.energy > f.n + 0.25::DOUBLE * (f.s - f.n) AS hit, coalesce(p.snap - f.last >= {least}, true) AS far) o),
b AS (SELECT record_id, lead, beat AS t FROM f WHERE beat IS NOT NULL)"""


@query("G07_band_pass", f"SELECT record_id, lead, t, round(value, 6) AS value FROM ({_fir('v_samples', _BAND)})")
def band_passed(spark, sf):
    return rounded(D.fir(V.samples(spark, sf), _BAND))


@query("G07_notch", f"SELECT record_id, lead, t, round(value, 6) AS value FROM ({_fir('v_samples', B.notch_taps(0.3, 0.02, 8))})")
def notched(spark, sf):
    return rounded(D.fir(V.samples(spark, sf), B.notch_taps(0.3, 0.02, 8)))


def _energy(spark, sf):
    return B.beat_energy(V.samples(spark, sf), _FS)


@query("G08_spaced_peaks", f"WITH RECURSIVE {_peaks('v_samples')} SELECT record_id, lead, t, round(energy, 6) AS energy, snap FROM p")
def spaced(spark, sf):
    return rounded(B.spaced_peaks(_energy(spark, sf), _FS).drop("signal0", "noise0"))


@query("G09_selected_beats", f"WITH RECURSIVE {_peaks('v_samples')} SELECT * FROM b")
def selected(spark, sf):
    return B.detect_beats(V.samples(spark, sf), _FS)


_RESAMPLED = oracle_text("G05_resample").replace("round(value * (1 - (i * 64 / 48.0::DOUBLE - t)) + nxt * (i * 64 / 48.0::DOUBLE - t), 6)", "value * (1 - (i * 64 / 48.0::DOUBLE - t)) + nxt * (i * 64 / 48.0::DOUBLE - t)")
_CHAIN_FS = 24


@query("G22_preprocess", f"""WITH RECURSIVE r AS MATERIALIZED ({_RESAMPLED}), c AS MATERIALIZED ({_fir("r", B.band_taps(0.5 / _CHAIN_FS, _CHAIN_FS / 2 * 0.99 / _CHAIN_FS, 8))}),
    two AS (SELECT * FROM c WHERE lead = 'II'), {_peaks("two", _CHAIN_FS)}
    SELECT c.record_id, c.lead, c.t, round((value - avg(value) OVER v) / (stddev_pop(value) OVER v + 1e-8), 6) AS value, b.t IS NOT NULL AS beat
    FROM c LEFT JOIN b ON b.record_id = c.record_id AND b.t = c.t WINDOW v AS (PARTITION BY c.record_id, c.lead)""")
def preprocessed(spark, sf):
    return rounded(B.preprocess(V.samples(spark, sf), 64, 48, _CHAIN_FS))


_MEDIAN = oracle_text("G12_median_beat").replace("round(quantile_cont(value, 0.5), 6)", "quantile_cont(value, 0.5)")
_AT = lambda k: f"b[greatest(0, least(len(b) - 1, i // 5 + {k})) + 1]"
_S = "((i % 5) / 5.0::DOUBLE)"
_UP = f"{_AT(0)} + 0.5::DOUBLE * {_S} * ({_AT(1)} - {_AT(-1)} + {_S} * (2 * {_AT(-1)} - 5 * {_AT(0)} + 4 * {_AT(1)} - {_AT(2)} + {_S} * (3 * ({_AT(0)} - {_AT(1)}) + {_AT(2)} - {_AT(-1)})))"


@query("G14_qrs_bounds", f"""WITH m AS ({_MEDIAN}), a AS (SELECT record_id, lead, min("offset") AS first, list(value ORDER BY "offset") AS b FROM m WHERE value IS NOT NULL GROUP BY ALL),
    u AS (SELECT record_id, lead, first, i, {_UP} AS up FROM (SELECT *, unnest(range((len(b) - 1) * 5 + 1)) AS i FROM a)),
    d AS (SELECT *, coalesce(up - lag(up) OVER (PARTITION BY record_id, lead ORDER BY i), 0) AS d FROM u),
    c AS MATERIALIZED (SELECT record_id, i, -min(first) * 5 AS centre, round(sqrt(sum(up * up ORDER BY lead)), 9) AS mag, round(sqrt(sum(d * d ORDER BY lead)), 9) AS vel FROM d GROUP BY record_id, i),
    r AS (SELECT record_id, arg_min(i, (-mag, i)) AS r FROM c WHERE i BETWEEN centre - 4 AND centre + 3 GROUP BY record_id),
    s AS MATERIALIZED (SELECT record_id, r, max(i) AS n FROM c JOIN r USING (record_id) GROUP BY record_id, r),
    k AS (SELECT s.*, (SELECT max(vel) FROM c WHERE c.record_id = s.record_id AND c.i BETWEEN s.r - 8 AND s.r + 7) AS top FROM s),
    o AS (SELECT k.*, (SELECT max(i) FROM c WHERE c.record_id = k.record_id AND i BETWEEN r - 12 AND r - 1 AND vel < 0.08::DOUBLE * top) AS lo,
      (SELECT min(i) FROM c WHERE c.record_id = k.record_id AND i BETWEEN r + 1 AND r + 20 AND vel < 0.04::DOUBLE * top) AS hi FROM k WHERE top > 0)
    SELECT o.record_id, r::DOUBLE AS r_peak,
      round(CASE WHEN r IN (0, n) THEN r WHEN lo IS NULL THEN greatest(0, r - 12) ELSE lo + 1 - CASE WHEN a.vel > b.vel THEN (a.vel - 0.08::DOUBLE * top) / (a.vel - b.vel) ELSE 0 END END, 6) AS qrs_onset,
      round(CASE WHEN r IN (0, n) THEN r WHEN hi IS NULL THEN least(n, r + 20) ELSE hi - 1 + CASE WHEN y.vel > z.vel THEN (y.vel - 0.04::DOUBLE * top) / (y.vel - z.vel) ELSE 0 END END, 6) AS qrs_offset
    FROM o LEFT JOIN c a ON a.record_id = o.record_id AND a.i = lo + 1 LEFT JOIN c b ON b.record_id = o.record_id AND b.i = lo LEFT JOIN c y ON y.record_id = o.record_id AND y.i = hi - 1 LEFT JOIN c z ON z.record_id = o.record_id AND z.i = hi""")
def bounds(spark, sf):
    beat = G.median_beat(G.segments(V.samples(spark, sf), plain_candidates(spark, sf), 4, 6))
    found = B.qrs_bounds(beat, 20)
    return rounded(found.select("record_id", F.col("r").cast("double").alias("r_peak"), "qrs_onset", "qrs_offset"))


@query("G14_wave_bounds")
def waves(spark, sf):
    """P and T as well, on beats that are selected and measured as G09 and G10 do; held to a signal of known intervals in tests."""
    samples, beats = V.samples(spark, sf), B.detect_beats(V.samples(spark, sf), _FS)
    qrs = B.qrs_bounds(G.median_beat(G.segments(samples, beats, 11, 18)), _FS)
    rr = F.col("t") - F.lag("t").over(B.W.partitionBy("record_id").orderBy("t"))
    rates = beats.where("lead = 'II'").withColumn("rr", rr * 1000.0 / _FS).groupBy("record_id").agg(F.percentile("rr", F.lit(0.5)).alias("rr_ms"))
    return rounded(B.wave_bounds(qrs, rates, _FS))
