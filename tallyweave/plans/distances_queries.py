"""Queries over vector distances and changed signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import distances as D
from ..operators import views as V
from .registry import query
from .subgroups_queries import rounded

_NN = """(SELECT q.vec_id AS id, min(list_distance(q.embedding::DOUBLE[], r.embedding::DOUBLE[])) AS distance FROM embeddings q CROSS JOIN (SELECT * FROM embeddings WHERE vec_id % 50 > 1) r WHERE q.vec_id % 50 = {k} GROUP BY 1)"""
_U = "(('0x' || substr(md5({}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _part(spark, sf, test):
    return V.table(spark, sf, "embeddings").where(test).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


@query("Y04_nearest_distance", f"SELECT id, round(distance, 5) AS distance FROM {_NN.format(k=0)}")
def nearest(spark, sf):
    return D.nearest_distance(_part(spark, sf, "vec_id % 50 = 0"), _part(spark, sf, "vec_id % 50 > 1")).withColumn("distance", F.round("distance", 5))


@query("Y05_memorisation", f"""SELECT round(a, 5) AS synthetic, round(b, 5) AS held_out, round(a / b, 5) AS ratio FROM (SELECT quantile_cont(distance, 0.5) AS a FROM {_NN.format(k=0)}), (SELECT quantile_cont(distance, 0.5) AS b FROM {_NN.format(k=1)})""")
def memorised(spark, sf):
    m = D.memorisation(*[_part(spark, sf, t) for t in ("vec_id % 50 = 0", "vec_id % 50 = 1", "vec_id % 50 > 1")])
    return m.select(*[F.round(c, 5).alias(c) for c in m.columns])


@query("Y06_diversity", """WITH f AS (SELECT * FROM (SELECT vec_id % 3 AS part, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY vec_id % 3 ORDER BY md5(vec_id::VARCHAR), vec_id) AS n FROM embeddings) WHERE n <= 128)
    SELECT part, round(avg(list_distance(a.v, b.v)), 5) AS mean_distance, count(*) AS pairs FROM f a JOIN f b USING (part) WHERE a.n < b.n GROUP BY part""")
def spread(spark, sf):
    return D.diversity(_part(spark, sf, "true").withColumn("part", F.col("id") % 3), "part").withColumn("mean_distance", F.round("mean_distance", 5))


def _near(k: int) -> str:
    if k == 0:
        return "value"
    f, end = ("lag", "first") if k < 0 else ("lead", "last")
    return f"coalesce({f}(value, {abs(k)}) OVER w, {end}(value) OVER (PARTITION BY record_id, lead ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"


_W = "WINDOW w AS (PARTITION BY record_id, lead ORDER BY t)"


@query("G07_low_pass", f"SELECT record_id, lead, t, round({' + '.join(f'{w!r}::DOUBLE * {_near(k - 4)}' for k, w in enumerate(D.taps(0.2, 4)))}, 6) AS value FROM v_samples {_W}")
def smoothed(spark, sf):
    return rounded(D.low_pass(V.samples(spark, sf)))


@query("G05_resample", f"""SELECT record_id, lead, i::INT AS t, round(value * (1 - (i * 64 / 48.0::DOUBLE - t)) + nxt * (i * 64 / 48.0::DOUBLE - t), 6) AS value FROM (SELECT unnest(range(48)) AS i) JOIN (SELECT record_id, lead, t, value, {_near(1)} AS nxt FROM
    (SELECT record_id, lead, t, ({_near(-1)} + value + {_near(1)}) / 3 AS value FROM v_samples {_W}) {_W}) ON t = (i * 64) // 48""")
def resampled(spark, sf):
    return rounded(D.resample(V.samples(spark, sf), 64, 48))


@query("G21_augment", f"""SELECT record_id, lead, ((t + floor({_U.format("'0:shift:' || record_id::VARCHAR")} * 16)::INT) % 64)::INT AS t,
    round(value * (0.8::DOUBLE + 0.4::DOUBLE * {_U.format("'0:gain:' || record_id::VARCHAR")}) * CASE WHEN {_U.format("'0:drop:' || record_id::VARCHAR || ':' || lead")} < 0.1 THEN 0.0 ELSE 1.0 END, 6) AS value FROM v_samples""")
def augmented(spark, sf):
    return rounded(D.augment(V.samples(spark, sf), 64))


@query("G21_recordings")
def recordings(spark, sf):
    """Two copies of every record; held against numpy in tests."""
    return rounded(D.augment_recordings(V.samples(spark, sf), 64, 32, copies=2))
