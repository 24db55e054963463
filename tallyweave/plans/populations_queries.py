"""Queries over partitions and sample sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import populations as D
from ..operators import views as V
from .registry import query
from .subgroups_queries import rounded

_TRAIN = "(SELECT * FROM v_records WHERE fold <= 8)"
_D01 = f"(SELECT record_id, CASE WHEN count(*) OVER (PARTITION BY client) < 100 THEN 'other' ELSE client END AS client FROM (SELECT record_id, coalesce(device, 'unknown') AS client FROM {_TRAIN}))"
_SIZES = f"(SELECT client, count(*) AS n FROM {_D01} GROUP BY client)"
_Y = f"(SELECT client, p.* FROM v_pred p JOIN {_D01} USING (record_id))"
_PAR = "(SELECT label::VARCHAR AS client, (vec_id % 4)::INT AS key, idx, avg(value) AS value, count(*) AS n FROM (SELECT vec_id, label, unnest(embedding)::DOUBLE AS value, unnest(range(64)) AS idx FROM embeddings) GROUP BY ALL)"
_U = "(('0x' || substr(md5({}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
TARGETS = ["NATION_3", "NATION_7", "NATION_17"]
_T = "('NATION_3', 'NATION_7', 'NATION_17')"


def train(spark, sf):
    return V.records(spark, sf).where("fold <= 8")


def clients(spark, sf):
    return D.natural_partition(train(spark, sf), "device").select("record_id", "client")


def sizes(spark, sf):
    return clients(spark, sf).groupBy("client").agg(F.count("*").alias("n"))


def scored(spark, sf):
    return V.predictions(spark, sf).join(clients(spark, sf), "record_id")


def params(spark, sf):
    e = V.table(spark, sf, "embeddings").select(F.col("label").cast("string").alias("client"), (F.col("vec_id") % 4).cast("int").alias("key"), F.posexplode("embedding").alias("idx", "value"))
    return e.groupBy("client", "key", "idx").agg(F.avg(F.col("value").cast("double")).alias("value"), F.count("*").alias("n"))


@query("D01_natural_partition", f"SELECT * FROM {_D01}")
def natural(spark, sf):
    return clients(spark, sf)


@query("D02_matched_partition", f"""WITH s AS (SELECT client, sum(n) OVER (ORDER BY n DESC, client) AS hi, n FROM {_SIZES}), r AS (SELECT record_id, row_number() OVER (ORDER BY {_U.format("'iid:' || record_id::VARCHAR")}, record_id) - 1 AS place FROM {_TRAIN})
    SELECT record_id, client FROM r JOIN s ON place >= hi - n AND place < hi""")
def matched(spark, sf):
    return D.matched_partition(train(spark, sf), sizes(spark, sf))


@query("D03_label_skew", f"""WITH o AS (SELECT client, label, n::DOUBLE / sum(n) OVER (PARTITION BY client) AS share FROM (SELECT client, label, count(*) AS n FROM {_Y} WHERE y = 1 GROUP BY client, label)), a AS (SELECT label, n::DOUBLE / sum(n) OVER () AS all_share FROM (SELECT label, count(*) AS n FROM {_Y} WHERE y = 1 GROUP BY label))
    SELECT client, round(0.5::DOUBLE * sum(abs(coalesce(share, 0) - coalesce(all_share, 0))), 6) AS skew FROM (SELECT DISTINCT client FROM {_Y}) CROSS JOIN (SELECT code AS label FROM v_dict) LEFT JOIN o USING (client, label) LEFT JOIN a USING (label) GROUP BY client""")
def skew(spark, sf):
    return rounded(D.label_skew(scored(spark, sf)))


@query("D04_size_inequality", f"""SELECT round(2.0::DOUBLE * sum(k * n) / (count(*) * sum(n)) - (count(*) + 1)::DOUBLE / count(*), 6) AS gini, round(max(n)::DOUBLE / sum(n), 6) AS largest_share, round(max(n)::DOUBLE / min(n), 6) AS max_to_min
    FROM (SELECT *, row_number() OVER (ORDER BY n, client) AS k FROM {_SIZES})""")
def inequality(spark, sf):
    return rounded(D.size_inequality(sizes(spark, sf)))


@query("D05_partition_summary", f"""SELECT client, n, labels_1, labels_10, round(positives::DOUBLE / n, 6) AS labels_per_record FROM (SELECT client, count(*) FILTER (pos >= 1) AS labels_1, count(*) FILTER (pos >= 10) AS labels_10, sum(pos) AS positives
    FROM (SELECT client, label, sum(y) AS pos FROM {_Y} GROUP BY ALL) GROUP BY client) JOIN {_SIZES} USING (client)""")
def summary(spark, sf):
    return rounded(D.partition_summary(scored(spark, sf)))


@query("D06_misaligned", """SELECT record_id, code, 'first' AS only_in FROM (SELECT record_id, code FROM v_codes WHERE code <> 'NATION_7') WHERE code = 'NATION_17' UNION ALL SELECT record_id, code, 'second' FROM v_codes WHERE code = 'NATION_7'""")
def misaligned(spark, sf):
    c = V.codes(spark, sf)
    return D.misaligned(c.where("code <> 'NATION_7'"), c.where("code <> 'NATION_17'"))


@query("D07_weighted_average", f"SELECT key, idx::INT AS idx, round(sum(n * value) / sum(n), 6) AS value FROM {_PAR} GROUP BY ALL")
def average(spark, sf):
    return rounded(D.weighted_average(params(spark, sf)))


@query("D08_client_drift", f"""WITH p AS {_PAR}, a AS (SELECT key, idx, sum(n * value) / sum(n) AS avg FROM p GROUP BY ALL) SELECT round(avg(d / a), 6) AS drift FROM (SELECT client, sqrt(sum((value - avg) * (value - avg))) AS d, sqrt(sum(avg * avg)) AS a FROM p JOIN a USING (key, idx) GROUP BY client)""")
def drift(spark, sf):
    return rounded(D.client_drift(params(spark, sf)))


@query("D09_sample_clients", f"""SELECT client FROM (SELECT client, row_number() OVER (ORDER BY {_U.format("'7:' || client")}, client) AS k, count(*) OVER () AS c FROM {_SIZES}) WHERE k <= greatest(1, round_even(0.4 * c, 0))""")
def sampled(spark, sf):
    return D.sample_clients(sizes(spark, sf), 0.4, 7)


@query("Y01_make_rare", f"""SELECT record_id, label, CASE WHEN y = 1 AND label IN {_T} AND k > 20 THEN 0 ELSE y END AS y FROM (SELECT record_id, label, y, row_number() OVER (PARTITION BY label, y ORDER BY {_U.format("'rare:' || label || ':' || record_id::VARCHAR")}, record_id) AS k FROM v_pred)""")
def rare(spark, sf):
    return D.make_rare(V.predictions(spark, sf), TARGETS, 20).select("record_id", "label", "y")


@query("Y02_oversample", f"SELECT record_id, label, copy::INT AS copy FROM (SELECT record_id, label, unnest(range(1, CASE WHEN label IN {_T} THEN 4 ELSE 2 END)) AS copy FROM v_pred WHERE y = 1)")
def over(spark, sf):
    return D.oversample(V.predictions(spark, sf).where("y = 1"), F.col("label").isin(*TARGETS), 3).select("record_id", "label", "copy")


@query("Y03_equal_arm", f"""WITH n AS (SELECT label, record_id, row_number() OVER (PARTITION BY label ORDER BY record_id) - 1 AS k, count(*) OVER (PARTITION BY label) AS c FROM v_pred WHERE y = 1 AND label IN {_T}),
    d AS (SELECT label, draw, floor({_U.format("'arm:' || label || ':' || draw::VARCHAR")} * c)::INT AS k FROM (SELECT DISTINCT label, c FROM n) CROSS JOIN (SELECT unnest(range(1, 201)) AS draw)) SELECT label, draw::INT AS draw, record_id FROM d JOIN n USING (label, k)""")
def arm(spark, sf):
    return D.equal_arm(V.predictions(spark, sf), TARGETS, 200, "arm")


@query("Y07_compare_measures", """SELECT grp, measure, count(*) AS n, round(avg((value IS NOT NULL)::INT), 6) AS measurable, quantile_cont(value, 0.5) AS median FROM (SELECT record_id % 2 AS grp, unnest(['hr', 'pr', 'qrs', 'qt']) AS measure, unnest([hr, pr, qrs, qt]) AS value FROM v_obs) GROUP BY ALL""")
def measures(spark, sf):
    return D.compare_measures(V.observations(spark, sf).withColumn("grp", F.col("record_id") % 2), "grp", ["hr", "pr", "qrs", "qt"])
