"""Queries over surfaced findings, cohorts and reliability flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks as C
from ..operators import labels as L
from ..operators import views as V
from .registry import oracle_text, query

URGENT = ["NATION_3", "NATION_7", "NATION_17"]
_URGENT = "('NATION_3', 'NATION_7', 'NATION_17')"
_FOUND = "(SELECT record_id, label, p AS confidence FROM v_pred WHERE p >= 0.5)"
_OUT = f"""SELECT record_id, coalesce(list(label ORDER BY label) FILTER (y = 1 AND p < 0.5), []) AS misses, coalesce(list(label ORDER BY label) FILTER (y = 0 AND p >= 0.5), []) AS false_positives,
    coalesce(list(label ORDER BY label) FILTER (y = 1 AND p < 0.5 AND label IN {_URGENT}), []) AS urgent_misses, coalesce(list(label ORDER BY label) FILTER (y = 1 AND p < 0.5 AND p >= 0.35), []) AS near_misses,
    max(p) AS max_p, max(p) FILTER (y = 1 AND p < 0.5) AS top_missed_p FROM v_pred GROUP BY record_id"""
_RULES = "(SELECT a.code AS a, b.code AS b FROM v_dict a JOIN v_dict b ON a.code < b.code AND a.superclass = b.superclass AND (a.code_idx + b.code_idx) % 3 = 0)"
_PAIRS = f"(SELECT x.record_id, r.a, r.b FROM {_FOUND} x JOIN {_RULES} r ON x.label = r.a JOIN {_FOUND} z ON z.record_id = x.record_id AND z.label = r.b)"


def rules(spark, sf):
    d = V.dictionary(spark, sf)
    a, b = d.alias("a"), d.alias("b")
    cond = (F.col("a.code") < F.col("b.code")) & (F.col("a.superclass") == F.col("b.superclass")) & ((F.col("a.code_idx") + F.col("b.code_idx")) % 3 == 0)
    return a.join(b, cond).select(F.col("a.code").alias("a"), F.col("b.code").alias("b"))


def found(spark, sf):
    return C.surfaced(V.predictions(spark, sf))


@query("C01_surfaced", f"SELECT * FROM {_FOUND}")
def surfaced(spark, sf):
    return found(spark, sf)


@query("C02_record_outcomes", _OUT)
def outcomes(spark, sf):
    return C.record_outcomes(V.predictions(spark, sf), URGENT)


_NOISE = """(SELECT p_partkey AS record_id, CASE WHEN p_partkey % 7 = 0 THEN 'alles' WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 5 = 0 THEN NULL ELSE '' END AS n1,
    CASE WHEN p_partkey % 4 = 0 THEN p_type WHEN p_partkey % 6 = 0 THEN ' ' END AS n2 FROM part)"""
_TOK = "CASE WHEN contains(lower(coalesce({0}, '')), 'alles') THEN ['ALL'] ELSE list_filter(string_split_regex(upper(trim(coalesce({0}, ''))), '[,;\\s]+'), lambda x: x <> '') END"


def noise(spark, sf):
    k = F.col("p_partkey")
    return V.table(spark, sf, "part").select(
        k.alias("record_id"), F.when(k % 7 == 0, "alles").when(k % 3 == 0, F.col("p_name")).when(k % 5 == 0, None).otherwise("").alias("n1"),
        F.when(k % 4 == 0, F.col("p_type")).when(k % 6 == 0, " ").alias("n2"),
    )


@query("C03_parse_affected", f"SELECT record_id, {_TOK.format('n1')} AS tokens FROM {_NOISE}")
def affected(spark, sf):
    return noise(spark, sf).select("record_id", C.parse_affected(F.col("n1")).alias("tokens"))


@query("C04_artifact_profile", f"""SELECT record_id, whole, kinds, burst, whole OR kinds >= 2 OR burst AS significant FROM (SELECT record_id, list_contains(a, 'ALL') OR list_contains(b, 'ALL') AS whole,
    (len(a) > 0)::INT + (len(b) > 0)::INT AS kinds, len(b) > 0 AS burst FROM (SELECT record_id, {_TOK.format('n1')} AS a, {_TOK.format('n2')} AS b FROM {_NOISE}))""")
def artifacts(spark, sf):
    return C.artifact_profile(noise(spark, sf), ["n1", "n2"], ["n2"]).select("record_id", "whole", "kinds", "burst", "significant")


_BORDER = "SELECT DISTINCT record_id FROM v_pred WHERE y = 1 AND abs(p - 0.5) <= 0.1 + 1e-9"
_MULTI = "SELECT record_id FROM v_pred WHERE y = 1 GROUP BY record_id HAVING count(*) >= 3"


@query("C05_borderline", _BORDER)
def borderline(spark, sf):
    return C.borderline(V.predictions(spark, sf))


@query("C06_multi_condition", _MULTI)
def multi(spark, sf):
    return C.multi_condition(V.predictions(spark, sf))


@query("C07_rare_carriers", """SELECT DISTINCT record_id FROM v_pred WHERE y = 1 AND label IN (SELECT label FROM v_pred JOIN v_records USING (record_id) WHERE y = 1 AND fold <= 8 GROUP BY label HAVING count(*) >= 10 ORDER BY count(*), label LIMIT 3)""")
def rare(spark, sf):
    p = V.predictions(spark, sf)
    train = p.join(V.records(spark, sf).where("fold <= 8").select("record_id"), "record_id", "left_semi")
    return C.carriers(p, C.rarest_labels(train, 3, 10).select("label"))


@query("C08_only_superclass", """SELECT record_id FROM v_codes JOIN v_dict USING (code) WHERE diagnostic GROUP BY record_id HAVING count(DISTINCT superclass) = 1 AND min(superclass) = 'ASIA'""")
def only(spark, sf):
    return C.only_superclass(L.superclasses(V.codes(spark, sf), V.dictionary(spark, sf)), "ASIA")


@query("C08_over_flags", f"""WITH o AS ({_OUT}), c AS ({oracle_text("C08_only_superclass")}) SELECT count(*) AS n, count(*) FILTER (len(false_positives) > 0) AS over_flagged, round(count(*) FILTER (len(false_positives) > 0)::DOUBLE / nullif(count(*), 0), 4) AS rate FROM c JOIN o USING (record_id)""")
def over_flags(spark, sf):
    return C.over_flag_rate(only(spark, sf), C.record_outcomes(V.predictions(spark, sf), URGENT))


@query("C09_cohort_metrics", f"""WITH o AS ({_OUT}), c AS (SELECT 'all' AS cohort, record_id FROM v_records UNION ALL SELECT 'borderline', record_id FROM ({_BORDER}) UNION ALL SELECT 'multi', record_id FROM ({_MULTI})),
    n AS (SELECT record_id, count(*) AS np FROM v_pred WHERE y = 1 GROUP BY record_id)
    SELECT cohort, count(*) AS n, round(1 - sum(len(misses))::DOUBLE / nullif(sum(coalesce(np, 0)), 0), 4) AS label_recall, round(sum(len(false_positives))::DOUBLE / count(*), 4) AS over_flags,
    count(*) FILTER (len(misses) > 0) AS with_miss, count(*) FILTER (len(false_positives) > 0) AS with_over_flag, round(avg((len(urgent_misses) > 0)::INT), 4) AS urgent_miss_rate,
    sum(len(near_misses))::BIGINT AS near_misses, round(avg((len(misses) = 0 AND len(false_positives) = 0)::INT), 4) AS clean_rate FROM c JOIN o USING (record_id) LEFT JOIN n USING (record_id) GROUP BY cohort""")
def cohorts(spark, sf):
    p = V.predictions(spark, sf)
    named = lambda df, name: df.select(F.lit(name).alias("cohort"), "record_id")
    c = named(V.records(spark, sf), "all").unionByName(named(C.borderline(p), "borderline")).unionByName(named(C.multi_condition(p), "multi"))
    return C.cohort_metrics(C.record_outcomes(p, URGENT), p, c)


@query("C10_routed", f"""SELECT count(*) AS routed, round(count(*)::DOUBLE / (SELECT count(*) FROM v_records), 6) AS rate FROM (SELECT record_id FROM {_FOUND} WHERE confidence < 0.7 UNION SELECT record_id FROM {_PAIRS})""")
def routed(spark, sf):
    return C.routed(found(spark, sf), rules(spark, sf), V.records(spark, sf).count())


_ASSERTED = "(SELECT record_id, code AS label FROM v_codes)"


def asserted(spark, sf):
    return V.codes(spark, sf).withColumnRenamed("code", "label")


@query("R01_unsupported", f"SELECT record_id, label FROM {_ASSERTED} EXCEPT SELECT record_id, label FROM {_FOUND}")
def unsupported(spark, sf):
    return C.unsupported(asserted(spark, sf), found(spark, sf))


@query("R01_consistency_rate", f"""SELECT round(1 - count(DISTINCT u.record_id)::DOUBLE / (SELECT count(*) FROM v_records), 6) AS consistency_rate FROM (SELECT record_id, label FROM {_ASSERTED} EXCEPT SELECT record_id, label FROM {_FOUND}) u""")
def consistency(spark, sf):
    return C.consistency_rate(asserted(spark, sf), found(spark, sf), V.records(spark, sf))


@query("R02_hallucinations", "SELECT c.record_id, c.code AS label, t.p < 0.5 AS unsupported, t.p >= 0.5 AND t.p2 < 0.5 AS ungrounded FROM v_codes c JOIN v_two t ON t.record_id = c.record_id AND t.label = c.code")
def hallucinations(spark, sf):
    grounded = V.predictions(spark, sf, two=True).where("p2 >= 0.5").select("record_id", "label")
    return C.hallucinations(asserted(spark, sf), found(spark, sf), grounded)


@query("R03_low_confidence", f"SELECT * FROM {_FOUND} WHERE confidence < 0.7")
def low(spark, sf):
    return C.low_confidence(found(spark, sf))


@query("R04_exclusive_pairs", f"""SELECT record_id, a, b FROM (SELECT record_id, list(label) AS labels FROM {_FOUND} GROUP BY record_id) CROSS JOIN {_RULES} WHERE list_contains(labels, a) AND list_contains(labels, b)""")
def exclusive(spark, sf):
    return C.exclusive_pairs(found(spark, sf), rules(spark, sf))


@query("R05_cited_conflicts", """SELECT record_id, code, lead, rank FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY importance DESC, lead) AS rank, count(*) OVER (PARTITION BY record_id) AS leads
    FROM (SELECT l_orderkey AS record_id, 'any' AS code, l_suppkey AS lead, sum(round(l_extendedprice * 100)::BIGINT) AS importance FROM lineitem GROUP BY ALL)) JOIN (SELECT DISTINCT l_orderkey AS record_id, l_suppkey AS lead FROM lineitem WHERE l_returnflag = 'R') USING (record_id, lead) WHERE rank > leads - 3 AND leads > 3""")
def cited(spark, sf):
    li = V.table(spark, sf, "lineitem")
    imp = li.groupBy(F.col("l_orderkey").alias("record_id"), F.col("l_suppkey").alias("lead")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("importance")).withColumn("code", F.lit("any"))
    cites = li.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("record_id"), F.lit("any").alias("code"), F.col("l_suppkey").alias("lead")).distinct()
    return C.cited_conflicts(cites, imp)


_FLAGS = f"(SELECT record_id, label, 'low' AS type FROM {_FOUND} WHERE confidence < 0.7 UNION ALL SELECT record_id, a, 'exclusive' FROM {_PAIRS} UNION ALL SELECT record_id, b, 'exclusive' FROM {_PAIRS})"


def flags(spark, sf):
    f, ex = found(spark, sf), exclusive(spark, sf)
    low = C.low_confidence(f).select("record_id", "label", F.lit("low").alias("type"))
    both = ex.select("record_id", F.explode(F.array("a", "b")).alias("label"), F.lit("exclusive").alias("type"))
    return low.unionByName(both)


@query("R06_flag_summary", f"""SELECT type, count(*) AS flags, count(DISTINCT record_id) AS records, round(count(DISTINCT record_id)::DOUBLE / (SELECT count(*) FROM v_records), 6) AS rate FROM {_FLAGS} GROUP BY type
    UNION ALL SELECT 'any', count(*), count(DISTINCT record_id), round(count(DISTINCT record_id)::DOUBLE / (SELECT count(*) FROM v_records), 6) FROM {_FLAGS}""")
def summary(spark, sf):
    return C.flag_summary(flags(spark, sf), V.records(spark, sf).count()).select("type", "flags", "records", "rate")


@query("R07_report_rows", f"""SELECT record_id, count(*) AS findings, sum(n_flags)::BIGINT AS flags, bool_or(confidence < 0.5 OR n_flags > 0) AS review FROM (SELECT f.record_id, f.label, f.confidence, count(DISTINCT type) AS n_flags
    FROM {_FOUND} f LEFT JOIN {_FLAGS} g ON g.record_id = f.record_id AND g.label = f.label GROUP BY ALL) GROUP BY record_id""")
def reports(spark, sf):
    r = C.report_rows(found(spark, sf), flags(spark, sf))
    count = F.aggregate("findings", F.lit(0).cast("long"), lambda n, f: n + F.size(f["flags"]))
    return r.select("record_id", F.size("findings").cast("long").alias("findings"), count.alias("flags"), "review")


@query("R08_severity", f"""SELECT record_id, CASE WHEN bool_or(label IN {_URGENT}) THEN 'red' WHEN bool_or(confidence < 0.7) THEN 'yellow' ELSE 'green' END AS severity FROM {_FOUND} GROUP BY record_id""")
def triage(spark, sf):
    g = found(spark, sf).groupBy("record_id").agg(F.collect_set("label").alias("labels"), F.bool_or(F.col("confidence") < 0.7).alias("review"))
    return g.select("record_id", C.severity(F.col("labels"), F.col("review"), URGENT).alias("severity"))
