"""Queries over mappings, bundles, samples, prompts and run tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import exports as E
from ..operators import feedback as B
from ..operators import views as V
from ..sources import files
from .feedback_queries import decide, thresholds
from .registry import oracle_text, query
from .scoring_queries import _POOL, auroc_sql, pooled
from .subgroups_queries import rounded
from .systems_queries import _MAP, mapping

_MAP_TEXT = "(SELECT record_id, code, round((record_id % 7) * 10.0::DOUBLE, 1) AS likelihood FROM v_codes)"


@query("S01_parsed_codes", f"SELECT record_id, code, likelihood FROM {_MAP_TEXT}")
def parsed(spark, sf):
    item = F.concat(F.lit("'"), "code", F.lit("': "), F.round((F.col("record_id") % 7) * 10.0, 1).cast("string"))
    text = V.codes(spark, sf).groupBy("record_id").agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(item)), ", "), F.lit("}")).alias("codes"))
    return files.parse_codes(text, "codes").select("record_id", F.explode("codes").alias("code", "likelihood"))


@query("S08_last_runs", "SELECT o_custkey AS run, o_orderkey AS seq, o_totalprice AS value FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def last_runs(spark, sf):
    o = V.table(spark, sf, "orders")
    return E.last_of_each(o, "o_custkey", ["o_orderdate", "o_orderkey"]).select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("value"))


@query("E01_code_mapping", f"SELECT record_id, code, target, tier, evidence FROM v_codes LEFT JOIN {_MAP} USING (code)")
def mapped(spark, sf):
    return E.code_mapping(V.codes(spark, sf), mapping(spark, sf))


@query("E04_bundle_faults", """WITH e AS (SELECT l_orderkey::VARCHAR || '/' || l_linenumber::VARCHAR AS url, CASE WHEN l_orderkey % 17 = 0 AND l_linenumber = 1 THEN -1 WHEN l_orderkey % 19 = 0 THEN l_suppkey + 1000000000 ELSE l_orderkey END AS ref, CASE WHEN l_linenumber = 7 THEN 'Z' ELSE l_returnflag END AS value FROM lineitem),
    t AS (SELECT o_orderkey AS url, 'order' AS kind FROM orders UNION ALL SELECT s_suppkey + 1000000000, 'supplier' FROM supplier)
    SELECT url, 'value' AS fault FROM e WHERE value NOT IN ('A', 'N', 'R') UNION ALL SELECT e.url, CASE WHEN t.kind IS NULL THEN 'unresolved' ELSE 'wrong kind' END FROM e LEFT JOIN t ON e.ref = t.url WHERE t.kind IS NULL OR t.kind <> 'order'""")
def faults(spark, sf):
    li, o, s = (V.table(spark, sf, t) for t in ("lineitem", "orders", "supplier"))
    ref = F.when((F.col("l_orderkey") % 17 == 0) & (F.col("l_linenumber") == 1), F.lit(-1)).when(F.col("l_orderkey") % 19 == 0, F.col("l_suppkey") + 1000000000).otherwise(F.col("l_orderkey"))
    url = F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    entries = li.select(url.alias("url"), ref.cast("long").alias("ref"), F.lit("order").alias("kind"), F.when(F.col("l_linenumber") == 7, "Z").otherwise(F.col("l_returnflag")).alias("value"))
    targets = o.select(F.col("o_orderkey").cast("long").alias("url"), F.lit("order").alias("kind")).unionByName(s.select((F.col("s_suppkey") + 1000000000).cast("long").alias("url"), F.lit("supplier").alias("kind")))
    return E.bundle_faults(entries, targets, ["A", "N", "R"])


@query("E06_terminology_drift", """WITH m AS (SELECT 'I' || code_idx::VARCHAR AS code, code AS display, code_idx FROM v_dict),
    r AS (SELECT code, CASE WHEN code_idx % 5 = 1 THEN lower(display) ELSE display END AS display FROM m WHERE code_idx % 6 <> 0 UNION ALL SELECT code || '.1', 'part' FROM m WHERE code_idx % 4 = 2)
    SELECT code, 'missing' AS fault FROM m WHERE code NOT IN (SELECT code FROM r) UNION ALL SELECT m.code, 'display' FROM m JOIN r USING (code) WHERE m.display <> r.display UNION ALL SELECT code, 'has children' FROM m WHERE code_idx % 4 = 2""")
def drift(spark, sf):
    k = F.col("code_idx")
    m = V.dictionary(spark, sf).select(F.concat(F.lit("I"), k.cast("string")).alias("code"), F.col("code").alias("display"), "code_idx")
    r = m.where(k % 6 != 0).select("code", F.when(k % 5 == 1, F.lower("display")).otherwise(F.col("display")).alias("display"))
    r = r.unionByName(m.where(k % 4 == 2).select(F.concat("code", F.lit(".1")).alias("code"), F.lit("part").alias("display")))
    return E.terminology_drift(m.select("code", "display"), r)


_BUCKETS = [("old", "age >= 75 AND age <> 300"), ("rare device", "device LIKE 'rare%'"), ("old women", "age >= 70 AND age <> 300 AND sex = 1"), ("any", "true")]


def _sample_sql() -> str:
    parts, before = [], []
    for k, (name, test) in enumerate(_BUCKETS):
        gone = "".join(f" AND record_id NOT IN (SELECT record_id FROM s{b})" for b in before)
        parts.append(f"s{k} AS (SELECT record_id, '{name}' AS bucket, (row_number() OVER (ORDER BY h, record_id))::INT AS rank FROM (SELECT record_id, md5('review:' || record_id::VARCHAR) AS h FROM v_records WHERE {test}{gone} ORDER BY h, record_id LIMIT 16))")
        before.append(k)
    return f"WITH {', '.join(parts)} {' UNION ALL '.join(f'SELECT * FROM s{k}' for k in before)}"


@query("E09_review_sample", _sample_sql())
def review(spark, sf):
    key = F.md5(F.concat(F.lit("review:"), F.col("record_id").cast("string")))
    return E.review_sample(V.records(spark, sf), [(n, F.expr(t)) for n, t in _BUCKETS], key, 16)


@query("E10_one_of_each", """SELECT superclass, min(record_id) AS record_id FROM (SELECT superclass, record_id, sex, row_number() OVER (PARTITION BY superclass ORDER BY record_id) AS n FROM (SELECT DISTINCT superclass, record_id, sex FROM v_codes JOIN v_dict USING (code) JOIN v_records USING (record_id)))
    WHERE n <= 40 AND sex = 1 GROUP BY superclass""")
def each(spark, sf):
    d = F.broadcast(V.dictionary(spark, sf).select("code", "superclass"))
    rows = V.codes(spark, sf).join(d, "code").join(V.records(spark, sf).select("record_id", "sex"), "record_id").select("superclass", "record_id", "sex").distinct()
    return E.one_of_each(rows, "superclass", F.col("sex") == 1)


@query("E11_prompt_rows", """SELECT record_id, 'Patient: ' || CASE WHEN age > 0 AND age < 200 THEN age::INT::VARCHAR || ' y' ELSE 'age unknown' END || ', ' || CASE sex WHEN 0 THEN 'male' ELSE 'female' END || chr(10) || 'Codes: ' || c || chr(10) || 'Answer in German.' ||
    CASE WHEN record_id % 2 = 0 THEN chr(10) || 'Context:' || chr(10) || device ELSE '' END AS prompt, 'Findings: ' || replace(c, ', ', '; ') || '.' AS completion FROM v_records JOIN (SELECT record_id, string_agg(code, ', ' ORDER BY code) AS c FROM v_codes GROUP BY record_id) USING (record_id)""")
def prompts(spark, sf):
    c = V.codes(spark, sf).groupBy("record_id").agg(F.array_sort(F.collect_list("code")).alias("codes"))
    r = V.records(spark, sf).withColumn("context", F.when(F.col("record_id") % 2 == 0, F.col("device")))
    return E.prompt_rows(r.join(c, "record_id"), "German")


@query("X01_answered_auroc", f"SELECT label, (n_pos + n_neg)::BIGINT AS answered, CASE WHEN n_pos + n_neg >= 20 THEN round(auroc, 6) END AS auroc FROM ({auroc_sql('(SELECT * FROM v_pred WHERE record_id % 7 <> 0)', 'label')})")
def answered(spark, sf):
    return rounded(E.answered_auroc(V.predictions(spark, sf).withColumn("p", F.when(F.col("record_id") % 7 != 0, F.col("p")))))


_TWO = _POOL.replace("v_pred", "v_two").replace("max(p) AS p", "max(p2) AS p")


@query("X03_self_contradiction", f"""SELECT count(*) AS asserting, sum(d)::BIGINT AS contradicted, round(avg(d), 6) AS rate FROM (SELECT record_id, max((s.p < 0.5)::INT) AS d FROM (SELECT record_id, label FROM {_TWO} WHERE p >= 0.75) JOIN {_POOL} s USING (record_id, label) GROUP BY record_id)""")
def contradiction(spark, sf):
    two = V.predictions(spark, sf, two=True).select("record_id", "label", F.col("p2").alias("p"))
    d = V.dictionary(spark, sf).where("diagnostic").select(F.col("code").alias("label"), "superclass")
    said = two.join(F.broadcast(d), "label").groupBy("record_id", F.col("superclass").alias("label")).agg(F.max("p").alias("p")).where("p >= 0.75")
    return rounded(E.self_contradiction(said.select("record_id", "label"), pooled(spark, sf).select("record_id", "label", "p")))


@query("P18_measure_separation", f"""WITH m AS (SELECT label, y, qt AS p FROM v_pred JOIN v_obs USING (record_id) WHERE qt IS NOT NULL) SELECT label, CASE WHEN n_pos + n_neg >= 20 AND n_pos >= 8 THEN round(auroc, 6) END AS auroc, round(a, 6) AS median_pos, round(b, 6) AS median_neg
    FROM ({auroc_sql('m', 'label')}) JOIN (SELECT label, quantile_cont(p, 0.5) FILTER (y = 1) AS a, quantile_cont(p, 0.5) FILTER (y = 0) AS b FROM m GROUP BY label) USING (label)""")
def separation(spark, sf):
    o = V.observations(spark, sf).select("record_id", F.col("qt").alias("measure"))
    return rounded(E.measure_separation(V.predictions(spark, sf).select("record_id", "label", "y").join(o, "record_id")))


@query("B07_precision_bounds")
def bounds(spark, sf):
    n = lambda v: F.count_if(F.col("verdict") == v)
    sums = V.ratings(spark, sf).groupBy("label").agg(n("correct").alias("correct"), n("incorrect").alias("incorrect"), F.avg("confidence").alias("mean"))
    return rounded(E.precision_bounds(sums))


_T = "(SELECT code AS label, 0.3::DOUBLE + (code_idx % 5) / 10.0::DOUBLE AS threshold FROM v_dict WHERE code_idx % 3 <> 0)"


@query("B09_updated_thresholds", f"""SELECT label, round(CASE WHEN reason = 'moved' THEN new ELSE coalesce(threshold, new) END, 6) AS threshold, CASE WHEN reason = 'moved' THEN 'feedback' WHEN threshold IS NOT NULL THEN 'previous' ELSE 'default' END AS provenance, coalesce(reason = 'no evidence', false) AS needs_work
    FROM {_T} FULL JOIN (SELECT label, threshold AS new, reason FROM ({oracle_text("B08_decide_thresholds")})) USING (label)""")
def updated(spark, sf):
    return rounded(E.updated_thresholds(thresholds(spark, sf), decide(spark, sf)))


@query("D10_run_comparison", """WITH r AS (SELECT o_orderkey AS name, CASE o_orderkey % 3 WHEN 0 THEN 'plain' WHEN 1 THEN 'control' ELSE 'central' END AS arm, o_orderpriority AS device, o_totalprice AS value FROM orders), b AS (SELECT * FROM r WHERE arm = 'plain' ORDER BY value DESC, name DESC LIMIT 1)
    SELECT name, b.device, round(value, 6) AS value, round(control, 6) AS control, round(value - control, 6) AS gap, round((central - value) / central, 6) AS loss FROM b, (SELECT max(value) AS central FROM r WHERE arm = 'central') LEFT JOIN (SELECT device, max(value) AS control FROM r WHERE arm = 'control' GROUP BY device) c ON c.device = b.device""")
def comparison(spark, sf):
    k = F.col("o_orderkey")
    arm = F.when(k % 3 == 0, "plain").when(k % 3 == 1, "control").otherwise("central")
    return rounded(E.run_comparison(V.table(spark, sf, "orders").select(k.alias("name"), arm.alias("arm"), F.col("o_orderpriority").alias("device"), F.col("o_totalprice").alias("value"))))
