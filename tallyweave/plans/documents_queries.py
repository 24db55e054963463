"""Queries over documents of records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import documents as D
from ..operators import views as V
from .narratives_queries import _AXIS, _report, axis_code
from .registry import query
from .systems_queries import _MAP, mapping

_URN = "('urn:uuid:' || substr({0}, 1, 8) || '-' || substr({0}, 9, 4) || '-' || substr({0}, 13, 4) || '-' || substr({0}, 17, 4) || '-' || substr({0}, 21, 12))"


def bundles(spark, sf):
    r = V.records(spark, sf)
    heads = r.select(
        "record_id", F.when(F.col("record_id") % 5 != 0, F.concat(F.lit("Patient/"), F.col("patient_id").cast("string"))).alias("subject"), F.col("rec_ts").cast("date").cast("string").alias("effective"),
        F.lit("1").alias("issuer_version"), (F.col("record_id") % 4 == 0).alias("review"), F.lit("as above").alias("conclusion"),
    )
    d = V.dictionary(spark, sf).select("code", "code_idx")
    p = V.predictions(spark, sf).where("y = 1").select("record_id", F.col("label").alias("code"), "p").join(F.broadcast(d), "code")
    leads = F.when(F.col("code_idx") % 2 == 0, F.array(F.lit("I"), F.lit("V2"))).otherwise(F.array().cast("array<string>"))
    found = p.select("record_id", "code", F.lower("code").alias("display"), (F.floor(F.col("p") * 10000) / 10000).alias("confidence"), (F.col("p") < 0.5).alias("needs_review"), leads.alias("leads"))
    o = V.observations(spark, sf).select("record_id", F.explode(F.create_map(*[x for n, c in (("heart_rate", "hr"), ("pr", "pr"), ("qrs", "qrs"), ("qt", "qt")) for x in (F.lit(n), F.col(c))])).alias("name", "value"))
    return D.nested_bundles(heads, found, o, mapping(spark, sf).select("code", "target", F.lower("code").alias("display"), "tier"))


@query("S09_bundles", f"""WITH f AS (SELECT record_id, count(*) AS n, count(DISTINCT target) AS coded, count(target) AS other, count(*) FILTER (code_idx % 2 = 0) AS noted, round(sum(floor(p * 10000) / 10000), 4) AS total FROM v_pred JOIN v_dict ON label = code LEFT JOIN {_MAP} m USING (code) WHERE y = 1 GROUP BY record_id)
    SELECT record_id, CASE WHEN record_id % 4 = 0 THEN 'preliminary' ELSE 'final' END AS status, (2 + (record_id % 5 = 0)::INT + coalesce(f.n, 0) + coalesce(k, 0))::BIGINT AS entries, (coalesce(f.n, 0) + coalesce(k, 0))::BIGINT AS results, coalesce(coded, 0)::BIGINT AS conclusions,
      coalesce(other, 0)::BIGINT AS second_codings, coalesce(noted, 0)::BIGINT AS notes, coalesce(total, 0.0::DOUBLE) AS confidence, coalesce(v, 0.0::DOUBLE) AS measured, {_URN.format("md5(record_id::VARCHAR || '|device')")} AS device
    FROM v_records LEFT JOIN f USING (record_id) LEFT JOIN (SELECT record_id, (hr IS NOT NULL)::INT + (pr IS NOT NULL)::INT + 2 AS k, round(hr + coalesce(round(pr, 1), 0) + qrs + qt, 1) AS v FROM v_obs) USING (record_id)""")
def flattened(spark, sf):
    """Read back from the JSON text of every bundle."""
    e = bundles(spark, sf).select("record_id", "status", F.from_json("bundle", D.BUNDLE)["entry"].alias("e"))
    of = lambda kind: F.filter("e", lambda x: x["resource"]["resourceType"] == kind)
    report, seen = of("DiagnosticReport")[0]["resource"], of("Observation")
    total = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda a, x: a + F.coalesce(f(x["resource"]), F.lit(0.0)))
    count = lambda xs: F.size(xs).cast("long")
    return e.select(
        "record_id", report["status"].alias("status"), count("e").alias("entries"), count(report["result"]).alias("results"), F.coalesce(count(report["conclusionCode"]), F.lit(0).cast("long")).alias("conclusions"),
        count(F.filter(seen, lambda x: F.size(x["resource"]["valueCodeableConcept"]["coding"]) == 2)).alias("second_codings"), count(F.filter(seen, lambda x: x["resource"]["note"].isNotNull())).alias("notes"),
        F.round(total(seen, lambda r: r["extension"][0]["valueDecimal"]), 4).alias("confidence"), F.round(total(seen, lambda r: r["valueQuantity"]["value"]), 1).alias("measured"), of("Device")[0]["fullUrl"].alias("device"),
    )


_LONG = " pattern of the lateral and the high lateral wall with reciprocal change"
_VOCABULARY = f"""(SELECT code, {list(D.CONSEQUENCE)}[code_idx % 9 + 1] AS "group", code_idx % 9 AS place, code_idx % 3 = 1 AS localized, code_idx IN (5, 14) AS urgent, code_idx = 7 AS normal, code_idx % 9 = 3 AS benign, CASE WHEN code_idx % 3 = 1 THEN 'entity ' || (code_idx % 4)::VARCHAR ELSE lower(code) END AS entity,
    CASE WHEN code_idx = 3 THEN 'sinus rhythm' WHEN code_idx % 3 = 1 THEN lower(code) || ' entity ' || (code_idx % 4)::VARCHAR WHEN code_idx % 5 = 2 THEN lower(code) || '{_LONG}' ELSE lower(code) END AS phrase FROM v_dict)"""


def _words(spark, sf):
    k = F.col("code_idx")
    entity = F.when(k % 3 == 1, F.concat(F.lit("entity "), (k % 4).cast("string"))).otherwise(F.lower("code"))
    phrase = F.when(k == 3, "sinus rhythm").when(k % 3 == 1, F.concat(F.lower("code"), F.lit(" "), entity)).when(k % 5 == 2, F.concat(F.lower("code"), F.lit(_LONG))).otherwise(F.lower("code"))
    group = F.get(F.array(*map(F.lit, D.CONSEQUENCE)), (k % 9).cast("int"))
    return V.dictionary(spark, sf).select(
        "code", group.alias("group"), phrase.alias("phrase"), entity.alias("entity"), (k % 3 == 1).alias("localized"), k.isin(5, 14).alias("urgent"), (k == 7).alias("normal"), (k % 9 == 3).alias("benign")
    )


_AND = lambda r: f"CASE WHEN len({r}) <= 2 THEN array_to_string({r}, ' and ') ELSE array_to_string({r}[1:len({r}) - 1], ', ') || ', and ' || {r}[-1] END"
_PLUS = lambda n: f"CASE WHEN {n} > 0 THEN ', plus ' || ({n})::VARCHAR || ' further finding' || CASE WHEN {n} > 1 THEN 's' ELSE '' END ELSE '' END"


@query("E03_impressions", f"""WITH x AS MATERIALIZED (SELECT record_id, v.* FROM v_codes JOIN {_VOCABULARY} v USING (code)),
    l AS (SELECT record_id, arg_min(code, (NOT urgent, place, code)) FILTER ("group" IN ('rhythm', 'pacing')) AS lead, arg_min(phrase, (NOT urgent, place, code)) FILTER ("group" IN ('rhythm', 'pacing')) AS lead_phrase,
      arg_min(code, (place, code)) FILTER (urgent) AS first, arg_min(phrase, (place, code)) FILTER (urgent) AS first_phrase, bool_and(normal OR benign) AND bool_or(normal) AS plain FROM x GROUP BY record_id),
    r AS (SELECT x.* FROM x JOIN l USING (record_id) WHERE code IS DISTINCT FROM lead AND code IS DISTINCT FROM first AND NOT normal),
    e AS (SELECT record_id, entity, count(*) FILTER (localized) AS places, list(DISTINCT phrase) AS any_phrases, min((NOT urgent, place, code)) AS rank FROM r GROUP BY record_id, entity),
    c AS (SELECT record_id, rank, [0]::INT[] AS sub, 'multi-territory ' || entity AS clause FROM e WHERE places >= 2 UNION ALL
      SELECT r.record_id, e.rank, [1, min(place), 0]::INT[], phrase FROM r JOIN e USING (record_id, entity) WHERE places < 2 GROUP BY r.record_id, e.rank, phrase),
    s AS (SELECT record_id, list(clause ORDER BY rank, sub) AS every FROM c GROUP BY record_id),
    t AS (SELECT record_id, rate, review, lead, plain, first_phrase, coalesce(every[1:4], []) AS rest, greatest(coalesce(len(every), 0) - 4, 0) AS more, l.record_id IS NULL AS nothing,
      coalesce(upper(substr(w, 1, 1)) || substr(w, 2), '') AS rhythm FROM (SELECT record_id, CASE WHEN record_id % 11 <> 0 THEN hr END AS rate, record_id % 4 = 0 AS review FROM v_records LEFT JOIN v_obs USING (record_id)) q LEFT JOIN l USING (record_id) LEFT JOIN s USING (record_id),
      LATERAL (SELECT coalesce(lead_phrase, CASE WHEN rate IS NOT NULL THEN 'Rhythm' END) || CASE WHEN rate IS NOT NULL THEN ' at ' || round_even(rate, 0)::BIGINT::VARCHAR || ' bpm' ELSE '' END AS w)),
    u AS (SELECT *, coalesce('URGENT — ' || first_phrase || ': ', '') AS head, CASE WHEN review THEN '; {D.REVIEW_CLAUSE}; {D.ATTRIBUTION}.' ELSE '; {D.ATTRIBUTION}.' END AS tail FROM t),
    z AS (SELECT record_id, nothing, -1 AS k, head || CASE WHEN plain THEN CASE WHEN rhythm = '' THEN 'Normal ECG' WHEN contains(lower(rhythm), 'sinus rhythm') THEN rhythm || ' — normal ECG' ELSE rhythm || ', otherwise normal ECG' END
        WHEN rhythm <> '' AND len(rest) > 0 THEN rhythm || ' with ' || {_AND("rest")} WHEN rhythm <> '' THEN rhythm WHEN len(rest) > 0 THEN upper(substr({_AND("rest")}, 1, 1)) || substr({_AND("rest")}, 2) ELSE 'Abnormal ECG' END || {_PLUS("more")} || tail AS txt FROM u
      UNION ALL SELECT record_id, nothing, len(rest) - k, head || CASE WHEN rhythm <> '' AND k > 0 THEN rhythm || ' with ' || {_AND("kept")} WHEN rhythm <> '' THEN rhythm ELSE 'Abnormal ECG' END || {_PLUS("more + len(rest) - k")} || tail
      FROM (SELECT *, rest[1:k] AS kept FROM (SELECT *, unnest(range(len(rest))) AS k FROM u)))
    SELECT record_id, CASE WHEN bool_or(nothing) THEN 'No diagnostic findings surfaced; {D.ATTRIBUTION}.' ELSE coalesce(arg_min(txt, k) FILTER (length(txt) <= 300), arg_max(txt, k)) END AS impression FROM z GROUP BY record_id""")
def impressions(spark, sf):
    rate = V.observations(spark, sf).select("record_id", F.when(F.col("record_id") % 11 != 0, F.col("hr")).alias("rate"))
    r = V.records(spark, sf).select("record_id", (F.col("record_id") % 4 == 0).alias("review")).join(rate, "record_id", "left")
    return D.one_line_impressions(r, V.codes(spark, sf), _words(spark, sf))


_U = "(('0x' || substr(md5({}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
_KEY = "record_id::VARCHAR || ':' || code"
_C = _U.format(f"'0:confidence:' || {_KEY}")
_DRAWN = f"""(SELECT record_id, superclass AS "group", code, rhythm, CASE WHEN code_idx % 2 = 0 THEN 'I' ELSE 'II' END AS leads,
    round(CASE WHEN {_U.format(f"'0:low:' || {_KEY}")} < 0.15 THEN 0.30::DOUBLE + {0.49 - 0.30!r}::DOUBLE * {_C} ELSE 0.82::DOUBLE + {0.99 - 0.82!r}::DOUBLE * {_C} END, 6) AS confidence, r_regionkey AS rank
    FROM v_codes JOIN v_dict USING (code) JOIN region ON r_name = superclass WHERE code_idx % 4 = 0)"""
_TARGET = _report("en", _DRAWN)
_PLACE = "CASE WHEN record_id % 9 < 4 THEN ['LAD', 'RAD', 'ALAD', 'ARAD'][(record_id % 9)::INT + 1] END"


def examples(spark, sf):
    d = V.dictionary(spark, sf).where("code_idx % 4 = 0")
    rank = V.table(spark, sf, "region").select(F.col("r_name").alias("group"), F.col("r_regionkey").alias("rank"))
    leads = F.when(F.col("code_idx") % 2 == 0, "I").otherwise("II").alias("leads")
    vocabulary = d.withColumnRenamed("superclass", "group").join(F.broadcast(rank), "group").select("code", "rank", "group", "rhythm", leads)
    rate = V.observations(spark, sf).select("record_id", F.when(F.col("record_id") % 11 != 0, F.col("hr")).alias("rate"))
    r = V.records(spark, sf).select("record_id", "age", "sex", axis_code(), (F.col("record_id") % 13 != 0).alias("validated")).join(rate, "record_id", "left")
    return D.training_examples(r, V.codes(spark, sf), vocabulary, "ASIA")


_ACCEPTED = f"(SELECT record_id, age, sex FROM v_records WHERE record_id % 13 <> 0 AND record_id IN (SELECT record_id FROM {_DRAWN}))"


@query("E07_examples", f"""SELECT record_id, CASE WHEN age < 200 THEN age::INT END AS age, CASE sex WHEN 0 THEN 'M' ELSE 'F' END AS sex, CASE WHEN record_id % 11 <> 0 THEN hr END AS rate, {_PLACE} AS axis, codes, confidences, report
    FROM {_ACCEPTED} JOIN (SELECT record_id, list(code ORDER BY rank, code) AS codes, list(confidence ORDER BY rank, code) AS confidences FROM {_DRAWN} GROUP BY record_id) USING (record_id) JOIN {_TARGET} USING (record_id) LEFT JOIN v_obs USING (record_id)""")
def accepted(spark, sf):
    e = examples(spark, sf)[0]
    return e.select("record_id", "age", "sex", "rate", "axis", F.transform("findings", lambda f: f["code"]).alias("codes"), F.transform("findings", lambda f: f["confidence"]).alias("confidences"), "report")


@query("E07_rejects", f"SELECT record_id, CASE WHEN record_id % 13 = 0 THEN 'not validated' ELSE 'no known code' END AS reason FROM v_records WHERE record_id NOT IN (SELECT record_id FROM {_ACCEPTED})")
def rejected(spark, sf):
    return examples(spark, sf)[1]


_SYSTEM, _RULES = "Write a report of the listed findings only, in two sections.", {"es": "\n\nWrite the entire report in Spanish."}
_TWO = lambda c: f"(round({c} * 100)::BIGINT // 100)::VARCHAR || '.' || lpad((round({c} * 100)::BIGINT % 100)::VARCHAR, 2, '0')"
_NAMES = "CASE record_id % 9 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(("left axis deviation", "right axis deviation", "extreme left axis deviation", "extreme right axis deviation"))) + " END"


@query("E11_chat_rows", f"""WITH d AS MATERIALIZED {_DRAWN}, l AS (SELECT record_id, string_agg('- ' || code || ' (' || "group" || '): confidence=' || {_TWO("confidence")} || ', leads=' || leads, chr(10) ORDER BY rank, code) AS lines FROM d GROUP BY record_id)
    SELECT record_id, '{_SYSTEM}' || chr(10) || chr(10) || 'Write the entire report in Spanish.' AS system, concat_ws(chr(10), 'Patient: ' || concat_ws(' ', CASE WHEN age < 200 THEN age::INT::VARCHAR || 'y' END, CASE sex WHEN 0 THEN 'M' ELSE 'F' END),
      nullif(concat_ws(' | ', CASE WHEN record_id % 11 <> 0 THEN 'rate ' || round_even(hr, 0)::BIGINT::VARCHAR || ' bpm' END, 'axis ' || {_NAMES}), ''), 'Review threshold: 0.50', 'Detected findings:', lines)
      || CASE WHEN record_id % 2 = 0 THEN chr(10) || chr(10) || 'Reference ' || record_id::VARCHAR ELSE '' END || chr(10) || chr(10) || 'Write the report now.' AS prompt, report AS completion
    FROM {_ACCEPTED} JOIN l USING (record_id) JOIN {_TARGET} USING (record_id) LEFT JOIN v_obs USING (record_id)""")
def chat(spark, sf):
    e = examples(spark, sf)[0].withColumn("context", F.when(F.col("record_id") % 2 == 0, F.concat(F.lit("Reference "), F.col("record_id").cast("string"))))
    return D.chat_rows(e, _SYSTEM, "es", _RULES)
