"""Queries over label tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import labels as L
from ..operators import views as V
from .registry import query


@query("S01_code_maps", "SELECT record_id, count(*)::BIGINT AS n, string_agg(code, ',' ORDER BY code) AS codes FROM v_codes GROUP BY record_id")
def code_maps(spark, sf):
    m = L.code_maps(V.codes(spark, sf))
    return m.select("record_id", F.size("codes").cast("long").alias("n"), F.array_join(L.present_codes(F.col("codes")), ",").alias("codes"))


@query("S02_dictionary", "SELECT * FROM v_dict")
def dictionary(spark, sf):
    return V.dictionary(spark, sf)


@query("L01_present_codes", "SELECT record_id, list(code ORDER BY code) AS codes FROM v_codes GROUP BY record_id")
def present(spark, sf):
    m = L.code_maps(V.codes(spark, sf))
    return m.select("record_id", L.present_codes(F.col("codes")).alias("codes"))


@query("L02_multi_hot", "SELECT record_id, list(y ORDER BY label) AS hot FROM v_pred GROUP BY record_id HAVING sum(y) > 0")
def hot(spark, sf):
    space = V.dictionary(spark, sf).agg(F.array_sort(F.collect_set("code")).alias("space"))
    m = L.code_maps(V.codes(spark, sf)).crossJoin(F.broadcast(space))
    return m.select("record_id", L.multi_hot(F.map_keys("codes"), F.col("space")).alias("hot"))


@query("L03_category_members", """SELECT 'diagnostic' AS category, list(code ORDER BY code) AS members FROM v_dict WHERE diagnostic
    UNION ALL SELECT 'rhythm', list(code ORDER BY code) FROM v_dict WHERE rhythm""")
def members(spark, sf):
    return L.category_members(V.dictionary(spark, sf), ["diagnostic", "rhythm"])


@query("L04_superclasses", """SELECT record_id, list(DISTINCT superclass ORDER BY superclass) AS superclasses FROM v_codes JOIN v_dict USING (code) WHERE diagnostic GROUP BY record_id""")
def supers(spark, sf):
    return L.superclasses(V.codes(spark, sf), V.dictionary(spark, sf))


@query("L05_code_prevalence", """SELECT code, superclass, diagnostic, rhythm, coalesce(n, 0)::BIGINT AS n, round(100.0::DOUBLE * coalesce(n, 0) / (SELECT count(*) FROM v_records), 3) AS percent
    FROM v_dict LEFT JOIN (SELECT code, count(*) AS n FROM v_codes GROUP BY code) USING (code)""")
def prevalence(spark, sf):
    return L.code_prevalence(V.codes(spark, sf), V.dictionary(spark, sf), V.records(spark, sf).count())


@query("L06_superclass_prevalence", """SELECT superclass, coalesce(n, 0)::BIGINT AS n, round(100.0::DOUBLE * coalesce(n, 0) / (SELECT count(*) FROM v_records), 2) AS percent
    FROM (SELECT DISTINCT superclass FROM v_dict) LEFT JOIN (SELECT superclass, count(DISTINCT record_id) AS n FROM v_codes JOIN v_dict USING (code) WHERE diagnostic GROUP BY 1) USING (superclass)""")
def super_prevalence(spark, sf):
    return L.superclass_prevalence(V.codes(spark, sf), V.dictionary(spark, sf), V.records(spark, sf).count())


@query("L07_labels_per_record", """SELECT n_codes, count(*) AS n_records FROM (SELECT record_id, count(code) AS n_codes FROM v_records LEFT JOIN v_codes USING (record_id) GROUP BY record_id) GROUP BY n_codes""")
def per_record(spark, sf):
    return L.labels_per_record(V.codes(spark, sf), V.records(spark, sf))


@query("L08_records_per_patient", """SELECT count(*) AS patients, count(*) FILTER (n > 1) AS several, max(n) AS most FROM (SELECT patient_id, count(*) AS n FROM v_records GROUP BY 1)""")
def per_patient(spark, sf):
    return L.records_per_patient(V.records(spark, sf))


@query("L09_clean_age", "SELECT record_id, nullif(age, 300.0) AS age FROM v_records")
def ages(spark, sf):
    return V.records(spark, sf).select("record_id", L.clean_age(F.col("age")).alias("age"))


@query("L10_demographics", """SELECT count(*) AS n, count(DISTINCT patient_id) AS patients, quantile_cont(nullif(age, 300.0), 0.5) AS median_age, round(avg(nullif(age, 300.0)), 6) AS mean_age,
    count(*) FILTER (age = 300.0) AS sentinel_ages, count(*) FILTER (nullif(age, 300.0) IS NULL) AS missing_ages, count(*) FILTER (sex = 0) AS sex0, count(*) FILTER (sex = 1) AS sex1,
    count(DISTINCT device) AS devices, count(DISTINCT site) AS sites FROM v_records""")
def demographics(spark, sf):
    return L.demographics(V.records(spark, sf))


@query("L11_missingness", """SELECT * FROM (SELECT 'age' AS "column", round(100.0::DOUBLE * count(*) FILTER (age IS NULL) / count(*), 2) AS percent_null FROM v_records) WHERE percent_null > 0""")
def missing(spark, sf):
    return L.missingness(V.records(spark, sf))


@query("L12_split", "SELECT record_id, CASE WHEN fold <= 8 THEN 'train' WHEN fold = 9 THEN 'val' ELSE 'test' END AS split FROM v_records")
def split(spark, sf):
    return V.records(spark, sf).select("record_id", L.split_of(F.col("fold")).alias("split"))


_MANIFEST = """SELECT record_id, patient_id, fold, CASE WHEN fold <= 8 THEN 'train' WHEN fold = 9 THEN 'val' ELSE 'test' END AS split,
    coalesce(codes, []::VARCHAR[]) AS codes, coalesce(supers, []::VARCHAR[]) AS superclasses,
    list_contains(coalesce(supers, []), 'AFRICA')::INT AS is_africa, list_contains(coalesce(supers, []), 'AMERICA')::INT AS is_america, list_contains(coalesce(supers, []), 'ASIA')::INT AS is_asia,
    list_contains(coalesce(supers, []), 'EUROPE')::INT AS is_europe, list_contains(coalesce(supers, []), 'MIDDLE EAST')::INT AS is_middle_east
    FROM v_records LEFT JOIN (SELECT record_id, list(code ORDER BY code) AS codes FROM v_codes GROUP BY 1) USING (record_id)
    LEFT JOIN (SELECT record_id, list(DISTINCT superclass ORDER BY superclass) AS supers FROM v_codes JOIN v_dict USING (code) WHERE diagnostic GROUP BY 1) USING (record_id)"""


@query("L13_manifest", _MANIFEST)
def manifest(spark, sf):
    return L.manifest(V.records(spark, sf), V.codes(spark, sf), V.dictionary(spark, sf))


@query("L14_group_leaks", "SELECT device, count(DISTINCT site) AS parts FROM v_records GROUP BY device HAVING count(DISTINCT site) > 1")
def leaks(spark, sf):
    return L.group_leaks(V.records(spark, sf), "device", "site")


@query("L15_split_balance", f"""SELECT split, round(avg(is_africa), 6) AS is_africa, round(avg(is_america), 6) AS is_america, round(avg(is_asia), 6) AS is_asia, round(avg(is_europe), 6) AS is_europe,
    round(avg(is_middle_east), 6) AS is_middle_east FROM ({_MANIFEST}) GROUP BY split""")
def balance(spark, sf):
    return L.split_balance(manifest(spark, sf))


@query("L16_positive_weights", """SELECT label, round(CASE WHEN sum(y) IN (0, count(*)) THEN 1.0 ELSE least((count(*) - sum(y))::DOUBLE / sum(y), 20.0) END, 6) AS weight FROM v_pred GROUP BY label""")
def weights(spark, sf):
    return L.positive_weights(V.predictions(spark, sf))


@query("L17_input_gate", """WITH s AS (SELECT vec_id AS record_id, len(embedding) AS n, 10 + vec_id % 6 - 3 AS fs FROM embeddings)
    SELECT record_id, fs > 0 AS ok, fs > 0 AND n / fs::DOUBLE >= 5.0 AS reliable FROM s""")
def gate(spark, sf):
    e = V.table(spark, sf, "embeddings")
    s = e.select(F.col("vec_id").alias("record_id"), (10 + F.col("vec_id") % 6 - 3).alias("fs"), F.array_repeat("embedding", 12).alias("signal"))
    return L.input_gate(s).select("record_id", "ok", "reliable")
