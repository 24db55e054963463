"""Changes between two records: gates, empty pairs, texts and tampered claims."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import changes as C
from tallyweave.operators import views as V
from tallyweave.plans import changes_queries as Q
from tallyweave.plans import serial_queries as S

SF = "/root/testdata/sf0.001"

_SPAN = "prior_id long, current_id long, measure string, prior_value double, current_value double, diff double, significant boolean, direction string, suppressed string"


def _deltas(spark):
    days = (datetime(2024, 1, 2), datetime(2024, 2, 2))
    pairs = spark.createDataFrame([(1, 2, *days), (3, 4, *days)], "prior_id long, current_id long, prior_ts timestamp, current_ts timestamp")
    spans = spark.createDataFrame([(1, 2, "qt", 380.0, 430.0, 50.0, True, "longer", None), (1, 2, "pr", 100.0, 150.0, 50.0, False, None, "no P wave")], _SPAN)
    levels = spark.createDataFrame([(1, "V1", 0.0), (2, "V1", -0.2), (1, "V2", 0.15), (2, "V2", 0.0), (1, "V3", 0.0), (2, "V3", 0.05), (1, "V4", None), (2, "V4", 0.3)], "record_id long, lead string, level double")
    found = spark.createDataFrame([(1, 2, "AF", "resolved", True), (1, 2, "SR", "new", True), (1, 2, "LVH", "new", False)], "prior_id long, current_id long, label string, change string, rhythm boolean")
    studies = spark.createDataFrame([(1, 3, "ok"), (2, 9, "noisy"), (3, 0, "ok")], "record_id long, beats long, quality string")
    return C.delta_rows(pairs, spans, C.lead_changes(pairs, levels), found, studies)


def test_lead_rise_reads_elevated_without_being_significant(spark):
    pairs = spark.createDataFrame([(1, 2)], "prior_id long, current_id long")
    levels = spark.createDataFrame([(1, "a", 0.0), (2, "a", 0.05), (1, "b", 0.05), (2, "b", 0.0), (1, "c", 0.0), (2, "c", -0.3), (1, "d", 0.0)], "record_id long, lead string, level double")
    rows = {r.lead: (r.significant, r.direction) for r in C.lead_changes(pairs, levels).collect()}
    assert rows == {"a": (False, "elevated"), "b": (False, "unchanged"), "c": (True, "depressed")}


def test_narrative_and_pair_without_changes(spark):
    rows = {r.prior_id: r.report for r in C.change_narrative(_deltas(spark), "SR").collect()}
    assert rows[1] == (
        "Compared with the prior study of 2024-01-02: AF has reverted to SR. New since the prior study: LVH. New ST-segment depression in V1 (+0.00 mV to -0.20 mV). "
        "Previously noted ST deviation in V2 has resolved. The qt is longer from 380 to 430 (+50).\nImpression: interval change, new LVH.\n"
        "Not compared: pr: no P wave.\nData quality: current study flagged noisy; prior beat built from only 3 beats."
    )
    assert rows[3] == "Compared with the prior study of 2024-01-02: no significant change.\nImpression: no significant change."


def test_audit_of_true_tampered_and_null_texts(spark):
    d = _deltas(spark)
    told = C.change_narrative(d, "SR")
    audit = lambda t: {r.prior_id: r.unsupported for r in C.audit_claims(told.withColumn("report", t), d).collect()}
    assert audit(F.col("report")) == {1: [], 3: []}
    false = F.replace(F.replace("report", F.lit("longer"), F.lit("shorter")), F.lit("study: LVH"), F.lit("study: LVH and MI"))
    assert audit(F.concat(false, F.lit(" The pr is longer. No longer present: SR.")))[1] == ["direction:qt", "interval:pr", "new:MI", "resolved:SR"]
    assert audit(F.lit(None).cast("string")) == {1: [], 3: []}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_pairs_meet_whole_records_and_not_their_rows(spark):
    got = Q.deltas(spark, SF)
    joins = [line for line in got._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join [" in line]
    assert joins and not [line for line in joins if "lead#" in line or "record_id#" in line]
    assert not [line for line in joins if "_id#" in line and ("label#" in line or "measure#" in line)]  # only rhythms by code and figures by measure
    pairs = V.pairs(spark, SF)
    want = S.P.finding_changes(pairs, V.predictions(spark, SF))
    assert {tuple(r) for r in want.collect()} == {tuple(r) for r in S.finding_changes(spark, SF).select(*want.columns).collect()}
    told = C.change_narrative(got, "NATION_4", ["changes"])
    assert sorted(map(str, C.audit_claims(told).collect())) == sorted(map(str, C.audit_claims(told.drop("changes"), got).collect()))
