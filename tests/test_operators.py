"""Hand-made cases for the operators."""

import math

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import checks, labels, retrieval, scoring, serial, subgroups


def test_age_sentinel_and_bands(spark):
    df = spark.createDataFrame([(300.0,), (None,), (0.0,), (18.0,), (39.9,), (40.0,), (75.0,)], "age double")
    got = df.select(labels.clean_age(F.col("age")).alias("a"), subgroups.age_band(F.col("age")).alias("b")).collect()
    assert [r.a for r in got][:2] == [None, None] and [r.b for r in got] == [None, None, None, "18-39", "18-39", "40-59", "75+"]


def test_unknown_fold_is_an_error(spark):
    df = spark.createDataFrame([(1,), (9,), (10,)], "fold int")
    assert [r[0] for r in df.select(labels.split_of(F.col("fold"))).collect()] == ["train", "val", "test"]
    with pytest.raises(Exception, match="no split"):
        spark.createDataFrame([(11,)], "fold int").select(labels.split_of(F.col("fold"))).collect()


def test_leak_is_named(spark):
    df = spark.createDataFrame([(1, "train"), (1, "test"), (2, "val")], "patient_id int, split string")
    with pytest.raises(ValueError, match=r"\[1\]"):
        labels.assert_no_leak(df)
    labels.assert_no_leak(df.where("patient_id = 2"))


def test_auroc_by_hand_with_ties_and_one_class(spark):
    rows = [("a", 0.1, 0), ("a", 0.5, 1), ("a", 0.5, 0), ("a", 0.9, 1), ("b", 0.3, 1)]
    got = {r.label: r.auroc for r in scoring.auroc(spark.createDataFrame(rows, "label string, p double, y int"), ["label"]).collect()}
    assert got["a"] == pytest.approx(3.5 / 4) and got["b"] is None


def test_temperature_keeps_the_order_and_lowers_the_loss(spark):
    rows = [(i, "a", int(i % 10 < 3 + 5 * (i % 2)), 1 / (1 + math.exp(-(4.0 if i % 2 else -4.0) - i / 1000))) for i in range(400)]
    df = spark.createDataFrame(rows, "record_id int, label string, y int, p double").withColumn("z", F.log(F.col("p") / (1 - F.col("p"))))
    cal = scoring.apply_temperature(df, scoring.temperatures(df))
    before = scoring.brier_and_nll(df).first().nll
    after = scoring.brier_and_nll(cal.withColumn("p", F.col("p_cal"))).first().nll
    a, b = scoring.auroc(df, ["label"]).first().auroc, scoring.auroc(cal, ["label"], "p_cal").first().auroc
    assert after < before and a == pytest.approx(b, abs=1e-4)


def test_step_up_keeps_nulls(spark):
    rows = [("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None)]
    got = {r.label: r.q_value for r in subgroups.step_up(spark.createDataFrame(rows, "label string, p_value double")).collect()}
    assert got["a"] == pytest.approx(0.03) and got["c"] == pytest.approx(0.04) and got["b"] == pytest.approx(0.04) and got["d"] is None


def test_gap_words(spark):
    df = spark.createDataFrame([(60,), (3599,), (7200,), (86400,), (86400 * 61,), (86400 * 800,)], "s long")
    got = [r[0] for r in df.select(serial.gap_phrase(F.col("s"))).collect()]
    assert got == ["1 minute", "59 minutes", "2 hours", "1 day", "2 months", "2 years"]


def test_noise_cells(spark):
    df = spark.createDataFrame([("I, aVL",), ("alles",), ("",), (None,)], "c string")
    assert [r[0] for r in df.select(checks.parse_affected(F.col("c"))).collect()] == [["I", "AVL"], ["ALL"], [], []]


def test_passages_of_findings_and_their_codes(spark):
    findings = spark.createDataFrame([(1, 10), (1, 11), (2, 12)], "record_id long, query_id long")
    results = spark.createDataFrame([(10, 7, 0.5), (11, 7, 0.9), (11, 8, 0.9), (11, 9, 0.1)], "query_id long, id long, score double")
    passages = retrieval.finding_passages(findings, results, most=2)
    assert sorted(map(tuple, passages.collect())) == [(1, 7, 0.9, 0), (1, 8, 0.9, 1)]
    texts = spark.createDataFrame([(7, "Left bundle"), (8, "Branch block"), (9, "Fever")], "id long, text string")
    vocabulary = spark.createDataFrame([("A", "bundle branch"), ("B", "fever"), ("C", "")], "code string, phrase string")
    context = retrieval.context_codes(passages, texts, vocabulary)
    assert context.collect() == [(1, "A")]
    told = spark.createDataFrame([(1, "A"), (1, "A"), (2, "A"), (1, "B")], "record_id long, code string")
    assert sorted(map(tuple, retrieval.attributed(told, context).collect())) == [("A", 2, 1), ("B", 1, 0)]


def test_power_medians_keep_a_row_for_an_empty_set(spark):
    rows = [("a", 500, 0.1, 0.2, 0.3), ("b", 900, 0.3, 0.4, None)]
    table = spark.createDataFrame(rows, "label string, n_train long, width double, boot_width double, leverage double")
    got = {r.kind: tuple(r)[1:] for r in subgroups.power_medians(table, ["c"], 400).collect()}
    assert got["rare"] == got["target"] == (0, None, None, None)
    assert got["all"] == (2, pytest.approx(0.2), pytest.approx(0.3), pytest.approx(0.3))
    none = {r.kind: r.n_labels for r in subgroups.power_medians(table.limit(0), ["c"], 400).collect()}
    assert none == {"rare": 0, "target": 0, "all": 0}


def test_excluded_pairs_come_from_one_listing_of_a_record(spark):
    found = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "b"), (2, "d"), (3, "a")], "record_id long, label string")
    rules = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "d")], "a string, b string")
    got = checks.exclusive_pairs(found, rules)
    assert sorted(map(tuple, got.collect())) == [(1, "a", "b"), (1, "b", "c")]
    assert not [line for line in got._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join [" in line and "record_id" in line]
