"""Hand-made cases of report rendering, asserted findings, terms, wave regions, panels, resets and rate limits."""

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import narratives as N
from tallyweave.operators import regions as R
from tallyweave.streaming import monitor as M


def test_reports(spark):
    vocabulary = spark.createDataFrame([("AF", 1, "RHYTHM", True, "I"), ("MI", 0, "HEART", False, "II"), ("ST", 0, "HEART", False, "I")], "code string, rank int, group string, rhythm boolean, leads string")
    found = spark.createDataFrame([(1, "ST", 0.4), (1, "AF", 0.3), (1, "MI", 0.9), (1, "XX", 0.9)], "record_id long, code string, confidence double")
    all_records = spark.createDataFrame([(1, 71.6), (2, None)], "record_id long, rate double")
    rows = all_records.join(N.structured_findings(found, vocabulary), "record_id", "left")
    got = {r.record_id: r.report for r in N.render_reports(rows, "HEART").collect()}
    assert got[1] == "Findings: Possible Rhythm: AF. Rate 72 bpm. HEART: MI, ST.\nImpression: MI, ST, AF"
    assert got[2] == "Findings: Normal. No HEART finding.\nImpression: Normal."
    assert N.render_reports(rows, "HEART", "English").where("record_id = 2").first().report == got[2]
    with pytest.raises(ValueError):
        N.render_reports(rows, "HEART", "xx")


def test_longest_match(spark):
    t = spark.createDataFrame([(1, "old anterior infarct"), (2, "infarct, anterior infarct"), (3, ""), (4, None)], "id long, text string")
    p = spark.createDataFrame([("MI", "infarct"), ("AMI", "anterior infarct"), ("NO", "")], "code string, phrase string")
    assert {r.id: r.codes for r in N.asserted_findings(t, p).collect()} == {1: ["AMI"], 2: ["AMI", "MI"], 3: [], 4: []}


def test_terms_fall_back_to_the_head_noun(spark):
    t = spark.createDataFrame([(2, "Waves  everywhere"), (1, "a wave and WAVES"), (3, None)], "id long, text string")
    got = {r.code: r for r in N.term_coverage(t, {"W": ["tall waves", "waves"], "N": ["nothing"]}).collect()}
    assert (got["W"].term, got["W"].occurrences, got["W"].first_id, got["W"].example) == ("waves", 3, 1, "a wave and waves")
    assert (got["N"].occurrences, got["N"].first_id) == (0, None)


def test_region_priority_and_verdict(spark):
    s = spark.createDataFrame([(1, "I", t, 1.0) for t in range(10)] + [(2, "I", 0, 0.0)], "record_id long, lead string, t int, value double")
    b = spark.createDataFrame([(1, "I", 3), (1, "I", 6)], "record_id long, lead string, t int")
    m = R.region_mass(s, b, {"qrs": (0, 1), "st": (1, 2), "t_wave": (2, 3), "p": (-1, 0)})
    got = {r.record_id: r for r in m.collect()}
    # 3 and 6 are QRS, 4 and 7 ST, 5 and 8 T (5 is also the P of the next beat), 2 is P
    assert [round(got[1][c], 6) for c in R.REGIONS] == [0.2, 0.2, 0.2, 0.1, 0.3]
    assert [got[2][c] for c in R.REGIONS] == [0.0, 0.0, 0.0, 0.0, 1.0] and got[2].n_beats == 0
    v = m.withColumn("n_beats", F.lit(3)).where("record_id = 1").select(R.region_verdict(F.lit("repolarization")).alias("a"), R.region_verdict(F.lit("rhythm_irregular")).alias("b"), R.region_verdict(F.lit("x")).alias("c"))
    assert tuple(v.first()) == ("consistent", "consistent", "inconclusive")


def test_panel_and_resets(spark):
    hops = spark.createDataFrame([("s", h, "A", h != 4, 0.9) for h in range(1, 8)] + [("s", 3, "B", True, 0.95)], "source string, hop int, code string, fired boolean, value double")
    got = {r.hop: r for r in M.panel(hops, 2, 3, ["A"]).collect()}
    assert (got[1].confirmed, got[1].pending, got[1].fired, got[1].alarm) == ([], ["A"], ["A"], False)
    assert (got[3].confirmed, got[3].pending, got[3].fired, got[3].alarm) == (["A"], ["B"], ["B", "A"], True)
    two = M.with_epochs(hops, spark.createDataFrame([("s", 6)], "source string, hop int"))
    events = M.confirmation_events(two, 2, 3, ("source", "epoch")).where("code = 'A'").orderBy("hop").collect()
    assert [(r.epoch, r.hop, r.event) for r in events] == [(0, 2, "onset"), (1, 7, "onset")]


def test_rate_limits(spark):
    hits = spark.createDataFrame([("k", t, i) for i, t in enumerate([0.0, 1.0, 2.0, 10.0, 11.0])] + [("j", 5.0, 9), (None, 1.0, 10)], "key string, t double, id long")
    got = sorted(tuple(r) for r in M.rate_limits(hits, 2, 10.0).collect())
    assert [r[3:] for r in got] == [(True, 1, 0.0), (True, 1, 0.0), (True, 0, 0.0), (False, 0, 8.0), (True, 1, 0.0), (True, 0, 0.0)]


def test_plural_forms_and_accents_of_terms(spark):
    assert N.inflected("auriculares") == ["auricular", "auriculare", "auriculars", "auriculares"] and N.inflected("does") == ["doe", "does"] and N.inflected("bus") == ["bus", "buss"] and N.inflected("en") == ["en", "ens"]
    t = spark.createDataFrame([(1, "La EXTRASÍSTOLE  auricular, y extrasistoles auriculares"), (2, None)], "id long, text string")
    row = N.term_coverage(t, {"a": ["Extrasístoles auriculares"], "b": ["nada"]}).where("code = 'a'").first()
    assert (row.occurrences, row.first_id) == (2, 1) and "extrasistole auricular" in row.example


def test_phrases_of_several_words_overlap_and_long_vocabularies(spark):
    p = spark.createDataFrame([("P", "premature complexes"), ("A", "atrial premature complexes"), ("I", "injury, anteroseptal")] + [(f"c{k}", f"filler {k}") for k in range(20_000)], "code string, phrase string")
    t = spark.createDataFrame([(1, "atrial premature complexes"), (2, "premature complexes; atrial premature complexes."), (3, "injury, anteroseptal"), (4, "injury anteroseptal"), (5, "filler 19999 filler")], "id long, text string")
    assert {r.id: r.codes for r in N.asserted_findings(t, p).collect()} == {1: ["A"], 2: ["A", "P"], 3: ["I"], 4: [], 5: ["c19999"]}


def test_gate_notices_injected_findings_in_every_language(spark):
    rows = [(k, 60.0, "LAD", [(0, "A", "HEART", False, "I", 0.9)] + ([(1, "B", "HEART", False, "II", 0.9)] if k % 2 else [])) for k in range(1, 9)]
    s = spark.createDataFrame(rows, "record_id long, rate double, axis string, findings array<struct<rank:int,code:string,`group`:string,rhythm:boolean,leads:string,confidence:double>>")
    v = spark.createDataFrame([("en", "A", "Fibrillation"), ("en", "B", None), ("en", "C", "Block"), ("es", "A", "Fibrilación"), ("es", "B", "Isquemia"), ("es", "C", "Bloqueo")], "lang string, code string, phrase string")
    got = {r.lang: r for r in N.gate_parity(s, v, "HEART", {"en": "Complete block.", "es": "BLOQUEO completo."}, F.col("record_id") == 8, code="C").collect()}
    for lang in ("en", "es"):
        r = got[lang]
        assert (r.n, r.well_formed, r.detected, r.exact, r.unsupported, r.caught, r.informative, r.exact_informative_rate) == (8, 8, 8, 8, 0, 8, 7, 1.0)
    lost = N.gate_parity(s, v, "HEART", {"en": "Nothing of the sort.", "es": "Bloqueos."}, F.lit(True), code="C").collect()
    assert {r.lang: (r.caught, r.informative, r.exact_informative_rate) for r in lost} == {"en": (0, 0, None), "es": (0, 0, None)}


def test_arms_are_paired_by_record(spark):
    found = spark.createDataFrame([(1, "A"), (1, "B"), (2, "A"), (3, "A")], "record_id long, label string")
    texts = [(1, "x", "Findings: f\nImpression: alpha and beta"), (1, "y", "alpha"), (2, "x", "alpha, gamma. Start therapy"), (2, "y", "Alpha"), (3, "x", None), (4, "x", "gamma"), (4, "y", "gamma")]
    phrases = spark.createDataFrame([("A", "alpha"), ("B", "beta"), ("C", "Gamma")], "code string, phrase string")
    scores = N.arm_scores(spark.createDataFrame(texts, "record_id long, arm string, text string"), found, phrases, ["therapy"])
    got = {(r.record_id, r.arm): r for r in scores.collect()}
    assert got[1, "x"].coverage == 1.0 and got[1, "y"].coverage == 0.5 and got[3, "x"].coverage == 0 and got[4, "x"].coverage is None
    assert got[2, "x"].n_unsupported == 1 and got[2, "x"].treatment and not got[2, "y"].hallucinated and got[1, "x"].well_formed and not got[2, "x"].well_formed
    assert {(r.record_id, r.a, r.b) for r in N.arm_pairs(scores, "x", "y").collect()} == {(1, False, False), (2, True, False), (4, True, True)}
    summary = {r.arm: r for r in N.arm_summary(scores).collect()}
    assert (summary["x"].n, summary["x"].hallucination_rate, summary["y"].consistency_rate) == (4, 0.5, round(2 / 3, 4))
