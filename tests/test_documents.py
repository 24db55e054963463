"""Nested exports, impressions, examples and prompts on made-up records."""

import json

from pyspark.sql import functions as F

from tallyweave.operators import documents as D
from tallyweave.operators.exports import bundle_faults

HEAD = "record_id long, subject string, effective string, issuer_version string, review boolean, conclusion string"
FOUND = "record_id long, code string, display string, confidence double, needs_review boolean, leads array<string>"


def export(spark):
    heads = [(1, "Patient/7", "2024-01-01", "2", True, "c"), (2, None, "2024-01-02", "2", False, None), (3, None, None, None, None, "c")]
    found = [(1, "B", "bee", 0.123456, True, ["I", "V2"]), (1, "A", "ay", 0.9, False, []), (1, "C", "cee", None, None, None), (2, "A", 'q"uote', 0.5, False, None), (9, "A", "ay", 0.5, False, None)]
    measures = [(1, "qt", 400.26), (1, "heart_rate", 61.0), (1, "pr", None), (1, "made up", 3.0), (2, "qrs", 90.0)]
    mapping = [("A", "I10", "Ten", "candidate"), ("B", "I09", "Nine", "definitional"), ("C", "I10", "Other", "candidate"), ("D", None, None, "none")]
    return D.nested_bundles(
        spark.createDataFrame(heads, HEAD), spark.createDataFrame(found, FOUND).repartition(3), spark.createDataFrame(measures, "record_id long, name string, value double"),
        spark.createDataFrame(mapping, "code string, target string, display string, tier string"),
    )


def test_bundles_hold_their_children_in_order(spark):
    got = {r.record_id: (r.status, json.loads(r.bundle)) for r in export(spark).collect()}
    assert sorted(got) == [1, 2, 3] and [got[k][0] for k in (1, 2, 3)] == ["preliminary", "final", "final"]
    entries = [e["resource"] for e in got[1][1]["entry"]]
    assert [e["resourceType"] for e in entries] == ["Device", "DiagnosticReport"] + ["Observation"] * 5
    assert [e.get("valueQuantity", {}).get("value") for e in entries[5:]] == [61.0, 400.3]
    assert [e["valueCodeableConcept"]["coding"][0]["code"] for e in entries[2:5]] == ["A", "B", "C"]
    assert [c["coding"][0]["code"] for c in entries[1]["conclusionCode"]] == ["I09", "I10"]
    assert entries[3]["note"] == [{"text": "Implicated leads: I, V2"}] and entries[3]["extension"][0]["valueDecimal"] == 0.1235
    assert "note" not in entries[2] and "valueQuantity" not in entries[2] and all(e["subject"]["reference"] == "Patient/7" for e in entries[1:])
    assert [e["resource"]["resourceType"] for e in got[2][1]["entry"]] == ["Device", "DiagnosticReport", "Patient", "Observation", "Observation"]
    assert "birthDate" not in json.dumps(got[2][1]) and [x["resource"]["resourceType"] for x in got[3][1]["entry"]] == ["Device", "DiagnosticReport", "Patient"]


def test_bundles_have_no_fault_and_the_same_names_in_every_run(spark):
    b = export(spark)
    refs, targets = D.bundle_references(b)
    assert refs.count() == 5 + 2 + 5 + 2 + 3 + 1  # results, devices, the subjects of records 2 and 3
    assert bundle_faults(refs, targets, ["preliminary", "final", "active"]).count() == 0
    broken = b.withColumn("bundle", F.regexp_replace("bundle", '"fullUrl":"[^"]*","resource":\\{"resourceType":"Device"', '"fullUrl":"urn:uuid:x","resource":{"resourceType":"Device"'))
    assert {r.fault for r in bundle_faults(*D.bundle_references(broken), ["preliminary", "final", "active"]).collect()} == {"unresolved"}
    assert sorted(map(str, b.collect())) == sorted(map(str, export(spark).collect()))


def sentences(spark, cases, **options):
    """cases: record_id -> (codes, rate, review)."""
    group = ["infarction", "rhythm", "chamber", "normal"]
    words = [(f"c{k:02}", group[k % 3], f"word {k} " + "long " * (k % 5), f"word {k}", False, k == 12, False, False) for k in range(20)]
    words += [("NORM", "normal", "normal ECG", "normal ECG", False, False, True, False), ("SR", "rhythm", "sinus rhythm", "sinus rhythm", False, False, False, True)]
    words += [(f"t{k}", "infarction", f"place{k} infarct", "infarct", True, False, False, False) for k in range(3)]
    vocabulary = spark.createDataFrame(words, "code string, group string, phrase string, entity string, localized boolean, urgent boolean, normal boolean, benign boolean")
    records = spark.createDataFrame([(k, rate, review) for k, (_, rate, review) in cases.items()], "record_id long, rate double, review boolean")
    found = spark.createDataFrame([(k, c) for k, (codes, _, _) in cases.items() for c in codes], "record_id long, code string")
    return {r.record_id: r.impression for r in D.one_line_impressions(records, found, vocabulary, **options).collect()}


def test_impressions_of_none_few_and_many_findings(spark):
    tail = f"; {D.ATTRIBUTION}."
    every = [f"c{k:02}" for k in range(20)]
    got = sentences(spark, {
        0: ([], 60.0, True), 1: (["NORM", "SR"], 72.5, False), 2: (["NORM"], None, False), 3: (["t0", "t1"], None, False), 4: (["SR", "c00", "c02", "c03", "c05"], None, True),
        5: (["c00", "c02", "c03", "c05", "c06"], 80.0, None), 6: (every, 61.0, True), 7: (["NORM", "t1", "mystery"], 50.0, False), 8: (["c12"], None, False), 9: (["SR"], None, False),
    })
    assert got[0] == f"No diagnostic findings surfaced{tail}"
    assert got[1] == "Sinus rhythm at 72 bpm — normal ECG" + tail and got[2] == "Normal ECG" + tail
    assert got[3] == "Multi-territory infarct" + tail
    assert got[4].startswith("Sinus rhythm with word 0 , word 3 long long long , word 2 long long , and word 5 ") and D.REVIEW_CLAUSE in got[4] and "plus" not in got[4]
    assert "plus 1 further finding;" in got[5] and got[5].startswith("Rhythm at 80 bpm with ")
    assert got[6].startswith("URGENT — word 12 long long : Word 1 long  at 61 bpm with") and len(got[6]) <= 300 and "further findings" in got[6]
    assert got[7] == "Rhythm at 50 bpm with place1 infarct and mystery" + tail
    assert got[8] == "URGENT — word 12 long long : Abnormal ECG" + tail and got[9] == "Sinus rhythm" + tail
    short = sentences(spark, {6: (every, 61.0, True)}, max_chars=10)
    assert short[6].endswith(f"Word 1 long  at 61 bpm, plus 18 further findings; {D.REVIEW_CLAUSE}{tail}")


def training(spark, parts):
    records = [(k, 300.0 if k % 5 == 0 else 40.0 + k, k % 2, ["LAD", "MID", None][k % 3], 70.0 if k % 4 else None, k % 7 != 0) for k in range(1, 60)]
    codes = [(k, c) for k in range(1, 60) if k not in (10, 11) for c in ("A", "B", "X") if (k + len(c) * ord(c)) % 3] + [(4, "A"), (4, "A")]
    vocabulary = [("A", 1, "HEART", False, "I"), ("B", 0, "RHYTHM", True, "")]
    r = spark.createDataFrame(records, "record_id long, age double, sex int, axis string, rate double, validated boolean").repartition(parts)
    c = spark.createDataFrame(codes, "record_id long, code string").repartition(parts, "code")
    v = spark.createDataFrame(vocabulary, "code string, rank int, group string, rhythm boolean, leads string")
    return D.training_examples(r, c, v, "HEART")


def test_examples_agree_over_partitions_and_rejects_are_kept(spark):
    (one, gone), (two, gone_too) = training(spark, 1), training(spark, 9)
    a, b = ({r.record_id: r for r in x.collect()} for x in (one, two))
    assert a == b and set(gone.collect()) == set(gone_too.collect())
    lost = {r.record_id: r.reason for r in gone.collect()}
    assert not set(a) & set(lost) and set(a) | set(lost) == set(range(1, 60)) and set(lost.values()) == {"not validated", "no known code"}
    drawn = [f.confidence for r in a.values() for f in r.findings]
    assert all(0.30 <= x <= 0.49 or 0.82 <= x <= 0.99 for x in drawn) and any(x < 0.5 for x in drawn)
    assert all((r.age is None) == (k % 5 == 0) for k, r in a.items()) and all(r.axis in ("LAD", None) for r in a.values())
    assert any("Left axis deviation." in r.report for r in a.values())


def test_prompts_show_every_part(spark):
    rows = training(spark, 2)[0].withColumn("context", F.when(F.col("record_id") % 2 == 0, "Reference: x"))
    chat = {r.record_id: r for r in D.chat_rows(rows, "Rules.", "es", {"es": " Spanish."}).collect()}
    src = {r.record_id: r for r in rows.collect()}
    for k, c in chat.items():
        lines = c.prompt.split("\n")
        assert c.system == "Rules. Spanish." and c.completion == src[k].report and lines[-1] == "Write the report now."
        assert lines[0] == ("Patient: " + (f"{src[k].age}y " if src[k].age else "") + src[k].sex)
        assert ("axis left axis deviation" in c.prompt) == (src[k].axis == "LAD") and ("rate 70 bpm" in c.prompt) == (k % 4 != 0)
        assert ("\n\nReference: x\n\n" in c.prompt) == (k % 2 == 0)
        assert all(f"- {f.code} ({f.group}): confidence={f.confidence:.2f}"[:-1] in c.prompt for f in src[k].findings)
        assert ("leads=n/a" in c.prompt) == any(f.code == "B" for f in src[k].findings)
