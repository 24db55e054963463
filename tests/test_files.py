"""Signal files of every kind, good and bad ones side by side."""

import json

import pytest

from tallyweave.sources import feedback_store, files


def test_signals_from_json_csv_and_txt(spark, tmp_path):
    two = [[1.0, 2.0, 3.0], [4.0, 5.0, 6.5]]
    turned = [list(x) for x in zip(*two)]
    texts = {
        "a.json": json.dumps({"fs": 100, "signal": two}), "b.json": json.dumps({"sampling_rate": 250.0, "signal": turned}), "c.json": json.dumps(two), "d.csv": "1,2 , 3\n4,5,6.5\n",
        "e.txt": "# leads\n1 4\r\n2\t5\n\n3   6.5  # last\n", "f.CSV": "1,2,3\n4,x,6\n", "g.txt": "1 2 3\n4 5\n", "h.csv": "", "i.json": "{broken", "j.json": json.dumps({"signal": two}), "k.png": "PNG", "l.csv": "1,2,3\n4,5,6\n7,8,9\n",
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    good, bad = files.read_signals(spark, str(tmp_path), leads=2)
    got = {r.path.rsplit("/", 1)[1]: (r.fs, [list(x) for x in r.signal]) for r in good.collect()}
    assert got == {"a.json": (100.0, two), "b.json": (250.0, two), "c.json": (None, two), "d.csv": (None, two), "e.txt": (None, two)}
    why = {r.path.rsplit("/", 1)[1]: r.reason for r in bad.collect()}
    assert {k: v for k, v in why.items() if k != "h.csv"} == {"f.CSV": "no number", "g.txt": "ragged", "i.json": "no signal", "j.json": "no rate", "k.png": "unknown ending", "l.csv": "no lead axis"}


def reviews(spark, rows):
    full = [(k, "s1", None, "r1", "m", None, f"rec-{k}", {"A": 0.4}, True, findings, missed) for k, findings, missed in rows]
    return spark.createDataFrame(full, feedback_store.REVIEWS)


def test_feedback_store_appends_whole_batches_once(spark, tmp_path):
    store = feedback_store.FeedbackStore(spark, str(tmp_path / "store"))
    finding = lambda label, verdict, rate=None: (label, None, 0.7, 0.4, rate is not None, rate, verdict, None)
    one = reviews(spark, [("a", [finding("A", "correct"), finding("B", "incorrect", 0.1)], [("C", 0.3, None)]), ("b", [], None)])
    assert store.append(one, "day1") and not store.append(one, "day1")
    with pytest.raises(ValueError):
        store.append(reviews(spark, [("c", [finding("A", "maybe")], [])]), "day2")
    assert store.append(reviews(spark, [("c", [finding("A", "uncertain")], [])]), "day2")
    assert {n: store.read(n).count() for n in feedback_store.TABLES} == {"sessions": 2, "reports": 3, "findings": 3, "ratings": 3, "missed": 1}
    got = sorted((r.label, r.verdict, r.exploratory, r.sampling_rate) for r in store.rated().collect())
    assert got == [("A", "correct", False, 1.0), ("A", "uncertain", False, 1.0), ("B", "incorrect", True, 0.1)]
    one.limit(1).write.parquet(str(tmp_path / "store" / "findings" / "batch=broken"))  # a batch that was never finished
    assert store.read("ratings").count() == 3 and store.read("reports").where("thresholds['A'] = 0.4").count() == 3
