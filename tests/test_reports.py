import random

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import distances as D
from tallyweave.operators import exports as E
from tallyweave.operators import reports as R
from tallyweave.operators import retrieval as K
from tallyweave.sources import files


def test_rouge_l_equals_the_plain_table(spark):
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice("abcdef") for _ in range(rnd.randint(0, 30))) for _ in range(40)] + [None]
    rows = [(str(i), a, texts[-i - 1]) for i, a in enumerate(texts)]

    def lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    got = {r.id: r.rouge_l for r in R.rouge_l(spark.createDataFrame(rows, "id string, hypothesis string, reference string")).collect()}
    for i, h, r in rows:
        h, r = (h or "").split(), (r or "").split()
        assert got[i] == pytest.approx(2 * lcs(h, r) / (len(h) + len(r)) if h or r else 0.0)


def test_bleu_of_a_short_hypothesis(spark):
    row = spark.createDataFrame([("1", "a", "a"), ("2", "", "a"), ("3", "a b c d", "a b c d")], "id string, hypothesis string, reference string")
    got = {r.id: r.bleu for r in K.bleu(row).collect()}
    assert got["1"] == pytest.approx(0.125**0.25) and got["2"] == 0 and got["3"] == pytest.approx(1.0)


def test_corpus_score_of_equal_texts(spark):
    row = spark.createDataFrame([("1", "a b c d", "a b c d")], "id string, hypothesis string, reference string")
    assert R.corpus_score(row).first().asDict() == {"bleu": 1.0, "rouge_1": 1.0, "rouge_2": 1.0, "rouge_l": 1.0, "n": 1}


def test_chunks(spark):
    long = ". ".join(f"Sentence number {k}\n of this text" for k in range(90)) + "."
    text = f"Short.\n\n{long}\n\n\n{'x' * 1000}\n\n tail \n\n" + "y" * 850 + "\n\n" + "z" * 60
    got = [r.chunk for r in R.chunk_rows(spark.createDataFrame([(1, text), (2, None), (3, ""), (4, " \n\n ")], "id long, text string")).orderBy("chunk_no").collect()]
    assert all(len(c) <= 900 or " " not in c for c in got) and all("\n" not in c for c in got)
    assert " ".join(" ".join(got).split()) == " ".join(text.split())
    # as many sentences as fit stand together, "tail" follows a chunk that is too long to take it, and so does "z"
    assert got[0].startswith("Short.") is True and got[-4:] == ["x" * 1000, "tail", "y" * 850, "z" * 60]
    packed = got[1:-4] if got[0] == "Short." else got[:-4]
    for a, b in zip(packed, packed[1:]):
        first = b.split(". ")[0] + "."
        assert len(a) + 1 + len(first) > 900
    few = [r.chunk for r in R.chunk_rows(spark.createDataFrame([(1, "a b.\n\nc d.\n\n" + "e" * 30)], "id long, text string"), most=20, least=9).collect()]
    assert few == ["a b. c d.", "e" * 30]


def test_beta_bounds_at_known_quantiles(spark):
    assert E.beta_quantile(0.05, 1, 1) == pytest.approx(0.05, abs=1e-9)
    assert E.beta_quantile(0.05, 3, 1) == pytest.approx(0.05 ** (1 / 3), abs=1e-9)
    assert E.beta_quantile(0.5, 20, 20) == pytest.approx(0.5, abs=1e-9)
    got = E.precision_bounds(spark.createDataFrame([("a", 10, 0, 0.5), ("b", 0, 10, 2.0)], "label string, correct long, incorrect long, mean double")).collect()
    assert got[0].lower == pytest.approx(E.beta_quantile(0.05, 20, 10)) and 0 < got[1].lower < 1


def test_review_sample_falls_through_full_buckets(spark):
    rows = spark.createDataFrame([(i, i % 2) for i in range(30)], "record_id long, odd int")
    got = E.review_sample(rows, [("a", F.expr("odd = 1")), ("b", F.expr("true"))], F.lit(""), 4).collect()
    assert sorted(r.record_id for r in got if r.bucket == "a") == [1, 3, 5, 7]
    assert sorted(r.record_id for r in got if r.bucket == "b") == [0, 2, 4, 6] and len(got) == 8


def test_low_pass_keeps_slow_waves_and_stops_fast_ones(spark):
    import math

    rows = [(1, lead, t, math.sin(2 * math.pi * t * f)) for lead, f in (("slow", 0.02), ("fast", 0.45)) for t in range(100)]
    got = D.low_pass(spark.createDataFrame(rows, "record_id long, lead string, t int, value double"), cut=0.15).where("t between 20 and 80")
    peak = {r["lead"]: r["m"] for r in got.groupBy("lead").agg(F.max(F.abs("value")).alias("m")).collect()}
    assert peak["slow"] > 0.9 and peak["fast"] < 0.1


def test_resample_keeps_a_line_and_its_size(spark):
    rows = [(1, "I", t, float(t)) for t in range(64)]
    df = spark.createDataFrame(rows, "record_id long, lead string, t int, value double")
    for n in (16, 48, 64, 100):
        got = D.resample(df, 64, n).orderBy("t").collect()
        assert [r.t for r in got] == list(range(n))
        assert all(r.value == pytest.approx(r.t * 64 / n, abs=1e-6) for r in got if 2 < r.t * 64 / n < 61)


def test_nearest_distance_of_empty_and_null(spark):
    q = spark.createDataFrame([(1, [0.0, 1.0]), (2, None)], "id long, vector array<double>")
    r = spark.createDataFrame([(5, [0.0, 0.0]), (6, [3.0, 1.0])], "id long, vector array<double>")
    assert [(x.id, x.distance) for x in D.nearest_distance(q, r).collect()] == [(1, 1.0)]
    assert D.nearest_distance(q.limit(0), r).count() == 0 and D.nearest_distance(q, r.limit(0)).count() == 0


def test_record_and_signal_files(spark, tmp_path):
    (tmp_path / "r.csv").write_text("record_id,patient_id,age,sex,device,site,rec_ts,fold,codes\n1,2,300,0,d,s,2020-01-01 00:00:00,9,\"{'A': 100.0, 'B': 0.0}\"\n2,2,x,1,,,,10,oops\n")
    got = files.read_records(spark, f"file://{tmp_path}/r.csv").orderBy("record_id").collect()
    assert got[0].codes == {"A": 100.0, "B": 0.0} and got[0].age == 300 and got[1].age is None and not got[1].codes
    signals = tmp_path / "signals"
    signals.mkdir()
    (signals / "a.json").write_text('{"fs": 100, "signal": [' + ",".join("[1.0, 2.0, 3.0]" for _ in range(12)) + "]}")
    (signals / "b.json").write_text('{"fs": 100, "signal": [' + ",".join("[" + ",".join(str(k) for k in range(12)) + "]" for _ in range(5)) + "]}")
    (signals / "c.json").write_text('{"fs": 100, "signal": [[1.0, 2.0], [1.0]]}')
    (signals / "d.json").write_text("not json")
    good, bad = files.read_signals(spark, f"file://{signals}")
    shapes = {r.path[-6]: (len(r.signal), len(r.signal[0]), r.fs) for r in good.collect()}
    assert shapes == {"a": (12, 3, 100.0), "b": (12, 5, 100.0)}
    assert {r.path[-6]: r.reason for r in bad.collect()} == {"c": "ragged", "d": "no signal"}


def test_manifests_lines_cache_and_reviews(spark, tmp_path):
    df = spark.createDataFrame([(1, "train", None), (2, "val", "x"), (3, "train", "y")], "id long, split string, note string")
    files.write_manifests(df, f"file://{tmp_path}/m")
    assert {r.split: r["count"] for r in spark.read.parquet(f"file://{tmp_path}/m").groupBy("split").count().collect()} == {"train": 2, "val": 1}
    files.write_lines(df, f"file://{tmp_path}/l")
    assert sorted(map(tuple, files.read_lines(spark, f"file://{tmp_path}/l", "id long, split string, note string").collect())) == sorted(map(tuple, df.collect()))
    first = files.cached_split(spark, df, "train", f"file://{tmp_path}/c").count()
    assert first == files.cached_split(spark, df.limit(0), "train", f"file://{tmp_path}/c").count() == 2
    review = spark.createDataFrame([("f", "correct"), ("g", "uncertain")], "finding_id string, verdict string")
    files.write_review(review, f"file://{tmp_path}/r")
    with pytest.raises(ValueError, match="verdict"):
        files.write_review(review.unionByName(spark.createDataFrame([("h", "maybe")], review.schema)), f"file://{tmp_path}/r")
    files.write_review(review, f"file://{tmp_path}/r")
    assert spark.read.parquet(f"file://{tmp_path}/r").count() == 4


def test_context_is_cut_at_a_space_that_ends_the_part(spark):
    rows = [(1, 0, "u", "ab cd\nef"), (1, 1, "v", "ab cd ef"), (1, 2, "w", "ab\x0bcd ef"), (1, 3, "x", "ab"), (2, None, "y", "z")]
    got = {r.id: r.context for r in R.context_block(spark.createDataFrame(rows, "id long, rank int, title string, text string"), most=6).collect()}
    assert got == {1: "[0] u: ab cd ...\n[1] v: ab cd ...\n[2] w: ab\x0bcd ...\n[3] x: ab", 2: None}
