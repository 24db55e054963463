"""Sparse and dense search against brute force, and AUROC by ranges of scores."""

import random

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import retrieval as K
from tallyweave.operators import scoring as S


def postings(seed, n):
    rnd = random.Random(seed)
    docs = {}
    for i in range(n):
        terms = {"the": rnd.random()} | ({"of": rnd.random()} if rnd.random() < 0.7 else {})
        for _ in range(rnd.choice([0, 1, 3, 8])):
            terms[f"t{min(rnd.randrange(40), rnd.randrange(40))}"] = rnd.random()
        size = sum(w * w for w in terms.values()) ** 0.5
        docs[i] = {t: w / size for t, w in terms.items()}
    return docs


@pytest.mark.parametrize(("often", "k"), [(1000, 3), (12, 3), (12, 40), (1, 2)])
def test_sparse_search_equals_brute_force_whatever_is_common(spark, often, k):
    docs = postings(often + k, 90)
    rows = spark.createDataFrame([(i, t, w) for i, d in docs.items() for t, w in d.items()], "id long, term string, w double").repartition(5)
    got = {(r.query_id, r.rank): (r.id, r.score) for r in K.sparse_search(rows.withColumnRenamed("id", "query_id"), rows, k, others_only=True, often=often).collect()}
    want = {}
    for q, a in docs.items():
        score = {i: round(sum(w * b[t] for t, w in a.items() if t in b), 9) for i, b in docs.items() if i != q and set(a) & set(b)}
        for rank, i in enumerate(sorted(score, key=lambda i: (-score[i], i))[:k]):
            want[q, rank + 1] = (i, score[i])
    assert got.keys() == want.keys()
    assert all(got[x][0] == want[x][0] or abs(got[x][1] - want[x][1]) < 2e-9 for x in want)


def test_dense_search_in_blocks(spark):
    rnd = random.Random(2)
    v = spark.createDataFrame([(i, [rnd.gauss(0, 1) for _ in range(8)]) for i in range(60)], "id long, vector array<float>")
    q = v.withColumnRenamed("id", "query_id")
    assert sorted(K.dense_search(q, v, 4, block=7).collect()) == sorted(K.dense_search(q, v, 4).collect())


@pytest.mark.parametrize("scale", [1.0, 1e-6, 500.0])
def test_auroc_by_ranges_equals_pairs(spark, scale):
    rnd = random.Random(int(scale))
    rows = [(lab, rnd.randrange(2), round(rnd.gauss(0.2 if lab == "a" else 0, 1), 1) * scale) for lab in ("a", "b") for _ in range(150)] + [("c", 1, 0.5), ("d", 0, None)]
    got = {r.label: r for r in S.auroc(spark.createDataFrame(rows, "label string, y int, p double").where("p is not null"), ["label"]).collect()}
    for lab in ("a", "b"):
        pos, neg = ([p for x, y, p in rows if x == lab and y == k] for k in (1, 0))
        want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
        assert got[lab].auroc == pytest.approx(want, abs=1e-12) and (got[lab].n_pos, got[lab].n_neg) == (len(pos), len(neg))
    assert got["c"].auroc is None


def test_ranges_rise_with_scores_and_no_label_is_one_window(spark):
    values = sorted([0.0, -1.0, -1e-9, 1e-9, 0.4999, 0.5, 0.500001, 1.0, 300.0, 1e6, -1e6])
    got = [r.r for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").select("k", S.score_range(F.col("v")).alias("r")).orderBy("k").collect()]
    assert got == sorted(got)
    plan = S.auroc(spark.createDataFrame([("a", 1, 0.5)], "label string, y int, p double"), ["label"])._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.split("\n") if "Window [" in x]
    assert len(windows) == 2 and "[label" in windows[0] and any("_range" in x.split("],")[1] for x in windows)


def test_exact_quantiles_and_places_over_ranges(spark):
    import numpy as np

    rnd = random.Random(8)
    values = [rnd.choice([0.0, 0.25, -3.5, rnd.random(), rnd.gauss(0, 500)]) for _ in range(400)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "p double").repartition(7)
    shares = [0.0, 0.1, 0.333, 0.5, 0.75, 1.0]
    assert S.exact_quantiles(df, "p", shares).first().quantiles == pytest.approx(np.quantile(values, shares).tolist())
    assert S.exact_quantiles(df.where("p is null"), "p", [0.5]).first().quantiles == [None]
    runs = spark.createDataFrame([(str(k), rnd.choice([None, 1.0, round(rnd.gauss(0, 3), 1)]), rnd.choice([None, 0.5])) for k in range(120)], "name string, test double, val double")
    got = S.leaderboard(runs, runs.limit(0)).collect()
    known = sorted({r.score for r in got if r.score is not None}, reverse=True)
    assert all(r.place == (known.index(r.score) + 1 if r.score is not None else len(known) + 1) for r in got) and len(got) == 120
