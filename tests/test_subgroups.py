"""Prediction rows of chosen records, resamples and paired tests against plain counting."""

import hashlib
import math
import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.operators import resamples, scoring, subgroups
from tallyweave.operators import views as V
from tallyweave.plans import subgroups_queries as Q

SF = "/root/testdata/sf0.001"
data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@data
def test_the_grid_is_made_after_records_are_chosen_and_meet_their_codes(spark):
    test = Q.rows(spark, SF, test=True)
    plan = test._jdf.queryExecution().sparkPlan().toString()
    assert "hashpartitioning(record_id" not in plan and not [line for line in plan.splitlines() if "Join [" in line and "label" in line]
    assert plan.count("= 10") >= 1
    cols = ["record_id", "label", "y", "p", "p2", "sex", "band"]
    whole = {tuple(r) for r in Q.rows(spark, SF).where("fold = 10").select(*cols).collect()}
    assert whole == {tuple(r) for r in test.select(*cols).collect()} and len(whole) % 25 == 0
    none = V.predictions(spark, SF, of=spark.createDataFrame([(-1,)], "record_id long"))
    assert [r.y for r in none.collect()] == [0] * 25


def test_weights_equal_the_hash_and_survive_packing():
    keys = [b"1", b"42", "é".encode(), b"123456789", b"x" * 60, b""]
    w = resamples.poisson_weights(keys, 120, "boot")
    u = lambda r, k: int(hashlib.md5(b"boot:%d:%s" % (r, k)).hexdigest()[:8], 16) / 2**32
    assert w.tolist() == [[sum(u(r, k) >= t for t in resamples.POISSON_ONE) for r in range(120)] for k in keys]
    assert (resamples.unpack(resamples.pack(w), 120) == w).all()
    assert resamples.pack(np.zeros((1, 8), int)) == [b"\0"]


def test_resampled_auroc_equals_rows_taken_once_for_each_replicate(spark, monkeypatch):
    monkeypatch.setattr(resamples, "_SLICE", 7)  # ties and ranges run over slices
    rnd = random.Random(3)
    rows = [(r, rnd.choice([None, 0, 1]), label, rnd.randint(0, 1), rnd.choice([0.0, 0.1, 0.5, 0.500001, round(rnd.random(), 2)]), rnd.random()) for r in [*range(60), None] for label in "abc"]
    df = spark.createDataFrame(rows, "record_id long, sex int, label string, y int, p double, p2 double").repartition(3)
    got = resamples.resampled_auroc(df, ["sex", "label"], 12, ("p", "p2"))
    assert not [line for line in got._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in line]
    plain = lambda rs: {tuple(r) for r in rs}
    for score in ("p", "p2"):
        want = scoring.auroc(subgroups.replicate(df, 12), ["sex", "label", "rep"], score, weight=F.col("w"))
        assert plain(want.collect()) == plain(got.where(F.col("of") == score).select(*want.columns).collect())


def test_paired_test_of_large_counts_takes_time_in_proportion(spark):
    def found(b, c, block=65_536):
        rows = spark.range(b + c).select((F.col("id") < b).alias("x"))
        return tuple(subgroups.mcnemar(rows, F.col("x"), ~F.col("x"), block).first())

    for b, c in ((0, 0), (0, 1), (3, 3), (1, 9), (40, 17), (500, 431), (431, 500)):
        tail = sum(math.comb(b + c, i) for i in range(min(b, c) + 1)) / 2 ** (b + c)
        assert found(b, c, 7) == (b, c, pytest.approx(min(1.0, 2 * tail), rel=1e-12))
    b, c = 101_000, 100_000
    z = (c + 0.5 - (b + c) / 2) / math.sqrt((b + c) / 4)
    start = time.monotonic()
    assert found(b, c) == (b, c, pytest.approx(math.erfc(-z / math.sqrt(2)), rel=1e-5))
    assert time.monotonic() - start < 60  # terms that each count to their place again would take hours
