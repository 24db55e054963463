"""The affine fit recovers a known map, beats the temperature, and falls back."""

import math

from tallyweave.operators import scoring as S


def test_affine_fit(spark):
    rows = []
    for k in range(-30, 31):
        z = k / 10
        ones = round(1000 / (1 + math.exp(-(0.5 * z - 1.0))))
        rows += [("A", 1, z, ones), ("A", 0, z, 1000 - ones)]
    rows += [("B", 1, 0.5, 3), ("B", 0, -0.5, 50), ("C", 1, 1.0, 40)]
    df = spark.createDataFrame(rows, "label string, y int, z double, n int").selectExpr("label", "y", "z", "explode(sequence(1, n)) AS k")
    got = {r.label: r for r in S.label_affine(df).collect()}
    assert abs(got["A"].a - 0.5) < 0.01 and abs(got["A"].b + 1.0) < 0.01
    assert got["B"].nll is None and (got["B"].a, got["B"].b) == (got["C"].a, got["C"].b)
    assert got["A"].nll <= S.temperatures(df, ["label"]).where("label = 'A'").first().nll + 1e-9
    assert S.label_affine(df.limit(0)).count() == 0
