"""Beats of made-up signals with known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.operators import beats as B
from tallyweave.operators import distances as D
from tallyweave.operators import signals as G

FS = 100
LEADS = ["I", "II", "V1", "V2", "V3", "V4", "V5", "V6"]


def strip(seconds=10.0, rate=60.0, pr=160.0, qrs=90.0, qt=380.0, p_wave=True):
    """One lead of Gaussian waves whose bounds lie where the arguments say."""
    t = np.arange(int(FS * seconds)) / FS
    out, centres, r = np.zeros(len(t)), [], 0.5
    wave = lambda at, width, size: size * np.exp(-0.5 * ((t - at) / width) ** 2)
    while r < seconds - 0.6:
        onset = r - qrs / 2000
        out += wave(r, qrs / 5000, 1.2) - wave(r - qrs / 2200, 0.010, 0.15) - wave(r + qrs / 2200, 0.012, 0.20)
        out += wave(onset + qt / 1000 - 0.11, 0.055, 0.32)
        if p_wave:
            out += wave(onset - pr / 1000 + 0.044, 0.022, 0.15)
        centres.append(round(r * FS))
        r += 60 / rate
    return out, centres


def table(spark, signals):
    """signals: (record_id, lead) -> array."""
    rows = [(r, lead, k, float(x)) for (r, lead), s in signals.items() for k, x in enumerate(s)]
    return spark.createDataFrame(rows, "record_id long, lead string, t int, value double")


def plain_beats(x):
    """The rules in a loop over one signal."""
    half, w = 8, B.band_taps(5 / FS, 15 / FS, 8)
    padded = np.r_[np.full(half, x[0]), x, np.full(half, x[-1])]
    f = np.round(np.array([sum(a * b for a, b in zip(w, padded[k : k + 17])) for k in range(len(x))]), 9)
    d = np.r_[0.0, np.diff(f)] ** 2
    e = np.array([round(sum(d[max(0, k - 7) : k + 8]) / 15, 9) for k in range(len(x))])
    tops, k = [], 1
    while k < len(e) - 1:
        j = k
        while j + 1 < len(e) and e[j + 1] == e[k]:
            j += 1
        if e[k - 1] < e[k] and j + 1 < len(e) and e[j + 1] < e[k]:
            tops.append((k + j) // 2)
        k = j + 1
    kept = []
    for p in sorted(tops, key=lambda p: (-e[p], -p)):
        if all(abs(p - q) >= 20 for q in kept):
            kept.append(p)
    s, n, out = round(0.25 * e[:200].max(), 9), round(0.5 * e[:200].mean(), 9), []
    for p in sorted(kept):
        if e[p] > n + 0.25 * (s - n):
            s = 0.125 * e[p] + 0.875 * s
            lo = max(0, p - 10)
            r = lo + int(np.argmax(np.abs(f[lo : p + 10])))
            if not out or r - out[-1] >= 20:
                out.append(r)
        else:
            n = 0.125 * e[p] + 0.875 * n
    return out


def test_beats_equal_a_plain_loop_and_flat_or_short_signals_have_none(spark):
    rng = np.random.default_rng(2)
    one, centres = strip()
    noisy = strip(rate=83)[0] + rng.normal(0, 0.05, 1000)
    signals = {(1, "II"): one, (2, "II"): noisy, (3, "II"): np.zeros(500), (4, "II"): one[:40], (5, "II"): rng.normal(0, 1, 700), (6, "II"): one[: 3 * FS], (7, "II"): [1.0]}
    found = {}
    for r in B.detect_beats(table(spark, signals), FS).collect():
        found.setdefault(r.record_id, []).append(r.t)
    assert not {3, 4, 7} & set(found)
    for k in (1, 2, 5, 6):
        assert sorted(found[k]) == plain_beats(np.asarray(signals[k, "II"]))
    assert len(found[1]) == len(centres) and all(abs(a - b) <= 2 for a, b in zip(sorted(found[1]), centres))


def test_levels_pass_from_block_to_block(spark, monkeypatch):
    monkeypatch.setattr(B, "_FOLD", 3)
    x = strip(30.0, 75)[0] * np.linspace(0.2, 1.5, 3000) + np.random.default_rng(3).normal(0, 0.04, 3000)
    assert sorted(r.t for r in B.detect_beats(table(spark, {(1, "II"): x}), FS).collect()) == plain_beats(x)


def test_filters_pass_and_stop(spark):
    t = np.arange(600) / FS
    tone = lambda hz: np.sin(2 * np.pi * hz * t)
    size = lambda weights, hz: max(abs(r.value) for r in D.fir(table(spark, {(1, "I"): tone(hz)}), weights).where("t between 100 and 500").collect())
    band = B.band_taps(5 / FS, 15 / FS, 24)
    assert size(band, 10) > 0.9 and size(band, 0.3) < 0.1 and size(band, 35) < 0.05
    notch = B.notch_taps(0.3, 0.04, 24)
    assert size(notch, 30) < 0.3 and size(notch, 8) > 0.9


def measured(spark, **shape):
    x, _ = strip(**shape)
    samples = table(spark, {(1, lead): x * s for lead, s in zip(LEADS, np.linspace(0.6, 1.0, 8))})
    beats = B.detect_beats(samples, FS).where("lead = 'II'").select("record_id", F.explode(F.array(*map(F.lit, LEADS))).alias("lead"), "t")
    qrs = B.qrs_bounds(G.median_beat(G.segments(samples, beats, 35, 54)), FS)
    row = B.wave_bounds(qrs, spark.createDataFrame([(1, 60000.0 / shape.get("rate", 60.0))], "record_id long, rr_ms double"), FS).first()
    return {k: v / (FS * 5) * 1000 if k != "record_id" and v is not None else v for k, v in row.asDict().items()}


def test_known_intervals_are_met(spark):
    m = measured(spark, pr=160.0, qrs=90.0, qt=380.0)
    assert m["qrs_onset"] - m["p_onset"] == pytest.approx(160, abs=35)
    assert m["qrs_offset"] - m["qrs_onset"] == pytest.approx(90, abs=35)
    assert m["t_offset"] - m["qrs_onset"] == pytest.approx(380, abs=60)
    assert m["p_onset"] < m["p_peak"] < m["p_offset"] < m["qrs_onset"] < m["r_peak"] < m["qrs_offset"] < m["t_peak"] < m["t_offset"]


def test_no_p_wave_is_null_not_zero(spark):
    m = measured(spark, p_wave=False)
    assert m["p_onset"] is m["p_peak"] is m["p_offset"] is None and m["t_offset"] is not None


def test_crossings_are_interpolated_and_the_walk_ends(spark):
    df = spark.createDataFrame([([0.0, 2.0, 4.0, 8.0, 6.0, 3.0, 3.0, 3.0],)], "c array<double>")
    at = lambda start, level, limit, way: df.select(F.expr(B._crossing("c", str(start), f"{level}D", limit, way))).first()[0]
    assert at(3, 3, 3, -1) == 1.5 and at(3, 5, 4, 1) == pytest.approx(4 + 1 / 3)
    assert at(3, 1, 2, -1) == 1 and at(3, 1, 9, 1) == 7 and at(0, 9, 5, -1) == 0 and at(3, 0, 9, -1) == 0


def test_chain_equals_its_steps_and_deals_rows_once(spark):
    rng = np.random.default_rng(5)
    signals = {(r, lead): strip(4.0, 60 + 9 * r)[0] + rng.normal(0, 0.02, 400) for r in range(3) for lead in ("I", "II")}
    samples = table(spark, signals)
    got = B.preprocess(samples, 400, 320, 80)
    filtered = D.fir(D.resample(samples, 400, 320), B.band_taps(0.5 / 80, 80 / 2 * 0.99 / 80, 8))
    beats = {(r.record_id, r.t) for r in B.detect_beats(filtered.where("lead = 'II'"), 80).collect()}
    want = {(r.record_id, r.lead, r.t, round(r.value, 9), (r.record_id, r.t) in beats) for r in G.zscore(filtered).collect()}
    assert {(r.record_id, r.lead, r.t, round(r.value, 9), r.beat) for r in got.collect()} == want and beats
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    dealt = [x for x in plan.split("\n") if "Exchange " in x and "Reused" not in x]
    assert all("record_id" in x and "lead" not in x for x in dealt), dealt
