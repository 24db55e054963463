"""Changed copies of signals against numpy."""

import hashlib

import numpy as np

from tallyweave.operators import distances as D

SIZE, FS = 60, 40


def u(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 4294967296.0


def plain(signals, copy, record, seed):
    """signals: lead -> array."""
    k = lambda step, *more: u(f"{seed}:{step}", copy, record, *more)
    on = lambda step: k(f"{step}?") < D.CHANCES[step]
    normal = lambda step, *more: sum(k(step, j, *more) for j in range(12)) - 6
    x = {lead: np.array(s, float) for lead, s in signals.items()}
    t = np.arange(SIZE)
    if on("gain"):
        x = {lead: s * (D.GAIN[0] + (D.GAIN[1] - D.GAIN[0]) * k("gain")) for lead, s in x.items()}
    if on("warp"):
        knots = np.array([D.WARP * normal("warp", f"k{j}") for j in range(8)])
        place = np.cumsum(1 + np.interp(t * 7 / (SIZE - 1), np.arange(8), knots))
        place = (place - place[0]) / (place[-1] - place[0]) * (SIZE - 1)
        x = {lead: np.interp(t, place, s) for lead, s in x.items()}
    if on("shift"):
        most = int(D.SHIFT_S * FS)
        x = {lead: np.roll(s, int(np.floor(2 * most * k("shift"))) - most) for lead, s in x.items()}
    for lead in x:
        if on("drift"):
            hz = D.DRIFT_HZ[0] + (D.DRIFT_HZ[1] - D.DRIFT_HZ[0]) * k("drift hz")
            x[lead] = x[lead] + D.DRIFT * (0.4 + 0.6 * k("drift size")) * np.sin(2 * np.pi * hz * t / FS + 2 * np.pi * k("drift phase")) * (0.5 + 0.5 * k("drift lead", lead))
        if on("mains"):
            x[lead] = x[lead] + D.MAINS * np.sin(2 * np.pi * D.MAINS_HZ * t / FS + 2 * np.pi * k("mains phase"))
        if on("noise"):
            x[lead] = x[lead] + D.NOISE * np.array([normal("noise", lead, j) for j in t])
    if on("drop"):
        x[min(x, key=lambda lead: k("drop", lead))][:] = 0
    return x


def test_copies_equal_numpy_over_partitions(spark):
    rng = np.random.default_rng(4)
    signals = {r: {lead: rng.normal(0, 1, SIZE) for lead in ("I", "II", "V1")} for r in range(14)}
    rows = [(r, lead, k, float(v)) for r, s in signals.items() for lead, x in s.items() for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "record_id long, lead string, t int, value double")
    out = D.augment_recordings(df, SIZE, FS, seed=7, copies=3)
    got = {(r.copy, r.record_id, r.lead, r.t): r.value for r in out.collect()}
    assert len(got) == 3 * len(rows) and got == {(r.copy, r.record_id, r.lead, r.t): r.value for r in D.augment_recordings(df.repartition(7), SIZE, FS, seed=7, copies=3).collect()}
    for copy in range(3):
        for r, s in signals.items():
            for lead, x in plain(s, copy, r, 7).items():
                np.testing.assert_allclose([got[copy, r, lead, k] for k in range(SIZE)], x, atol=1e-9)
