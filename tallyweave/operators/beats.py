"""Beats of signals: filters, candidates, adaptive selection, wave boundaries, and the whole chain.

Signals are long, (record_id, lead, t, value) with t from 0. Every step keys by
record and lead, so rows once dealt by record stay where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .distances import fir, resample, taps
from .signals import KEY, zscore

#: Candidates of a record are folded in blocks of so many, so that no list is copied once for each of its items.
_FOLD = 512


def band_taps(low: float, high: float, half: int) -> list[float]:
    """Weights that let frequencies between two shares of the rate pass."""
    return [h - l for h, l in zip(taps(high, half), taps(low, half), strict=True)]


def notch_taps(at: float, width: float, half: int) -> list[float]:
    """Weights that take out the frequencies around one share of the rate."""
    return [(k == half) - x for k, x in enumerate(band_taps(at - width, at + width, half))]


def _count(seconds: float, fs: float) -> int:
    return max(1, round(seconds * fs))


def beat_energy(samples: DataFrame, fs: float, low: float = 5.0, high: float = 15.0, half: int = 8) -> DataFrame:
    """G08, first half: filtered, energy (centred 150 ms mean of the squared slope) and snap (place of the largest deflection within 100 ms).

    ``signal0`` and ``noise0`` are the levels that selection starts from: a
    quarter of the largest and half of the mean energy of the first two
    seconds. Signals shorter than half a second are left out. Beyond the ends
    the slope is 0; of equal deflections the first counts.
    """
    filtered = fir(samples, band_taps(low / fs, min(high, fs / 2 * 0.99) / fs, half)).withColumnRenamed("value", "filtered")
    w = W.partitionBy(*KEY).orderBy("t")
    whole = W.partitionBy(*KEY)
    wide, near = _count(0.15, fs), _count(0.1, fs)
    first = F.when(F.col("t") < 2 * fs, F.col("energy"))
    df = filtered.withColumn("filtered", F.round("filtered", 9)).withColumn("n", F.count("*").over(whole)).where(F.col("n") >= int(fs // 2))
    df = df.withColumn("d", F.coalesce(F.col("filtered") - F.lag("filtered").over(w), F.lit(0.0)))
    df = df.withColumn("energy", F.round(F.sum(F.col("d") * F.col("d")).over(w.rowsBetween(-(wide // 2), (wide - 1) // 2)) / wide, 9))
    df = df.withColumn("snap", F.max_by("t", F.struct(F.abs("filtered"), -F.col("t"))).over(w.rowsBetween(-near, near - 1)))
    df = df.withColumn("signal0", F.round(0.25 * F.max(first).over(whole), 9)).withColumn("noise0", F.round(0.5 * F.avg(first).over(whole), 9))
    return df.drop("n", "d")


def spaced_peaks(energy: DataFrame, fs: float, apart: float = 0.2) -> DataFrame:
    """G08, second half: local maxima of the energy, at least ``apart`` seconds from any higher one that stays.

    A flat top counts once, at its middle. Of peaks too near to each other the
    higher stays, of equal ones the later. Peaks are settled within runs of
    near neighbours, so that no task needs all peaks of a long record at once.
    """
    w = W.partitionBy(*KEY).orderBy("t")
    least = _count(apart, fs)
    df = energy.withColumn("level", F.sum((F.col("energy") != F.lag("energy").over(w)).cast("int")).over(w)).fillna(0, ["level"])
    flat = W.partitionBy(*KEY, "level")
    df = df.withColumn("first", F.min("t").over(flat)).withColumn("last", F.max("t").over(flat))
    # the edges of the flat top: the row before its first and after its last
    up = F.lag("energy").over(w)
    down = F.lead("energy").over(w)
    df = df.withColumn("rose", F.max(F.when((F.col("t") == F.col("first")) & (up < F.col("energy")), 1)).over(flat)).withColumn(
        "falls", F.max(F.when((F.col("t") == F.col("last")) & (down < F.col("energy")), 1)).over(flat)
    )
    peaks = df.where((F.col("t") == F.floor((F.col("first") + F.col("last")) / 2)) & F.col("rose").isNotNull() & F.col("falls").isNotNull())
    peaks = peaks.drop("level", "first", "last", "rose", "falls")
    near = peaks.withColumn("run", F.sum((F.coalesce(F.col("t") - F.lag("t").over(w), F.lit(least)) >= least).cast("int")).over(w))
    runs = near.groupBy(*KEY, "run").agg(F.collect_list(F.struct((-F.col("energy")).alias("depth"), (-F.col("t")).alias("back"), "t", "energy", "snap", "signal0", "noise0")).alias("peaks"))
    kept = F.expr(f"aggregate(array_sort(peaks), slice(peaks, 1, 0), (kept, p) -> if(exists(kept, k -> abs(k.t - p.t) < {least}), kept, concat(kept, array(p))))")
    return runs.select(*KEY, F.explode(kept).alias("p")).select(*KEY, "p.t", "p.energy", "p.snap", "p.signal0", "p.noise0")


def select_beats(peaks: DataFrame, fs: float, apart: float = 0.2) -> DataFrame:
    """(record_id, lead, t) of the peaks taken for beats, in an ordered fold over each record's peaks.

    A peak above noise + (signal - noise) / 4 is a beat and moves the signal
    level by an eighth, any other moves the noise level. Beats stand at their
    ``snap`` and at least ``apart`` seconds after the one before. Levels start
    at ``signal0`` and ``noise0``. The fold runs over blocks of peaks whose
    state passes from one to the next, so its time stays near linear.
    """
    least = _count(apart, fs)
    item = F.struct("t", "energy", "snap")
    g = peaks.groupBy(*KEY).agg(F.array_sort(F.collect_list(item)).alias("peaks"), F.first("signal0").alias("signal0"), F.first("noise0").alias("noise0"))
    none = "cast(array() as array<int>)"
    fold = f"""aggregate(transform(sequence(0, (size(peaks) - 1) div {_FOLD}), i -> slice(peaks, int(i * {_FOLD} + 1), {_FOLD})),
      named_struct('s', signal0, 'n', noise0, 'last', cast(null as int), 'out', cast(array() as array<array<int>>)),
      (a, block) -> transform(array(aggregate(block, named_struct('s', a.s, 'n', a.n, 'last', a.last, 'out', {none}),
        (b, p) -> if(p.energy > b.n + 0.25D * (b.s - b.n),
          named_struct('s', 0.125D * p.energy + 0.875D * b.s, 'n', b.n, 'last', if(coalesce(p.snap - b.last >= {least}, true), p.snap, b.last),
                       'out', if(coalesce(p.snap - b.last >= {least}, true), concat(b.out, array(p.snap)), b.out)),
          named_struct('s', b.s, 'n', 0.125D * p.energy + 0.875D * b.n, 'last', b.last, 'out', b.out)))),
        b -> named_struct('s', b.s, 'n', b.n, 'last', b.last, 'out', concat(a.out, array(b.out))))[0],
      a -> flatten(a.out))"""
    return g.select(*KEY, F.explode(F.expr(fold)).alias("t"))


def detect_beats(samples: DataFrame, fs: float, low: float = 5.0, high: float = 15.0, half: int = 8) -> DataFrame:
    """G08 and G09 in one: (record_id, lead, t) of the beats of every signal; flat and very short signals have none."""
    return select_beats(spaced_peaks(beat_energy(samples, fs, low, high, half), fs), fs)


def preprocess(samples: DataFrame, size: int, new_size: int, fs: float, lead: str = "II", low: float = 0.5, high: float = 40.0, half: int = 8) -> DataFrame:
    """record_id, lead, t, value, beat: resampled, band-passed and z-scored signals with the beats of one lead marked.

    ``fs`` is the rate after resampling. Beats come from the filtered signal
    before it is normalised; ``beat`` marks their places on every lead of the
    record. Rows are dealt by record once; all steps, the union with the
    beats included, find them there.
    """
    dealt = samples.select("record_id", "lead", "t", "value").repartition("record_id")
    filtered = fir(resample(dealt, size, new_size), band_taps(low / fs, min(high, fs / 2 * 0.99) / fs, half))
    beats = detect_beats(filtered.where(F.col("lead") == lead), fs, half=half)
    none = F.lit(None).cast("double")
    both = zscore(filtered).select("record_id", "lead", "t", "value", F.lit(False).alias("mark")).unionByName(beats.select("record_id", "lead", "t", none.alias("value"), F.lit(True).alias("mark")))
    beat = F.max("mark").over(W.partitionBy("record_id", "t"))
    return both.select("record_id", "lead", "t", "value", "mark", beat.alias("beat")).where("not mark").drop("mark")


def upsampled(values: str, factor: int) -> str:
    """SQL of an array at ``factor`` times its rate: a cubic through each two samples with the slopes of their neighbours."""
    at = lambda k: f"{values}[greatest(0, least(size({values}) - 1, int(i div {factor} + {k})))]"
    a, b, c, d = (at(k) for k in (-1, 0, 1, 2))
    s = f"((i % {factor}) / {factor}D)"
    curve = f"{b} + 0.5D * {s} * ({c} - {a} + {s} * (2 * {a} - 5 * {b} + 4 * {c} - {d} + {s} * (3 * ({b} - {c}) + {d} - {a})))"
    return f"transform(sequence(0, (size({values}) - 1) * {factor}), i -> {curve})"


def _crossing(curve: str, start: str, level: str, limit: int, way: int) -> str:
    """SQL of the place where ``curve`` first falls below ``level`` walking from ``start``, interpolated; else where the walk ends."""
    end = f"greatest(0, {start} - {limit})" if way < 0 else f"least(size({curve}) - 1, {start} + {limit})"
    steps = f"if({start} = {end} or {start} = 0 or {start} = size({curve}) - 1, cast(array() as array<int>), sequence({start} + {way}, {end}))"
    hit = f"get(filter({steps}, j -> {curve}[j] < {level}), 0)"  # indexing past an array raises under ANSI rules
    inside = f"({hit} - {way})"
    drop = f"({curve}[{inside}] - {curve}[{hit}])"
    return f"coalesce({inside} + {way} * if({drop} > 0, ({curve}[{inside}] - {level}) / {drop}, 0D), cast(if({start} = 0 or {start} = size({curve}) - 1, {start}, {end}) as double))"


def boundary_curves(beat: DataFrame, fs: float, factor: int = 5) -> DataFrame:
    """record_id, ups (leads by name), mag, vel, centre: root-sum-squares over leads of a median beat and of its slope, at ``factor`` times the rate."""
    leads = beat.where("value is not null").repartition("record_id").groupBy(*KEY).agg(
        F.min("offset").alias("begin"), F.transform(F.array_sort(F.collect_list(F.struct("offset", "value"))), lambda x: x["value"]).alias("b")
    )
    each = leads.select("record_id", F.struct("lead", F.expr(upsampled("b", factor)).alias("up")).alias("one"), "begin")
    g = each.groupBy("record_id").agg(F.transform(F.array_sort(F.collect_list("one")), lambda x: x["up"]).alias("ups"), (-F.min("begin") * factor).cast("int").alias("centre"))
    g = g.withColumn("mag", F.expr("transform(sequence(0, size(ups[0]) - 1), i -> round(sqrt(aggregate(ups, 0D, (s, u) -> s + u[i] * u[i])), 9))"))
    slope = "(u[i] - u[greatest(i - 1, 0)])"
    return g.withColumn("vel", F.expr(f"transform(sequence(0, size(ups[0]) - 1), i -> round(sqrt(aggregate(ups, 0D, (s, u) -> s + {slope} * {slope})), 9))"))


def qrs_bounds(beat: DataFrame, fs: float, factor: int = 5, onset: float = 0.08, offset: float = 0.04) -> DataFrame:
    """record_id, r_peak, qrs_onset, qrs_offset in samples of the raised rate, with the curves.

    The peak is the largest magnitude within 40 ms of offset 0. From it the
    walk goes out until the slope curve falls below its share of the largest
    slope within 80 ms: at most 120 ms to the onset, 200 ms to the offset.
    Crossings are interpolated. A record without slope gives no row.
    """
    ms = fs * factor / 1000
    reach, wide = max(1, int(40 * ms)), max(1, int(80 * ms))
    df = boundary_curves(beat, fs, factor)
    around = f"sequence(greatest(0, centre - {reach}), least(size(mag), centre + {reach}) - 1)"
    df = df.withColumn("r", F.expr(f"element_at(array_sort(transform({around}, i -> named_struct('a', -mag[i], 'i', i))), 1).i"))
    df = df.withColumn("top", F.expr(f"array_max(slice(vel, greatest(0, r - {wide}) + 1, least(size(vel), r + {wide}) - greatest(0, r - {wide})))")).where("top > 0")
    return df.withColumn("qrs_onset", F.expr(_crossing("vel", "r", f"{onset}D * top", int(120 * ms), -1))).withColumn(
        "qrs_offset", F.expr(_crossing("vel", "r", f"{offset}D * top", int(200 * ms), 1))
    )


def _nth(values: str, share: float) -> str:
    """SQL of a percentile of an array, between neighbours by distance."""
    x = f"(size({values}) - 1) * {share}D"
    low = f"array_sort({values})[int(floor({x}))]"
    return f"({low} + ({x} - floor({x})) * (array_sort({values})[int(ceil({x}))] - {low}))"


def wave_bounds(qrs: DataFrame, rates: DataFrame, fs: float, factor: int = 5) -> DataFrame:
    """Adds p_onset, p_peak, p_offset, t_peak, t_offset (null where there is no such wave) to ``qrs_bounds``; ``rates``: record_id, rr_ms.

    P is the most prominent local maximum from 300 to 20 ms before the QRS
    onset that stands clear of that stretch's lower fifth; its bounds are
    crossings of 15 % of the largest slope there, and an onset 80 to 400 ms
    before the QRS holds. T is the largest magnitude from 60 ms after the QRS;
    its end is where the steepest tangent back, on the lead that it is largest
    on, meets 0.
    """
    ms = fs * factor / 1000
    df = qrs.join(rates.select("record_id", "rr_ms"), "record_id", "left")
    df = df.withColumn("p_hi", F.expr(f"int(qrs_onset - {20 * ms}D)")).withColumn("p_lo", F.expr(f"greatest(0, int(qrs_onset - {300 * ms}D))"))
    df = df.withColumn("seg", F.expr(f"if(p_hi - p_lo > {int(20 * ms)}, slice(mag, p_lo + 1, p_hi - p_lo), cast(null as array<double>))")).withColumn("floor", F.expr(_nth("seg", 0.2)))
    higher = lambda a, b, last: f"try_element_at(filter(sequence({a}, {b}), j -> seg[j] > seg[i]), {last})"
    left = f"array_min(slice(seg, coalesce({higher('0', 'i', -1)}, -1) + 2, i - coalesce({higher('0', 'i', -1)}, -1)))"
    right = f"array_min(slice(seg, i + 1, coalesce({higher('i', 'size(seg) - 1', 1)}, size(seg)) - i))"
    peak = "seg[i] >= greatest(3 * floor, 0.02D) and seg[i - 1] < seg[i] and seg[i + 1] < seg[i]"
    found = f"filter(transform(filter(sequence(1, greatest(1, size(seg) - 2)), i -> {peak}), i -> named_struct('prom', -(seg[i] - greatest({left}, {right})), 'i', i)), x -> -x.prom >= greatest(0.5D * floor, 0.01D))"
    df = df.withColumn("cand", F.expr(f"if(size(seg) >= 3, p_lo + get(array_sort({found}), 0).i, cast(null as int))"))
    df = df.withColumn("p_level", F.expr("0.15D * array_max(slice(vel, p_lo + 1, greatest(0, p_hi - p_lo)))"))
    side = lambda way: F.expr(f"if(cand is null, cast(null as double), {_crossing('vel', 'cand', 'p_level', int(120 * ms), way)})")
    df = df.withColumn("p_onset", side(-1)).withColumn("p_offset", side(1)).withColumn("fits", F.expr(f"p_onset < qrs_onset and (qrs_onset - p_onset) / {ms}D between 80 and 400"))
    df = df.withColumn("end", F.expr(f"int(least(size(vel) - 1, qrs_offset + coalesce(0.6D * rr_ms * {ms}D, {450 * ms}D)))")).withColumn("begin", F.expr(f"int(qrs_offset + {60 * ms}D)"))
    top = "get(array_sort(transform(sequence(begin, end - 1), i -> named_struct('a', -mag[i], 'i', i))), 0).i"
    df = df.withColumn("tp", F.expr(f"if(end - begin > {int(40 * ms)}, {top}, cast(null as int))"))
    lead = "get(array_sort(transform(ups, (u, k) -> named_struct('a', -abs(u[tp]), 'k', k))), 0).k"
    df = df.withColumn("trace", F.expr(f"if(tp is null, cast(null as array<double>), ups[{lead}])"))
    at = lambda k: f"trace[greatest(0, least(size(trace) - 1, {k}))]"
    slope = lambda k: f"(({at(f'{k} + 1')} - {at(f'{k} - 1')}) / (least(size(trace) - 1, {k} + 1) - greatest(0, {k} - 1)))"
    steep = f"get(array_sort(transform(sequence(tp, end - 1), i -> named_struct('a', round(if(trace[tp] < 0, -1, 1) * {slope('i')}, 12), 'i', i))), 0).i"
    df = df.withColumn("k", F.expr(f"if(end - tp > 2, {steep}, cast(null as int))")).withColumn("tilt", F.expr(f"if(k is null, cast(null as double), {slope('k')})"))
    off = "if(abs(tilt) > 1e-9D, least(greatest(k - trace[k] / tilt, double(tp)), double(size(trace) - 1)), cast(null as double))"
    held = lambda c: F.when(F.col("fits"), F.col(c).cast("double"))
    return df.select(
        "record_id", held("p_onset").alias("p_onset"), held("cand").alias("p_peak"), held("p_offset").alias("p_offset"),
        "qrs_onset", F.col("r").cast("double").alias("r_peak"), "qrs_offset", F.col("tp").cast("double").alias("t_peak"), F.expr(off).alias("t_offset"),
    )
