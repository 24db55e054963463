"""Debounced findings over a stream of hops, its batch twin, and request metrics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F


def rolling_windows(events: DataFrame, size: str, hop: str, watermark: str | None = None) -> DataFrame:
    """Count, mean and largest value of each source and code in windows of ``size`` every ``hop``; works on streams with a watermark."""
    df = events.withWatermark("ts", watermark) if watermark else events
    g = df.groupBy("source", "code", F.window("ts", size, hop).alias("w")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("most"))
    return g.select("source", "code", F.col("w.start").alias("start"), "n", "mean", "most")


def confirmation_states(hops: DataFrame, k: int, m: int, by: tuple[str, ...] = ("source",)) -> DataFrame:
    """by..., code, hop, hit, value, hits, state, before: the debounced state of every watched code at every hop.

    A code that is absent in a hop counts as a miss. History starts at the
    first firing. ``value`` is null where hops have none.
    """
    if not 1 <= k <= m:
        raise ValueError("1 <= k <= m")
    ticks = hops.select(*by, "hop").distinct()
    value = F.max("value") if "value" in hops.columns else F.max(F.lit(None).cast("double"))
    seen = hops.groupBy(*by, "hop", "code").agg(F.max(F.col("fired").cast("int")).alias("hit"), value.alias("value"))
    first = seen.where("hit = 1").groupBy(*by, "code").agg(F.min("hop").alias("first"))
    grid = first.join(ticks, [*by]).where("hop >= first").join(seen, [*by, "code", "hop"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    w = W.partitionBy(*by, "code").orderBy("hop")
    grid = grid.withColumn("hits", F.sum("hit").over(w.rowsBetween(-(m - 1), 0)))
    mark = F.when(F.col("hits") >= k, 1).when(F.col("hits") == 0, 0)
    state = F.coalesce(F.last(mark, True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(0))
    return grid.withColumn("state", state).withColumn("before", F.coalesce(F.lag("state").over(w), F.lit(0))).drop("first")


def confirmation_events(hops: DataFrame, k: int, m: int, by: tuple[str, ...] = ("source",)) -> DataFrame:
    """One row per transition with its time and confidence (the hop's value, 0 where the code is absent)."""
    event = F.when(F.col("state") == 1, "onset").otherwise("offset")
    changed = confirmation_states(hops, k, m, by).where("state <> before")
    return changed.select(*by, "code", "hop", event.alias("event"), F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("confidence"))


def confirmations(hops: DataFrame, k: int, m: int) -> DataFrame:
    """W03 in batch: onset when a code fired in at least k of the last m hops, offset when in none of m."""
    return confirmation_events(hops, k, m).drop("confidence")


def latest_due(hops: DataFrame) -> DataFrame:
    """One analysis for each chunk (source, chunk, hop): its newest hop, and how many older hops it skips."""
    return hops.groupBy("source", "chunk").agg(F.max("hop").alias("hop"), (F.count_distinct("hop") - 1).alias("skipped"))


def panel(hops: DataFrame, k: int, m: int, urgent: list[str]) -> DataFrame:
    """By source and hop the confirmed, pending, fired and releasing codes, most confident first, and whether an urgent one is confirmed."""
    s = confirmation_states(hops, k, m).withColumn("row", F.struct(-F.coalesce(F.col("value").cast("double"), F.lit(0.0)), "code"))
    on = F.col("state") == 1
    listed = lambda which: F.transform(F.array_sort(F.collect_list(F.when(which, F.col("row")))), lambda r: r["code"])
    return s.groupBy("source", "hop").agg(
        listed(on).alias("confirmed"), listed(~on & (F.col("hits") > 0)).alias("pending"), listed(F.col("hit") == 1).alias("fired"),
        listed(on & (F.col("hits") < k)).alias("releasing"), F.bool_or(on & F.col("code").isin(urgent)).alias("alarm"),
    )


def with_epochs(hops: DataFrame, resets: DataFrame) -> DataFrame:
    """Hops with ``epoch``, the resets (source, hop) of the source up to that hop; a reset clears buffer and findings."""
    marks = resets.select("source", "hop").distinct().withColumn("epoch", F.row_number().over(W.partitionBy("source").orderBy("hop")))
    both = hops.withColumn("epoch", F.lit(None).cast("int")).unionByName(marks.withColumn("reset", F.lit(True)), allowMissingColumns=True)
    # a reset stands before the hops of its time
    w = W.partitionBy("source").orderBy("hop", F.col("reset").isNull()).rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("epoch", F.coalesce(F.max("epoch").over(w), F.lit(0))).where("reset is null").drop("reset")


def rate_limits(hits: DataFrame, limit: int, seconds: float) -> DataFrame:
    """(key, t in seconds, id) with allowed, remaining, retry_after of a fixed-window counter for each key.

    A window opens at a key's first hit and again at the first hit at or after
    its end. The fold is serial by key, so a key is sorted on disk and read as
    a stream of batches that carries only key, start and count.
    """

    def fold(batches):
        last, start, count = None, 0.0, 0
        for rows in batches:
            allowed, remaining, retry = [], [], []
            for key, t in zip(rows["key"], rows["t"], strict=True):
                if key != last or t - start >= seconds:
                    last, start, count = key, t, 0
                count += 1
                allowed.append(count <= limit)
                remaining.append(max(0, limit - count))
                retry.append(0.0 if count <= limit else max(0.0, start + seconds - t))
            yield rows.assign(allowed=allowed, remaining=remaining, retry_after=retry)

    rows = hits.where("key is not null and t is not null").select("key", F.col("t").cast("double").alias("t"), "id").repartition("key").sortWithinPartitions("key", "t", "id")
    types = dict(rows.dtypes)
    return rows.mapInPandas(fold, f"key {types['key']}, t double, id {types['id']}, allowed boolean, remaining long, retry_after double")


def stream_confirmations(hops: DataFrame, k: int, m: int) -> DataFrame:
    """W03 on a stream: one row per source and hop (source, hop long, codes array<string>), state by source.

    State: the last m hit flags and the confirmed mark of each code under
    watch; codes that were never confirmed and have no hits are forgotten.
    """
    if not 1 <= k <= m:
        raise ValueError("1 <= k <= m")

    def step(key, batches, state):
        known: dict[str, list] = {c: [list(h), bool(on)] for c, h, on in zip(*state.get, strict=True)} if state.exists else {}
        rows = pd.concat(list(batches)).sort_values("hop")
        out = []
        for hop, fired in zip(rows["hop"], rows["codes"], strict=True):
            now = set(fired)
            for c in now - set(known):
                known[c] = [[], False]
            for c in sorted(known):
                hits, on = known[c]
                hits = [*hits, int(c in now)][-m:]
                event = "onset" if not on and sum(hits) >= k else "offset" if on and sum(hits) == 0 else None
                if event:
                    out.append((key[0], c, int(hop), event))
                known[c] = [hits, event == "onset" or on and event is None]
        known = {c: v for c, v in known.items() if v[1] or sum(v[0])}
        state.update((list(known), [v[0] for v in known.values()], [v[1] for v in known.values()]))
        yield pd.DataFrame(out, columns=["source", "code", "hop", "event"])

    return hops.groupBy("source").applyInPandasWithState(
        step, "source long, code string, hop long, event string", "codes array<string>, hits array<array<int>>, confirmed array<boolean>", "append", "NoTimeout"
    )


def churn(hops: DataFrame) -> DataFrame:
    """By source: hops, changes of the fired set from hop to hop, and codes ever shown."""
    sets = hops.groupBy("source", "hop").agg(F.array_sort(F.collect_set(F.when(F.col("fired"), F.col("code")))).alias("codes"))
    before = F.lag("codes").over(W.partitionBy("source").orderBy("hop"))
    c = sets.withColumn("changed", (F.coalesce(before, F.array().cast("array<string>")) != F.col("codes")).cast("int"))
    ever = hops.where("fired").groupBy("source").agg(F.count_distinct("code").alias("codes_ever"))
    g = c.groupBy("source").agg(F.count("*").alias("hops"), F.sum("changed").alias("changes"))
    return g.join(ever, "source", "left").withColumn("codes_ever", F.coalesce("codes_ever", F.lit(0).cast("long")))


def request_metrics(requests: DataFrame, latest: int = 2000) -> DataFrame:
    """By key: count, errors and rate of all requests; latency percentiles, mean and largest of its latest requests (ts, id)."""
    newest = W.partitionBy("key").orderBy(F.desc("ts"), F.desc("id"))
    r = requests.withColumn("k", F.row_number().over(newest)).where(F.col("k") <= latest)
    q = F.percentile("latency", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    timed = r.groupBy("key").agg(q.alias("q"), F.avg("latency").alias("mean"), F.max("latency").alias("most"))
    g = requests.groupBy("key").agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("errors")).join(timed, "key")
    return g.select("key", "n", "errors", (F.col("errors") / F.col("n")).alias("error_rate"), F.col("q")[0].alias("p50"), F.col("q")[1].alias("p95"), F.col("q")[2].alias("p99"), "mean", "most")
