"""Monitors whose state lives in the stream: due analyses, confirmed codes, resets and silent sources."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: One row for each analysis that a chunk makes due, each change of a code's state, each reset and each source that fell silent.
OUTPUT = "source long, seq long, event string, code string, total long, skipped long"


def due_count(total: Column, window: int, hop: int) -> Column:
    """How many analyses a source of so many samples has been due: the first at ``window`` samples, then one every ``hop``."""
    return F.when(total >= window, F.floor((total - window) / hop) + 1).otherwise(F.lit(0)).cast("long")


def due_analyses(chunks: DataFrame, window: int, hop: int) -> DataFrame:
    """W02, W06 in batch: source, seq, total, skipped for every chunk that completes a hop.

    ``chunks``: source, seq, n (samples of the chunk, null for a control row
    that resets the source). A chunk that completes several hops gives one
    analysis, on the newest data, and ``skipped`` older ones. A reset empties
    the buffer: counting starts at 0 after it.
    """
    order = W.partitionBy("source").orderBy("seq")
    epochs = chunks.withColumn("epoch", F.sum(F.col("n").isNull().cast("int")).over(order))
    own = W.partitionBy("source", "epoch").orderBy("seq")
    # a source's epochs lie in one partition already: no further exchange
    sums = epochs.where("n is not null").withColumn("total", F.sum("n").over(own).cast("long")).withColumn("before", F.col("total") - F.col("n"))
    new = due_count(F.col("total"), window, hop) - due_count(F.col("before"), window, hop)
    return sums.withColumn("new", new).where("new > 0").select("source", "seq", "total", (F.col("new") - 1).alias("skipped"))


class Monitor(StatefulProcessor):
    """State of one source: samples so far, hit flags of the watched codes, and which are confirmed."""

    def __init__(self, window: int, hop: int, k: int, m: int, idle_ms: int):
        self.window, self.hop, self.k, self.m, self.idle_ms = window, hop, k, m, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.position = handle.getValueState("position", "total long", ttlDurationMs=2 * self.idle_ms)
        self.codes = handle.getMapState("codes", "code string", "hits string, confirmed boolean", ttlDurationMs=2 * self.idle_ms)

    def _clear(self) -> None:
        self.position.clear()
        self.codes.clear()

    def _due(self, total: int) -> int:
        return 0 if total < self.window else (total - self.window) // self.hop + 1

    def _analysed(self, fired: set[str]) -> Iterator[tuple[str, str]]:
        """(event, code) of an analysis: confirmed by k of the last m, released by none of m."""
        known = {key[0]: (value[0], value[1]) for key, value in self.codes.iterator()}
        for code in sorted(fired | set(known)):
            hits, on = known.get(code, ("", False))
            hits = (hits + ("1" if code in fired else "0"))[-self.m :]
            event = "onset" if not on and hits.count("1") >= self.k else "offset" if on and "1" not in hits else None
            on = event == "onset" or on and event is None
            if on or "1" in hits:
                self.codes.updateValue((code,), (hits, on))
            elif code in known:
                self.codes.removeKey((code,))
            if event:
                yield event, code

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        source, out = key[0], []
        total = self.position.get()[0] if self.position.exists() else 0
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            if pd.isna(r.n):
                self._clear()
                total = 0
                out.append((source, r.seq, "reset", None, 0, 0))
                continue
            new = self._due(total + int(r.n)) - self._due(total)
            total += int(r.n)
            if new > 0:
                out.append((source, r.seq, "analysis", None, total, new - 1))
                out += [(source, r.seq, event, code, total, 0) for event, code in self._analysed(set(r.codes if r.codes is not None else []))]
        self.position.update((total,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame(out, columns=["source", "seq", "event", "code", "total", "skipped"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        total = self.position.get()[0] if self.position.exists() else 0
        self._clear()
        yield pd.DataFrame([(key[0], -1, "silent", None, total, 0)], columns=["source", "seq", "event", "code", "total", "skipped"])

    def close(self) -> None:
        pass


def stream_monitor(chunks: DataFrame, *, window: int, hop: int, k: int, m: int, idle_ms: int = 3_600_000) -> DataFrame:
    """W02, W03 and W06 on a stream of (source long, seq long, n long, codes array<string>): rows of ``OUTPUT``.

    ``codes`` are those that fire on the newest data of a chunk; they count
    only where the chunk makes an analysis due. A row whose ``n`` is null
    resets its source. A source that sends nothing for ``idle_ms`` gives a row
    "silent" and loses its state; what a timer misses goes by its time to
    live, twice that long. Within a trigger rows of a source are taken by
    ``seq``; across triggers they must arrive in order. Needs the RocksDB
    state store.
    """
    if not 1 <= k <= m:
        raise ValueError("1 <= k <= m")
    return chunks.select("source", "seq", "n", "codes").groupBy("source").transformWithStateInPandas(
        statefulProcessor=Monitor(window, hop, k, m, idle_ms), outputStructType=OUTPUT, outputMode="Append", timeMode="ProcessingTime"
    )


def monitor_events(chunks: DataFrame, *, window: int, hop: int, k: int, m: int) -> DataFrame:
    """The batch twin of ``stream_monitor``, without silent sources."""
    from .monitor import confirmation_events

    order = W.partitionBy("source").orderBy("seq")
    rows = chunks.withColumn("epoch", F.sum(F.col("n").isNull().cast("int")).over(order))
    due = due_analyses(chunks, window, hop)
    none = F.lit(None).cast("string")
    zero = F.lit(0).cast("long")
    analyses = due.select("source", "seq", F.lit("analysis").alias("event"), none.alias("code"), "total", "skipped")
    resets = chunks.where("n is null").select("source", "seq", F.lit("reset").alias("event"), none.alias("code"), zero.alias("total"), zero.alias("skipped"))
    shown = rows.join(due.select("source", "seq", "total"), ["source", "seq"]).select("source", "epoch", F.col("seq").alias("hop"), "total", F.explode_outer("codes").alias("code"))
    hops = shown.withColumn("fired", F.col("code").isNotNull())
    changed = confirmation_events(hops, k, m, ("source", "epoch")).select("source", F.col("hop").alias("seq"), "event", "code").join(due.select("source", "seq", "total"), ["source", "seq"])
    return analyses.unionByName(resets).unionByName(changed.select("source", "seq", "event", "code", "total", zero.alias("skipped")))
