"""Structured Streaming forms of the windowed and stateful operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracelake.sources.logs import PARSERS, parse_security


def read_log_stream(spark: SparkSession, path: str, default_year: int, kind: str = "security", files_per_trigger: int = 100) -> DataFrame:
    """Lines of new files as events."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    return parse_security(lines, default_year) if kind == "security" else PARSERS[kind](lines, default_year)


def window_counts(events: DataFrame, width: str, step: str, delay: str) -> DataFrame:
    """Events by half-open, epoch-aligned windows and entity; late rows beyond the delay are dropped."""
    return events.withWatermark("timestamp", delay).groupBy(F.window("timestamp", width, step), "entity").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "failed").alias("n_failed"))


def sessions(events: DataFrame, gap: str, delay: str) -> DataFrame:
    """Events by session windows and entity."""
    return events.withWatermark("timestamp", delay).groupBy(F.session_window("timestamp", gap), "entity").agg(F.count("*").alias("n"))


def alert_cooldown(alerts: DataFrame, seconds: int) -> DataFrame:
    """Critical alerts pass; others only if the entity's last one is older than the cooldown (event time).

    alerts: entity, us, severity, score.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for frame in frames:
            kept = []
            for row in frame.sort_values("us").itertuples(index=False):
                if row.severity == "CRITICAL" or last is None or row.us - last >= seconds * 1_000_000:
                    kept.append(row)
                    last = row.us
            if kept:
                yield pd.DataFrame(kept)[["entity", "us", "severity", "score"]]
        if last is not None:
            state.update((last,))

    return alerts.select("entity", "us", "severity", "score").groupBy("entity").applyInPandasWithState(run, "entity string, us long, severity string, score double", "last long", "append", GroupStateTimeout.NoTimeout)


#: transformWithState keeps its state in this provider.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Ordered(StatefulProcessor):
    """A key's events in the order of their times, whatever batch they came in.

    Events wait until the watermark has passed them, for which each time has a timer; then they go through in order,
    ties alike, against what the key carries: its last time, and the times in its buffer.
    """

    def __init__(self, seconds: int, max_gap_s: int, most: int):
        self.width, self.gap, self.most = seconds * 1_000_000, max_gap_s * 1_000_000, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long")
        self.carried = handle.getValueState("carried", "last long, dropped long, times array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times = [int(us) for frame in rows for us in frame["us"]]
        if times:
            self.waiting.appendList([(us,) for us in times])
            for ms in {-(-us // 1000) for us in times}:
                self.handle.registerTimer(ms)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        reached = timerValues.getCurrentWatermarkInMs() * 1000
        held = [us for (us,) in self.waiting.get()] if self.waiting.exists() else []
        due = sorted(us for us in held if us <= reached)
        if not due:  # another timer of this watermark has taken them
            return
        rest = [(us,) for us in held if us > reached]
        self.waiting.put(rest) if rest else self.waiting.clear()
        last, dropped, times = self.carried.get() if self.carried.exists() else (None, 0, [])
        times, out = list(times), []
        for us in due:
            gap = 0 if last is None else us - last
            times.append(us)
            times = [x for x in times if x >= us - self.width]
            if len(times) > self.most:
                dropped += len(times) - self.most
                times = times[-self.most :]
            out.append((key[0], us, gap, "ACTIVITY_GAP" if gap > self.gap else None, len(times), dropped))
            last = us
        self.carried.update((last, dropped, times))
        yield pd.DataFrame(out, columns=["entity", "us", "gap", "kind", "n", "dropped"])

    def close(self) -> None:
        pass


def ordered_activity(events: DataFrame, seconds: int, max_gap_s: int = 3600, delay: str = "10 minutes", most: int = 50_000) -> DataFrame:
    """For each event (entity, us) in order of time: the gap before it, ACTIVITY_GAP where that is too long, and how many of
    its entity's events lie in the last seconds.

    Events come out once the watermark, delay behind the latest time, has passed them; later ones are left out by Spark and
    counted in the query's progress (numRowsDroppedByWatermark). A buffer holds at most so many times; ``dropped``
    counts those it had to let go. Of events of one time each counts itself and those before it. The session's state store
    must be STATE_STORE.
    """
    timed = events.select("entity", "us", F.timestamp_micros("us").alias("timestamp")).withWatermark("timestamp", delay)
    schema = "entity string, us long, gap long, kind string, n long, dropped long"
    return timed.groupBy("entity").transformWithStateInPandas(_Ordered(seconds, max_gap_s, most), schema, "append", "eventTime")


def rolling_buffer(events: DataFrame, seconds: int, most: int = 50_000) -> DataFrame:
    """For each event, how many of its entity's events lie in the last seconds, by arrival.

    At most so many are held; ``dropped`` counts those the entity's buffer had to let go, so n is a lower bound
    from the first of them on. ordered_activity orders events over batches.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, dropped = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        for frame in frames:
            out = []
            for us in frame["us"].sort_values().tolist():
                held = [x for x in held if x >= us - seconds * 1_000_000] + [us]
                if len(held) > most:
                    dropped += len(held) - most
                    held = held[-most:]
                out.append((key[0], us, len(held), dropped))
            yield pd.DataFrame(out, columns=["entity", "us", "n", "dropped"])
        state.update((held, dropped))

    return events.select("entity", "us").groupBy("entity").applyInPandasWithState(run, "entity string, us long, n long, dropped long", "held array<long>, dropped long", "append", GroupStateTimeout.NoTimeout)
