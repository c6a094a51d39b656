"""Event operators: as batch queries over a table of events, and as stateful streams with the same results.

Events are (event_id, ts, key, kind, ...). The order within a key is by (ts, event_id); a stream relies on its
watermark to bound state, and orders what arrives together in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_ORDER = ("ts", "event_id")


def _of(key: str) -> Any:
    return Window.partitionBy(key).orderBy(*_ORDER)


def millis(ts: Column | str) -> Column:
    return F.unix_millis((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


# --- batch -------------------------------------------------------------------------------------------------


def rising_edges(events: DataFrame, key: str, flag: Column) -> DataFrame:
    """The events at which a key's flag turns from false to true; its first event only sets the state."""
    before = F.lag("flag").over(_of(key))
    return events.withColumn("flag", flag).withColumn("before", before).where("flag AND before IS NOT NULL AND NOT before").drop("flag", "before")


def durations(events: DataFrame, key: str) -> DataFrame:
    """Milliseconds since the key's event before (0 for the first), and their running sum."""
    gap = F.coalesce(millis("ts") - F.lag(millis("ts")).over(_of(key)), F.lit(0))
    out = events.withColumn("duration_ms", gap)
    return out.withColumn("sum_ms", F.sum("duration_ms").over(_of(key).rowsBetween(Window.unboundedPreceding, 0)))


def mark_delta(events: DataFrame, key: str, kind: str, first: str, second: str) -> DataFrame:
    """(key, delta_ms): from the last mark of one kind to the last of another, for keys that have both."""
    last = events.groupBy(key).agg(F.max(F.when(F.col(kind) == first, F.col("ts"))).alias("a"), F.max(F.when(F.col(kind) == second, F.col("ts"))).alias("b"))
    return last.where("a IS NOT NULL AND b IS NOT NULL").select(key, (millis("b") - millis("a")).alias("delta_ms"))


def coordinated(events: DataFrame, key: str, kind: str, first: str, second: str) -> DataFrame:
    """(key, start_ts): when a key has had both kinds, in whatever order, once."""
    seen = events.groupBy(key).agg(F.min(F.when(F.col(kind) == first, F.col("ts"))).alias("a"), F.min(F.when(F.col(kind) == second, F.col("ts"))).alias("b"))
    return seen.where("a IS NOT NULL AND b IS NOT NULL").select(key, F.greatest("a", "b").alias("start_ts"))


def first_only(events: DataFrame, key: str, kind: str, trigger: str) -> DataFrame:
    """Of each key's events of the kind the first: the others are refused at the gate."""
    return events.where(F.col(kind) == trigger).withColumn("nth", F.row_number().over(_of(key))).where("nth = 1").drop("nth")


def sessions(events: DataFrame, key: str, kind: str, starts: tuple[str, ...], end: str) -> DataFrame:
    """(key, session, start_ts, last_ts, n, total, closed): runs of events from a start, which resets, to the end or the next start.

    Events before the first start, and those after an end, belong to no session.
    """
    begin = F.col(kind).isin(*starts)
    nth = F.sum(F.when(begin, 1).otherwise(0)).over(_of(key).rowsBetween(Window.unboundedPreceding, 0))
    out = events.withColumn("session", nth).where("session > 0")
    within = Window.partitionBy(key, "session").orderBy(*_ORDER)
    ended = F.sum(F.when(F.col(kind) == end, 1).otherwise(0)).over(within.rowsBetween(Window.unboundedPreceding, -1))
    out = out.withColumn("ended", F.coalesce(ended, F.lit(0))).where("ended = 0")
    return out.groupBy(key, "session").agg(
        F.min("ts").alias("start_ts"),
        F.max("ts").alias("last_ts"),
        F.count("*").alias("n"),
        F.round(F.sum("value"), 4).alias("total"),
        F.bool_or(F.col(kind) == end).alias("closed"),
    )


def snapshot_at(events: DataFrame, triggers: DataFrame, key: str, kind: str) -> DataFrame:
    """(event_id, kind, value): at each trigger the latest value of every kind of its key up to then.

    One sweep over the key's events in order, triggers last among equals: no join by time.
    """
    marked = events.select(key, "ts", "event_id", F.col(kind).alias("kind"), "value", F.lit(0).alias("is_trigger"))
    asked = triggers.select(key, "ts", "event_id", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("double").alias("value"), F.lit(1).alias("is_trigger"))
    order = Window.partitionBy(key).orderBy("ts", "is_trigger", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    kinds = [r[0] for r in events.select(kind).distinct().orderBy(kind).collect()]  # event types: a fixed, short list
    both = marked.unionByName(asked)
    cols = [F.last(F.when(F.col("kind") == k, F.col("value")), ignorenulls=True).over(order).alias(f"k{n}") for n, k in enumerate(kinds)]
    swept = both.select("event_id", "is_trigger", *cols).where("is_trigger = 1")
    pairs = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"k{n}").alias("value")) for n, k in enumerate(kinds)))
    return swept.select("event_id", F.explode(pairs).alias("x")).select("event_id", "x.*").where("value IS NOT NULL")


def dispatch(events: DataFrame, subscriptions: DataFrame, kind: str) -> DataFrame:
    """(event_id, handler, place): handlers of each event, highest priority (1 to 4) first, then by subscription."""
    p = F.least(F.greatest("priority", F.lit(1)), F.lit(4))
    both = events.select("event_id", kind).join(F.broadcast(subscriptions.withColumn("p", p)), kind)
    place = F.row_number().over(Window.partitionBy("event_id").orderBy(F.desc("p"), "nth"))
    return both.select("event_id", "handler", place.alias("place"))


# --- streams -----------------------------------------------------------------------------------------------


def _sorted(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(list(_ORDER))


def stream_rising_edges(events: DataFrame, key: str, flag: Column, delay: str = "10 minutes") -> DataFrame:
    """As `rising_edges`, over a stream: the last flag of each key is its state."""
    kind = dict(events.dtypes)[key]

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = _sorted(frames)
        last = state.get[0] if state.exists else None
        out = []
        for r in rows.itertuples(index=False):
            if last is not None and r.flag and not last:
                out.append((r.event_id, r.ts, k[0]))
            last = bool(r.flag)
        state.update((last,))
        yield pd.DataFrame(out, columns=["event_id", "ts", key])

    rows = events.withWatermark("ts", delay).select("event_id", "ts", key, flag.alias("flag"))
    return rows.groupBy(key).applyInPandasWithState(step, f"event_id long, ts timestamp, `{key}` {kind}", "flag boolean", "append", GroupStateTimeout.NoTimeout)


def stream_durations(events: DataFrame, key: str, delay: str = "10 minutes") -> DataFrame:
    """As `durations`, over a stream: a key's state is its last time and the sum so far."""
    kind = dict(events.dtypes)[key]

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = _sorted(frames)
        last, total = state.get if state.exists else (None, 0)
        out = []
        for r in rows.itertuples(index=False):
            now = int(r.ts.value // 1_000_000)
            gap = 0 if last is None else now - last
            total += gap
            last = now
            out.append((r.event_id, k[0], gap, total))
        state.update((last, total))
        yield pd.DataFrame(out, columns=["event_id", key, "duration_ms", "sum_ms"])

    rows = events.withWatermark("ts", delay).select("event_id", "ts", key)
    return rows.groupBy(key).applyInPandasWithState(step, f"event_id long, `{key}` {kind}, duration_ms long, sum_ms long", "last long, total long", "append", GroupStateTimeout.NoTimeout)


def stream_coordinated(events: DataFrame, key: str, kind: str, first: str, second: str, delay: str = "10 minutes") -> DataFrame:
    """As `coordinated`, over a stream: tells a key once, when the second of its two kinds has come."""
    of_key = dict(events.dtypes)[key]

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        a, b, told = state.get if state.exists else (None, None, False)
        out = []
        for r in _sorted(frames).itertuples(index=False):
            now = int(r.ts.value // 1000)
            if r.kind == first and a is None:
                a = now
            elif r.kind == second and b is None:
                b = now
        if a is not None and b is not None and not told:
            out.append((k[0], pd.Timestamp(max(a, b), unit="us")))
            told = True
        state.update((a, b, told))
        yield pd.DataFrame(out, columns=[key, "start_ts"])

    rows = events.withWatermark("ts", delay).where(F.col(kind).isin(first, second)).select("event_id", "ts", key, F.col(kind).alias("kind"))
    return rows.groupBy(key).applyInPandasWithState(step, f"`{key}` {of_key}, start_ts timestamp", "a long, b long, told boolean", "append", GroupStateTimeout.NoTimeout)


def stream_first_only(events: DataFrame, key: str, kind: str, trigger: str, delay: str = "1 hour") -> DataFrame:
    """The gate over a stream: a key's first trigger within the watermark passes, the others don't."""
    return events.where(F.col(kind) == trigger).withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def stream_sessions(events: DataFrame, key: str, kind: str, starts: tuple[str, ...], end: str, delay: str = "10 minutes") -> DataFrame:
    """Closed sessions of a stream, told at their end; a start resets a key, events outside of a session are dropped as stale."""
    of_key = dict(events.dtypes)[key]

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        nth, active, begin, n, total = state.get if state.exists else (0, False, 0, 0, 0.0)
        out = []
        for r in _sorted(frames).itertuples(index=False):
            if r.kind in starts:
                nth, active, begin, n, total = nth + 1, True, int(r.ts.value // 1000), 0, 0.0
            if not active:
                continue
            n, total = n + 1, total + (0.0 if pd.isna(r.value) else float(r.value))
            if r.kind == end:
                out.append((k[0], nth, pd.Timestamp(begin, unit="us"), r.ts, n, round(total, 4)))
                active = False
        state.update((nth, active, begin, n, total))
        yield pd.DataFrame(out, columns=[key, "session", "start_ts", "last_ts", "n", "total"])

    rows = events.withWatermark("ts", delay).select("event_id", "ts", key, F.col(kind).alias("kind"), "value")
    return rows.groupBy(key).applyInPandasWithState(
        step, f"`{key}` {of_key}, session long, start_ts timestamp, last_ts timestamp, n long, total double", "nth long, active boolean, begin long, n long, total double", "append", GroupStateTimeout.NoTimeout
    )


def append_csv(path: str):
    """A foreachBatch sink that appends rows to CSV files with a header."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("append").option("lineSep", "\r\n").csv(path, header=True)

    return write


# --- commands and queues -----------------------------------------------------------------------------------


def drain(events: DataFrame, queue: str, most: int) -> DataFrame:
    """The events with `call`: which call of a queue's reader takes each, first in first out and `most` at a time."""
    if most < 1:
        raise ValueError("a call takes one event at least")
    return events.withColumn("call", F.floor((F.row_number().over(_of(queue)) - 1) / most).cast("long"))


def due_callbacks(calls: DataFrame, delay_ms: str, period_ms: int) -> DataFrame:
    """The calls with `fired_ms`: the first poll, every `period_ms` from 0 on, at or after a call's time and delay."""
    due = millis("ts") + F.greatest(F.col(delay_ms), F.lit(0))
    return calls.withColumn("fired_ms", (F.ceil(due / F.lit(period_ms)) * F.lit(period_ms)).cast("long"))


def pulse_commands(pulses: DataFrame, width_ms: str, preclear: Column) -> DataFrame:
    """(event_id, step, at_ms, value): low first if asked for, high 20 ms after that, low again after the width (100 ms by default)."""
    at = millis("ts")
    clear = F.coalesce(preclear, F.lit(False))
    high = at + F.when(clear, 20).otherwise(0)
    width = F.when(F.col(width_ms) > 0, F.col(width_ms)).otherwise(F.lit(100))

    def row(step: str, when: Column, value: bool) -> Column:
        return F.struct(F.lit(step).alias("step"), when.cast("long").alias("at_ms"), F.lit(value).alias("value"))

    steps = F.array(F.when(clear, row("preclear", at, False)), row("high", high, True), row("low", high + width, False))
    return pulses.select("event_id", F.explode(F.filter(steps, lambda x: x.isNotNull())).alias("x")).select("event_id", "x.*")


def parameters(events: DataFrame, key: str, kind: str, value: str, *, mode: str, monitoring: str, system: str, snapshot: str) -> DataFrame:
    """(key, failure_mode, monitoring, system, snapshot): what a record of a failure is assembled from.

    The last failure mode and snapshot, all monitoring reactions in their order, the first system reaction.
    """
    order = F.struct("ts", "event_id")

    def of(k: str) -> Column:
        return F.when(F.col(kind) == k, order)

    listed = F.sort_array(F.collect_list(F.when(F.col(kind) == monitoring, F.struct("ts", "event_id", F.col(value).alias("v")))))
    return events.groupBy(key).agg(
        F.max_by(value, of(mode)).alias("failure_mode"),
        F.transform(listed, lambda x: x["v"]).alias("monitoring"),
        F.min_by(value, of(system)).alias("system"),
        F.max_by(value, of(snapshot)).alias("snapshot"),
    )


def segments(events: DataFrame, key: str, kind: str, first: str, second: str) -> DataFrame:
    """(key, event_id, segment_ms): for each mark of the second kind the time since the last one of the first before it."""
    begun = F.last(F.when(F.col(kind) == first, F.col("ts")), ignorenulls=True).over(_of(key).rowsBetween(Window.unboundedPreceding, -1))
    return events.withColumn("begun", begun).where((F.col(kind) == second) & F.col("begun").isNotNull()).select(key, "event_id", (millis("ts") - millis("begun")).alias("segment_ms"))
