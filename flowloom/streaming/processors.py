"""Keyed streaming state: causal windows, cooldowns and pair series.

Each processor is the step function of the batch folds with its state kept between batches, so a
stream gives what the batch gives on the same rows in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from flowloom.operators.folds import cooldown_step, early_step, reanchor_step


def stateful_fold(stream: DataFrame, key: str, order: str, inputs: list[str], columns: list[str], output: str, step: Callable, state_schema: str, idle_ms: int | None = None) -> DataFrame:
    """``columns`` and ``output`` of every row; rows of a batch are folded in ``order``.

    With ``idle_ms``, ``stream`` has a watermark on ``ts``, and the state of a key goes when that passes the
    key's last row by so much; a later row of the key begins anew.
    """
    types = dict(stream.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in columns) + f", {output} long"

    def run(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        now, out = (state.get if state.exists else None), []
        for row in zip(*(rows[c].tolist() for c in inputs), strict=True):
            now, value = step(now, row)
            out.append(value)
        state.update(now)
        if idle_ms is not None:
            state.setTimeoutTimestamp(max(int(rows["_ms"].max()), state.getCurrentWatermarkMs()) + idle_ms)
        yield rows[columns].assign(**{output: out})

    kind = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.EventTimeTimeout
    if idle_ms is not None:
        stream = stream.withColumn("_ms", F.unix_millis("ts"))
    return stream.groupBy(key).applyInPandasWithState(run, schema, state_schema, "append", kind)


def _timed(stream: DataFrame, key: str, value: Column, name: str, delay: str | None) -> DataFrame:
    rows = stream if delay is None else stream.withWatermark("ts", delay)
    return rows.select(key, "event_id", "ts", value.alias(name))


def causal_windows(stream: DataFrame, key: str, width_us: int, idle_ms: int | None = None, delay: str | None = None) -> DataFrame:
    """Numbers of re-anchoring windows; ``stream`` has ``event_id, ts``. With ``idle_ms``, ``delay`` is the watermark's."""
    rows = _timed(stream, key, F.unix_micros("ts"), "ts_us", delay)
    return stateful_fold(rows, key, "event_id", ["ts_us"], [key, "event_id"], "win_no", reanchor_step(width_us), "number long, start long", idle_ms)


def guarded_windows(stream: DataFrame, key: str, width_us: int, timeout_us: int, activity_cap_us: int, packet_cap: int, idle_ms: int | None = None, delay: str | None = None) -> DataFrame:
    """One causal window an instance: a frozen window takes no more rows until a gap or a cap ends it (0).

    With ``idle_ms`` of the timeout or more, ending a key's state changes no window, but numbers begin anew.
    """
    rows = _timed(stream, key, F.unix_micros("ts"), "ts_us", delay)
    step = early_step(width_us, timeout_us, activity_cap_us, packet_cap)
    return stateful_fold(rows, key, "event_id", ["ts_us"], [key, "event_id"], "win_no", step, "number long, active boolean, start long, last long, n long", idle_ms)


def cooldowns(stream: DataFrame, key: str, wait_s: float, idle_ms: int | None = None, delay: str | None = None) -> DataFrame:
    """Which alerts are emitted, given the wait after an emission; state that is idle for the wait decides nothing."""
    rows = _timed(stream, key, F.unix_micros("ts") / 1e6, "ts_s", delay)
    step = cooldown_step(wait_s)

    def one(state: tuple | None, row: tuple) -> tuple:
        last, value = step(state[0] if state else None, row)
        return (last,), value

    return stateful_fold(rows, key, "event_id", ["ts_s"], [key, "event_id"], "emitted", one, "last double", idle_ms)


def tumbling(stream: DataFrame, width: str, delay: str, keys: list[str]) -> DataFrame:
    """Buckets of event time; a bucket appears once the watermark has passed its end."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", width), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(stream: DataFrame, gap: str, delay: str, key: str) -> DataFrame:
    """Sessions of a key; a gap of exactly the timeout starts a new one."""
    return stream.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n"))


def first_of_each(stream: DataFrame, delay: str, keys: list[str]) -> DataFrame:
    """The first row of each key within the watermark; later ones are dropped."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def pair_series_stream(stream: DataFrame, most: int = 256, ttl_ms: int = 900_000) -> DataFrame:
    """Updates of every pair's series: how many starts there were, and the first ``most`` of them.

    ``stream`` has ``src, dst, event_id, ts_us`` and a watermark on ``ts``; a pair's state goes when event
    time passes its last start by ``ttl_ms``.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        new = pd.concat(list(batches)).sort_values(["ts_us", "event_id"], kind="stable")["ts_us"].tolist()
        held, n = state.get if state.exists else ([], 0)
        held = [*held, *new[: max(0, most - len(held))]]
        state.update((held, n + len(new)))
        state.setTimeoutTimestamp(max(new[-1] // 1000, state.getCurrentWatermarkMs()) + ttl_ms)
        yield pd.DataFrame({"src": [key[0]], "dst": [key[1]], "events": [n + len(new)], "kept": [len(held)], "first_us": [held[0]]})

    schema = "src long, dst long, events long, kept long, first_us long"
    return stream.groupBy("src", "dst").applyInPandasWithState(run, schema, "starts array<long>, n long", "update", GroupStateTimeout.EventTimeTimeout)
