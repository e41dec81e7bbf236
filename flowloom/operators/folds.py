"""Ordered stateful folds over groups of any size.

Rules that anchor on their own earlier decisions (caps, re-anchoring windows, cooldowns, mirror
duplicates) are no window frames. They are folded here over the rows of a key in order: rows are
dealt by key, sorted within the partition and streamed through the state machine in Arrow batches,
so a key's rows are never held together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType


def ordered_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], inputs: Sequence[str], output: str, step: Callable[[object, tuple], tuple[object, object]], kind: str = "long", dealt: bool = False) -> DataFrame:
    """``df`` with the column ``output``: ``step(state, inputs)`` gives ``(state, value)``; a key's first state is None.

    Keys are told apart by a hash of their values and of which are null, beside their order; only the
    inputs leave Arrow. ``dealt``: the rows are partitioned by the keys already.
    """
    schema = StructType([*df.schema.fields, StructField(output, StringType() if kind == "string" else LongType())])
    mark = F.xxhash64(*[x for k in keys for x in (F.col(k).isNull(), F.col(k))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            own = b.column(n_cols).to_numpy()
            new = np.concatenate([[last is None or own[0] != last], own[1:] != own[:-1]])
            last, out = own[-1], []
            for fresh, row in zip(new.tolist(), zip(*(b.column(i).to_pylist() for i in at)), strict=True):
                if fresh:
                    state = None
                state, value = step(state, row)
                out.append(value)
            yield pa.RecordBatch.from_arrays([*b.columns[:n_cols], pa.array(out, pa.string() if kind == "string" else pa.int64())], names=names)

    n_cols, at, names = len(df.columns), [df.columns.index(c) for c in inputs], [*df.columns, output]
    rows = df if dealt else df.repartition(*[F.col(k) for k in keys])
    return rows.sortWithinPartitions(*keys, *order).select(*df.columns, mark).mapInArrow(run, schema)


def caps_step(packet_cap: int, activity_cap_us: int) -> Callable:
    """Instance numbers: a new one where the input flag says so or after a packet that reached a cap.

    Inputs ``(flag, ts_us)``. Both caps are tested after a packet is added; it still belongs to its instance.
    """

    def step(state, row):
        flag, ts = row
        number, start, n, cut = state or (0, 0, 0, True)
        if cut or flag:
            number, start, n = number + 1, ts, 0
        n += 1
        return (number, start, n, n >= packet_cap or ts - start >= activity_cap_us), number

    return step


def reanchor_step(width_us: int) -> Callable:
    """Window numbers: the first packet later than start + width starts a new window. Inputs ``(ts_us,)``."""

    def step(state, row):
        number, start = state or (0, None)
        if start is None or row[0] > start + width_us:
            number, start = number + 1, row[0]
        return (number, start), number

    return step


def early_step(width_us: int, timeout_us: int, activity_cap_us: int, packet_cap: int) -> Callable:
    """One causal window an instance; 0 for packets outside. Inputs ``(ts_us,)``.

    A window takes packets up to start + width; the packet that crosses freezes it and is dropped, as are
    all later ones until the gap reaches the timeout or a cap is reached.
    """

    def step(state, row):
        ts = row[0]
        if state is None:
            return (1, True, ts, ts, 1), 1
        number, active, start, last, n = state
        if active:
            if ts <= start + width_us:
                return (number, True, start, ts, n + 1), number
            return (number, False, start, last, n), 0
        if ts - last >= timeout_us or ts - start >= activity_cap_us or n >= packet_cap:
            return (number + 1, True, ts, ts, 1), number + 1
        return (number, False, start, max(last, ts), n), 0

    return step


def mirror_step(tolerance: int) -> Callable:
    """1 for rows kept, 0 for mirrors: rows within ``tolerance`` of the last kept row. Inputs ``(ts,)``."""

    def step(state, row):
        if state is not None and abs(row[0] - state) <= tolerance:
            return state, 0
        return row[0], 1

    return step


def cooldown_step(wait: float) -> Callable:
    """1 where ``end`` is at least ``wait`` after the last emission (0 at first). Inputs ``(end,)``."""

    def step(state, row):
        last = state or 0.0
        return (row[0], 1) if row[0] - last >= wait else (last, 0)

    return step
