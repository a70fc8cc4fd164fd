"""Streams whose rows arrive in any order, worked on in order."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE = "carried string, ts array<long>, seq array<long>, rank array<int>, body array<string>"


def in_order(rows: DataFrame, key: str, delay: str, step: Callable[[dict, list[dict], int], tuple[dict, list[tuple], int | None]], output: str) -> DataFrame:
    """``key`` and the columns ``output`` that ``step`` makes of each key's ``rows(key, ts, seq, rank, body)``, in order of ts, seq, rank.

    Rows wait in state until the watermark, ``delay`` behind the latest ts of all keys, has passed them; rows that come
    later than that are dropped, by the engine.  ``step`` takes what the key carries (a dict), the rows that are due
    (dicts: the JSON of body, ts in microseconds, seq) and the watermark, and returns what to carry, rows to emit, and
    when to be called again though nothing comes (microseconds), or None.  Rows with a null ts are left out.
    """
    kind = rows.schema[key].dataType.simpleString()
    names = [key, *(c.split()[0] for c in output.split(", "))]

    def run(keys, frames, state):
        carried, waiting = {}, []
        if state.exists:
            text, *lists = state.get
            carried, waiting = json.loads(text), list(zip(*lists))
        if not state.hasTimedOut:
            for f in frames:
                waiting += zip(f["at"].tolist(), f["seq"].tolist(), f["rank"].tolist(), f["body"].tolist())
        watermark = state.getCurrentWatermarkMs() * 1000
        waiting.sort()
        due = [{**json.loads(b), "ts": t, "seq": s} for t, s, _, b in waiting if t <= watermark]
        waiting = waiting[len(due) :]
        carried, out, again = step(carried, due, watermark)
        state.update((json.dumps(carried), *([list(c) for c in zip(*waiting)] or [[]] * 4)))
        wake = min([t for t in (waiting[0][0] if waiting else None, again) if t is not None], default=None)
        if wake is not None:
            state.setTimeoutTimestamp(max(wake // 1000, watermark // 1000) + 1)
        if out:
            yield pd.DataFrame([(keys[0], *o) for o in out], columns=names).astype({n: "Int64" for n, c in zip(names[1:], output.split(", ")) if c.endswith(" long")})

    given = rows.where("ts is not null").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).selectExpr(key, "unix_micros(ts) as at", "ts", "seq", "rank", "body")
    return given.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {output}", STATE, "append", "EventTimeTimeout")
