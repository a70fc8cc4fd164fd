"""Recording of build events, over a batch or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import carry_forward
from .ordered import in_order

LABEL_WIDTH = 12


def _micros(name: str):
    return F.unix_micros(F.col(name).cast("timestamp"))


def _line(emacs: bool):
    label = F.concat(F.lit("["), F.col("target").cast("string"), F.lit("] "))
    label = F.when(F.length(label) < LABEL_WIDTH, F.lpad(label, LABEL_WIDTH, " ")).otherwise(label)
    return F.col("message") if emacs else F.concat(label, F.col("message"))


def _kept(events: DataFrame, level: int) -> DataFrame:
    if not 0 <= level <= 4:
        raise ValueError("a level is 0 to 4")
    return events.where(F.col("priority") <= level)


def record(events: DataFrame, level: int = 2, emacs: bool = False) -> DataFrame:
    """``event_id, line``: messages of priority up to ``level``, behind the label ``[target]`` right-aligned unless emacs."""
    return _kept(events, level).select("event_id", _line(emacs).alias("line"))


def record_while_on(events: DataFrame, actions: DataFrame, level: int = 2, emacs: bool = False) -> DataFrame:
    """``build, recorder, event_id, line``: what each recorder of a build records while it is on.

    ``events(build, event_id, ts, target, priority, message)``, ``actions(build, recorder, event_id, ts, action)``.  A
    recorder exists from its first action: ``start`` and null turn it on, ``stop`` off, and a null later changes nothing.
    An action holds from its own place (ts, event_id) on, for the message of that place too.  The state is carried along
    each recorder's messages by ranges, so that a build that holds a third of all messages is many tasks.
    """
    recorders = actions.select("build", "recorder").distinct()
    order = ["ts", "event_id", "seq"]
    said = _kept(events, level).select("build", "ts", "event_id", F.lit(1).alias("seq"), _line(emacs).alias("line")).join(recorders, "build")
    done = actions.select("build", "recorder", "ts", "event_id", F.lit(0).alias("seq"), F.coalesce("action", F.lit("")).alias("action"))
    rows = said.unionByName(done, allowMissingColumns=True)
    state = {"on": F.when(F.col("action").isin("start", "stop"), F.col("action") == "start"), "there": F.when(F.col("action").isNotNull(), True)}
    carried = carry_forward(rows, ["build", "recorder"], order, state)
    return carried.where((F.col("seq") == 1) & F.coalesce("on", "there", F.lit(False))).select("build", "recorder", "event_id", "line")


def _switch(carried: dict, rows: list[dict], watermark: int):
    out = []
    for r in rows:
        if "recorder" in r:
            on = carried.get(r["recorder"])
            carried[r["recorder"]] = r["action"] == "start" if r.get("action") else True if on is None else on
        else:
            out += [(k, r["seq"], r["line"]) for k, on in sorted(carried.items()) if on]
    return carried, out, None


def stream_record_while_on(events: DataFrame, actions: DataFrame, level: int = 2, emacs: bool = False, delay: str = "1 hour") -> DataFrame:
    """``record_while_on`` over streams whose rows arrive in any order, up to ``delay`` late; state is a build's recorders."""
    said = _kept(events, level).select("build", "ts", F.col("event_id").alias("seq"), F.lit(1).alias("rank"), F.to_json(F.struct(_line(emacs).alias("line"))).alias("body"))
    done = actions.select("build", "ts", F.col("event_id").alias("seq"), F.lit(0).alias("rank"), F.to_json(F.struct("recorder", "action")).alias("body"))
    rows = in_order(said.unionByName(done), "build", delay, _switch, "recorder string, event_id long, line string")
    return rows.select("build", "recorder", "event_id", "line")


def durations(events: DataFrame, within: float | None = None) -> DataFrame:
    """``target, started_id, finished_id, seconds`` of each started event: until the finished one that follows it directly.

    Started events that another one follows, or nothing, or that finish later than ``within`` seconds, are unfinished:
    finished_id and seconds are null.  The next event is looked up by ranges, so that a hot target is many tasks.
    """
    rows = events.select("target", "ts", "event_id", "kind")
    told = carry_forward(rows, ["target"], ["ts", "event_id"], {"after": F.struct("kind", "ts", "event_id")}, upto_here=False, backward=True)
    seconds = (F.unix_micros(F.col("after.ts").cast("timestamp")) - _micros("ts")) / 1e6
    done = (F.col("after.kind") == "finished") & (F.lit(True) if within is None else seconds <= within)
    return told.where("kind = 'started'").select("target", F.col("event_id").alias("started_id"), F.when(done, F.col("after.event_id")).alias("finished_id"), F.when(done, F.round(seconds, 3)).alias("seconds"))


def _pair(within: float):
    limit = round(within * 1e6)

    def step(carried: dict, rows: list[dict], watermark: int):
        out = []
        for r in rows:
            begun = carried.pop("begun", None)
            if begun:
                took = r["ts"] - begun[0]
                done = r.get("kind") == "finished" and took <= limit
                out.append((begun[1], r["seq"] if done else None, took if done else None))
            if r.get("kind") == "started":
                carried["begun"] = [r["ts"], r["seq"]]
        if "begun" in carried and carried["begun"][0] + limit < watermark:  # nothing that comes can finish it in time
            out.append((carried.pop("begun")[1], None, None))
        return carried, out, carried["begun"][0] + limit if "begun" in carried else None

    return step


def stream_durations(events: DataFrame, within: float = 86_400.0, delay: str = "1 hour") -> DataFrame:
    """``durations`` over a stream whose events arrive in any order, up to ``delay`` late.

    A pair is told when the watermark has passed its end; a started event that is not finished ``within`` seconds is
    told as unfinished by a timer.  State is one started event a target, and what the watermark has not reached.
    """
    rows = events.select("target", "ts", F.col("event_id").alias("seq"), F.lit(0).alias("rank"), F.to_json(F.struct("kind")).alias("body"))
    return in_order(rows, "target", delay, _pair(within), "started_id long, finished_id long, micros long").select("target", "started_id", "finished_id", F.round(F.col("micros") / 1e6, 3).alias("seconds"))


def run_to_table(stream: DataFrame, path: str) -> DataFrame:
    """Process what is available now into a Parquet table below ``path``, in a folder that all executors share, and read it."""
    sink = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint")
    sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")
