"""Progress events of analysis runs: an append-only log, followed as a stream and folded to states."""

from __future__ import annotations

import time
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EVENTS
from . import log

STEPS = 11
MOST_FINISHED = 20


class EventLog:
    """Writes a run's events to a folder, by a path or an address that all machines see, and tells a listener."""

    def __init__(self, folder: str, run_id: str, listener=None):
        self.folder, self.run_id, self.seq, self.listener = str(folder), run_id, 0, listener

    def emit(self, node: str, phase: str, duration_ms: int | None = None, detail: str | None = None) -> dict:
        event = {"run_id": self.run_id, "seq": self.seq, "node": node, "phase": phase, "at": datetime.now(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z"), "duration_ms": duration_ms, "detail": detail}
        log.put(self.folder, event)
        self.seq += 1
        if self.listener:
            self.listener(event)
        return event

    def step(self, node: str):
        return _Step(self, node)


class _Step:
    def __init__(self, log: EventLog, node: str):
        self.log, self.node, self.detail = log, node, None

    def __enter__(self) -> _Step:
        self.began = time.monotonic()
        self.log.emit(self.node, "start")
        return self

    def __exit__(self, kind, error, trace) -> None:
        ms = round((time.monotonic() - self.began) * 1000)
        self.log.emit(self.node, "error" if error else "end", ms, str(error) if error else self.detail)


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(EVENTS).json(f"{folder}/*.json")


def node_states(events: DataFrame) -> DataFrame:
    """Per run and node the state of its last event, and its first place. Works on a stream in complete or update mode."""
    state = F.when(F.col("phase") == "start", "running").when(F.col("phase") == "end", "done").otherwise("error")
    return events.groupBy("run_id", "node").agg(F.max_by(state, "seq").alias("status"), F.max_by("duration_ms", "seq").alias("duration_ms"), F.max_by("detail", "seq").alias("detail"), F.min("seq").alias("first_seq"))


def progress_label(states: DataFrame, steps: int = STEPS) -> DataFrame:
    return states.groupBy("run_id").agg(F.concat(F.count_if(F.col("status") != "running").cast("string"), F.lit(f"/{steps}")).alias("label"))


def current_step(events: DataFrame) -> DataFrame:
    """The node that started last."""
    return events.where("phase = 'start'").groupBy("run_id").agg(F.max_by("node", "seq").alias("current_step"))


def run_status(events: DataFrame, last: Column | None = None) -> DataFrame:
    """failed if any event is an error, completed when the closing node has ended, running otherwise.
    last: condition of the event that closes a run."""
    closing = (F.col("node") == "render") & (F.col("phase") == "end") if last is None else last
    return events.groupBy("run_id").agg(F.when(F.bool_or(F.col("phase") == "error"), "failed").when(F.bool_or(closing), "completed").otherwise("running").alias("status"))


def replayed_frames(events: DataFrame, status: DataFrame) -> DataFrame:
    """run_id, n, name, payload: the frames of each run's history in order, and a closing done for each that isn't running.
    status: run_id, status."""
    own = events.select("run_id", F.col("seq").alias("n"), F.lit("progress").alias("name"), F.to_json(F.struct("node", "phase", "seq")).alias("payload"))
    last = events.groupBy("run_id").agg((F.max("seq") + 1).alias("n")).join(status.where("status <> 'running'"), "run_id")
    return own.unionByName(last.select("run_id", "n", F.lit("done").alias("name"), F.to_json(F.struct("status")).alias("payload")))


def retained_runs(runs: DataFrame, most: int = MOST_FINISHED) -> DataFrame:
    """All running ones and the newest finished ones. runs: run_id, status, started."""
    done = runs.where("status <> 'running'").orderBy(F.desc("started"), "run_id").limit(most)
    return runs.where("status = 'running'").unionByName(done)


def latest_checkpoints(rows: DataFrame) -> DataFrame:
    """The last state of each run. rows: run_id, seq, updated_at, state."""
    return rows.groupBy("run_id").agg(F.max(F.struct("seq", "updated_at", "state")).alias("x")).select("run_id", "x.seq", "x.updated_at", "x.state")
