"""The state of analysis runs, kept by a stream of their events.

Runs are dealt to shards by a hash of their id; a shard's state holds a row for each run that is under way and for its newest finished
ones. The newest finished runs of all are among the newest of each shard, so a bounded state is enough whatever has passed by. The fold takes events
in any order: a node's state is that of its last event by seq, a run has failed once any event is an error, and is completed once its closing
event has come. What changes is appended to the result, so the last row of a run and node counts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..staging import shared_dir
from .events import MOST_FINISHED

SHARDS = 64
ROWS = "run_id string, node string, status string, duration_ms long, detail string, first_seq long, seq long, run_status string, started long, evicted boolean"
_COLUMNS = [c.split()[0] for c in ROWS.split(", ")]
STATUS = {"start": "running", "end": "done"}
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_status(run: dict) -> str:
    return "failed" if run["failed"] else "completed" if run["closed"] else "running"


class RunStates(StatefulProcessor):
    """most_finished: finished runs that a shard keeps; None keeps all. quiet_ms: a run without events for so long has failed; None waits
    for ever. Events of a run that was evicted begin it anew."""

    def __init__(self, most_finished: int | None = MOST_FINISHED, quiet_ms: int | None = None):
        self.most_finished, self.quiet_ms = most_finished, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getMapState("runs", "run_id string", "state string")

    def _load(self, run_id: str) -> dict:
        if self.runs.containsKey((run_id,)):
            return json.loads(self.runs.getValue((run_id,))[0])
        return {"failed": False, "closed": False, "seq": -1, "nodes": {}, "at": 0}

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        met: dict[str, dict] = {}
        touched: dict[str, set] = {}
        now = timerValues.getCurrentProcessingTimeInMs() if self.quiet_ms else 0
        for pdf in rows:
            for run_id, seq, node, phase, ms, detail, closing in pdf[["run_id", "seq", "node", "phase", "duration_ms", "detail", "closing"]].astype(object).where(lambda d: d.notna(), None).itertuples(index=False):
                run = met.get(run_id) or met.setdefault(run_id, self._load(run_id))
                own = run["nodes"].setdefault(node, {"first": seq, "seq": -1})
                own["first"] = min(own["first"], seq)
                if seq > own["seq"]:
                    own |= {"seq": seq, "status": STATUS.get(phase, "error"), "ms": None if ms is None else int(ms), "detail": detail}
                run["seq"], run["at"] = max(run["seq"], seq), now
                run["failed"] |= phase == "error"
                run["closed"] |= bool(closing)
                touched.setdefault(run_id, set()).add(node)
        for run_id, run in met.items():
            self.runs.updateValue((run_id,), (json.dumps(run),))
        out = [self._row(run_id, met[run_id], node) for run_id, nodes in touched.items() for node in nodes]
        out += self._evicted() if self.most_finished is not None and any(run_status(r) != "running" for r in met.values()) else []
        if self.quiet_ms and any(run_status(r) == "running" for r in met.values()):
            self.handle.registerTimer(now + self.quiet_ms)
        yield pd.DataFrame(out, columns=_COLUMNS)

    def _row(self, run_id: str, run: dict, node: str | None, evicted: bool = False) -> tuple:
        own = run["nodes"].get(node, {})
        return run_id, node, own.get("status"), own.get("ms"), own.get("detail"), own.get("first"), run["seq"], run_status(run), run["seq"], evicted

    def _evicted(self) -> list[tuple]:
        done = [(run["seq"], run_id, run) for run_id, run in ((k[0], json.loads(v[0])) for k, v in self.runs.iterator()) if run_status(run) != "running"]
        done.sort(key=lambda x: (-x[0], x[1]))
        for _, run_id, _ in done[self.most_finished :]:
            self.runs.removeKey((run_id,))
        return [self._row(run_id, run, None, True) for _, run_id, run in done[self.most_finished :]]

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        now, out, next_at = timerValues.getCurrentProcessingTimeInMs(), [], None
        for k, v in list(self.runs.iterator()):
            run = json.loads(v[0])
            if run_status(run) != "running":
                continue
            if run["at"] + self.quiet_ms <= now:
                run["failed"] = True
                self.runs.updateValue(k, (json.dumps(run),))
                out.append(self._row(k[0], run, None))
            else:
                next_at = min(next_at or run["at"] + self.quiet_ms, run["at"] + self.quiet_ms)
        if next_at:
            self.handle.registerTimer(next_at)
        yield pd.DataFrame(out, columns=_COLUMNS)

    def close(self) -> None:
        pass


def run_states(events: DataFrame, closing: Column | None = None, most_finished: int | None = MOST_FINISHED, quiet_ms: int | None = None, shards: int = SHARDS) -> DataFrame:
    """Rows of ROWS from a stream of events (run_id, seq, node, phase, duration_ms, detail). closing: condition of the event that closes a run.
    The session needs the RocksDB state store (see configure)."""
    last = (F.col("node") == "render") & (F.col("phase") == "end") if closing is None else closing
    own = events.select(F.pmod(F.xxhash64("run_id"), F.lit(shards)).alias("shard"), "run_id", "seq", "node", "phase", "duration_ms", "detail", F.coalesce(last, F.lit(False)).alias("closing"))
    mode = "ProcessingTime" if quiet_ms else "None"
    return own.groupBy("shard").transformWithStateInPandas(RunStates(most_finished, quiet_ms), ROWS, "Append", mode)


def configure(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def written(rows: DataFrame, folder: str, checkpoint: str) -> None:
    """Appends what the stream brings now to Parquet files in a folder, exactly once; called again it goes on where it ended."""
    rows.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def fold(events: DataFrame, tag: str, **options) -> DataFrame:
    """run_states of a stream of events until what is there is read, as a table in the shared folder."""
    import uuid

    spark = events.sparkSession
    configure(spark)
    root = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    written(run_states(events, **options), f"{root}/rows", f"{root}/checkpoint")
    return spark.read.schema(ROWS).parquet(f"{root}/rows")


def last_nodes(rows: DataFrame) -> DataFrame:
    """run_id, node, status, duration_ms, detail, first_seq: the last state of each node."""
    last = lambda c: F.max_by(c, "seq").alias(c)
    return rows.where("node is not null").groupBy("run_id", "node").agg(last("status"), last("duration_ms"), last("detail"), F.min("first_seq").alias("first_seq"))


def kept_runs(rows: DataFrame) -> DataFrame:
    """run_id, status, started of the runs that the state still has."""
    final = rows.groupBy("run_id").agg(F.max(F.struct("seq", "evicted", "run_status")).alias("x"), F.max("seq").alias("started"))
    return final.where("not x.evicted").select("run_id", F.col("x.run_status").alias("status"), "started")
