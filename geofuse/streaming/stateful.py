"""Streams whose state is bounded: a processor a key, with timers that drop what has ended or gone quiet.

Each function takes a streaming (or batch) DataFrame and gives one in update or append mode. They need the RocksDB state
store where the query is started: `with state_store(spark): ... .start()`. State is one small row a key. A key's rows
of a batch are folded piece by piece as they come, so a key may have any number of them.
"""

from __future__ import annotations

import contextlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from geofuse.sources.files import listed

c = F.col
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TERMINAL = ("done", "failed", "cancelled")
#: Before all times.
LOW = -(1 << 62)
EXPORT = re.compile(r"export_(\d{1,9})\.ply")


@contextlib.contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that these streams need, for the queries that are started inside the block."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)


def _millis(span: str) -> int:
    return int(pd.Timedelta(span) / pd.Timedelta("1ms"))


class _Fold(StatefulProcessor):
    """Keeps one row a key, folds a batch's events into it, and drops it when event time has passed the row's end.

    keep and quiet: how long a key is held after its last event, if it has ended, and if not. Only the timer that was
    set last counts.
    """

    schema = ""

    def __init__(self, keep: str, quiet: str):
        self.keep, self.quiet = _millis(keep), _millis(quiet)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.row = handle.getValueState("row", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # Each call of the store is a round trip: it is asked once, and only a key that was seen has a timer.
        held = self.row.get()
        state = self.empty() if held is None else dict(zip(self.fields(), held))
        for pdf in rows:
            events = {k: pdf[k].to_numpy() for k in ("us", "event_id", "kind", "progress", "detail")}
            state["seen"] = max(state["seen"], int(events["us"].max()))
            self.fold(state, events)
        self.row.update(tuple(state.values()))
        for at in list(self.handle.listTimers()) if held is not None else ():
            self.handle.deleteTimer(at)
        self.handle.registerTimer(state["seen"] // 1000 + (self.keep if self.ended(state) else self.quiet))
        yield pd.DataFrame({k: [v] for k, v in self.out(key[0], state).items()})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.row.clear()
        return iter(())

    def close(self) -> None:
        pass

    def fields(self) -> list[str]:
        return [f.split()[0] for f in self.schema.split(", ")]

    def empty(self) -> dict:
        return dict.fromkeys(self.fields())


def _last(events: dict[str, np.ndarray], rows: np.ndarray) -> dict | None:
    """Of these rows that of the greatest (us, event_id)."""
    if not len(rows):
        return None
    at = rows[np.lexsort((events["event_id"][rows], events["us"][rows]))[-1]]
    return {k: v[at] for k, v in events.items()}


def _plain(v):
    return None if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else v.item() if hasattr(v, "item") else v


class _Status(_Fold):
    schema = "us bigint, event_id bigint, kind string, progress double, detail string, events bigint, seen bigint"

    def empty(self) -> dict:
        return super().empty() | {"us": LOW, "event_id": LOW, "events": 0, "seen": LOW}

    def fold(self, state: dict, events: dict[str, np.ndarray]) -> None:
        state["events"] += len(events["us"])
        new = _last(events, np.arange(len(events["us"])))
        if new is not None and (new["us"], new["event_id"]) > (state["us"], state["event_id"]):
            state |= {k: _plain(new[k]) for k in ("us", "event_id", "kind", "progress", "detail")}

    def ended(self, state: dict) -> bool:
        return state["kind"] in TERMINAL

    def out(self, key, state: dict) -> dict:
        return {"run": key, **{k: v for k, v in state.items() if k != "seen"}}


class _Progress(_Fold):
    """The last move (progress or terminal mark), and the last terminal mark; other kinds of events change nothing."""

    schema = "us bigint, event_id bigint, progress double, detail string, end_us bigint, end_id bigint, state string, seen bigint"

    def empty(self) -> dict:
        return super().empty() | {"us": LOW, "event_id": LOW, "end_us": LOW, "end_id": LOW, "state": "running", "seen": LOW}

    def fold(self, state: dict, events: dict[str, np.ndarray]) -> None:
        kinds = events["kind"].tolist()
        new = _last(events, np.flatnonzero([k == "progress" or k in TERMINAL for k in kinds]))
        if new is not None and (new["us"], new["event_id"]) > (state["us"], state["event_id"]):
            p = 1.0 if new["kind"] == "done" else _plain(new["progress"])
            state |= {"us": int(new["us"]), "event_id": int(new["event_id"]), "progress": None if p is None else min(1.0, max(0.0, p)), "detail": _plain(new["detail"])}
        end = _last(events, np.flatnonzero([k in TERMINAL for k in kinds]))
        if end is not None and (end["us"], end["event_id"]) > (state["end_us"], state["end_id"]):
            state |= {"end_us": int(end["us"]), "end_id": int(end["event_id"]), "state": end["kind"]}

    def ended(self, state: dict) -> bool:
        return state["state"] != "running"

    def out(self, key, state: dict) -> dict:
        moved = None if state["us"] == LOW else state["us"]
        return {"item": key, "us": moved, **{k: state[k] for k in ("progress", "detail", "state")}}


def _folded(events: DataFrame, watermark: str, processor: _Fold, schema: str) -> DataFrame:
    rows = events.filter("ts is not null").withWatermark("ts", watermark).withColumn("us", F.unix_micros("ts")).select("run", "ts", "us", "event_id", "kind", "progress", "detail")
    return rows.groupBy("run").transformWithStateInPandas(processor, schema, "update", "EventTime")


def run_status(events: DataFrame, watermark: str = "7 days", keep: str = "1 day", quiet: str = "30 days") -> DataFrame:
    """Per run its latest status by event time (ties by event_id), a row for each batch that changes it: run, us, event_id, kind, progress, detail, events.

    A run's state is dropped when the watermark is keep past its last event, if its status is terminal (done, failed,
    cancelled), or quiet past it, if not; if it is heard of again, it begins anew. Rows later than the watermark,
    and rows without a time, are dropped.
    """
    return _folded(events, watermark, _Status(keep, quiet), "run bigint, us bigint, event_id bigint, kind string, progress double, detail string, events bigint")


def queue_progress(events: DataFrame, watermark: str = "7 days", keep: str = "1 day", quiet: str = "30 days") -> DataFrame:
    """Per item its progress (0 to 1) and detail by the latest event, its state by the latest terminal mark: item, us, progress, detail, state.

    Progress after a terminal mark changes progress and detail, never the state. State is dropped as in run_status.
    """
    return _folded(events, watermark, _Progress(keep, quiet), "item bigint, us bigint, progress double, detail string, state string")


class FolderPolls(DataSource):
    """A folder looked at once a micro-batch, as a stream: spark.readStream.format("folder_polls").load(path).

    Rows: poll (its number), folder, iteration, path, bytes: of each folder the export_<iteration>.ply of the greatest iteration. A poll
    that has to be run again after a failure looks again.
    """

    @classmethod
    def name(cls) -> str:
        return "folder_polls"

    def schema(self) -> str:
        return "poll bigint, folder string, iteration int, path string, bytes bigint"

    def simpleStreamReader(self, schema: StructType) -> FolderReader:
        return FolderReader(self.options["path"])


class FolderReader(SimpleDataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"poll": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        return self._look(start["poll"]), {"poll": start["poll"] + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return self._look(start["poll"])

    def _look(self, poll: int) -> Iterator[tuple]:
        newest: dict[str, tuple] = {}
        for uri, size in listed(self.path, ".ply"):
            folder, name = uri.rsplit("/", 1)
            found = EXPORT.fullmatch(name)
            if found and int(found[1]) >= newest.get(folder, (0, 0, -1))[2]:
                newest[folder] = poll, folder, int(found[1]), uri, size
        return iter(list(newest.values()))


class _Exports(StatefulProcessor):
    """Of a folder the iteration that was announced last, and the newest export of the last poll with its size."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.row = handle.getValueState("row", "announced int, iteration int, bytes bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        announced, iteration, size = self.row.get() if self.row.exists() else (-1, -1, -1)
        polls = pd.concat(list(rows)).sort_values(["poll", "iteration"]).drop_duplicates("poll", keep="last")
        out = []
        for p in polls.itertuples(index=False):
            if p.iteration <= announced:
                continue
            if (p.iteration, p.bytes) == (iteration, size) and size > 0:
                announced = int(p.iteration)
                out.append((key[0], announced, p.path, int(p.bytes), int(p.poll)))
            iteration, size = int(p.iteration), int(p.bytes)
        self.row.update((announced, iteration, size))
        yield pd.DataFrame(out, columns=["folder", "iteration", "path", "bytes", "poll"])

    def close(self) -> None:
        pass


def stable_exports(polls: DataFrame) -> DataFrame:
    """Exports announced once: folder, iteration, path, bytes, poll, in append mode.

    polls has poll, folder, iteration, path and bytes, as FolderPolls gives them. A folder's newest export is announced when two polls
    that follow each other saw it with the same size over zero; one no newer than an announced one is never announced.
    State is one row a folder, and survives restarts with the query's checkpoint.
    """
    rows = polls.select("poll", "folder", "iteration", "path", "bytes")
    return rows.groupBy("folder").transformWithStateInPandas(_Exports(), "folder string, iteration int, path string, bytes bigint, poll bigint", "append", "None")


def stream_exports(spark: SparkSession, path: str) -> DataFrame:
    """The exports of a folder and the folders below it, as they become stable; a poll a micro-batch."""
    spark.dataSource.register(FolderPolls)
    return stable_exports(spark.readStream.format("folder_polls").load(path))
