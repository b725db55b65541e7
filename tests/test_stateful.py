"""Stateful streams: equal to their batch twins, with state that falls; exports that are stable, and announced once."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from geofuse.streaming import stateful as st

SCHEMA = "run long, ts timestamp, event_id long, kind string, progress double, detail string"
T0 = dt.datetime(2024, 1, 1)


def hours(h):
    return T0 + dt.timedelta(hours=h)


def play(spark, tmp_path, make, batches, mode="update"):
    """Runs make(stream) over one file a batch; per batch the rows out, and the rows of state at the end of each."""
    src = tmp_path / "src"
    src.mkdir()
    out, kept = [], []
    stream = make(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(src)))
    with st.state_store(spark):
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(src))
            q = stream.writeStream.outputMode(mode).foreachBatch(lambda b, i: out.append([r.asDict() for r in b.collect()])).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            q.awaitTermination()
            kept.append([o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"]])
    return out, kept


def test_queue_progress_and_state_that_falls(spark, tmp_path):
    batches = [
        [(1, hours(0), 1, "progress", 0.4, "a"), (1, hours(1), 2, "progress", 1.4, "b"), (2, hours(0), 3, "progress", -1.0, "c"), (3, hours(0), 4, "note", 0.5, "d")],
        [(1, hours(2), 5, "done", 0.2, "e"), (1, hours(3), 6, "progress", 0.7, "f"), (2, hours(2), 7, "failed", 0.3, "g")],
        [(4, hours(100), 8, "progress", 0.1, "h")],
        [(5, hours(101), 9, "progress", None, None)],
    ]
    out, kept = play(spark, tmp_path, lambda e: st.queue_progress(e, "1 hour", keep="10 hours", quiet="1000 hours"), batches)
    last = {r["item"]: (r["progress"], r["detail"], r["state"]) for b in out for r in b}
    assert last == {1: (0.7, "f", "done"), 2: (0.3, "g", "failed"), 3: (None, None, "running"), 4: (0.1, "h", "running"), 5: (None, None, "running")}
    # Items 1 and 2 were last heard of at hours 3 and 2: when event time is at hour 99, over their keep of 10 hours later, they go.
    assert [k[-1] for k in kept] == [3, 3, 2, 3], kept


def test_quiet_runs_are_dropped_and_ended_ones_begin_anew(spark, tmp_path):
    batches = [[(1, hours(0), 1, "progress", 0.4, "a"), (1, hours(0), 2, "done", 0.4, "b")], [(2, hours(50), 3, "progress", 0.4, "a")], [(3, hours(99), 4, "progress", 0.4, "c")], [(1, hours(100), 5, "progress", 0.1, "again")]]
    out, _ = play(spark, tmp_path, lambda e: st.run_status(e, "1 hour", keep="5 hours", quiet="20 hours"), batches)
    rows = [r for b in out for r in b]
    assert [(r["run"], r["event_id"], r["kind"], r["events"]) for r in rows] == [(1, 2, "done", 2), (2, 3, "progress", 1), (3, 4, "progress", 1), (1, 5, "progress", 1)]


def test_batch_and_stream_agree(spark, tmp_path):
    rows = [(i % 7, hours(i * 13 % 50), i, ("progress", "done", "failed", "other")[i * i % 11 % 4], (i % 15) / 10, f"d{i}") for i in range(300)]
    batch = st.queue_progress(spark.createDataFrame(rows, SCHEMA), "100 days")
    out, _ = play(spark, tmp_path, lambda e: st.queue_progress(e, "100 days"), [rows[:100], rows[100:250], rows[250:]])
    last = {r["item"]: r for b in out for r in b}
    assert {r["item"]: r.asDict() for r in batch.collect()} == last and len(last) == 7


def test_the_store_is_set_for_the_block_alone(spark):
    before = spark.conf.get(st.STORE)
    with st.state_store(spark):
        assert spark.conf.get(st.STORE) == st.ROCKS
    assert spark.conf.get(st.STORE) == before


def poll(spark, folder, checkpoint, seen):
    """One look at the folder, by a query that is started anew each time."""
    with st.state_store(spark):
        stream = st.stream_exports(spark, str(folder))
        q = stream.writeStream.outputMode("append").foreachBatch(lambda b, i: seen.extend((r["folder"].rsplit("/", 1)[1], r["iteration"]) for r in b.collect())).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
        q.awaitTermination()


def test_exports_are_stable_and_announced_once(spark, tmp_path):
    a, b, checkpoint, seen = tmp_path / "w" / "a", tmp_path / "w" / "b", tmp_path / "cp", []
    a.mkdir(parents=True)
    b.mkdir()
    for n in ("init.ply", "export_x.ply", "notes.txt", ".export_9.ply"):
        (a / n).write_bytes(b"x")
    (a / "export_500.ply").write_bytes(b"x")
    (b / "export_7.ply").write_bytes(b"")
    poll(spark, tmp_path / "w", checkpoint, seen)
    (a / "export_500.ply").write_bytes(b"xx")  # still growing
    poll(spark, tmp_path / "w", checkpoint, seen)
    assert seen == []
    poll(spark, tmp_path / "w", checkpoint, seen)
    assert seen == [("a", 500)]  # b's is empty
    (a / "export_1000.ply").write_bytes(b"x")
    (b / "export_7.ply").write_bytes(b"y")
    poll(spark, tmp_path / "w", checkpoint, seen)
    assert seen == [("a", 500)]
    poll(spark, tmp_path / "w", checkpoint, seen)
    poll(spark, tmp_path / "w", checkpoint, seen)
    assert sorted(seen) == [("a", 500), ("a", 1000), ("b", 7)]  # once each, over six starts from one checkpoint


@pytest.mark.parametrize("order", [1, -1])
def test_polls_of_one_batch_are_taken_in_order(spark, order):
    rows = [(1, "f", 1, "p1", 5), (2, "f", 1, "p1", 9), (3, "f", 2, "p2", 9), (4, "f", 1, "p1", 9), (5, "f", 2, "p2", 9), (6, "f", 2, "p2", 9), (7, "f", 2, "p2", 9), (8, "f", 3, "p3", 0), (9, "f", 3, "p3", 0)]
    df = spark.createDataFrame(rows[::order], "poll long, folder string, iteration int, path string, bytes long")
    assert [tuple(r) for r in st.stable_exports(df).select("iteration", "poll").collect()] == [(2, 6)]
    assert st.stable_exports(df.filter(F.lit(False))).count() == 0


def test_a_key_asks_the_store_once():
    """A new key: its row is got and put, and a timer set; timers are listed for keys that were seen only."""
    calls, held, timers = [], {}, []

    class Row:
        def get(self):
            calls.append("get")
            return held.get("row")

        def update(self, row):
            calls.append("update")
            held["row"] = row

    class Handle:
        def getValueState(self, name, schema):
            return Row()

        def listTimers(self):
            calls.append("list")
            return iter(timers)

        def deleteTimer(self, at):
            timers.remove(at)

        def registerTimer(self, at):
            timers.append(at)

    p = st._Progress("1 hour", "1 day")
    p.init(Handle())
    rows = pd.DataFrame({"us": [5_000_000, 7_000_000, 7_000_000], "event_id": [1, 3, 2], "kind": ["done", "progress", "other"], "progress": [None, 0.5, 0.7], "detail": ["x", None, "z"]})
    (out,) = p.handleInputRows((4,), iter([rows]), None)
    assert out.to_dict("records") == [{"item": 4, "us": 7_000_000, "progress": 0.5, "detail": None, "state": "done"}]
    assert calls == ["get", "update"] and timers == [7_000 + 3_600_000]
    (out,) = p.handleInputRows((4,), iter([rows.assign(us=rows["us"] + 1_000_000, kind="failed")]), None)
    assert out["state"].tolist() == ["failed"] and timers == [8_000 + 3_600_000]
