"""The store under many writers: batches, snapshots and stamps."""

import threading
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from hashloom.sources.ledger import Ledger


def state(df):
    return sorted(map(repr, df.collect()))


def grow(spark, ledger, files=40):
    """Many small event files, with what later entries change."""
    day = lambda k: datetime(2024, 1, 1 + k % 28)
    for k in range(files):
        runs = spark.createDataFrame([(f"s{(k * 7 + i) % 50}", f"/{k}.py", day(k), "running") for i in range(3)], "session_id string, script_path string, started_at timestamp_ntz, status string")
        ledger.append("runs", runs.coalesce(1))
        if k % 3 == 0:
            ledger.append("runs", spark.createDataFrame([(f"s{k % 50}", "success", 0, "h")], "session_id string, status string, exit_code int, combined_hash string").coalesce(1), "finish")
        if k % 4 == 0:
            ledger.append("runs", spark.createDataFrame([(f"s{k % 50}", f"s{k}")], "session_id string, parent_session string").coalesce(1), "parent")
            ledger.append("session_parents", spark.createDataFrame([(f"s{k % 5}", "p", day(k))], "session_id string, parent_session string, recorded_at timestamp_ntz").coalesce(1))


def test_snapshots_change_no_view_while_readers_go_on(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "l"))
    grow(spark, ledger)
    tables = ("runs", "session_parents")
    before = {t: state(ledger.view(t)) for t in tables}
    assert len(ledger._files("runs")) > 60
    seen, stop = [], threading.Event()

    def read():
        reader = Ledger(spark, ledger.root)
        while not stop.is_set():
            seen.append(state(reader.view("runs")))

    thread = threading.Thread(target=read)
    thread.start()
    held = ledger.view("runs")  # a reader that began before
    covered = {t: ledger.compact_in_place(t) for t in tables}
    stop.set()
    thread.join(60)
    assert seen and all(s == before["runs"] for s in seen)
    assert covered["runs"] == len(ledger._files("runs")) and {t: state(ledger.view(t)) for t in tables} == before
    assert len([n for n in ledger._names(ledger._snapshot("runs")[1]) if n.startswith("part-")]) == 1
    assert state(held) == before["runs"]
    assert ledger.compact_in_place("runs") == covered["runs"]  # nothing new: nothing done
    ledger.add_run("s1", "/new.py")
    ledger.finish_run("s2", "failed", 1)
    later = state(ledger.view("runs"))
    assert later != before["runs"] and len(set(ledger._files("runs")) - ledger._snapshot("runs")[0]) == 2
    assert ledger.vacuum("runs", 3600) == 0  # too young
    assert ledger.vacuum("runs", -1) == covered["runs"] and len(ledger._files("runs")) == 2 and state(ledger.view("runs")) == later
    assert ledger.compact_in_place("runs") == covered["runs"] + 2 and state(ledger.view("runs")) == later
    ledger.vacuum("runs", -1)
    assert ledger._files("runs") == [] and state(ledger.view("runs")) == later and len(ledger._names(ledger.root + "/_snapshots/runs")) == 2
    assert ledger.vacuum("claims") == 0 and ledger.compact_in_place("claims") == 0 and ledger.view("claims").count() == 0


def test_late_entries_and_rivals(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "l"))
    ledger.add_run("a", "/a.py")
    ledger.finish_run("a", "success", 0)
    slow = Ledger(spark, ledger.root)
    slow._last = -1
    ledger.compact_in_place("runs")
    rows = spark.createDataFrame([("a", "failed", 1, 0, "finish")], "session_id string, status string, exit_code int, seq bigint, op string")
    newest = ledger.view("runs").head()["batch"]
    late = ledger.log("runs").where("op = 'finish'").select(*[F.lit("late").alias(c) if c == "status" else F.lit(newest - 1).cast("long").alias(c) if c == "batch" else F.col(c) for c in ledger.log("runs").columns])
    late.coalesce(1).write.mode("append").parquet(f"{ledger.root}/runs")  # written before, committed after
    assert ledger.view("runs").head()["status"] == "success"
    ledger.append("runs", rows.coalesce(1), None)
    assert ledger.view("runs").head()["status"] == "failed"
    keep = ledger._names
    rival = Ledger(spark, ledger.root)
    assert rival.compact_in_place("runs") == 4
    ledger._names = lambda path: [n for n in keep(path) if not n.startswith("0000000002")]  # did not see the rival's snapshot
    with pytest.raises(FileExistsError):
        ledger.compact_in_place("runs")
    del ledger._names
    assert len([n for n in ledger._names(f"{ledger.root}/_snapshots/runs") if n.startswith("0000000002-")]) == 1 and ledger.view("runs").head()["status"] == "failed"


def test_batches_write_one_file_a_table(spark, tmp_path):
    one, many = Ledger(spark, str(tmp_path / "one")), Ledger(spark, str(tmp_path / "many"))

    def events(ledger):
        for k in range(6):
            ledger.add_run(f"s{k % 4}", f"/{k}.py")
            ledger.finish_run(f"s{k % 4}", "success" if k < 5 else "failed", 0)
            ledger.set_parent(f"s{k % 4}", "p")

    events(many)
    with one.batch(), one.batch():
        events(one)
        assert one.view("runs").count() == 0
    assert len(one._files("runs")) == 1 and len(one._files("session_parents")) == 1 and len(many._files("runs")) > 10
    for t in ("runs", "session_parents"):
        drop = ("batch", "seq", "started_at", "finished_at", "recorded_at")
        assert state(one.view(t).drop(*drop)) == state(many.view(t).drop(*drop))
    with pytest.raises(KeyError), one.batch():
        one.add_run("last")
        raise KeyError  # what was told so far is kept
    assert one.view("runs").where("session_id = 'last'").count() == 1


def test_stamps_list_their_sessions_in_a_table(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "l"))
    with ledger.batch():
        for k in range(30):
            ledger.add_run(f"s{k:02}")
            ledger.finish_run(f"s{k:02}", "success", 0, f"h{k}")
    first = ledger.stamp(proof=str(tmp_path / "proof"))
    assert ledger.stamp_sessions(first).count() == 30 and spark.read.json(str(tmp_path / "proof" / "sessions")).count() == 30
    some = ledger.stamp(["s01", "s02", "nobody"])
    assert {r[0] for r in ledger.stamp_sessions(some).collect()} == {"s01", "s02"}
    ledger.add_run("more")
    ledger.finish_run("more", "success", 0, "hm")
    told = ledger.check_stamp(first)
    assert told["matches"] and told["run_count"] == 30 and told["run_count_now"] == 31
    ledger.finish_run("s01", "success", 0, "changed")
    assert not ledger.check_stamp(first)["matches"] and not ledger.check_stamp()["matches"]
    old = spark.createDataFrame([("stamp_old", told["root_hash"], 30, [f"s{k:02}" for k in range(30)])], "stamp_id string, root_hash string, run_count int, session_ids array<string>")
    ledger.finish_run("s01", "success", 0, "h1")
    ledger.append("stamps", old)  # as earlier versions wrote them
    assert ledger.check_stamp("stamp_old")["matches"] and ledger.check_stamp(first)["matches"]
    with pytest.raises(ValueError):
        ledger.stamp(["nobody"])
