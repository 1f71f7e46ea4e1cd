"""What a run's plans say it read and wrote, and links that a stream finds."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hashloom.operators import lineage
from hashloom.sources.ledger import Ledger
from hashloom.streaming import capture, live


def told(ledger, session, root):
    rows = ledger.view("file_hashes").where(F.col("session_id") == session).collect()
    return sorted((r["role"], r["file_path"].removeprefix(f"{root}/")) for r in rows)


def test_plain_reads_and_writes_are_recorded(spark, tmp_path):
    root = tmp_path.resolve()
    ledger = Ledger(spark, str(root / "ledger"))
    raw, other, out = (str(root / n) for n in ("raw", "other.csv", "out"))
    spark.range(10).write.parquet(raw)
    (root / "other.csv").write_text("1\n2\n")
    with capture.session(ledger, session_id="A", watch_plans=True):
        left, right = spark.read.parquet(raw), spark.read.csv(other)
        left.join(right, left["id"] == right["_c0"].cast("long")).where("id < 5").write.parquet(out)
        spark.read.parquet(raw).where(F.col("id").isin(1, 2)).collect()
    assert told(ledger, "A", root) == [("input", "other.csv"), ("input", "raw"), ("output", "out")]
    with capture.session(ledger, session_id="B", watch_plans=True):
        assert spark.read.parquet(out).count() == 2
        spark.range(3).count()
    assert told(ledger, "B", root) == [("input", "out")]
    assert ledger.view("runs").where("session_id = 'B'").head()["parent_session"] == "A"  # linked by what A wrote
    spark.read.parquet(raw).count()  # outside of a session
    with pytest.raises(KeyError), capture.session(ledger, session_id="C", watch_plans=True):
        spark.read.parquet(raw).count()
        raise KeyError
    assert told(ledger, "C", root) == [("input", "raw")] and ledger.view("runs").where("session_id = 'C'").head()["status"] == "error"
    hashes = {(r["session_id"], r["file_path"]): r["hash"] for r in ledger.view("file_hashes").collect()}
    assert hashes["A", raw] == hashes["C", raw] and hashes["A", out] == hashes["B", out] and len(set(hashes.values())) == 3
    assert told(ledger, "D", root) == []


def test_links_of_a_stream_equal_those_of_the_whole_log(spark, tmp_path):
    """Reads before writes, late and repeated events, a session that writes again, and a path that everyone reads."""
    rng = random.Random(4)
    day = lambda k: datetime(2024, 1, 1) + timedelta(hours=k)
    rows = [(f"s{rng.randrange(25):02}", f"/p{rng.randrange(8)}", rng.choice(["input", "input", "output"]), day(rng.randrange(40))) for _ in range(160)]
    rows += [(f"s{k:02}", "/hot", "input", day(k)) for k in range(25)] + [("s03", "/hot", "output", day(1)), ("s04", "/hot", "output", day(1)), ("s09", "/none", "input", day(2)), ("s10", "/hot", "script", day(90))]
    rng.shuffle(rows)
    rows += rows[:30]
    schema = "session_id string, file_path string, role string, recorded_at timestamp_ntz"
    ledger = Ledger(spark, str(tmp_path / "l"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    target, done = str(tmp_path / "edges"), 0
    for cut in (40, 41, 130, len(rows)):  # the query ends and goes on from its state
        for low in range(done, cut, 30):
            ledger.append("file_hashes", spark.createDataFrame(rows[low:min(low + 30, cut)], schema).coalesce(1))
        done = cut
        live.store_edges(live.link_edges(live.read_log(spark, ledger.root, "file_hashes", files_per_trigger=2), shards=3), target, str(tmp_path / "check")).awaitTermination(200)
        want = lineage.file_edges(spark.createDataFrame(rows[:done], schema))
        assert sorted(map(tuple, live.read_edges(spark, target).collect())) == sorted(map(tuple, want.collect()))
    assert spark.read.parquet(target).where("file_path = '/none' and parent is null").count() == 1
