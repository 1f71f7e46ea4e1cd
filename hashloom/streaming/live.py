"""Structured Streaming over the ledger's logs: an addition of this library."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from hashloom.sources.schema import log_schema


def read_log(spark: SparkSession, root: str, table: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(log_schema(table)).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{root.rstrip('/')}/{table}")


def outcome_counts(results: DataFrame, window: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """(start, status, n): verification outcomes by window of verified_at; entries later than ``lateness`` are left out."""
    timed = results.withColumn("verified_at", F.col("verified_at").cast("timestamp"))  # event time must be an instant; ledger times are UTC
    return timed.withWatermark("verified_at", lateness).groupBy(F.window("verified_at", window).alias("w"), "status").agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("start"), "status", "n")


def latest_outputs(files: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Keep, under ``target``, each path's newest producer of each micro-batch; readers take the newest of all.

    Every batch is reduced before it is written, and the batch id in the path makes a
    repeated batch write the same place again.
    """
    def write(batch: DataFrame, number: int) -> None:
        newest = batch.where("role = 'output'").groupBy("file_path").agg(F.max_by(F.struct("session_id", "hash", "recorded_at"), F.struct("recorded_at", "batch", "seq")).alias("r"))
        newest.select("file_path", "r.*").write.mode("overwrite").parquet(f"{target.rstrip('/')}/part={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_latest(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target).groupBy("file_path").agg(F.max_by(F.struct("session_id", "hash", "recorded_at"), F.struct("recorded_at", "session_id")).alias("r")).select("file_path", "r.*")


#: Readers of one path are dealt out over so many states, which all know the path's writers.
READER_SHARDS = 16


class Linker(StatefulProcessor):
    """Of one path (and shard of its readers): the two newest writers, and each reader with the parent it was last given.

    That is what ``lineage.file_edges`` needs: a reader's parent is the newest writer other
    than itself. A writer's time is its latest, so events may come late, repeated and in
    any order: the two newest are a maximum.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.writers = handle.getValueState("writers", "first string, first_at bigint, second string, second_at bigint")
        self.readers = handle.getMapState("readers", "session_id string", "parent string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802 (Spark's name)
        held = self.writers.get() if self.writers.exists() else (None,) * 4
        latest = {s: at for s, at in ((held[0], held[1]), (held[2], held[3])) if s is not None}
        new: set[str] = set()
        for part in rows:
            for session, role, at in zip(part["session_id"], part["role"], part["at"]):
                if role == "input":
                    new.add(session)
                else:
                    latest[session] = max(latest.get(session, at), at)
        top = sorted(latest.items(), key=lambda x: (-x[1], x[0]))[:2]
        now = tuple(v for pair in [*top, (None, None), (None, None)][:2] for v in pair)
        parent = lambda session: now[0] if now[0] != session else now[2]
        out = []
        if now != tuple(held):
            self.writers.update(now)
            for (session,), (given,) in list(self.readers.iterator()):
                if parent(session) != given:
                    out.append((session, parent(session)))
        out += [(s, parent(s)) for s in sorted(new) if not self.readers.containsKey((s,))]
        for session, given in out:
            self.readers.updateValue((session,), (given,))
        told = [(session, key[0], given) for session, given in out]
        yield pd.DataFrame(told, columns=["child", "file_path", "parent"])

    def close(self) -> None:
        pass


def link_edges(files: DataFrame, shards: int = READER_SHARDS) -> DataFrame:
    """(child, file_path, parent) of a stream of file rows, as reads and writes arrive; a later row for the same child and path replaces an earlier one.

    A parent of null says that nobody else has written the path yet. State is keyed by path;
    a path's readers are dealt out over ``shards`` keys, and its writes go to all of them, so
    that a path that everyone reads is not one key. The session must use the RocksDB state
    store.
    """
    at = F.coalesce(F.unix_micros(F.col("recorded_at").cast("timestamp")), F.lit(-(1 << 62)))
    own = F.pmod(F.xxhash64("session_id"), F.lit(shards)).cast("int")
    shard = F.when(F.col("role") == "input", F.array(own)).otherwise(F.sequence(F.lit(0), F.lit(shards - 1)))
    rows = files.where("role in ('input', 'output')").select("file_path", "session_id", "role", at.alias("at"), F.explode(shard).alias("shard"))
    return rows.groupBy("file_path", "shard").transformWithStateInPandas(
        statefulProcessor=Linker(), outputStructType="child string, file_path string, parent string", outputMode="Update", timeMode="None")


def store_edges(edges: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Write ``link_edges`` under ``target``, a folder for each micro-batch; a repeated batch writes the same place again."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target.rstrip('/')}/part={number}")

    return edges.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_edges(spark: SparkSession, target: str) -> DataFrame:
    """(child, parent) as ``lineage.file_edges`` has them, from what ``store_edges`` wrote."""
    newest = spark.read.parquet(target).groupBy("child", "file_path").agg(F.max_by(F.struct("parent"), "part").alias("r"))
    return newest.select("child", "r.parent").where("parent is not null").distinct()
