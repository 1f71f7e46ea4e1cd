"""Point lookups, lists, top-k and counts over the ledger's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hashloom.functions.hashes import consistent


def list_runs(runs: DataFrame, status: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Newest runs first, then by id."""
    rows = runs if status is None else runs.where(F.col("status") == status)
    return rows.orderBy(F.desc_nulls_last("started_at"), "session_id").offset(offset).limit(limit)


def get_run(runs: DataFrame, session: str) -> DataFrame:
    return runs.where(F.col("session_id") == session)


def run_files(files: DataFrame, session: str, role: str | None = None) -> DataFrame:
    """(file_path, hash) of a session; without a role a path that has two counts once, with its last row."""
    rows = files.where(F.col("session_id") == session)
    rows = rows if role is None else rows.where(F.col("role") == role)
    return rows.groupBy("file_path").agg(F.max_by("hash", "seq").alias("hash"))


def frozen_files(files: DataFrame, session: str, role: str | None = None) -> DataFrame:
    rows = files.where((F.col("session_id") == session) & F.col("frozen"))
    return (rows if role is None else rows.where(F.col("role") == role)).select("file_path").distinct()


def sessions_by_file(files: DataFrame, path: str, role: str | None = None) -> DataFrame:
    """(session_id, at) of the sessions that touched a path, newest first."""
    rows = files.where(F.col("file_path") == path)
    return _sessions(rows if role is None else rows.where(F.col("role") == role))


def sessions_by_hash(files: DataFrame, digest: str, role: str | None = None) -> DataFrame:
    """(session_id, at) of the sessions that saw some content, newest first."""
    rows = files.where(F.col("hash") == digest)
    return _sessions(rows if role is None else rows.where(F.col("role") == role))


def _sessions(rows: DataFrame) -> DataFrame:
    return rows.groupBy("session_id").agg(F.max("recorded_at").alias("at")).orderBy(F.desc("at"), "session_id")


def sessions_by_files(files: DataFrame, paths: DataFrame, role: str | None = None) -> DataFrame:
    """(file_path, session_id, at) for many paths at once: each session's newest record of each path."""
    rows = files if role is None else files.where(F.col("role") == role)
    return rows.join(paths.select("file_path").distinct(), "file_path", "left_semi").groupBy("file_path", "session_id").agg(F.max("recorded_at").alias("at"))


def hosts_for_hash(files: DataFrame, digest: str) -> DataFrame:
    return files.where((F.col("hash") == digest) & F.col("host").isNotNull()).select("host").distinct().orderBy("host")


def latest_verifications(results: DataFrame) -> DataFrame:
    """Each session's newest verification; equal times go by the later entry. One aggregation, no sort."""
    newest = F.max_by(F.struct("level", "status", "verified_at"), F.struct("verified_at", "seq"))
    return results.groupBy("session_id").agg(newest.alias("v")).select("session_id", "v.*")


def verification_history(results: DataFrame, keep: int = 10) -> DataFrame:
    """The newest ``keep`` verifications of each session with ``rank``."""
    order = Window.partitionBy("session_id").orderBy(F.desc("verified_at"), F.desc("seq"))
    return results.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def children(runs: DataFrame, session: str) -> DataFrame:
    return runs.where(F.col("parent_session") == session).orderBy("started_at", "session_id")


def parents(listed: DataFrame, session: str) -> DataFrame:
    return listed.where(F.col("session_id") == session).orderBy("recorded_at", "parent_session")


def list_stamps(stamps: DataFrame, limit: int = 20) -> DataFrame:
    return stamps.orderBy(F.desc("seq")).limit(limit)


def under(path: Column, prefix: str) -> Column:
    """The path itself or anything below it; _ and % have no meaning."""
    return (path == prefix) | path.startswith(prefix.rstrip("/") + "/")


def list_claims(claims: DataFrame, file_path: str | None = None, claim_type: str | None = None, status: str | None = None,
                prefix: str | None = None, include_superseded: bool = False, limit: int | None = 100) -> DataFrame:
    """Claims by path and line (no line first); superseded ones only if asked for, or by their status."""
    rows = claims
    for column, value in (("file_path", file_path), ("claim_type", claim_type), ("status", status)):
        rows = rows if value is None else rows.where(F.col(column) == value)
    if prefix is not None:
        rows = rows.where(under(F.col("file_path"), prefix))
    if status is None and not include_superseded:
        rows = rows.where("status <> 'superseded'")
    rows = rows.orderBy(F.asc_nulls_first("file_path"), F.asc_nulls_first("line_number"), "claim_id")
    return rows if limit is None else rows.limit(limit)


def list_citations(citations: DataFrame, manuscript: str | None = None, status: str | None = None, limit: int | None = 1000) -> DataFrame:
    rows = citations
    for column, value in (("manuscript_file", manuscript), ("status", status)):
        rows = rows if value is None else rows.where(F.col(column) == value)
    rows = rows.orderBy("cite_key")
    return rows if limit is None else rows.limit(limit)


def lookup_citation(citations: DataFrame, key: str) -> DataFrame:
    return citations.where(F.col("cite_key") == key)


def resolve_claims(claims: DataFrame, wanted: DataFrame) -> DataFrame:
    """(identifier, claim_id): identifiers are ids, ``path:L<n>``, or paths (then the least line), tried in this order.

    Three equi joins and one pick, for any number of identifiers.
    """
    ids = wanted.select("identifier").distinct()
    spot = ids.select("identifier", F.regexp_extract("identifier", r"^(.+):L(\d+)$", 1).alias("file_path"),
                      F.regexp_extract("identifier", r"^(.+):L(\d+)$", 2).cast("int").alias("line_number")).where("file_path <> ''")
    kept = claims.select("claim_id", "file_path", "line_number")
    line = F.coalesce(F.col("line_number"), F.lit(-1))
    found = (
        ids.join(kept, F.col("identifier") == F.col("claim_id")).select("identifier", F.lit(1).alias("way"), line.alias("line"), "claim_id")
        .union(spot.join(kept, ["file_path", "line_number"]).select("identifier", F.lit(2), line, "claim_id"))
        .union(ids.join(kept, F.col("identifier") == F.col("file_path")).select("identifier", F.lit(3), line, "claim_id")))
    return found.groupBy("identifier").agg(F.min_by("claim_id", F.struct("way", "line", "claim_id")).alias("claim_id"))


def resolve_targets(runs: DataFrame, files: DataFrame, wanted: DataFrame) -> DataFrame:
    """(target, session_id): targets are session ids, script paths (their newest run), or files (their newest producer)."""
    names = wanted.select("target").distinct()
    by_script = runs.where("script_path is not null").groupBy(F.col("script_path").alias("target")).agg(
        F.max_by("session_id", F.struct("started_at", "session_id")).alias("b"))
    by_file = files.where("role = 'output'").groupBy(F.col("file_path").alias("target")).agg(
        F.max("recorded_at").alias("at"), F.min_by("session_id", F.struct(-F.unix_micros(F.col("recorded_at").cast("timestamp")), "session_id")).alias("c"))
    return (names.join(runs.select(F.col("session_id").alias("target"), F.col("session_id").alias("a")), "target", "left")
            .join(by_script, "target", "left").join(by_file, "target", "left").select("target", F.coalesce("a", "b", "c").alias("session_id")))


def completed_runs(runs: DataFrame, script_hash: str | None = None, script_path: str | None = None) -> DataFrame:
    rows = runs.where("finished_at is not null")
    for column, value in (("script_hash", script_hash), ("script_path", script_path)):
        rows = rows if value is None else rows.where(F.col(column) == value)
    return rows.orderBy(F.desc("started_at"), "session_id")


def stats(runs: DataFrame, files: DataFrame) -> dict[str, int]:
    """Counts of runs, successes, failures, file rows and different files: two one-row aggregates."""
    r = runs.agg(F.count("*"), F.count_if(F.col("status") == "success"), F.count_if(F.col("status") == "failed")).head()
    f = files.agg(F.count("*"), F.countDistinct("file_path")).head()
    return {"n_runs": r[0], "n_success": r[1], "n_failed": r[2], "n_file_rows": f[0], "n_files": f[1]}


def reuse_hints(runs: DataFrame, files: DataFrame, disk: DataFrame, keep: int = 5) -> DataFrame:
    """(session_id, file_path, producer, at, rank): outputs of others that a session reads and could take as they are.

    Of all pairs of a session's inputs and other producers the ``keep`` of the latest
    started runs count; of these, the ones stay whose file still has the content that the
    producer recorded. at: when the producer started. Each path's keep + 1 latest producers are
    enough for any reader, which bounds the join.
    """
    top = Window.partitionBy("file_path").orderBy(F.desc_nulls_last("at"), "producer")
    made = files.where("role = 'output'").groupBy("file_path", F.col("session_id").alias("producer")).agg(F.max_by("hash", "recorded_at").alias("hash"))
    made = made.join(runs.select(F.col("session_id").alias("producer"), F.col("started_at").alias("at")), "producer").withColumn("k", F.row_number().over(top)).where(F.col("k") <= keep + 1)
    read = files.where("role = 'input'").select("session_id", "file_path").distinct()
    order = Window.partitionBy("session_id").orderBy(F.desc_nulls_last("at"), "producer", "file_path")
    near = read.join(made, "file_path").where("session_id <> producer").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)
    loose = disk.where("exists").select("file_path", F.col("current_hash").alias("_now"))
    return near.join(loose, "file_path").where(consistent(F.col("_now"), F.col("hash"))).select("session_id", "file_path", "producer", "at", "rank")
