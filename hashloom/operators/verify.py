"""Verification: recorded against current hashes, and worst-status reductions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hashloom.functions.codes import MISMATCH, MISSING, SUSPECT, UNKNOWN, VERIFIED, worst_status
from hashloom.functions.hashes import basename, consistent, starts_with_expected
from hashloom.operators import lineage
from hashloom.plans.scratch import materialize

FAILED = (MISMATCH, MISSING)


def checked_files(runs: DataFrame, files: DataFrame) -> DataFrame:
    """What a run's check is about: its inputs and outputs, and its script if path and hash are known.

    Recorded rows of role script do not count; a script is never frozen.
    """
    return _own_files(files).unionByName(_scripts(runs))


def _own_files(files: DataFrame) -> DataFrame:
    return files.where("role in ('input', 'output')").select("session_id", "file_path", "hash", "role", F.coalesce("frozen", F.lit(False)).alias("frozen"))


def _scripts(runs: DataFrame) -> DataFrame:
    return runs.where("script_path is not null and script_hash is not null").select(
        "session_id", F.col("script_path").alias("file_path"), F.col("script_hash").alias("hash"), F.lit("script").alias("role"), F.lit(False).alias("frozen"))


def checked(runs: DataFrame, files: DataFrame, disk: DataFrame) -> DataFrame:
    """``verify_files`` of all ``checked_files``: files and scripts meet the disk apart, so files that are dealt by path already stay where they are."""
    return verify_files(_own_files(files), disk).unionByName(verify_files(_scripts(runs), disk))


def verify_files(rows: DataFrame, disk: DataFrame) -> DataFrame:
    """``rows`` (file_path, hash, frozen, ...) with current_hash and status.

    disk: (file_path, exists, current_hash, archived_hash), one row a path; absent paths
    are missing. A frozen file that exists, loose or archived, is taken at its recorded
    hash. Otherwise the loose file's hash counts before the archived one's.
    """
    found = rows.join(disk.select("file_path", "exists", F.col("current_hash").alias("_loose"), "archived_hash"), "file_path", "left")
    there = F.coalesce(F.col("exists"), F.lit(False))
    current = F.when(F.col("frozen"), F.when(there | F.col("archived_hash").isNotNull(), F.col("hash"))).otherwise(
        F.when(there, F.col("_loose")).otherwise(F.col("archived_hash")))
    status = F.when(F.col("_current").isNull(), MISSING).when(F.col("frozen") | starts_with_expected(F.col("_current"), F.col("hash")), VERIFIED).otherwise(MISMATCH)
    return found.withColumn("_current", current).withColumn("status", status).withColumn("current_hash", F.col("_current")).drop("_current", "_loose", "exists", "archived_hash")


def run_status(propagate: bool = True, collapse_suspect: bool = False) -> Column:
    """Aggregate over a run's checked files (null status: no file): the run's status.

    Own failures come first, then failed inputs (suspect), and no files at all is verified.
    """
    bad = F.col("status").isin(*FAILED)
    own = F.col("role") != "input"
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    out = F.when(any_(own & (F.col("status") == MISMATCH)), MISMATCH).when(any_(own & (F.col("status") == MISSING)), MISSING)
    if propagate:
        out = out.when(any_(~own & bad), MISMATCH if collapse_suspect else SUSPECT)
    return (out.when(F.coalesce(F.bool_and(F.col("status") == VERIFIED), F.lit(True)), VERIFIED)
            .when(any_(F.col("status") == MISMATCH), MISMATCH).when(any_(F.col("status") == MISSING), MISSING).otherwise(UNKNOWN))


def verify_runs(runs: DataFrame, files: DataFrame, disk: DataFrame, propagate: bool = True, collapse_suspect: bool = False) -> DataFrame:
    """(session_id, status, n_files, n_mismatch, n_missing) of every run; runs without files are verified."""
    return run_statuses(runs, checked(runs, files, disk), propagate, collapse_suspect)


def run_statuses(runs: DataFrame, checked: DataFrame, propagate: bool = True, collapse_suspect: bool = False) -> DataFrame:
    """``verify_runs`` from ``checked`` files: each run adds a row without file, and all rows are grouped at once."""
    none = F.lit(None).cast("string")
    rows = checked.select("session_id", "file_path", "role", "status", F.lit(False).alias("run")).unionByName(
        runs.select("session_id", none.alias("file_path"), none.alias("role"), none.alias("status"), F.lit(True).alias("run")))
    return rows.groupBy("session_id").agg(
        run_status(propagate, collapse_suspect).alias("status"), F.count("file_path").alias("n_files"),
        F.count_if(F.col("status") == MISMATCH).alias("n_mismatch"), F.count_if(F.col("status") == MISSING).alias("n_missing"),
        F.bool_or("run").alias("run")).where("run").drop("run")


def status_overview(verified: DataFrame) -> DataFrame:
    """One row of counts of ``verify_runs``: verified, mismatched and missing runs; suspect and unknown ones are in none."""
    s = F.col("status")
    counts = [F.count_if(c).alias(n) for n, c in (
        ("n_verified", s == VERIFIED), ("n_mismatch", (s != VERIFIED) & (F.col("n_mismatch") > 0)),
        ("n_missing", (s != VERIFIED) & (F.col("n_mismatch") == 0) & (F.col("n_missing") > 0)))]
    return verified.agg(F.count("*").alias("n_runs"), *counts)


def targets_of(files: DataFrame, paths: DataFrame) -> DataFrame:
    """(file_path, session_id): the newest producer of each target path, null where nobody wrote it."""
    newest = lineage.newest_producers(files).select("file_path", "session_id")
    return paths.select("file_path").distinct().join(newest, "file_path", "left")


def verify_chains(targets: DataFrame, members: DataFrame, verified: DataFrame) -> DataFrame:
    """(file_path, session_id, status, n_runs) of each target's whole chain; a target without producer is unknown.

    members: ``lineage.closure`` of the targets' sessions; verified: ``verify_runs`` with
    propagation. Sessions that have no run row are unknown.
    """
    known = members.join(verified.select("session_id", "status"), "session_id", "left").withColumn("status", F.coalesce("status", F.lit(UNKNOWN)))
    of_leaf = known.groupBy("leaf").agg(worst_status(F.col("status")).alias("status"), F.count("*").alias("n_runs"))
    return targets.join(of_leaf, targets["session_id"] == of_leaf["leaf"], "left").select(
        "file_path", "session_id", F.coalesce("status", F.lit(UNKNOWN)).alias("status"), F.coalesce("n_runs", F.lit(0)).cast("long").alias("n_runs"))


#: Bits of ``chain_marks``: statuses that occur in a chain (no bit: all verified), and what flags its claims.
MARKS = {MISMATCH: 1, MISSING: 2, SUSPECT: 4, UNKNOWN: 8, "exception": 16, "frozen": 32}


def chain_marks(edges: DataFrame, runs: DataFrame, files: DataFrame, verified: DataFrame, anchored: DataFrame | None = None, max_depth: int | None = 50) -> DataFrame:
    """(session_id, marks, anchor): which MARKS occur in each session's whole chain, and its least trusted file.

    verified: ``verify_runs`` with propagation; a session with files but no run row is
    unknown. anchored: (session_id, anchor) of trusted files by session, if they are asked
    for. Marks travel from parents to children; sessions whose chains have none have no row.
    """
    bit = lambda name: F.lit(MARKS[name]).cast("long")
    status = F.when(F.col("status") == VERIFIED, 0)
    for name in (MISMATCH, MISSING, SUSPECT):
        status = status.when(F.col("status") == name, MARKS[name])
    rows = [
        verified.select("session_id", status.otherwise(MARKS[UNKNOWN]).cast("long").alias("marks")).where("marks > 0"),
        files.select("session_id").distinct().join(runs.select("session_id"), "session_id", "left_anti").select("session_id", bit(UNKNOWN).alias("marks")),
        runs.where("provenance = 'exception'").select("session_id", bit("exception").alias("marks")),
        files.where("frozen").select("session_id", bit("frozen").alias("marks")).distinct()]
    kind = anchored.schema["anchor"].dataType if anchored is not None else "string"
    own = rows[0]
    for more in rows[1:]:
        own = own.union(more)
    own = own.withColumn("anchor", F.lit(None).cast(kind))
    if anchored is not None:
        own = own.unionByName(anchored.select("session_id", F.lit(0).cast("long").alias("marks"), "anchor"))
    return lineage.inherited(edges, own, {"marks": lineage.BITS, "anchor": lineage.LEAST}, max_depth)


def marked(name: str) -> Column:
    """Whether a row's ``marks`` have the named one; no marks at all: it has not."""
    return F.coalesce(F.col("marks").bitwiseAND(F.lit(MARKS[name]).cast("long")) > 0, F.lit(False))


def marked_status() -> Column:
    """The worst status that a row's ``marks`` tell."""
    out = F.when(marked(MISMATCH), MISMATCH)
    for name in (MISSING, SUSPECT, UNKNOWN):
        out = out.when(marked(name), name)
    return out.otherwise(VERIFIED)


def chain_statuses(targets: DataFrame, marks: DataFrame) -> DataFrame:
    """(file_path, session_id, status) of each target's whole chain by ``chain_marks``; a target without producer is unknown."""
    found = targets.join(marks.select("session_id", "marks"), "session_id", "left")
    return found.select("file_path", "session_id", F.when(F.col("session_id").isNull(), UNKNOWN).otherwise(marked_status()).alias("status"))


def file_chains(runs: DataFrame, files: DataFrame, disk: DataFrame, max_depth: int | None = 50) -> DataFrame:
    """``verify_chains`` of every path in ``files``, without looking up the status of each pair of leaf and ancestor.

    Files meet the disk, their producers and their readers once, by path. Runs take the
    bits of their failed files, which their chains add up: of a chain's bits only the
    worst counts, so a run's lesser ones do no harm.
    """
    bit = lambda name: F.lit(MARKS[name]).cast("long")
    run, needed, none = F.lit(64).cast("long"), F.lit(128).cast("long"), F.lit(0).cast("long")
    bad = F.when(F.col("status") == MISMATCH, bit(MISMATCH)).when(F.col("status") == MISSING, bit(MISSING)).otherwise(none)
    told = F.when(F.col("role") == "output", bad).when((F.col("role") == "input") & F.col("status").isin(*FAILED), bit(SUSPECT)).otherwise(none)
    rows = lineage.traced(files.select("session_id", "file_path", "hash", "role", F.coalesce("frozen", F.lit(False)).alias("frozen"), "recorded_at"))
    scripts = _scripts(runs).select("file_path", "hash", "frozen").distinct()
    path = F.when(F.col("first"), F.col("file_path"))
    met = materialize(verify_files(rows, disk).select(
        "session_id", told.bitwiseOR(F.when(F.col("needed"), needed).otherwise(none)).alias("marks"), "parent", path.alias("file_path"), F.when(F.col("first"), F.col("newest")).alias("newest"),
        F.lit(None).cast("string").alias("hash"), "first").unionByName(verify_files(scripts, disk).select(
            F.lit(None).cast("string").alias("session_id"), bad.alias("marks"), F.lit(None).cast("string").alias("parent"), "file_path", F.lit(None).cast("string").alias("newest"),
            "hash", F.lit(None).cast("boolean").alias("first"))), "met")
    own, of_script = met.where("first is not null"), met.where("first is null").select(F.col("file_path").alias("script_path"), F.col("hash").alias("script_hash"), "marks")
    ran = runs.select("session_id", "script_path", "script_hash").join(of_script, ["script_path", "script_hash"], "left").select(
        "session_id", F.coalesce("marks", none).bitwiseOR(run).alias("marks"))
    marks = own.select("session_id", "marks").where("marks > 0").union(ran).groupBy("session_id").agg(F.bit_or("marks").alias("marks")).where(F.col("marks").bitwiseAND(needed) > 0)
    status = F.when(F.col("marks").bitwiseAND(run) > 0, F.col("marks").bitwiseAND(bit(MISMATCH) + bit(MISSING) + bit(SUSPECT))).otherwise(bit(UNKNOWN))
    edges = own.where("parent is not null").select(F.col("session_id").alias("child"), "parent")
    found = lineage.totals(edges, marks.select("session_id", status.alias("marks")), max_depth)
    return own.where("first").select("file_path", F.col("newest").alias("session_id")).join(found, "session_id", "left").select(
        "file_path", "session_id", F.when(F.col("n").isNull(), UNKNOWN).otherwise(marked_status()).alias("status"), F.coalesce("n", none).alias("n_runs"))


def verify_dag(edges: DataFrame, members: DataFrame, verified: DataFrame) -> DataFrame:
    """(session_id, level, status, failed): runs of a target DAG, in the strict order of levels, and whether they or an ancestor failed.

    verified: ``verify_runs`` without propagation, so suspect does not occur. A cycle is a ValueError.
    """
    own = materialize(members.select("session_id").distinct().join(verified.select("session_id", "status"), "session_id", "left").select(
        "session_id", F.coalesce("status", F.lit(UNKNOWN)).alias("status")), "dag")
    order = lineage.failing_levels(edges, own.select("session_id", (F.col("status") != VERIFIED).alias("bad")))
    return own.join(order, "session_id").select("session_id", "level", "status", "failed")


def dag_status(dag: DataFrame) -> DataFrame:
    """One row: status and counts of a verified DAG; no runs at all is unknown."""
    worst = F.when(F.count("*") == 0, UNKNOWN).otherwise(worst_status(F.col("status")))
    return dag.agg(worst.alias("status"), F.count("*").alias("n_runs"), F.count_if("failed").alias("n_failed"))


def attribution(dag: DataFrame, checked: DataFrame) -> DataFrame:
    """One row: ok, root_cause, root_session, failed_node, failed_session.

    The root cause is the first run in order with failures of its own, at its failed
    input if it has one; the failed node is the last such run, at its failed output if it
    has one (of several, the first path at the root, the last path at the end). checked: ``verify_files`` rows.
    """
    bad = checked.where(F.col("status").isin(*FAILED)).join(dag.select("session_id", "level"), "session_id")
    at = F.struct("file_path", "session_id")
    first = F.min_by(at, F.struct("level", "session_id", F.when(F.col("role") == "input", 0).otherwise(1), "file_path"))
    turned = F.struct(F.col("level"), F.col("session_id"), F.when(F.col("role") == "output", 1).otherwise(0), "file_path")
    return bad.agg(first.alias("a"), F.max_by(at, turned).alias("z")).select(
        F.col("a").isNull().alias("ok"), F.col("a.file_path").alias("root_cause"), F.col("a.session_id").alias("root_session"),
        F.col("z.file_path").alias("failed_node"), F.col("z.session_id").alias("failed_session"))


def blast_radius(edges: DataFrame, checked: DataFrame) -> DataFrame:
    """(session_id): runs with failed files of their own, and all downstream of them."""
    return lineage.downstream(edges, checked.where(F.col("status").isin(*FAILED)))


def split_claims(claims: DataFrame, chains: DataFrame, blast: DataFrame) -> DataFrame:
    """Claims with ``still_valid``: false if the chain of their session (closure rows) meets the blast radius."""
    hit = chains.join(blast.select("session_id"), "session_id", "left_semi").select(F.col("leaf").alias("source_session")).distinct().withColumn("_hit", F.lit(True))
    return claims.join(hit, "source_session", "left").withColumn("still_valid", F.col("_hit").isNull()).drop("_hit")


def fresh_runs(runs: DataFrame, files: DataFrame, disk: DataFrame) -> DataFrame:
    """(session_id, fresh): whether script and all inputs exist and match as loose files; outputs do not count.

    A run without script hash is not fresh.
    """
    now = disk.select("file_path", "exists", "current_hash")
    match = F.coalesce(F.col("exists"), F.lit(False)) & consistent(F.col("current_hash"), F.col("hash"))
    found = [rows.where("role <> 'output'").join(now, "file_path", "left").select("session_id", "role", match.alias("same")) for rows in (_own_files(files), _scripts(runs))]
    own = found[0].union(found[1]).groupBy("session_id").agg((F.bool_and("same") & F.bool_or(F.col("role") == "script")).alias("fresh"))
    return runs.select("session_id").join(own, "session_id", "left").withColumn("fresh", F.coalesce("fresh", F.lit(False)))


def compare_rerun(original: DataFrame, again: DataFrame) -> DataFrame:
    """Recorded outputs (file_path, hash) against a new run's, by base name; of equal base names the last path counts."""
    new = again.groupBy(basename(F.col("file_path")).alias("_base")).agg(F.max_by("hash", "file_path").alias("new_hash"))
    status = F.when(F.col("new_hash").isNull(), MISSING).when(F.col("new_hash") == F.col("hash"), VERIFIED).otherwise(MISMATCH)
    return original.withColumn("_base", basename(F.col("file_path"))).join(new, "_base", "left").withColumn("status", status).drop("_base")


def rerun_status(compared: DataFrame) -> DataFrame:
    """One row: verified if all outputs are, mismatch if any differs, else unknown (also where files are only missing)."""
    s = F.col("status")
    return compared.agg(F.when(F.bool_and(s == VERIFIED), VERIFIED).when(F.bool_or(s == MISMATCH), MISMATCH).otherwise(UNKNOWN).alias("status"))


def rerun_plan(edges: DataFrame, members: DataFrame, fresh: DataFrame, skip_unchanged: bool = False) -> DataFrame:
    """(session_id, level, fresh, action) of what to run again, parents first; fresh runs are skipped if asked."""
    order = lineage.levels(edges, members.select("session_id").distinct()).join(fresh, "session_id", "left").withColumn("fresh", F.coalesce("fresh", F.lit(False)))
    action = F.when(F.lit(skip_unchanged) & F.col("fresh"), "skip").otherwise("run")
    return order.withColumn("action", action)


def rerun_outcomes(edges: DataFrame, plan: DataFrame, statuses: DataFrame) -> DataFrame:
    """``plan`` with ``status`` and ``failed`` of its runs, and action blocked where something upstream failed.

    statuses: (session_id, status) of what ran. A skipped run is verified; one without a
    status, as it was blocked or left nothing, is unknown. What is not verified fails, and
    so does all that reads from it, however far.
    """
    told = plan.join(statuses.select("session_id", F.col("status").alias("_s")), "session_id", "left").withColumn(
        "status", F.when(F.col("action") == "skip", VERIFIED).otherwise(F.coalesce("_s", F.lit(UNKNOWN)))).drop("_s")
    names = told.select("session_id")
    inner = edges.join(names.toDF("child"), "child", "left_semi").join(names.toDF("parent"), "parent", "left_semi")
    bad = told.where(F.col("status") != VERIFIED).select("session_id")
    direct = inner.join(bad.toDF("parent"), "parent").select(F.col("child").alias("session_id")).distinct()
    below = lineage.downstream(inner, direct).withColumn("_blocked", F.lit(True))
    x = told.join(below, "session_id", "left")
    blocked = F.coalesce("_blocked", F.lit(False))
    return x.withColumn("failed", blocked | (F.col("status") != VERIFIED)).withColumn("action", F.when(blocked, "blocked").otherwise(F.col("action"))).drop("_blocked")


def rerun_summary(outcomes: DataFrame) -> DataFrame:
    """One row: status, n_runs and n_failed of re-runs; verified if nothing failed, no runs at all are unknown."""
    s = F.col("status")
    worst = F.when(F.count("*") == 0, UNKNOWN).when(~F.bool_or("failed"), VERIFIED).when(F.bool_or(s == MISMATCH), MISMATCH).when(F.bool_or(s == MISSING), MISSING).otherwise(UNKNOWN)
    return outcomes.agg(worst.alias("status"), F.count("*").alias("n_runs"), F.count_if("failed").alias("n_failed"))
