"""Running scripts again: Spark plans waves and compares, the driver runs the scripts of a wave."""

from __future__ import annotations

import os
import subprocess
import sys
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from hashloom.functions.codes import MISMATCH, MISSING, UNKNOWN, VERIFIED
from hashloom.operators import lineage, lookups, verify
from hashloom.plans.scratch import materialize


def run_again(ledger, session_id: str, timeout: float = 300.0) -> str:
    """Status of a run after its script ran again in its own folder, recorded with level rerun.

    No script: missing; a script that fails: mismatch; one that takes too long, or that
    leaves no new run: unknown. Else the outputs of both runs are compared by base name.
    """
    runs = ledger.view("runs")
    row = lookups.get_run(runs, session_id).head()
    if row is None:
        return UNKNOWN
    status = _attempt(ledger, row, timeout)
    ledger.record_verification(session_id, "rerun", status)
    return status


def _attempt(ledger, row, timeout: float) -> str:
    script = row["script_path"]
    if not script or not os.path.isfile(script):
        return MISSING
    before = ledger.view("runs").agg(F.max("batch")).head()[0]
    try:
        done = subprocess.run([sys.executable, script], cwd=os.path.dirname(script) or ".", timeout=timeout, capture_output=True, check=False)
    except subprocess.TimeoutExpired:
        return UNKNOWN
    if done.returncode:
        return MISMATCH
    fresh = ledger.view("runs").where((F.col("script_path") == script) & (F.col("batch") > before)).orderBy(F.desc("batch")).select("session_id").head()
    if fresh is None:
        return UNKNOWN
    files = ledger.view("file_hashes").where("role = 'output'")
    own = lambda s: files.where(F.col("session_id") == s).select("file_path", "hash")
    return verify.rerun_status(verify.compare_rerun(own(row["session_id"]), own(fresh["session_id"]))).head()[0]


def run_dag_again(ledger, targets, disk, skip_unchanged: bool = False, timeout: float = 300.0, workers: int = 1):
    """``verify.rerun_outcomes`` of everything behind ``targets`` (file_path), run again in waves, parents first.

    A wave is a level of the plan without the runs that are fresh, if those are skipped,
    and without those that read from a failed run: a join of the plan with the outcomes so
    far chooses it. The runs of a wave do not depend on each other; ``workers`` of them run
    at a time. No targets, or none that a run wrote: no rows, and nothing runs.
    """
    runs, files = ledger.view("runs"), ledger.view("file_hashes")
    leaves = verify.targets_of(files, targets).where("session_id is not null")
    edges = materialize(lineage.recorded_edges(runs, ledger.view("session_parents")), "rerun-edges")
    plan = materialize(verify.rerun_plan(edges, lineage.reachable(edges, leaves, None), verify.fresh_runs(runs, files, disk), skip_unchanged), "rerun-plan")
    spark, told = plan.sparkSession, []
    done = lambda: spark.createDataFrame(told, "session_id string, status string")
    for (level,) in plan.select("level").distinct().orderBy("level").collect():
        ready = verify.rerun_outcomes(edges, plan.where(F.col("level") <= level), done().unionByName(
            plan.where(F.col("level") == level).select("session_id", F.lit(VERIFIED).alias("status")))).where((F.col("level") == level) & (F.col("action") == "run"))
        wave = [r["session_id"] for r in ready.select("session_id").orderBy("session_id").toLocalIterator()]
        with ThreadPoolExecutor(max(workers, 1)) as pool:
            told += zip(wave, pool.map(lambda s: run_again(ledger, s, timeout), wave))
    return verify.rerun_outcomes(edges, plan, done())


def run_claims_again(ledger, disk, file_path: str | None = None, claim_type: str | None = None, skip_unchanged: bool = False, timeout: float = 300.0, workers: int = 1):
    """``run_dag_again`` of the sources of all claims in force, of one manuscript or type if given. Claims without sources run nothing."""
    rows = ledger.view("claims").where("status <> 'superseded' and source_file is not null")
    for column, value in (("file_path", file_path), ("claim_type", claim_type)):
        rows = rows if value is None else rows.where(F.col(column) == value)
    return run_dag_again(ledger, rows.select(F.col("source_file").alias("file_path")).distinct(), disk, skip_unchanged, timeout, workers)
