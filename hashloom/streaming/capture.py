"""Capture of what a run reads and writes, as small batches appended to the ledger."""

from __future__ import annotations

import hashlib
import logging
import os
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashloom.functions import hashes
from hashloom.operators import lineage
from hashloom.plans.scratch import scope, scratch_dir
from hashloom.sources.documents import read_citation_artifact
from hashloom.sources.files import hash_paths, list_tree
from hashloom.sources.ledger import Ledger

log = logging.getLogger(__name__)


class Tracker:
    """One run: its inputs count the first time, its outputs each time; all producers of an input become parents."""

    def __init__(self, ledger: Ledger, session_id: str | None = None, script_path: str | None = None, parent_session: str | None = None, **more):
        self.ledger, self.session_id = ledger, session_id or f"run-{uuid.uuid4().hex[:12]}"
        self.script_path, self.script_hash = script_path, None
        self.inputs: dict[str, str] = {}
        self.outputs: dict[str, str] = {}
        self.done = False
        if script_path and os.path.isfile(script_path):
            self.script_hash = hashlib.sha256(open(script_path, "rb").read()).hexdigest()
        ledger.add_run(self.session_id, script_path, self.script_hash, parent_session, **more)

    def _hashed(self, paths: list[str]) -> DataFrame:
        """(file_path, hash, size_bytes); a folder's hash is the Merkle root of its data files', whatever their names."""
        spark, real = self.ledger.spark, [os.path.realpath(p) for p in paths]
        found = hash_paths(spark.createDataFrame([(p,) for p in real], "file_path string"))
        for folder in filter(os.path.isdir, real):
            files = hash_paths(list_tree(spark, folder)).where(~F.element_at(F.split("file_path", "/"), -1).rlike(r"^[._]"))
            found = found.union(files.agg(F.lit(folder).alias("file_path"), hashes.merkle_root(F.col("hash")).alias("hash"), F.sum("size_bytes").alias("size_bytes")).where("size_bytes is not null"))
        return found

    def _record(self, paths: list[str], role: str, into: dict[str, str]) -> None:
        with scope(self.ledger.spark):
            found = self._hashed(paths).collect()  # the caller's own list of paths
        if not found:
            return
        rows = self.ledger.spark.createDataFrame([(self.session_id, r["file_path"], r["hash"], role, r["size_bytes"]) for r in found], "session_id string, file_path string, hash string, role string, size_bytes bigint")
        self.ledger.add_files(rows)
        into.update({r["file_path"]: r["hash"] for r in found})
        if role == "input":
            made = lineage.producers(self.ledger.view("file_hashes")).join(rows.select("file_path"), "file_path", "left_semi")
            for r in made.where(F.col("session_id") != self.session_id).select("session_id").distinct().orderBy("session_id").collect():
                self.ledger.add_parent(self.session_id, r["session_id"])

    def record_inputs(self, *paths: str) -> None:
        self._record([p for p in dict.fromkeys(paths) if os.path.realpath(p) not in self.inputs], "input", self.inputs)

    def record_outputs(self, *paths: str) -> None:
        self._record(list(dict.fromkeys(paths)), "output", self.outputs)

    def combined_hash(self) -> str:
        pairs = [(f"input:{p}", h) for p, h in self.inputs.items()] + [(f"output:{p}", h) for p, h in self.outputs.items()]
        pairs += [("script", self.script_hash)] if self.script_hash else []
        return hashlib.sha256("".join(f"{k}:{h}" for k, h in sorted(pairs)).encode()).hexdigest()

    def finalize(self, status: str = "success", exit_code: int = 0) -> None:
        """End the run, once."""
        if not self.done:
            self.done = True
            self.ledger.finish_run(self.session_id, status, exit_code, self.combined_hash())

    def summary(self) -> dict:
        return {"session_id": self.session_id, "n_inputs": len(self.inputs), "n_outputs": len(self.outputs), "combined_hash": self.combined_hash()}


_active: list[Tracker] = []


def start_tracking(ledger: Ledger, **options) -> Tracker:
    _active.append(Tracker(ledger, **options))
    return _active[-1]


def stop_tracking(status: str = "success", exit_code: int = 0) -> Tracker | None:
    if not _active:
        return None
    tracker = _active.pop()
    tracker.finalize(status, exit_code)
    return tracker


def current() -> Tracker:
    if not _active:
        raise RuntimeError("no run is being tracked")
    return _active[-1]


def record_input(path: str) -> None:
    current().record_inputs(path)


def record_output(path: str) -> None:
    current().record_outputs(path)


class PlanWatch:
    """What Spark itself reads and writes while it watches, from the plans that it executed.

    A query execution listener takes the root paths of file scans and the target of file
    writes out of every plan that succeeds, so ``spark.read`` and ``df.write`` need no
    wrapper. It only notes paths: hashes are taken by the run's own record, once, at its
    end. Paths under ``hidden`` folders (the store, scratch tables) are not noted. A plan
    that it cannot read is passed over.
    """

    class Java:
        implements = ["org.apache.spark.sql.util.QueryExecutionListener"]

    def __init__(self, spark, hidden: list[str]):
        self.spark, self.inputs, self.outputs = spark, {}, {}
        self.hidden = [self._plain(h) for h in hidden if h]

    @staticmethod
    def _plain(path: str) -> str:
        """A local path without scheme; paths of other stores as they are."""
        return os.path.realpath("/" + path.split(":", 1)[1].lstrip("/")) if path.startswith("file:") else os.path.realpath(path) if path.startswith("/") else path

    def __enter__(self) -> PlanWatch:
        from pyspark.java_gateway import ensure_callback_server_started

        ensure_callback_server_started(self.spark.sparkContext._gateway)
        self.spark._jsparkSession.listenerManager().register(self)
        return self

    def __exit__(self, *_) -> None:
        self.spark._jsc.sc().listenerBus().waitUntilEmpty()  # plans are told after they ran
        self.spark._jsparkSession.listenerManager().unregister(self)

    def onSuccess(self, name, execution, nanoseconds) -> None:  # noqa: N802 (the JVM's name)
        try:
            self._walk(execution.analyzed())
        except Exception as e:  # a hook must not break the program it watches
            log.warning("plan not recorded: %s", e)

    def onFailure(self, name, execution, error) -> None:  # noqa: N802
        """What failed wrote nothing that counts."""

    def _walk(self, plan) -> None:
        kind = plan.getClass().getSimpleName()
        if kind == "InsertIntoHadoopFsRelationCommand":
            self._note(self.outputs, plan.outputPath().toString())
        elif kind == "LogicalRelation" and plan.relation().getClass().getSimpleName() == "HadoopFsRelation":
            paths = plan.relation().location().rootPaths()
            for i in range(paths.size()):
                self._note(self.inputs, paths.apply(i).toString())
        for children in (plan.children(), plan.innerChildren()):
            for i in range(children.size()):
                if children.apply(i).getClass().getName().startswith("org.apache.spark.sql.") and hasattr(children.apply(i), "children"):
                    self._walk(children.apply(i))

    def _note(self, into: dict, path: str) -> None:
        path = self._plain(path)
        if not any(path == h or path.startswith(h.rstrip("/") + "/") for h in self.hidden):
            into.setdefault(path)


@contextmanager
def session(ledger: Ledger, output_dir: str | None = None, watch_plans: bool = False, **options):
    """A tracked run: success at the end, error where an exception leaves it; files without record are warned of.

    With ``watch_plans`` what Spark reads and writes within is recorded too (``PlanWatch``),
    also of a run that ends in error.
    """
    tracker = start_tracking(ledger, **options)
    try:
        if watch_plans:
            watch = PlanWatch(ledger.spark, [ledger.root, scratch_dir(ledger.spark)])
            try:
                with watch:
                    yield tracker
            finally:
                written = [p for p in watch.inputs if p not in watch.outputs]
                _quietly(lambda t: t.record_inputs(*written))
                _quietly(lambda t: t.record_outputs(*watch.outputs))
        else:
            yield tracker
    except BaseException:
        stop_tracking("error", 1)
        raise
    if output_dir and os.path.isdir(output_dir) and os.listdir(output_dir) and not tracker.outputs:
        log.warning("%s has files, but the run recorded no output", output_dir)
    stop_tracking()


def register_intermediate(ledger: Ledger, name: str, value, file_path: str, supports: list[str] | None = None, session_id: str | None = None) -> str:
    """Register a run's intermediate value as a claim; without session id or tracked run a RuntimeError."""
    session_id = session_id or current().session_id
    spark = ledger.spark
    rows = spark.createDataFrame([(file_path, name, repr(value), supports or [], session_id)], "file_path string, name string, text string, supports array<string>, source_session string")
    from hashloom.operators.claims import intermediate_payload

    rows = rows.select("file_path", "source_session", F.lit("value").alias("claim_type"), intermediate_payload(F.col("name"), F.col("text"), F.col("supports")).alias("claim_value"))
    rows = rows.withColumn("claim_id", hashes.claim_id(F.col("file_path"), F.lit(None).cast("int"), F.col("claim_type"), F.col("claim_value")))
    ledger.add_claims(rows, spark.createDataFrame([], "file_path string, exists boolean, current_hash string"))
    return rows.head()["claim_id"]


def tracked_read(read: Callable[[str], DataFrame], path: str) -> DataFrame:
    """Read, and record the input if a run is tracked; recording never fails a read."""
    df = read(path)
    _quietly(lambda t: t.record_inputs(path))
    return df


def tracked_write(write: Callable[[str], None], path: str) -> None:
    """Write, and record the output if a run is tracked; citation artifacts are taken in as well."""
    write(path)
    _quietly(lambda t: t.record_outputs(path))
    if path.endswith(".json"):
        _quietly(lambda t: _ingest(t.ledger, path))


def _ingest(ledger: Ledger, path: str) -> None:
    rows = read_citation_artifact(ledger.spark, path)
    if rows is not None:
        ledger.add_citations(rows)


def _quietly(action: Callable[[Tracker], None]) -> None:
    if _active:
        try:
            action(_active[-1])
        except Exception as e:  # a hook must not break the program it watches
            log.warning("not recorded: %s", e)
