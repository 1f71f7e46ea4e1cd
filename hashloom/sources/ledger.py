"""The ledger: append-only Parquet logs, and views of their latest state.

Writers only add files, so many may write at once. A view keeps the newest entry of each
key with one aggregation; later entries for parts of a row (a run's end, a claim's
status) are laid over the newest whole row that came before them.
"""

from __future__ import annotations

import hashlib
import os
import socket
import time
import uuid
import warnings
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hashloom.functions import hashes
from hashloom.functions.codes import CLAIM_TYPES
from hashloom.operators import citations as cite
from hashloom.operators import lineage, lookups
from hashloom.sources.schema import GROWING, KEYS, TABLES, columns, log_schema


class Ledger:
    """The tables under ``root``, a folder that all executors reach."""

    def __init__(self, spark: SparkSession, root: str, host: str | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.host = host or os.environ.get("HASHLOOM_HOST") or socket.gethostname()
        self._last = 0
        self._held: list | None = None

    # --- logs ---------------------------------------------------------------

    def log(self, table: str) -> DataFrame:
        """All entries of a table, oldest schema included: columns that a file lacks are null.

        The newest snapshot, if there is one, and the files that it does not cover.
        """
        covered, snapshot = self._snapshot(table)
        rest = [f"{self.root}/{table}/{n}" for n in self._files(table) if n not in covered]
        paths = ([snapshot] if snapshot else []) + ([f"{self.root}/{table}"] if rest and not snapshot else rest)
        if not paths:
            return self.spark.createDataFrame([], log_schema(table))
        return self.spark.read.schema(log_schema(table)).parquet(*paths)

    def append(self, table: str, rows: DataFrame, op: str | None = "add") -> None:
        """Add ``rows`` as one batch; columns that they lack are null. Without ``op`` rows have their own."""
        self._last = max(time.time_ns() // 1000, self._last + 1)
        have = {c.lower() for c in rows.columns}
        out = []
        for field in self.spark.createDataFrame([], TABLES[table]).schema:
            value = F.col(field.name) if field.name in have else F.lit(None)
            out.append(value.cast(field.dataType).alias(field.name))
        order = F.col("seq") if op is None else F.monotonically_increasing_id()
        rows.select(*out, F.lit(self._last).cast("long").alias("batch"), order.cast("long").alias("seq"), (F.col("op") if op is None else F.lit(op)).alias("op")).write.mode("append").parquet(f"{self.root}/{table}")

    def _row(self, table: str, op: str = "add", **values) -> None:
        if self._held is not None:
            self._held.append((table, op, values))
            return
        schema = ", ".join(x for x in TABLES[table].split(", ") if x.split(" ")[0] in values)
        names = [x.split(" ")[0] for x in schema.split(", ")]
        self.append(table, self.spark.createDataFrame([tuple(values[n] for n in names)], schema).coalesce(1), op)

    @contextmanager
    def batch(self):
        """Single events within are held back and written at the end, one file a table, in their order; nothing of them is seen before."""
        if self._held is not None:  # within another batch
            yield self
            return
        self._held = []
        try:
            yield self
        finally:
            held, self._held = self._held, None
            for table in dict.fromkeys(t for t, _, _ in held):
                names = columns(table)
                rows = [(*(values.get(n) for n in names), k, op) for k, (t, op, values) in enumerate(held) if t == table]
                self.append(table, self.spark.createDataFrame(rows, f"{TABLES[table]}, seq bigint, op string").coalesce(1), None)

    # --- snapshots ----------------------------------------------------------

    def _store(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _names(self, path: str) -> list[str]:
        store, where = self._store(path)
        return sorted(f.getPath().getName() for f in store.listStatus(where)) if store.exists(where) else []

    def _files(self, table: str) -> list[str]:
        """Names of the event files of a table."""
        return [n for n in self._names(f"{self.root}/{table}") if not n.startswith(("_", "."))]

    def _snapshot(self, table: str) -> tuple[set[str], str | None]:
        """(covered event files, folder) of the newest snapshot that is committed."""
        folder = f"{self.root}/_snapshots/{table}"
        marks = [n for n in self._names(folder) if n.endswith(".mark")]
        if not marks:
            return set(), None
        lines = self.spark.sparkContext.wholeTextFiles(f"{folder}/{marks[-1]}").first()[1].splitlines()
        return set(lines[1:]), f"{folder}/{lines[0]}"

    def compact_in_place(self, table: str) -> int:
        """Gather a table's events into one snapshot, while readers and writers go on; how many event files it covers.

        The snapshot keeps, of each key and kind of entry, what a view can still need: the
        newest (of parents the first). That is a maximum, so entries that arrive late
        change nothing else. It counts once its mark, which names the files that it covers,
        is renamed into place; of two that try for the same number one fails with
        FileExistsError and leaves no trace. Readers take the newest mark and the files that
        it does not name; ``vacuum`` removes the others later.
        """
        before, files = self._snapshot(table)[0], self._files(table)
        if not set(files) - before:
            return len(before)
        folder = f"{self.root}/_snapshots/{table}"
        number = 1 + max((int(n.split(".")[0]) for n in self._names(folder) if n.endswith(".mark")), default=0)
        log, covered = self.log(table), sorted(before | set(files))
        if table not in GROWING:
            row, when = F.struct(*log.columns), F.struct("batch", "seq")
            pick = F.min_by(row, when) if table == "session_parents" else F.max_by(row, when)
            log = log.groupBy(*KEYS[table], F.col("op").alias("_op")).agg(pick.alias("r")).select("r.*")
        name = f"{number:010}-{uuid.uuid4().hex}"
        log.coalesce(1).write.parquet(f"{folder}/{name}")
        jvm = self.spark._jvm
        store, draft = self._store(f"{folder}/.{name}")
        out = store.create(draft, False)
        out.write(bytearray("\n".join([name, *covered]).encode()))
        out.close()
        try:
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration())
            none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            context.rename(store.makeQualified(draft), store.makeQualified(jvm.org.apache.hadoop.fs.Path(f"{folder}/{number:010}.mark")), none)
        except Exception as e:
            store.delete(draft, False)
            store.delete(jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"), True)
            raise FileExistsError(f"snapshot {number} of {table} is another's") from e
        return len(covered)

    def vacuum(self, table: str, older_than: float = 86_400.0) -> int:
        """Delete event files that the newest snapshot covers, and older snapshots, once they are ``older_than`` seconds old; how many files went.

        Readers that began with them must have ended by then. The newest mark keeps their names.
        """
        covered, snapshot = self._snapshot(table)
        if snapshot is None:
            return 0
        store, _ = self._store(self.root)
        limit, gone, path = (time.time() - older_than) * 1000, 0, self.spark._jvm.org.apache.hadoop.fs.Path
        for name in self._files(table):
            where = path(f"{self.root}/{table}/{name}")
            if name in covered and store.getFileStatus(where).getModificationTime() <= limit:
                gone += bool(store.delete(where, False))
        folder, newest = f"{self.root}/_snapshots/{table}", snapshot.rsplit("/", 1)[1]
        for name in self._names(folder):
            where = path(f"{folder}/{name}")
            if name[:10] < newest[:10] and store.getFileStatus(where).getModificationTime() <= limit:
                store.delete(where, True)
        return gone

    def compact(self, table: str, target: str) -> None:
        """Write the latest state of a table as a log of its own under ``target``."""
        view = self.view(table)
        view.select(*columns(table), "batch", "seq", F.lit("add").alias("op")).write.parquet(f"{target.rstrip('/')}/{table}")

    # --- views --------------------------------------------------------------

    def view(self, table: str) -> DataFrame:
        """Latest rows of a table, with ``batch`` and ``seq`` of their newest whole entry."""
        log = self.log(table)
        if table in GROWING:
            return log.drop("op")
        if table == "session_parents":  # what is there already stays
            first = F.min_by(F.struct("recorded_at", "batch", "seq"), F.struct("batch", "seq"))
            return log.groupBy("session_id", "parent_session").agg(first.alias("r")).select("session_id", "parent_session", "r.*")
        keys, rest = list(KEYS[table]), [c for c in columns(table) if c not in KEYS[table]]
        when = F.struct("batch", "seq")
        row = F.struct(*rest, "batch", "seq")
        newest = lambda op: F.max_by(F.when(F.col("op") == op, row), F.when(F.col("op") == op, when))
        ops = {"runs": ("finish", "parent"), "claims": ("status", "remove"), "file_hashes": ("class",)}.get(table, ())
        last = log.groupBy(*keys).agg(newest("add").alias("add"), *[newest(op).alias(op) for op in ops]).where("add is not null")
        at = lambda x: F.struct(F.col(f"{x}.batch"), F.col(f"{x}.seq"))
        later = lambda op: F.coalesce(F.col(op).isNotNull() & (at(op) > at("add")), F.lit(False))
        over: dict[str, Column] = {}
        if table == "runs":
            over = {c: F.when(later("finish"), F.col(f"finish.{c}")).otherwise(F.col(f"add.{c}")) for c in ("finished_at", "status", "exit_code", "combined_hash")}
            over["parent_session"] = F.when(later("parent"), F.col("parent.parent_session")).otherwise(F.col("add.parent_session"))
        elif table == "claims":
            last = last.where(~later("remove"))
            over = {c: F.when(later("status"), F.col(f"status.{c}")).otherwise(F.col(f"add.{c}")) for c in ("status", "verified_at")}
        elif table == "file_hashes":
            over = {"node_class": F.when(later("class"), F.col("class.node_class")).otherwise(F.col("add.node_class"))}
        out = last.select(*keys, *[over.get(c, F.col(f"add.{c}")).alias(c) for c in rest], F.col("add.batch").alias("batch"), F.col("add.seq").alias("seq"))
        return out.select(*columns(table), "batch", "seq")

    # --- runs ---------------------------------------------------------------

    def add_run(self, session_id: str, script_path: str | None = None, script_hash: str | None = None, parent_session: str | None = None,
                metadata: str | None = None, provenance: str = "tracked", exception_reason: str | None = None) -> None:
        """Begin a run; one of that id begins anew, without end."""
        self._row("runs", session_id=session_id, script_path=script_path, script_hash=script_hash, parent_session=parent_session, metadata=metadata,
                  provenance=provenance, exception_reason=exception_reason, status="running", started_at=_now())

    def finish_run(self, session_id: str, status: str = "success", exit_code: int = 0, combined_hash: str | None = None) -> None:
        self._row("runs", "finish", session_id=session_id, status=status, exit_code=exit_code, combined_hash=combined_hash, finished_at=_now())

    def set_parent(self, session_id: str, parent: str) -> None:
        """Make ``parent`` the run's own parent, and list it."""
        self._row("runs", "parent", session_id=session_id, parent_session=parent)
        self._row("session_parents", session_id=session_id, parent_session=parent, recorded_at=_now())

    def add_parent(self, session_id: str, parent: str) -> None:
        """List a parent; it becomes the run's own only if that has none."""
        row = lookups.get_run(self.view("runs"), session_id).select("parent_session").head()
        if row is not None and row[0] is None:
            self._row("runs", "parent", session_id=session_id, parent_session=parent)
        self._row("session_parents", session_id=session_id, parent_session=parent, recorded_at=_now())

    def migrate_parents(self) -> None:
        """List each run's own parent where it is not listed yet."""
        own = self.view("runs").where("parent_session is not null").select("session_id", "parent_session")
        fresh = own.join(self.view("session_parents"), ["session_id", "parent_session"], "left_anti")
        self.append("session_parents", fresh.withColumn("recorded_at", F.lit(_now())))

    # --- files --------------------------------------------------------------

    def add_files(self, rows: DataFrame) -> None:
        """Record (session_id, file_path, hash, role); columns that rows lack are null, or false for frozen."""
        for name, value in (("frozen", F.lit(False)), ("host", F.lit(self.host)), ("recorded_at", F.lit(_now()))):
            rows = rows if name in rows.columns else rows.withColumn(name, value)
        self.append("file_hashes", rows)

    def set_node_class(self, session_id: str, file_path: str, role: str, node_class: str) -> None:
        self._row("file_hashes", "class", session_id=session_id, file_path=file_path, role=role, node_class=node_class)

    def auto_classify(self) -> int:
        """Give rows without a node class one by role and extension; how many got one."""
        rows = self.view("file_hashes").where("node_class is null").select(
            "session_id", "file_path", "role", hashes.node_class(F.col("role"), F.col("file_path")).alias("node_class")).where("node_class is not null")
        n = rows.count()
        if n:
            self.append("file_hashes", rows, "class")
        return n

    def record_verification(self, session_id: str, level: str, status: str) -> None:
        self._row("verification_results", session_id=session_id, level=level, status=status, verified_at=_now())

    # --- claims -------------------------------------------------------------

    def add_claims(self, rows: DataFrame, disk: DataFrame, warn: bool = True, export: Callable[[Ledger], None] | None = None) -> None:
        """Register claims (file_path, claim_type, and any of line_number, claim_value, source_file, source_session, claim_id).

        Ids are derived where absent, sources hashed by ``disk``, sessions taken from the
        newest producer. An unknown type is a ValueError. With ``warn`` a RuntimeWarning tells
        how many sources no run has written, as their claims have no lineage. ``export`` is
        called with the ledger once the claims are in; that it fails is a RuntimeWarning too.
        """
        for c, t in (("line_number", "int"), ("claim_value", "string"), ("source_file", "string"), ("source_session", "string"), ("claim_id", "string")):
            rows = rows if c in rows.columns else rows.withColumn(c, F.lit(None).cast(t))
        odd = rows.where(~F.coalesce(F.col("claim_type").isin(*CLAIM_TYPES), F.lit(False))).head()
        if odd is not None:
            raise ValueError(f"unknown claim type {odd['claim_type']}")
        loose = disk.where("exists").select(F.col("file_path").alias("source_file"), F.col("current_hash").alias("source_hash"))
        made = lineage.newest_producers(self.view("file_hashes")).select(F.col("file_path").alias("source_file"), F.col("session_id").alias("_made"))
        derived = hashes.claim_id(F.col("file_path"), F.col("line_number"), F.col("claim_type"), F.col("claim_value"))
        out = rows.join(loose, "source_file", "left").join(made, "source_file", "left")
        out = out.withColumn("source_session", F.coalesce("source_session", "_made")).withColumn("claim_id", F.coalesce("claim_id", derived))
        if warn:
            lost = out.where("source_file is not null and source_session is null").agg(F.count_distinct("source_file"), F.min("source_file")).head()
            if lost[0]:
                warnings.warn(f"{lost[0]} source files have no run that wrote them, among them {lost[1]}: their claims have no lineage", RuntimeWarning, stacklevel=2)
        self.append("claims", out.withColumn("registered_at", F.lit(_now())).withColumn("status", F.lit("registered")))
        if export is not None:
            try:
                export(self)
            except Exception as e:  # the claims are in; what shows them may come later
                warnings.warn(f"claims not exported: {e!r}", RuntimeWarning, stacklevel=2)

    def write_statuses(self, verified: DataFrame) -> None:
        """Record the new status of verified claims (claim_id, new_status)."""
        self.append("claims", verified.select("claim_id", F.col("new_status").alias("status"), F.lit(_now()).alias("verified_at")), "status")

    def _mutate(self, chosen: DataFrame, op: str, status: str | None = None) -> int:
        ids = chosen.select("claim_id")
        n = ids.count()
        if n:
            self.append("claims", ids.withColumn("status", F.lit(status)).withColumn("verified_at", F.lit(_now())), op)
        return n

    def preview(self, prefix: str) -> int:
        """How many claims, superseded ones included, lie under a path."""
        return self.view("claims").where(lookups.under(F.col("file_path"), prefix)).count()

    def remove_claim(self, claim_id: str) -> bool:
        return self._mutate(self.view("claims").where(F.col("claim_id") == claim_id), "remove") > 0

    def remove_claims_under(self, prefix: str) -> int:
        return self._mutate(self.view("claims").where(lookups.under(F.col("file_path"), prefix)), "remove")

    def supersede_claim(self, claim_id: str) -> bool:
        return self._mutate(self.view("claims").where(F.col("claim_id") == claim_id), "status", "superseded") > 0

    def supersede_claims_under(self, prefix: str) -> int:
        return self._mutate(self.view("claims").where(lookups.under(F.col("file_path"), prefix) & (F.col("status") != "superseded")), "status", "superseded")

    # --- citations, stamps --------------------------------------------------

    def add_citations(self, rows: DataFrame) -> int:
        """Record citations (cite_key, and any of the table's columns, author, year, title, journal); a blank key is a ValueError."""
        if rows.where("trim(coalesce(cite_key, '')) = ''").head() is not None:
            raise ValueError("a citation without key")
        for c, t in (("doi", "string"), ("resolved", "boolean"), ("is_stub", "boolean"), ("author", "string"), ("year", "string"), ("title", "string"), ("journal", "string")):
            rows = rows if c in rows.columns else rows.withColumn(c, F.lit(None).cast(t))
        fields = {c: F.col(c) for c in ("author", "year", "title", "journal", "doi")}
        status = cite.derived_status(F.col("resolved"), F.col("is_stub"), F.col("doi"))
        out = rows.withColumn("status", status).withColumn("metadata_json", hashes.metadata_text(fields)).withColumn("metadata_hash", hashes.metadata_hash(fields)).withColumn(
            "registered_at", F.lit(_now())).withColumn("verified_at", F.when(F.col("status") == "verified", F.lit(_now())))
        self.append("citations", out)
        return rows.count()

    def stamp(self, session_ids: list[str] | None = None, backend: str = "file", proof: str | None = None) -> str:
        """Stamp the ledger's root hash; a proof is written as JSON under ``proof`` if given. Nothing to stamp is a ValueError.

        Which sessions a stamp covers goes to a table of its own, so no list of them is made.
        """
        if backend != "file":
            raise ValueError(f"backend {backend} needs a network service")
        rows = self._stamped(session_ids)
        root, count = rows.agg(hashes.ledger_root(F.col("session_id"), F.col("combined_hash")), F.count("*")).head()
        if root is None:
            raise ValueError("no runs to stamp")
        now = _now().isoformat()
        stamp_id = "stamp_" + hashlib.sha256(f"{root}:{now}".encode()).hexdigest()[:12]
        self.append("stamp_sessions", rows.select(F.lit(stamp_id).alias("stamp_id"), "session_id"))
        self._row("stamps", stamp_id=stamp_id, root_hash=root, timestamp=now, backend=backend, service_url=None, response_token=None, run_count=count)
        if proof:
            self.view("stamps").where(F.col("stamp_id") == stamp_id).drop("batch", "seq", "session_ids").coalesce(1).write.json(f"{proof}/stamp")
            self.stamp_sessions(stamp_id).orderBy("session_id").write.json(f"{proof}/sessions")
        return stamp_id

    def stamp_sessions(self, stamp_id: str) -> DataFrame:
        """(session_id) of what a stamp covers; stamps of an older kind list them themselves."""
        own = self.view("stamp_sessions").where(F.col("stamp_id") == stamp_id).select("session_id")
        listed = self.view("stamps").where(F.col("stamp_id") == stamp_id).select(F.explode("session_ids").alias("session_id"))
        return own.union(listed).distinct()

    def _stamped(self, session_ids: list[str] | None) -> DataFrame:
        runs = self.view("runs")
        if session_ids is None:
            return runs.where("status = 'success' and combined_hash is not null")
        return runs.join(self.spark.createDataFrame([(s,) for s in session_ids], "session_id string").distinct(), "session_id", "left_semi")

    def check_stamp(self, stamp_id: str | None = None) -> dict:
        """Whether a stamp's (the newest's) root hash still holds, and how many runs could be stamped now."""
        stamps = self.view("stamps")
        rows = stamps if stamp_id is None else stamps.where(F.col("stamp_id") == stamp_id)
        s = rows.orderBy(F.desc("batch")).drop("session_ids").head()
        if s is None:
            raise ValueError("no such stamp")
        now = self.view("runs").join(self.stamp_sessions(s["stamp_id"]), "session_id", "left_semi")
        root = now.agg(hashes.ledger_root(F.col("session_id"), F.col("combined_hash"))).head()[0]
        return {"stamp_id": s["stamp_id"], "matches": root == s["root_hash"], "root_hash": root, "run_count": s["run_count"], "run_count_now": self._stamped(None).count()}


def _now():
    from datetime import datetime, timezone

    return datetime.now(timezone.utc).replace(tzinfo=None)
