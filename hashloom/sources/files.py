"""Hashes of files, folders and archive members, computed where the files are read."""

from __future__ import annotations

import fnmatch
import hashlib
import io
import json
import lzma
import os
import tarfile
import uuid
import zlib
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

from hashloom.plans.scratch import materialize

SUFFIXES = (".tar.gz", ".tar.xz", ".tar")
CHUNK = 1 << 20


def _chunked(path: str, algorithm: str) -> str | None:
    digest = hashlib.new(algorithm)
    try:
        with open(path, "rb") as f:
            while block := f.read(CHUNK):
                digest.update(block)
    except OSError:
        return None
    return digest.hexdigest()


def hash_paths(paths: DataFrame, algorithm: str = "sha256") -> DataFrame:
    """(file_path, hash, size_bytes) of the different paths that are regular files; others are left out.

    Each path is read once, in chunks, by the task that has it: any ``hashlib`` algorithm,
    any size, any name. Paths must be on a file system that executors mount.
    """
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(p, _chunked(p, algorithm), os.path.getsize(p)) for p in part["file_path"] if os.path.isfile(p)]
            yield pd.DataFrame([r for r in rows if r[1] is not None], columns=["file_path", "hash", "size_bytes"])

    return paths.select("file_path").distinct().mapInPandas(run, "file_path string, hash string, size_bytes bigint")


def hash_store(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """(file_path, hash, size_bytes) of files in any store that Spark reads; names that begin with . or _ are not seen there.

    A file is one cell, so one of 2 GB or more fails; ``hash_paths`` reads those in chunks from a mounted file system.
    """
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return rows.select(F.col("path").alias("file_path"), F.sha2("content", 256).alias("hash"), F.col("length").alias("size_bytes"))


def disk_snapshot(paths: DataFrame, algorithm: str = "sha256", levels: int = 8) -> DataFrame:
    """(file_path, exists, current_hash, archived_hash) of the different paths, as verification wants it.

    archived_hash is looked for only where the loose file is missing, in archives of its
    nearest ``levels`` folders; the deepest one that has it counts.
    """
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            there = [os.path.isfile(p) for p in part["file_path"]]
            yield pd.DataFrame([(p, t, _chunked(p, algorithm) if t else None) for p, t in zip(part["file_path"], there)], columns=["file_path", "exists", "current_hash"])

    loose = materialize(paths.select("file_path").distinct().mapInPandas(run, "file_path string, exists boolean, current_hash string"), "loose")
    found = archived_hashes(loose.where("not exists").select("file_path"), algorithm, levels)
    return loose.join(found.select("file_path", "archived_hash"), "file_path", "left")


def archive_of(folder: str) -> str | None:
    """The path itself if it is an archive, else an archive beside it that has the folder's name."""
    if folder.endswith(SUFFIXES) and os.path.isfile(folder):
        return folder
    return next((folder.rstrip("/") + s for s in SUFFIXES if os.path.isfile(folder.rstrip("/") + s)), None)


def archived_hashes(missing: DataFrame, algorithm: str = "sha256", levels: int = 8) -> DataFrame:
    """(file_path, archived_hash, archive, scan) of missing files that an archive of one of their nearest ``levels`` folders has.

    Folders are looked up once each, and each archive is read once, by the task that has
    all names wanted of it (at most as many as it has paths under its folder); ``scan``
    tells which reading found a file. An archive that cannot be read has nothing.
    """
    at = F.col("file_path")
    folders = [at]
    for _ in range(levels):
        folders.append(F.regexp_replace(folders[-1], "/[^/]*$", ""))
    near = missing.select(at, F.posexplode(F.array(*folders[1:])).alias("depth", "folder")).where("folder <> ''").distinct()

    def look(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(f, archive_of(f)) for f in part["folder"]]
            yield pd.DataFrame([r for r in rows if r[1]], columns=["folder", "archive"])

    met = near.select("folder").distinct().mapInPandas(look, "folder string, archive string")
    member = F.concat(F.element_at(F.split("folder", "/"), -1), F.expr("substr(file_path, length(folder) + 1)"))
    wanted = materialize(near.join(met, "folder").select("file_path", "depth", "archive", member.alias("member")), "wanted")

    def scan(group: pd.DataFrame) -> pd.DataFrame:
        archive, mark = group["archive"].iloc[0], uuid.uuid4().hex
        return pd.DataFrame([(archive, m, h, mark) for m, _, h in _members(archive, algorithm, set(group["member"]).__contains__)], columns=["archive", "member", "hash", "scan"])

    read = wanted.select("archive", "member").distinct().groupBy("archive").applyInPandas(scan, "archive string, member string, hash string, scan string")
    best = wanted.join(read, ["archive", "member"]).groupBy("file_path").agg(F.min_by(F.struct("hash", "archive", "scan"), "depth").alias("m"))
    return best.select("file_path", F.col("m.hash").alias("archived_hash"), "m.archive", "m.scan")


def _members(archive: str, algorithm: str, wanted=lambda name: True) -> Iterator[tuple[str, int, str]]:
    """(name, size, hash) of an archive's regular members that are wanted; of repeated names the first. Damage ends it."""
    seen = set()
    try:
        with tarfile.open(archive) as tar:
            for m in tar:
                name = m.name.removeprefix("./")
                if m.isfile() and name not in seen and wanted(name):
                    seen.add(name)
                    yield name, m.size, _digest(tar.extractfile(m), algorithm)
    except (tarfile.TarError, OSError, EOFError, zlib.error, lzma.LZMAError):
        return


class TarMembers(DataSource):
    """``spark.read.format("tar_members")``: (archive, member, size_bytes, hash) of tar archives, one partition an archive.

    Option ``archives``: a JSON list of paths; ``algorithm``: any of ``hashlib``. Conditions
    on member (equality, in, starts, ends or contains) are pushed to the reading, so that
    contents of other members are passed over instead of hashed.
    """

    @classmethod
    def name(cls) -> str:
        return "tar_members"

    def schema(self) -> str:
        return "archive string, member string, size_bytes bigint, hash string"

    def reader(self, schema) -> DataSourceReader:
        return _TarReader(json.loads(self.options.get("archives", "[]")), self.options.get("algorithm", "sha256"))


class _TarReader(DataSourceReader):
    def __init__(self, archives: list[str], algorithm: str):
        self.archives, self.algorithm, self.tests = archives, algorithm, []

    def pushFilters(self, filters):
        for f in filters:
            value = getattr(f, "value", None)
            kinds = {EqualTo: str.__eq__, StringStartsWith: str.startswith, StringEndsWith: str.endswith, StringContains: str.__contains__}
            if getattr(f, "attribute", None) == ("member",) and isinstance(f, In):
                self.tests.append(("in", frozenset(value)))
            elif getattr(f, "attribute", None) == ("member",) and type(f) in kinds and isinstance(value, str):
                self.tests.append((type(f).__name__, value))
            else:
                yield f

    def partitions(self):
        return [InputPartition(a) for a in self.archives]

    def _wanted(self, name: str) -> bool:
        by = {"in": lambda v: name in v, "EqualTo": lambda v: name == v, "StringStartsWith": name.startswith, "StringEndsWith": name.endswith, "StringContains": lambda v: v in name}
        return all(by[kind](v) for kind, v in self.tests)

    def read(self, partition):
        for name, size, digest in _members(partition.value, self.algorithm, self._wanted):
            yield partition.value, name, size, digest


def tar_members(spark: SparkSession, archives: list[str], algorithm: str = "sha256") -> DataFrame:
    """The members of the archives as a table whose conditions on member are pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TarMembers)
    return spark.read.format("tar_members").option("archives", json.dumps(archives)).option("algorithm", algorithm).load()


def _digest(stream: io.BufferedIOBase, algorithm: str) -> str:
    digest = hashlib.new(algorithm)
    while block := stream.read(CHUNK):
        digest.update(block)
    return digest.hexdigest()


def archive_members(spark: SparkSession, archives: list[str], pattern: str = "*", algorithm: str = "sha256") -> DataFrame:
    """(archive, member, hash) of regular members; a top folder that all share is left off. One task an archive."""
    rows = tar_members(spark, archives, algorithm).select("archive", "member", "hash")
    top = F.substring_index("member", "/", 1)
    shared = rows.groupBy("archive").agg(((F.min(top) == F.max(top)) & F.bool_and(F.contains("member", F.lit("/")))).alias("_shared"))
    named = rows.join(shared, "archive").withColumn("member", F.when(F.col("_shared"), F.expr("substr(member, instr(member, '/') + 1)")).otherwise(F.col("member")))
    like = fnmatch.translate(pattern).replace("(?s:", "(?s)(?:").replace("\\Z", "\\z")
    return named.where(F.col("member").rlike(f"^{like}") | F.element_at(F.split("member", "/"), -1).rlike(f"^{like}")).select("archive", "member", "hash")


def list_tree(spark: SparkSession, folder: str, recursive: bool = True, follow_links: bool = False) -> DataFrame:
    """(file_path) of all files under a folder, hidden ones included, listed by the tasks.

    Folders are rows: each round lists those that the last one found, dealt out anew, until
    there are none, so neither names nor folders gather on the driver. Links to folders are
    passed over; with ``follow_links`` each real folder is listed once, under the path that
    met it first, so cycles of links end. A folder that may not be read has nothing.
    """
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in part["folder"]:
                rows = []
                try:
                    with os.scandir(at) as entries:
                        for e in entries:
                            if e.is_dir(follow_symlinks=follow_links):
                                rows.append((e.path, os.path.realpath(e.path), True))
                            elif e.is_file():
                                rows.append((e.path, None, False))
                except OSError:
                    continue
                for k in range(0, len(rows), 10_000):
                    yield pd.DataFrame(rows[k:k + 10_000], columns=["path", "real", "is_dir"])

    fresh = spark.createDataFrame([(folder.rstrip("/") or "/", os.path.realpath(folder))], "folder string, real string")
    seen, found, hop = fresh.select("real"), None, 0
    while True:
        listed = materialize(fresh.select("folder").repartition("folder").mapInPandas(run, "path string, real string, is_dir boolean"), f"tree-{hop}")
        here = listed.where("not is_dir").select(F.col("path").alias("file_path"))
        found, hop = here if found is None else found.union(here), hop + 1
        if not recursive:
            return found
        met = listed.where("is_dir").groupBy("real").agg(F.min("path").alias("folder")) if follow_links else listed.where("is_dir").select("real", F.col("path").alias("folder"))
        fresh = materialize(met.join(seen, "real", "left_anti").select("folder", "real"), f"folders-{hop}")
        if fresh.isEmpty():
            return found
        seen = seen.union(fresh.select("real"))


def hash_directory(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = True, algorithm: str = "sha256", follow_links: bool = False) -> DataFrame:
    """(rel_path, hash) of a folder's files whose path ends like ``pattern``, hidden ones included; of its archive where the folder is gone.

    Names are listed and contents are read by the tasks. Neither folder nor archive: NotADirectoryError.
    """
    root = str(Path(folder))
    if os.path.isdir(root):
        paths = list_tree(spark, root, recursive, follow_links)
        if pattern != "*":
            like = [fnmatch.translate(p).replace("(?s:", "(?s)(?:").replace("\\Z", "\\z") for p in pattern.split("/")]
            parts = F.split("file_path", "/")
            for k, p in enumerate(like):
                paths = paths.where(F.element_at(parts, k - len(like)).rlike(f"^{p}"))
        return hash_paths(paths, algorithm).select(F.expr(f"substr(file_path, {len(root.rstrip('/')) + 2})").alias("rel_path"), "hash")
    archive = archive_of(folder)
    if archive is None:
        raise NotADirectoryError(folder)
    return archive_members(spark, [archive], pattern, algorithm).select(F.col("member").alias("rel_path"), "hash")
