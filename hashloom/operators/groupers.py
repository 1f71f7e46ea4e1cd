"""Groupers of files: ordered steps, each over what is still alone; never across sessions or roles."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hashloom.functions.hashes import basename, dirname, merkle_root

#: A grouper takes rows (session_id, role, file_path, hash, group_id, label, kind) and fills the last three of some.
Grouper = Callable[[DataFrame], DataFrame]
_NEW = ("group_id", "label", "kind")


def start(files: DataFrame) -> DataFrame:
    rows = files.select("session_id", "role", "file_path", "hash")
    return rows.withColumns({c: F.lit(None).cast("string") for c in _NEW})


def _assign(rows: DataFrame, bucket, enough: int, label, kind: str) -> DataFrame:
    """Give rows without group that share ``bucket`` (null: none), ``enough`` or more, one group."""
    free = rows.withColumn("_b", F.when(F.col("group_id").isNull(), bucket))
    alone = F.when(F.col("_b").isNull(), F.xxhash64("file_path"))  # rows without bucket are dealt out, not gathered in one window
    n = F.count("_b").over(Window.partitionBy("session_id", "role", "_b", alone))
    free = free.withColumn("_n", n).withColumn("_t", F.col("_b").isNotNull() & (F.col("_n") >= enough))
    name = F.concat(label, F.lit(" (×"), F.col("_n").cast("string"), F.lit(")"))
    return free.withColumn("label", F.when(F.col("_t"), name).otherwise(F.col("label"))).withColumn("kind", F.when(F.col("_t"), kind).otherwise(F.col("kind"))).withColumn(
        "group_id", F.when(F.col("_t"), F.concat(F.lit(f"{kind.split(chr(58))[0]}:"), F.col("_b"))).otherwise(F.col("group_id"))).drop("_b", "_n", "_t")


def identity() -> Grouper:
    return lambda rows: rows


def drop_all_files() -> Grouper:
    return lambda rows: rows.where(F.lit(False))


def pattern(regex: str, placeholder: str = "{X}") -> Grouper:
    """Base names that are equal once every match of ``regex`` is replaced; folders do not count, unmatched names stay alone."""
    base = basename(F.col("file_path"))
    norm = F.regexp_replace(base, regex, placeholder.replace("\\", "\\\\").replace("$", "\\$"))
    return lambda rows: _assign(rows, F.when(norm != base, norm), 2, norm, f"pattern:{regex}")


def directory(min_size: int = 10, depth: int = 1) -> Grouper:
    """Files of one folder, if it has ``min_size`` of them; labelled with the folder's last ``depth`` names."""
    folder = dirname(F.col("file_path"))
    names = F.filter(F.split(folder, "/"), lambda x: x != "")
    last = F.array_join(F.slice(names, F.greatest(F.size(names) - depth + 1, F.lit(1)), depth), "/")
    return lambda rows: _assign(rows, folder, min_size, F.concat(last, F.lit("/")), "directory")


def session_bundle(max_files: int = 3) -> Grouper:
    """All files of a role, if there are more than ``max_files``."""
    return lambda rows: _assign(rows, F.col("role"), max_files + 1, F.concat(F.col("role"), F.lit(" bundle")), "session_bundle")


def compose(*steps: Grouper) -> Grouper:
    def run(rows: DataFrame) -> DataFrame:
        for step in steps:
            rows = step(rows)
        return rows
    return run


def auto() -> Grouper:
    return compose(pattern(r"P\d+"), pattern(r"\d{4}-\d{2}-\d{2}"), pattern(r"fold_\d+"), directory(10), session_bundle(3))


_REGISTRY: dict[str, Callable[..., Grouper]] = {
    "identity": identity, "drop_all_files": drop_all_files, "pattern": pattern, "directory": directory, "session_bundle": session_bundle, "auto": auto}


def register_grouper(name: str, factory: Callable[..., Grouper]) -> None:
    _REGISTRY[name] = factory


def resolve(spec, allow_import: bool = True) -> Grouper:
    """A grouper from None (auto), a grouper, a name, or a dict with ``type`` and the factory's arguments.

    type compose has ``steps``; type custom has ``import``, a ``package:factory`` name.
    """
    if spec is None:
        return auto()
    if callable(spec):
        return spec
    spec = {"type": spec} if isinstance(spec, str) else dict(spec)
    kind = spec.pop("type", None)
    if kind == "compose":
        return compose(*[resolve(s, allow_import) for s in spec["steps"]])
    if kind == "custom":
        if not allow_import:
            raise ValueError("custom groupers are off")
        module, _, name = spec.pop("import").partition(":")
        return getattr(importlib.import_module(module), name)(**spec)
    if kind not in _REGISTRY:
        raise ValueError(f"unknown grouper {kind}")
    return _REGISTRY[kind](**spec)


def groups(rows: DataFrame, across_roles: bool = False) -> DataFrame:
    """(session_id, role, group_id, label, kind, size, root_hash, members): one row a group, lone files as groups of one.

    With ``across_roles`` equal group ids of both roles are one group, whose role is
    mixed if it has files of both; the groupers here never need that, custom ones may.
    """
    own = F.coalesce("group_id", F.concat(F.lit("single:"), *([F.col("role"), F.lit(":")] if across_roles else []), F.col("file_path")))
    role = F.when(F.min("role") == F.max("role"), F.min("role")).otherwise("mixed")
    found = rows.withColumn("group_id", own).groupBy("session_id", *([] if across_roles else ["role"]), "group_id").agg(
        *([role.alias("role")] if across_roles else []),
        F.coalesce(F.first("label"), basename(F.min("file_path"))).alias("label"), F.coalesce(F.first("kind"), F.lit("single")).alias("kind"),
        F.count("*").alias("size"), merkle_root(F.col("hash")).alias("root_hash"), F.array_sort(F.collect_list("file_path")).alias("members"))
    return found.select("session_id", "role", "group_id", "label", "kind", "size", "root_hash", "members")
