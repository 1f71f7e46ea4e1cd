"""Readers and writers of the documents around a ledger: manifests, citation files, bibliographies, configuration."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hashloom.plans.scratch import materialize, scope

# Schema names of documents.
SOURCES_SCHEMA = "sources-1.0"
CITATION_SCHEMA = r"^[^/\s]+/citations"  # of any version
CONFIG_NAMES = ("config.yaml", "config.yml", "config.json")
BIB_FIELDS = ("doi", "journal", "note", "title", "author", "year")


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, dict] | None:
    """((ord, file_path, sha256), signature or {}) of a sources manifest; None if it is not there, ValueError if it is malformed."""
    p = Path(path)
    if not p.is_file():
        return None
    try:
        data = json.loads(p.read_text())
        if data["schema"] != SOURCES_SCHEMA:
            raise ValueError(f"schema {data['schema']}")
        rows = [(i, str((p.parent / s["path"]).resolve()) if not s["path"].startswith("/") else s["path"], s["sha256"]) for i, s in enumerate(data["sources"])]
        if not all(re.fullmatch("[0-9a-fA-F]{64}", r[2]) for r in rows):
            raise ValueError("a hash is not a sha256")
    except (KeyError, TypeError, json.JSONDecodeError) as e:
        raise ValueError(f"malformed manifest {path}: {e}") from e
    return spark.createDataFrame(rows, "ord int, file_path string, sha256 string"), data.get("signature") or {}


def _write_manifest(path: str, sources: dict[str, str]) -> None:
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    rows = [{"path": k, "sha256": sources[k]} for k in sorted(sources)]
    p.write_text(json.dumps({"schema": SOURCES_SCHEMA, "sources": rows, "signature": None}, indent=2) + "\n")


def _sources(path: str) -> dict[str, str]:
    p = Path(path)
    return {s["path"]: s["sha256"] for s in json.loads(p.read_text())["sources"]} if p.is_file() else {}


def register_sources(hashed: DataFrame, path: str, wanted: list[str], dry_run: bool = False) -> int:
    """Add files (file_path, hash) to a manifest by path, which drops its signature; a file without hash is FileNotFoundError.

    With ``dry_run`` all is checked and counted, but nothing written.
    """
    found = {r["file_path"]: r["hash"] for r in hashed.where(F.col("file_path").isin(wanted)).select("file_path", "hash").collect()}
    lost = [w for w in wanted if w not in found]
    if lost:
        raise FileNotFoundError(lost[0])
    if not dry_run:
        _write_manifest(path, _sources(path) | found)
    return len(found)


def unregister_sources(path: str, wanted: list[str], dry_run: bool = False) -> int:
    """Take files out of a manifest; how many were in it. With ``dry_run`` they stay."""
    have = _sources(path)
    gone = [w for w in wanted if w in have]
    if gone and not dry_run:
        _write_manifest(path, {k: v for k, v in have.items() if k not in gone})
    return len(gone)


def read_path_list(spark: SparkSession, path: str) -> DataFrame:
    """(file_path) of a list with a path on each line; blank lines and # comments are left out. A list that is not there is FileNotFoundError."""
    if not Path(path).is_file():
        raise FileNotFoundError(path)
    line = F.trim("value")
    return spark.read.text(path).select(line.alias("file_path")).where("file_path <> '' and not startswith(file_path, '#')")


def register_list(spark: SparkSession, listed: str, path: str, dry_run: bool = False) -> int:
    """``register_sources`` of the paths of a list; one that is no file is FileNotFoundError, and nothing is registered then."""
    from hashloom.sources.files import hash_paths

    with scope(spark):
        wanted = materialize(read_path_list(spark, listed).distinct(), "wanted")
        hashed = materialize(hash_paths(wanted), "hashed")
        lost = wanted.join(hashed, "file_path", "left_anti").orderBy("file_path").head()
        if lost is not None:
            raise FileNotFoundError(lost["file_path"])
        return register_sources(hashed, path, [r["file_path"] for r in wanted.toLocalIterator()], dry_run)  # a manifest is one document


def read_citation_artifact(spark: SparkSession, path: str) -> DataFrame | None:
    """Citation rows of an artifact file (rows with a blank key are left out), None if it is none."""
    row = ("cite_key: STRING, doi: STRING, source_id: STRING, resolved: BOOLEAN, is_stub: BOOLEAN, url: STRING, manuscript_file: STRING, line_number: INT, "
           "metadata: STRUCT<author: STRING, year: STRING, title: STRING, journal: STRING>")
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"schema STRING, citations ARRAY<STRUCT<{row}>>").alias("d"))
    if whole.where(F.col("d.schema").rlike(CITATION_SCHEMA)).isEmpty():
        return None
    rows = whole.select(F.explode("d.citations").alias("c")).select("c.*")
    return rows.where("trim(coalesce(cite_key, '')) <> ''").select("*", "metadata.*").drop("metadata")


def read_bib(spark: SparkSession, path: str, keys: list[str] | None = None) -> DataFrame:
    """(seq, key, doi, journal, note, title, author, year) of bibliography files; a later entry of a key has the higher seq."""
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"\r\n?", "\n").alias("t"))
    entries = whole.select(F.posexplode(F.split("t", r"(?m)^\s*(?=@)")).alias("seq", "e")).where(F.col("e").rlike(r"^@(?i:(?!comment|string|preamble))\w+\s*\{"))
    field = lambda n: F.nullif(F.trim(F.regexp_replace(F.regexp_extract("e", rf'(?is)[,\s]{n}\s*=\s*(\{{(?:[^{{}}]|\{{[^{{}}]*\}})*\}}|"[^"]*"|[^,\s}}]+)', 1), r'^[{"]|[}"]$', "")), F.lit(""))
    out = entries.select("seq", F.trim(F.regexp_extract("e", r"^@\w+\s*\{\s*([^,\s}]+)", 1)).alias("key"), *[field(n).alias(n) for n in BIB_FIELDS]).where("key <> ''")
    return out if keys is None else out.where(F.col("key").isin(keys))


def merge(base: dict, over: dict) -> dict:
    """``over`` laid over ``base``, mappings merged key by key."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def _read_config(path: Path) -> dict:
    try:
        if path.suffix in (".yaml", ".yml"):
            try:
                import yaml
            except ImportError as e:
                raise ImportError(f"{path} needs PyYAML") from e
            try:
                data = yaml.safe_load(path.read_text()) or {}
            except yaml.YAMLError as e:
                raise ValueError(f"malformed configuration {path}: {e}") from e
        else:
            data = json.loads(path.read_text().strip() or "{}")
    except json.JSONDecodeError as e:
        raise ValueError(f"malformed configuration {path}: {e}") from e
    if not isinstance(data, dict):
        raise ValueError(f"malformed configuration {path}")
    return data


def load_config(*paths: str, explicit: str | None = None) -> dict:
    """Configuration of JSON and YAML files and of folders, each laid over those before it; absent ones are skipped, malformed ones are ValueErrors.

    Of a folder its config file counts first (.yaml before .yml before .json), then its
    other JSON files by name, then the files of its folder config by name. ``explicit``
    comes last and must be there.
    """
    out: dict = {}
    if explicit is not None and not Path(explicit).exists():
        raise FileNotFoundError(explicit)
    for path in map(Path, [*paths, *([explicit] if explicit is not None else [])]):
        if path.is_dir():
            first = [p for p in (path / n for n in CONFIG_NAMES) if p.is_file()][:1]
            rest = sorted(p for p in path.glob("*.json") if p.name not in CONFIG_NAMES)
            nested = sorted((p for p in (path / "config").glob("*") if p.suffix in (".yaml", ".yml", ".json")), key=lambda p: p.name)
            found = [*first, *rest, *nested]
        else:
            found = [path] if path.is_file() else []
        for p in found:
            out = merge(out, _read_config(p))
    return out


def project_config(start: str, folder: str = ".hashloom") -> dict:
    """The config file of the nearest ``folder`` in ``start`` or above it, as it is; {} where there is none. Its ``grouper`` is a spec for ``groupers.resolve``."""
    at = Path(start).resolve()
    for place in (at, *at.parents):
        for name in CONFIG_NAMES:
            if (place / folder / name).is_file():
                return _read_config(place / folder / name)
    return {}
