"""Exports: claims and citations for readers, and graphs as node and edge tables, JSON, Mermaid and HTML."""

from __future__ import annotations

import html
import json
from collections.abc import Iterator
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hashloom.functions.codes import STATUS_COLOURS
from hashloom.functions.hashes import basename, display_path, node_id
from hashloom.operators import citations as cite
from hashloom.operators import claims as claim
from hashloom.operators import groupers, lineage
from hashloom.plans.scratch import materialize

# Versions of the exported shapes.
CLAIMS_VERSION, FEED_VERSION, HINTS_SCHEMA = "1.4", "1.6-unified", "manuscript-hints/1"
#: What our hints are told from those of other programs by.
SOURCE = "hashloom"


def claim_rows(resolved: DataFrame) -> DataFrame:
    """One enriched row a claim with ``resolved``: its bucket, colours and flags."""
    r = F.col("resolved")
    return resolved.withColumn("bucket", claim.bucket(r)).withColumn("colour", claim.colour(r)).withColumn("bucket_colour", claim.bucket_colour(F.col("bucket")))


def feed_rows(resolved: DataFrame, citations: DataFrame) -> DataFrame:
    """Claims and citations in one row shape."""
    return claim.render_entries(resolved).unionByName(cite.render_entries(citations), allowMissingColumns=True)


def feed_summary(feed: DataFrame) -> DataFrame:
    """One row: counts by bucket and the badge of a feed."""
    counts = feed.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == b).alias(f"n_{b}") for b in ("verified", "suspect", "failed", "exception")])
    return counts.withColumn("badge", F.when(F.col("n_failed") > 0, "failing").when(F.col("n_verified") == F.col("total"), "all_verified").otherwise("partial"))


def hint_rows(resolved: DataFrame, citations: DataFrame) -> DataFrame:
    """Hints on claims and citations that need attention, in one shape, ordered by id."""
    return claim.hint_entries(resolved).unionByName(cite.hint_entries(citations)).orderBy("id")


def write_hints(hints: DataFrame, path: str, source: str = SOURCE) -> None:
    """Put ``hints`` into the table at ``path`` as those of ``source``; hints of other sources stay as they are.

    The table is partitioned by source and a run overwrites its own partition alone. One
    row without id marks the run, so that a run without hints clears its partition too.
    """
    mark = hints.sparkSession.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in hints.schema])
    hints.unionByName(mark).withColumn("source", F.lit(source)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(path)


def read_hints(spark, path: str) -> DataFrame:
    """Hints of all sources, with ``source``."""
    return spark.read.parquet(path).where("id is not null").withColumn("source", F.col("source").cast("string"))


def write_json(rows: DataFrame, path: str, **around) -> None:
    """One JSON document with the rows under ``rows``: rows stream to the driver, which holds one at a time."""
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    if p.exists():
        p.chmod(0o644)
    with p.open("w") as out:
        out.write(json.dumps(around)[:-1] + (", " if around else "") + '"rows": [')
        for k, r in enumerate(rows.toJSON().toLocalIterator()):
            out.write((",\n" if k else "\n") + r)
        out.write("\n]}\n")


def export_claims(resolved: DataFrame, reasons: DataFrame, path: str, read_only: bool = True) -> None:
    """The claims document; exceptions of the chains are told once a session."""
    told = reasons.groupBy("session_id").agg(F.min("reason").alias("reason")).orderBy("session_id")
    summary = claim.attestation(resolved).head().asDict()
    write_json(claim_rows(resolved).orderBy("claim_id"), path, version=CLAIMS_VERSION, attestation=summary, legend=STATUS_COLOURS,
               exceptions=[r.asDict() for r in told.toLocalIterator()])
    if read_only:
        Path(path).chmod(0o444)


def export_feed(resolved: DataFrame, citations: DataFrame, path: str, read_only: bool = True) -> None:
    feed = feed_rows(resolved, citations)
    write_json(feed.orderBy("kind", "id"), path, version=FEED_VERSION, summary=feed_summary(feed).head().asDict())
    if read_only:
        Path(path).chmod(0o444)


def export_hints(resolved: DataFrame, citations: DataFrame, path: str, source: str = SOURCE, read_only: bool = True) -> None:
    """The hints document; hints of other sources that it has already stay, before ours, and so does what else it tells.

    A document that cannot be read as JSON is written afresh. Our rows stream to the driver one at a time.
    """
    p, found = Path(path), {}
    if p.is_file():
        p.chmod(0o644)
        try:
            found = json.loads(p.read_text())
        except ValueError:
            found = {}
    found = found if isinstance(found, dict) else {}
    foreign = [h for h in found.pop("hints", None) or [] if isinstance(h, dict) and h.get("source") != source]
    around = found | {"schema": HINTS_SCHEMA, "generated_at": datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")}
    p.parent.mkdir(parents=True, exist_ok=True)
    with p.open("w") as out:
        out.write(json.dumps(around)[:-1] + ', "hints": [')
        k = 0
        for k, h in enumerate((*foreign, None)):
            if h is not None:
                out.write((",\n" if k else "\n") + json.dumps(h))
        for h in hint_rows(resolved, citations).toLocalIterator():
            out.write((",\n" if k else "\n") + json.dumps(h.asDict(recursive=True) | {"source": source}))
            k += 1
        out.write("\n]}\n")
    if read_only:
        p.chmod(0o444)


# --- graphs -----------------------------------------------------------------

def graph_nodes(runs: DataFrame, checked: DataFrame, levels: DataFrame, path_mode: str = "name", base: str | None = None) -> DataFrame:
    """(id, kind, label, status, level): script nodes in order of levels, and files once, with their first role and worst status.

    Labels are paths as ``display_path`` shows them.

    checked: ``verify_files`` rows of the runs in ``levels``.
    """
    upto = Window.orderBy(F.col("level").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)  # a row for each level
    before = levels.groupBy("level").count().withColumn("base", F.coalesce(F.sum("count").over(upto), F.lit(0))).withColumnRenamed("level", "_level")
    own = F.row_number().over(Window.partitionBy("level").orderBy("session_id")) - 1
    spot = levels.withColumn("own", own).join(before.select("_level", "base"), F.expr("level <=> _level")).withColumn("i", F.col("base") + F.col("own"))
    scripts = spot.join(runs.select("session_id", "script_path"), "session_id", "left").join(
        checked.groupBy("session_id").agg((F.count_if(F.col("status") != "verified") == 0).alias("good")), "session_id", "left").select(
        F.concat(F.lit("script_"), F.col("i").cast("string")).alias("id"), F.lit("script").alias("kind"), F.when(F.col("script_path").isNotNull(), display_path(F.col("script_path"), path_mode, base)).otherwise(F.col("session_id")).alias("label"),
        F.when(F.coalesce("good", F.lit(True)), "verified").otherwise("failed").alias("status"), "level", "session_id")
    files = checked.where("role <> 'script'").join(levels, "session_id").groupBy("file_path").agg(
        F.min_by("role", F.struct("level", "session_id", "role")).alias("kind"), F.bool_and(F.col("status") == "verified").alias("good"), F.min("level").alias("level"))
    return scripts.unionByName(files.select(
        node_id(F.col("file_path")).alias("id"), "kind", display_path(F.col("file_path"), path_mode, base).alias("label"),
        F.when(F.col("good"), "verified").otherwise("failed").alias("status"), "level", F.lit(None).cast("string").alias("session_id")))


def graph_edges(nodes: DataFrame, checked: DataFrame) -> DataFrame:
    """(source, target): inputs to scripts and scripts to outputs, by node id."""
    scripts = nodes.where("kind = 'script'").select("session_id", F.col("id").alias("script"))
    f = checked.where("role <> 'script'").select("session_id", node_id(F.col("file_path")).alias("file"), "role").distinct().join(scripts, "session_id")
    reads = F.col("role") == "input"
    return f.select(F.when(reads, F.col("file")).otherwise(F.col("script")).alias("source"), F.when(reads, F.col("script")).otherwise(F.col("file")).alias("target")).distinct()


def grouped_graph(nodes: DataFrame, checked: DataFrame, grouper=None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a graph whose files are contracted by a grouper spec (``groupers.resolve``).

    Groups of different runs with the same files and contents are one node, so what one
    run wrote and another read still meets. A node's role is input, output or, if it is
    both, mixed; it is failed if one of its files is. Edges that become equal are merged
    and tell how many there were (``n``). Group ids come from sums over members, so no
    list of a group's files is gathered. Scripts stay as they are. Checked files and
    groups are written once: nodes and edges, each of which may be used again, read them.
    """
    f = materialize(checked.where("role <> 'script'").select("session_id", "role", "file_path", "hash", "status"), "grouped-files")
    rows = groupers.resolve(grouper)(groupers.start(f)).join(f.select("session_id", "role", "file_path", "status"), ["session_id", "role", "file_path"])
    h = F.xxhash64("file_path", "hash")
    told = rows.where("group_id is not null").groupBy("session_id", "role", "group_id").agg(
        F.first("label").alias("label"), F.count("*").alias("size"), F.min("file_path").alias("first_path"), F.bool_and(F.col("status") == "verified").alias("good"),
        F.md5(F.concat_ws(":", F.count("*").cast("string"), F.bit_xor(h).cast("string"), F.sum(h.cast("decimal(38,0)")).cast("string"))).alias("key"))
    lone = rows.where("group_id is null").select(
        "session_id", "role", node_id(F.col("file_path")).alias("id"), basename(F.col("file_path")).alias("label"), F.lit(1).cast("long").alias("size"),
        F.col("file_path").alias("first_path"), (F.col("status") == "verified").alias("good"))
    met = lone.unionByName(told.select("session_id", "role", F.concat(F.lit("group_"), F.substring("key", 1, 16)).alias("id"), "label", "size", "first_path", "good"))
    met = materialize(met, "groups")
    scripts = nodes.where("kind = 'script'")
    files = met.groupBy("id").agg(
        F.when(F.min("role") == F.max("role"), F.min("role")).otherwise("mixed").alias("kind"), F.first("label").alias("label"), F.max("size").alias("size"),
        F.min("first_path").alias("first_path"), F.when(F.bool_and("good"), "verified").otherwise("failed").alias("status"))
    link = met.join(scripts.select("session_id", F.col("id").alias("script")), "session_id")
    reads = F.col("role") == "input"
    edges = link.select(F.when(reads, F.col("id")).otherwise(F.col("script")).alias("source"), F.when(reads, F.col("script")).otherwise(F.col("id")).alias("target"), "size").groupBy(
        "source", "target").agg(F.sum("size").alias("n"))
    return scripts.select("id", "kind", "label", "status").unionByName(files, allowMissingColumns=True), edges


def script_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of scripts alone: edges of runs (child, parent), relabelled by script node."""
    scripts = nodes.where("kind = 'script'")
    name = scripts.select("session_id", "id")
    child, parent = name.toDF("child", "target"), name.toDF("parent", "source")
    return scripts, edges.join(child, "child").join(parent, "parent").groupBy("source", "target").agg(F.count("*").alias("n"))


def cascade(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with ``tainted``: failed, or downstream of a failed node, however far."""
    e = edges.select(F.col("target").alias("child"), F.col("source").alias("parent"))
    bad = lineage.downstream(e, nodes.where("status = 'failed'").select(F.col("id").alias("session_id"))).select(F.col("session_id").alias("id"), F.lit(True).alias("tainted"))
    return nodes.join(bad, "id", "left").withColumn("tainted", F.coalesce("tainted", F.lit(False)))


def json_lines(nodes: DataFrame, edges: DataFrame) -> Iterator[str]:
    """The JSON document of a graph, a line at a time: the driver holds one row."""
    yield '{"nodes": ['
    for name, rows in (("links", nodes.orderBy("id")), (None, edges.orderBy("source", "target"))):
        held = None
        for r in rows.toLocalIterator():
            if held is not None:
                yield held + ","
            held = " " + json.dumps(r.asDict())
        if held is not None:
            yield held
        yield f'], "{name}": [' if name else "]}"


def to_json(nodes: DataFrame, edges: DataFrame) -> str:
    """``json_lines`` of a small graph as one text."""
    return "\n".join(json_lines(nodes, edges))


def mermaid_lines(nodes: DataFrame, edges: DataFrame, title: str | None = None) -> Iterator[str]:
    """Mermaid text of a graph, a line at a time; nodes with ``tainted`` are shown as failed."""
    yield from ("---", f"title: {title}", "---") if title else ()
    yield "graph TD"
    for r in nodes.orderBy("id").toLocalIterator():
        shape = ("[[", "]]") if r["kind"] == "script" else ("([", "])")
        bad = r["status"] == "failed" or r.asDict().get("tainted")
        yield f'    {r["id"]}{shape[0]}"{r["label"]}"{shape[1]}:::{"failed" if bad else "verified"}'
    for r in edges.orderBy("source", "target").toLocalIterator():
        yield f"    {r['source']} --> {r['target']}"
    yield "    classDef verified fill:#2da44e"
    yield "    classDef failed fill:#cf222e"


def to_mermaid(nodes: DataFrame, edges: DataFrame, title: str | None = None) -> str:
    """``mermaid_lines`` of a small graph as one text."""
    return "\n".join(mermaid_lines(nodes, edges, title)) + "\n"


def html_lines(lines: Iterator[str], title: str = "Lineage") -> Iterator[str]:
    """A page that shows Mermaid lines."""
    yield f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><pre class='mermaid'>"
    yield from map(html.escape, lines)
    yield "</pre></body></html>"


def render(nodes: DataFrame, edges: DataFrame, path: str, title: str | None = None) -> None:
    """Write a graph by the path's ending: .json, .mmd or .html. Other endings, and an empty graph, are ValueErrors."""
    if nodes.isEmpty():
        raise ValueError("nothing to render")
    kind = Path(path).suffix
    lines = {".json": lambda: json_lines(nodes, edges), ".mmd": lambda: mermaid_lines(nodes, edges, title), ".html": lambda: html_lines(mermaid_lines(nodes, edges), title or "Lineage")}.get(kind)
    if lines is None:
        raise ValueError(f"cannot render {kind or 'a path without ending'}")
    with Path(path).open("w") as out:
        out.writelines(f"{line}\n" for line in lines())


def summary_lines(overview: DataFrame) -> str:
    """Counts of a status overview as text."""
    r = overview.head()
    return f"{r['n_runs']} runs: {r['n_verified']} verified, {r['n_mismatch']} with changed files, {r['n_missing']} with missing files"
