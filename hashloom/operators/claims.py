"""Claims: verification, exit codes, resolved statuses and the flags of their chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hashloom.functions.codes import BUCKET_COLOURS, BUCKETS, EXIT_CODES, NAME_OF, STATUS_COLOURS, VERIFIED, classify_exit, lookup
from hashloom.functions.hashes import consistent, short_id
from hashloom.operators import lineage, verify


def source_sessions(claims: DataFrame, files: DataFrame) -> DataFrame:
    """Claims with ``session``: the recorded one, else the newest producer of the source file."""
    newest = lineage.newest_producers(files).select(F.col("file_path").alias("source_file"), F.col("session_id").alias("_made"))
    return claims.join(newest, "source_file", "left").withColumn("session", F.coalesce("source_session", "_made")).drop("_made")


def behind(members: DataFrame, runs: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """``behind`` (runs) and ``file_hashes`` of the sessions in ``members``: all that verdicts on the claims above them can depend on."""
    names = members.select("session_id")
    return {"behind": runs.join(names, "session_id", "left_semi"), "file_hashes": files.join(names, "session_id", "left_semi")}


def on_disk(disk: DataFrame, *paths: DataFrame) -> DataFrame:
    """The rows of ``disk`` at any of ``paths`` (one column each); a path that nobody asks for decides nothing."""
    asked = paths[0].toDF("file_path").distinct()
    for more in paths[1:]:
        asked = asked.union(more.toDF("file_path").distinct())
    return disk.join(asked.distinct(), "file_path", "left_semi")


def verify_claims(claims: DataFrame, disk: DataFrame, chains: DataFrame) -> DataFrame:
    """Claims with ``source_status``, ``chain_verified`` and ``new_status``.

    disk: current files, of which only loose ones count. chains: (file_path, status) of
    ``verify.verify_chains``. Without source file a claim keeps its status. Nothing is
    written: appending new_status is the caller's step.
    """
    loose = disk.where("exists").select(F.col("file_path").alias("source_file"), F.col("current_hash").alias("_now"))
    chain = chains.select(F.col("file_path").alias("source_file"), F.col("status").alias("_chain"))
    found = claims.join(loose, "source_file", "left").join(chain, "source_file", "left")
    source = (F.when(F.col("source_file").isNull(), F.lit(None)).when(F.col("_now").isNull(), "missing")
              .when(consistent(F.col("_now"), F.col("source_hash")), "verified").otherwise("mismatch"))
    whole = F.coalesce(F.col("_chain") == VERIFIED, F.lit(False))
    status = (F.when(F.col("source_status").isNull(), F.col("status")).when(F.col("source_status") != "verified", F.col("source_status"))
              .when(F.col("chain_verified"), "verified").otherwise("suspect"))
    return found.withColumn("source_status", source).withColumn("chain_verified", whole).withColumn("new_status", status).drop("_now", "_chain")


def claim_code(strict: bool = False) -> Column:
    """Exit code of a verified claim."""
    no_lineage = EXIT_CODES["NO_LINEAGE"] if strict else 0
    return (F.when(F.col("source_status").isNull(), 10).when(F.col("source_status") == "missing", 11).when(F.col("source_status") == "mismatch", 12)
            .when(~F.col("chain_verified"), no_lineage).otherwise(0))


def gate_claims(verified: DataFrame, severity: dict[int, str], strict: bool = False, gate_active: bool = False) -> tuple[DataFrame, DataFrame]:
    """(claims with ``code``, one-row exit): claims in force, those ungrounded failing where the gate is active.

    verified: ``verify_claims`` with ``grounded`` if the gate is active. No claim at all is NO_CLAIMS.
    """
    rows = verified.where("status <> 'superseded'").withColumn("code", claim_code(strict))
    if gate_active:
        rows = rows.withColumn("code", F.when((F.col("code") == 0) & ~F.coalesce(F.col("grounded"), F.lit(False)), EXIT_CODES["UNSOURCED"]).otherwise(F.col("code")))
    if rows.isEmpty():
        none = rows.sparkSession.createDataFrame([(EXIT_CODES["NO_CLAIMS"],)], "code int")
        return rows, classify_exit(none, severity)
    return rows, classify_exit(rows, severity)


def resolved_status(status: Column, grounded: Column, has_exception: Column, has_frozen: Column) -> Column:
    """What is shown of a claim; grounded null: the gate is off. The old name partial reads as suspect."""
    s = F.when(status == "partial", "suspect").otherwise(status)
    return (F.when(s.isin("mismatch", "missing"), s).when(~F.coalesce(grounded, F.lit(True)), "unsourced")
            .when((s == "verified") & has_exception, "exception").when((s == "verified") & has_frozen, "frozen")
            .when(s.isin("verified", "suspect"), s).otherwise("registered"))


def bucket(resolved: Column) -> Column:
    return F.coalesce(lookup(BUCKETS, resolved), resolved)


def colour(resolved: Column) -> Column:
    return lookup(STATUS_COLOURS, resolved, STATUS_COLOURS["registered"])


def bucket_colour(name: Column) -> Column:
    return lookup(BUCKET_COLOURS, name, STATUS_COLOURS["registered"])


def chain_flags(claims: DataFrame, chains: DataFrame, runs: DataFrame, files: DataFrame) -> DataFrame:
    """Claims (with ``session``) with has_exception and has_frozen: of any run, any file row in their chains."""
    odd = runs.where("provenance = 'exception'").select("session_id", F.lit(True).alias("x"), F.lit(False).alias("f"))
    cold = files.where("frozen").select("session_id", F.lit(False).alias("x"), F.lit(True).alias("f")).distinct()
    flags = chains.join(odd.union(cold), "session_id").groupBy(F.col("leaf").alias("session")).agg(
        F.bool_or("x").alias("has_exception"), F.bool_or("f").alias("has_frozen"))
    return claims.join(flags, "session", "left").fillna(False, ["has_exception", "has_frozen"])


def marked_flags(claims: DataFrame, marks: DataFrame) -> DataFrame:
    """``chain_flags`` from ``verify.chain_marks`` instead of the chains' members."""
    found = claims.join(marks.select(F.col("session_id").alias("session"), "marks"), "session", "left")
    return found.withColumn("has_exception", verify.marked("exception")).withColumn("has_frozen", verify.marked("frozen")).drop("marks")


def exceptional_ancestors(edges: DataFrame, runs: DataFrame, leaves: DataFrame, max_depth: int | None = 50) -> DataFrame:
    """(leaf, session_id) for ``exception_reasons``: each leaf and the exceptional runs of its chain.

    Walks down from the exceptional runs, so pairs are made for these alone.
    """
    odd = runs.where("provenance = 'exception'").select("session_id")
    turned = edges.select(F.col("parent").alias("child"), F.col("child").alias("parent"))
    down = lineage.closure(turned, odd, max_depth).select(F.col("session_id").alias("_at"), F.col("leaf").alias("session_id"))
    return down.join(leaves.select(F.col("session_id").alias("_at")).distinct(), "_at", "left_semi").select(F.col("_at").alias("leaf"), "session_id")


def exception_reasons(chains: DataFrame, runs: DataFrame) -> DataFrame:
    """(leaf, session_id, reason) of the exceptional runs in each chain."""
    odd = runs.where("provenance = 'exception'").select("session_id", F.coalesce(F.nullif(F.col("exception_reason"), F.lit("")), F.lit("no reason given")).alias("reason"))
    return chains.select("leaf", "session_id").join(odd, "session_id").select("leaf", "session_id", "reason")


def intermediate_payload(name: Column, text: Column, supports: Column) -> Column:
    """The JSON value of a registered intermediate result."""
    return F.to_json(F.struct(name.alias("name"), text.alias("value"), supports.alias("supports")))


def render_entries(resolved: DataFrame) -> DataFrame:
    """(id, kind, status, colour, link) of claims with ``resolved``: one row shape for all readers."""
    b = bucket(F.col("resolved"))
    return resolved.select(F.col("claim_id").alias("id"), F.when(F.col("claim_type") == "figure", "figure").otherwise("value").alias("kind"),
                           b.alias("status"), bucket_colour(b).alias("colour"), F.col("source_file").alias("link"))


# Severity of a claim's hint by its resolved status; verified and frozen claims have none.
HINTS = {"mismatch": "error", "missing": "error", "suspect": "warning", "registered": "warning", "unsourced": "advice", "exception": "advice"}
MESSAGES = {
    "mismatch": "the source's content is not what was recorded", "missing": "the source file is not there", "suspect": "the runs behind the source are not all verified",
    "registered": "not verified yet", "unsourced": "no trusted source is in the chain", "exception": "a run in the chain is a declared exception",
}


def hint_entries(resolved: DataFrame) -> DataFrame:
    """(id, kind, severity, message, location, claim_id) of claims that need attention, ordered by id; location: (file, line, page)."""
    kind = F.concat(F.lit("claim-"), F.col("resolved"))
    spot = F.struct(F.col("file_path").alias("file"), F.col("line_number").alias("line"), F.lit(None).cast("int").alias("page"))
    return resolved.where(~F.col("resolved").isin("verified", "frozen")).select(
        short_id("hint_", F.col("claim_id"), kind).alias("id"), kind.alias("kind"), lookup(HINTS, F.col("resolved"), "advice").alias("severity"),
        lookup(MESSAGES, F.col("resolved")).alias("message"), spot.alias("location"), "claim_id").orderBy("id")


def outcome_counts(gated: DataFrame) -> DataFrame:
    """(outcome, n): claims with ``code`` by the name of their exit code."""
    return gated.groupBy(lookup(NAME_OF, F.col("code")).alias("outcome")).agg(F.count("*").alias("n"))


def claims_dag(claims: DataFrame, edges: DataFrame, verified: DataFrame, file_path: str | None = None, claim_type: str | None = None) -> DataFrame:
    """``verify.verify_dag`` of the runs behind all claims in force (with ``session``), of one manuscript or type if given."""
    rows = claims.where("status <> 'superseded' and session is not null")
    for column, value in (("file_path", file_path), ("claim_type", claim_type)):
        rows = rows if value is None else rows.where(F.col(column) == value)
    members = lineage.reachable(edges, rows.select(F.col("session").alias("session_id")))
    return verify.verify_dag(edges, members, verified)


def attestation(resolved: DataFrame) -> DataFrame:
    """One row: counts of claims by bucket, unsourced and raw failures, and the badge."""
    b, s = bucket(F.col("resolved")), F.col("resolved")
    counts = resolved.agg(
        F.count("*").alias("total"), *[F.count_if(b == x).alias(f"n_{x}") for x in ("verified", "suspect", "failed", "exception")],
        F.count_if(s == "unsourced").alias("n_unsourced"), F.count_if(s == "mismatch").alias("n_mismatch"), F.count_if(s == "missing").alias("n_missing"))
    badge = F.when(F.col("n_failed") > 0, "failing").when(F.col("n_verified") == F.col("total"), "all_verified").otherwise("partial")
    return counts.withColumn("badge", badge)
