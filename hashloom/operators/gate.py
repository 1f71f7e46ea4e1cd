"""The source gate: trusted anchors, grounded claims, complete submissions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashloom.functions.codes import lookup
from hashloom.functions.hashes import consistent
from hashloom.operators import lookups


def manifest_entries(sources: DataFrame, disk: DataFrame) -> DataFrame:
    """Manifest rows (ord, file_path, sha256) with ``reason`` OK, MISSING or TAMPERED and ``valid``."""
    x = sources.join(disk.where("exists").select("file_path", F.col("current_hash").alias("_now")), "file_path", "left")
    reason = F.when(F.col("_now").isNull(), "MISSING").when(F.lower("_now") == F.lower("sha256"), "OK").otherwise("TAMPERED")
    return x.withColumn("reason", reason).withColumn("valid", F.col("reason") == "OK").drop("_now")


def manifest_state(entries: DataFrame, enforced: bool = False, signature_valid: bool = False) -> dict[str, bool]:
    """trusted and active: an enforced manifest needs a valid signature, others are active with one valid entry."""
    any_valid = bool(entries.agg(F.bool_or("valid")).head()[0])
    return {"trusted": not enforced or signature_valid, "active": enforced or any_valid}


def candidates(claims: DataFrame, chains: DataFrame, files: DataFrame) -> DataFrame:
    """(claim_id, ord, file_path, hash): a claim's source, then all files of the runs in its chain, each pair once."""
    own = claims.where("source_file is not null").select("claim_id", F.lit(0).alias("ord"), F.col("source_file").alias("file_path"), F.col("source_hash").alias("hash"))
    rows = files.select("session_id", "file_path", "hash").distinct()
    up = claims.select("claim_id", F.col("session").alias("leaf")).join(chains.select("leaf", "session_id"), "leaf").join(rows, "session_id").select(
        "claim_id", F.lit(1).alias("ord"), "file_path", "hash")
    return own.union(up).groupBy("claim_id", "file_path", "hash").agg(F.min("ord").alias("ord"))


def matches(found: DataFrame, anchors: DataFrame) -> DataFrame:
    """(claim_id, file_path, sha256): each claim's first match, in order of candidates, then of the manifest.

    An equi join on the path; hashes are compared over the shorter length, without regard to case.
    """
    x = found.join(anchors.select("file_path", "sha256", F.col("ord").alias("entry")), "file_path").where(consistent(F.col("hash"), F.col("sha256"), fold_case=True))
    return x.groupBy("claim_id").agg(F.min_by(F.struct("file_path", "sha256"), F.struct("ord", "file_path", "hash", "entry")).alias("m")).select("claim_id", "m.*")


def anchored_sessions(files: DataFrame, anchors: DataFrame) -> DataFrame:
    """(session_id, anchor) of sessions with trusted files: the least of (file_path, hash, entry, sha256)."""
    rows = files.select("session_id", "file_path", "hash").distinct().join(anchors.select("file_path", "sha256", F.col("ord").alias("entry")), "file_path")
    met = rows.where(consistent(F.col("hash"), F.col("sha256"), fold_case=True))
    return met.groupBy("session_id").agg(F.min(F.struct("file_path", "hash", "entry", "sha256")).alias("anchor"))


def marked_matches(claims: DataFrame, marks: DataFrame, anchors: DataFrame) -> DataFrame:
    """``matches`` of claims (with ``session``) from the anchors that ``verify.chain_marks`` brought to their sessions."""
    own = matches(claims.where("source_file is not null").select("claim_id", F.col("source_file").alias("file_path"), F.col("source_hash").alias("hash"), F.lit(0).alias("ord")), anchors)
    up = claims.select("claim_id", F.col("session").alias("session_id")).join(marks.where("anchor is not null"), "session_id").groupBy("claim_id").agg(F.min("anchor").alias("m"))
    first = own.select("claim_id", F.struct("file_path", "sha256").alias("o"))
    best = up.join(first, "claim_id", "full").select("claim_id", F.coalesce("o", F.struct("m.file_path", "m.sha256")).alias("m"))
    return best.select("claim_id", "m.file_path", "m.sha256")


def grounded(claims: DataFrame, chains: DataFrame | None, files: DataFrame, entries: DataFrame | None, enforced: bool = False, signature_valid: bool = False,
             marks: DataFrame | None = None) -> DataFrame:
    """Claims (with ``session``) with ``grounded``, ``ground_reason`` and ``matched``.

    No manifest, or one without valid entries: all are grounded. An untrusted one: none is.
    Matches come from the members of chains (closure rows) or, without pairs, from ``marks``
    with the valid entries' ``anchored_sessions``.
    """
    if entries is None:
        return claims.withColumn("grounded", F.lit(True)).withColumn("ground_reason", F.lit("no_manifest")).withColumn("matched", F.lit(None).cast("string"))
    state = manifest_state(entries, enforced, signature_valid)
    if not state["trusted"]:
        return claims.withColumn("grounded", F.lit(False)).withColumn("ground_reason", F.lit("manifest_untrusted")).withColumn("matched", F.lit(None).cast("string"))
    anchors = entries.where("valid")
    if anchors.isEmpty():
        return claims.withColumn("grounded", F.lit(True)).withColumn("ground_reason", F.lit("grounded")).withColumn("matched", F.lit(None).cast("string"))
    found = matches(candidates(claims, chains, files), anchors) if marks is None else marked_matches(claims, marks, anchors)
    met = found.select("claim_id", F.col("file_path").alias("matched"))
    return claims.join(met, "claim_id", "left").withColumn("grounded", F.col("matched").isNotNull()).withColumn(
        "ground_reason", F.when(F.col("matched").isNotNull(), "grounded").otherwise("no_chain_match"))


#: What to do about a verdict, by its reason.
FIXES = {
    "claim_not_found": "register the claim", "no_manifest": "write a manifest of trusted sources", "manifest_untrusted": "sign the manifest again",
    "no_chain_match": "register a source of the claim's chain, or derive the claim from one", "grounded": "",
}


def grounding_verdicts(wanted: DataFrame, gated: DataFrame, entries: DataFrame | None) -> DataFrame:
    """(identifier, claim_id, grounded, reason, matched, sha256, fix) of claim ids, places or paths; gated: ``grounded`` claims."""
    found = wanted.select("identifier").distinct().join(lookups.resolve_claims(gated, wanted), "identifier", "left")
    own = gated.select("claim_id", "grounded", "ground_reason", "matched").dropDuplicates(["claim_id"])
    x = found.join(own, "claim_id", "left").withColumn("reason", F.coalesce("ground_reason", F.lit("claim_not_found")))
    if entries is None:
        x = x.withColumn("sha256", F.lit(None).cast("string"))
    else:
        x = x.join(entries.where("valid").groupBy(F.col("file_path").alias("matched")).agg(F.min_by("sha256", "ord").alias("sha256")), "matched", "left")
    return x.select("identifier", F.coalesce("claim_id", "identifier").alias("claim_id"), F.coalesce("grounded", F.lit(False)).alias("grounded"), "reason", "matched", "sha256",
                    lookup(FIXES, F.col("reason")).alias("fix"))


def grounded_ids(claims: DataFrame, gate_active: bool = True) -> DataFrame:
    """Ids of verified claims that are grounded (all verified ones where the gate is off), sorted."""
    rows = claims.where("status = 'verified'")
    return (rows.where("grounded") if gate_active else rows).select("claim_id").distinct().orderBy("claim_id")


def submission_problems(submission: DataFrame, ids: DataFrame) -> DataFrame:
    """(problem, claim_id, questions): missing and orphan claims, and claims that several questions cite. Empty: complete.

    submission: (question_id, claim_id).
    """
    none = F.array().cast("array<string>")
    missing = submission.join(ids, "claim_id", "left_anti").groupBy("claim_id").agg(F.array_sort(F.collect_list("question_id")).alias("questions")).select(F.lit("missing").alias("problem"), "claim_id", "questions")
    orphan = ids.select("claim_id").distinct().join(submission, "claim_id", "left_anti").select(F.lit("orphan").alias("problem"), "claim_id", none.alias("questions"))
    twice = submission.groupBy("claim_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("question_id")).alias("questions")).where("n > 1").select(
        F.lit("duplicate").alias("problem"), "claim_id", "questions")
    return missing.union(orphan).union(twice)


def assert_complete(submission: DataFrame, ids: DataFrame) -> None:
    found = submission_problems(submission, ids).groupBy("problem").count().collect()
    if found:
        raise ValueError("incomplete submission: " + ", ".join(sorted(f"{r['count']} {r['problem']}" for r in found)))


def pre_submission(claims: DataFrame, runs: DataFrame, gate_active: bool) -> DataFrame:
    """(finding, claim_id): no runs, claims whose value fails, and ungrounded ones among the rest. Empty: passed.

    claims: gated ones with ``code`` (not strict) and ``grounded``.
    """
    value = F.when(F.col("code").isin(10, 11, 12), F.element_at(F.create_map(*[F.lit(x) for x in (10, "unverified", 11, "source_missing", 12, "hash_mismatch")]), F.col("code")))
    reason = F.coalesce(value, F.when(F.lit(gate_active) & ~F.coalesce(F.col("grounded"), F.lit(False)), "ungrounded"))
    out = claims.where("status <> 'superseded'").select(reason.alias("finding"), "claim_id").where("finding is not null")
    if runs.isEmpty():
        out = out.union(runs.sparkSession.createDataFrame([("no_runs", None)], "finding string, claim_id string"))
    return out
