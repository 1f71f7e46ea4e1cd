"""Citations: derived statuses, verdicts on bibliography entries, links and hints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hashloom.functions.codes import EXIT_CODES, NAME_OF, classify_exit, lookup
from hashloom.functions.hashes import short_id

# Fixed value: what marks an entry that was generated for want of metadata.
STUB_NOTE = "Auto-generated stub"
#: A journal that stands for pending metadata, whichever service is awaited: deliberately wider than one service's name.
STUB_JOURNAL = r"Pending \S+ metadata lookup"


def filled(c: Column) -> Column:
    return F.coalesce(F.trim(c) != "", F.lit(False))


def derived_status(resolved: Column, is_stub: Column, doi: Column) -> Column:
    """stub, else verified if resolved and with a DOI, else unverified."""
    return F.when(F.coalesce(is_stub, F.lit(False)), "stub").when(F.coalesce(resolved, F.lit(False)) & filled(doi), "verified").otherwise("unverified")


def stub_reason(note: Column, journal: Column, doi: Column) -> Column:
    """Why an entry looks like a stub, null if it does not."""
    return F.when(F.contains(note, F.lit(STUB_NOTE)), "note").when(journal.rlike(STUB_JOURNAL), "journal").when(~filled(doi), "no_doi")


def link(url: Column, doi: Column) -> Column:
    return F.when(filled(url), F.trim(url)).when(filled(doi), F.concat(F.lit("https://doi.org/"), F.trim(doi)))


def coerce_entries(rows: DataFrame) -> DataFrame:
    """(seq, key, doi, journal, note, title, author, year) of rows (seq, entry): an entry is a bare key or a JSON object with ``key``.

    An object without a key, or with an empty one, is an error when rows are read.
    """
    fields = ("key", "doi", "journal", "note", "title", "author", "year")
    parsed = F.from_json("entry", ", ".join(f"{f} string" for f in fields))
    whole = F.when(F.col("entry").startswith("{"), parsed).otherwise(F.struct(F.col("entry").alias("key"), *[F.lit(None).cast("string").alias(f) for f in fields[1:]]))
    key = F.when(F.coalesce(F.col("e.key"), F.lit("")) == "", F.raise_error(F.concat(F.lit("citation entry without key: "), F.col("entry")))).otherwise(F.col("e.key"))
    return rows.select("seq", "entry", whole.alias("e")).select("seq", key.alias("key"), *[F.col(f"e.{f}") for f in fields[1:]])


def verify_citations(entries: DataFrame, citations: DataFrame) -> DataFrame:
    """(cite_key, status, code, reason, link) of each bibliography entry; of repeated keys the last counts.

    entries: (seq, key, doi, journal, note, title, author, year); only seq and key need
    be filled. citations: recorded ones by cite_key.
    """
    last = Window.partitionBy("key").orderBy(F.desc("seq"))
    e = entries.withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k", "seq")
    rec = citations.select("cite_key", F.col("status").alias("_s"), F.col("doi").alias("_d"), F.col("url").alias("_u"))
    x = e.join(rec, F.col("key") == F.col("cite_key"), "left")
    known = F.col("cite_key").isNotNull()
    drift = filled(F.col("doi")) & filled(F.col("_d")) & (F.lower(F.trim("doi")) != F.lower(F.trim("_d")))
    bare = ~(filled(F.col("doi")) | filled(F.col("journal")) | filled(F.col("note")) | filled(F.col("title")) | filled(F.col("author")) | filled(F.col("year")))
    guess = stub_reason(F.col("note"), F.col("journal"), F.col("doi"))
    say = lambda status, code, reason: F.struct(F.lit(status).alias("status"), F.lit(code).alias("code"), reason.alias("reason"))
    recorded = F.lit("recorded")
    verdict = (
        F.when(known & drift, say("unverified", 12, F.lit("doi_drift"))).when(known & (F.col("_s") == "verified"), say("verified", 0, recorded))
        .when(known & (F.col("_s") == "stub"), say("stub", 14, recorded)).when(known, say("unverified", 15, recorded))
        .when(bare, say("unknown", 16, F.lit("unlinked"))).when(guess.isNotNull(), say("stub", 14, guess)).otherwise(say("unverified", 15, F.lit("no_record"))))
    return x.withColumn("v", verdict).select(F.col("key").alias("cite_key"), "v.status", "v.code", "v.reason", F.when(known, link(F.col("_u"), F.col("_d"))).otherwise(link(F.lit(None), F.col("doi"))).alias("link"))


def citations_exit(verdicts: DataFrame, severity: dict[int, str]) -> DataFrame:
    """One-row exit of all verdicts; no entry at all is NO_CLAIMS."""
    if verdicts.isEmpty():
        verdicts = verdicts.sparkSession.createDataFrame([(EXIT_CODES["NO_CLAIMS"],)], "code int")
    return classify_exit(verdicts, severity)


def bucket(status: Column) -> Column:
    return F.when(status == "verified", "verified").when(status == "unverified", "suspect").otherwise("failed")


def render_entries(citations: DataFrame) -> DataFrame:
    """(id, kind, status, link): the row shape that claims have too."""
    return citations.select(F.col("cite_key").alias("id"), F.lit("citation").alias("kind"), bucket(F.col("status")).alias("status"), link(F.col("url"), F.col("doi")).alias("link"))


def hint_severity(status: Column) -> Column:
    """Null for verified citations, which get no hint."""
    return F.when(status.isin("stub", "unverified"), "warning").when(status != "verified", "advice")


MESSAGES = {"stub": "the citation is a placeholder without confirmed metadata", "unverified": "the citation's metadata is not confirmed", "unknown": "the key has no bibliographic entry"}


def hint_entries(citations: DataFrame) -> DataFrame:
    """(id, kind, severity, message, location, claim_id) of citations that need attention: the shape that claims' hints have.

    location is where the manuscript cites, if that is recorded; claim_id is the citation's
    key. A status that is not known gets advice.
    """
    at = lambda c, kind: (F.col(c) if c in citations.columns else F.lit(None)).cast(kind)
    kind = F.concat(F.lit("citation-"), "status")
    spot = F.struct(at("manuscript_file", "string").alias("file"), at("line_number", "int").alias("line"), F.lit(None).cast("int").alias("page"))
    return citations.where(hint_severity(F.col("status")).isNotNull()).select(
        short_id("hint_", F.col("cite_key"), kind).alias("id"), kind.alias("kind"), hint_severity(F.col("status")).alias("severity"),
        lookup(MESSAGES, F.col("status"), "the citation's status is not known here").alias("message"), spot.alias("location"), F.col("cite_key").alias("claim_id"))


def outcome_counts(verdicts: DataFrame) -> DataFrame:
    """(outcome, n): verdicts by the name of their exit code."""
    return verdicts.groupBy(lookup(NAME_OF, F.col("code")).alias("outcome")).agg(F.count("*").alias("n"))
