"""Registered queries of point lookups, listings, verdicts and orders, each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import functions as F

from hashloom.functions import codes, hashes
from hashloom.operators import citations, claims, estimate, gate, groupers, lineage, lookups, verify
from hashloom.plans import exports
from hashloom.plans.queries import (
    _ALL_LEAVES, _ANCHORS, _CHECKED, _CLAIM_TABLES, _CLAIMS, _CLOSURE, _EDGES, _MEMBERS, _RANKS, _all_leaves, _checked, _claims, _edges, _verified, query)
from hashloom.plans.scratch import materialize
from hashloom.plans.testbed import load

RUN = "S0000000001"

# --- point lookups ----------------------------------------------------------


@query(f"select session_id, script_path, status, exit_code from runs where session_id = '{RUN}'", "runs")
def get_run(spark, sf_dir):
    return lookups.get_run(load(spark, sf_dir, "runs")["runs"], RUN).select("session_id", "script_path", "status", "exit_code")


@query(f"select file_path, max_by(hash, role) as hash from file_hashes where session_id = '{RUN}' group by 1", "file_hashes")
def run_files(spark, sf_dir):
    files = load(spark, sf_dir, "file_hashes")["file_hashes"].withColumn("seq", F.col("role"))  # outputs are recorded after inputs
    return lookups.run_files(files, RUN)


@query("select distinct file_path from file_hashes where frozen and session_id = (select min(session_id) from file_hashes where frozen)", "file_hashes")
def frozen_files(spark, sf_dir):
    files = load(spark, sf_dir, "file_hashes")["file_hashes"]
    return lookups.frozen_files(files, files.where("frozen").agg(F.min("session_id")).head()[0])


@query("""select session_id, max(recorded_at) as at from file_hashes where role = 'input' and file_path = (select min(file_path) from file_hashes where role = 'input') group by 1""", "file_hashes")
def sessions_by_file(spark, sf_dir):
    files = load(spark, sf_dir, "file_hashes")["file_hashes"]
    return lookups.sessions_by_file(files, files.where("role = 'input'").agg(F.min("file_path")).head()[0], "input")


@query("select session_id, max(recorded_at) as at from file_hashes where hash = (select min(hash) from file_hashes) group by 1", "file_hashes")
def sessions_by_hash(spark, sf_dir):
    files = load(spark, sf_dir, "file_hashes")["file_hashes"]
    return lookups.sessions_by_hash(files, files.agg(F.min("hash")).head()[0])


@query("select distinct host from contents where host is not null and hash = (select hash from contents group by 1 order by count(*) desc, hash limit 1)", "contents")
def hosts_for_hash(spark, sf_dir):
    rows = load(spark, sf_dir, "contents")["contents"]
    return lookups.hosts_for_hash(rows, rows.groupBy("hash").count().orderBy(F.desc("count"), "hash").head()["hash"])


@query(f"select session_id, started_at from runs where parent_session = '{RUN}'", "runs")
def children(spark, sf_dir):
    return lookups.children(load(spark, sf_dir, "runs")["runs"], RUN).select("session_id", "started_at")


#: Parents that are listed beside the runs: failed runs name the run of half their number.
_LISTED = """select session_id, 'S' || lpad(cast(cast(floor(cast(substr(session_id, 2) as bigint) / 2) as bigint) as {text}), 10, '0') as parent_session, started_at as recorded_at
             from {runs} where status = 'failed'"""


def _listed(spark, runs):
    return spark.sql(_LISTED.replace("{text}", "string"), runs=runs)


_LISTED_SQL = f"listed as ({_LISTED.replace('{text}', 'varchar').replace('{runs}', 'runs')})"


@query(f"with {_LISTED_SQL} select parent_session, recorded_at from listed where session_id = (select max(session_id) from listed)", "runs")
def parents(spark, sf_dir):
    listed = _listed(spark, load(spark, sf_dir, "runs")["runs"])
    return lookups.parents(listed, listed.agg(F.max("session_id")).head()[0]).select("parent_session", "recorded_at")


@query("select cast(n_nationkey as bigint) as seq, 'stamp_' || lower(n_name) as stamp_id from nation order by n_nationkey desc limit 20")
def list_stamps(spark, sf_dir):
    stamps = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("seq"), F.concat(F.lit("stamp_"), F.lower("n_name")).alias("stamp_id"))
    return lookups.list_stamps(stamps, 20)


@query("select cite_key, status, doi from citations where status = 'stub' order by cite_key limit 1000", "citations")
def list_citations(spark, sf_dir):
    return lookups.list_citations(load(spark, sf_dir, "citations")["citations"], status="stub").select("cite_key", "status", "doi")


@query("select cite_key, status, doi, url from citations where cite_key = (select max(cite_key) from citations)", "citations")
def lookup_citation(spark, sf_dir):
    rows = load(spark, sf_dir, "citations")["citations"]
    return lookups.lookup_citation(rows, rows.agg(F.max("cite_key")).head()[0]).select("cite_key", "status", "doi", "url")


@query("select session_id, started_at, finished_at from runs where finished_at is not null and script_hash = (select min(script_hash) from runs)", "runs")
def completed_runs(spark, sf_dir):
    runs = load(spark, sf_dir, "runs")["runs"]
    return lookups.completed_runs(runs, script_hash=runs.agg(F.min("script_hash")).head()[0]).select("session_id", "started_at", "finished_at")


# --- lineage ----------------------------------------------------------------

@query(f"""with {_LISTED_SQL}, edges as (select session_id as child, parent_session as parent from listed where session_id <> parent_session
            union select session_id, parent_session from runs where parent_session is not null and session_id <> parent_session and session_id not in (select session_id from listed)),
          closed as (select session_id as leaf, session_id, 0 as depth from runs union select c.leaf, e.parent, c.depth + 1 from closed c join edges e on e.child = c.session_id)
          select leaf, session_id, cast(min(depth) as int) as depth from closed group by 1, 2""", "runs", recursive=True)
def recorded_closure(spark, sf_dir):
    runs = load(spark, sf_dir, "runs")["runs"]
    return lineage.closure(materialize(lineage.recorded_edges(runs, _listed(spark, runs)), "recorded"), runs, None, children=True)


_WALK = f"""{_EDGES}, walk as (select child as session_id, 0 as level from edges union select parent, 0 from edges
            union select e.child, w.level + 1 from walk w join edges e on e.parent = w.session_id),
          placed as (select session_id, max(level) as level from walk group by 1)"""


def _with_cycle(spark, sf_dir):
    """(edges, nodes) of the whole ledger, and of two sessions that read from each other."""
    edges = _edges(load(spark, sf_dir, "file_hashes")).union(spark.createDataFrame([("X1", "X2"), ("X2", "X1")], "child string, parent string"))
    return edges, edges.select(F.col("child").alias("session_id")).union(edges.select("parent"))


@query(f"with {_WALK} select session_id, cast(level as int) as level from placed union all select * from (values ('X1', -1), ('X2', -1))", "file_hashes", recursive=True)
def roots_first(spark, sf_dir):
    return lineage.roots_first(*_with_cycle(spark, sf_dir)).withColumn("level", F.coalesce("level", F.lit(-1)))


@query(f"""with {_WALK}, every as (select session_id, level from placed union all select x, (select max(level) + 1 from placed) from (values ('X1'), ('X2')) v(x)),
          turned as (select *, row_number() over (partition by level order by session_id) - 1 - (count(*) over (partition by level) - 1) / 2 as spot from every)
          select session_id, cast(level as int) as level, level * 3.0::double as x, round(-spot * 1.6::double, 6) as y from turned""", "file_hashes", recursive=True)
def layered_layout(spark, sf_dir):
    return lineage.layout(*_with_cycle(spark, sf_dir)).withColumn("y", F.round("y", 6))


_FRESH = """fresh as (select r.session_id, coalesce(x.fresh, false) as fresh from runs r left join (
              select p.session_id, bool_and(coalesce(d."exists", false) and coalesce(d.current_hash = p.hash, false)) and bool_or(p.role = 'script') as fresh
              from (select session_id, file_path, hash, role from file_hashes where role = 'input' union all select session_id, script_path, script_hash, 'script' from runs) p
              left join disk d on d.file_path = p.file_path group by 1) x on x.session_id = r.session_id)"""


@query(f"""with {_EDGES}, {_ALL_LEAVES}, reach as (select session_id from leaves union select e.parent from reach r join edges e on e.child = r.session_id),
          inside as (select child, parent from edges where child in (select session_id from reach) and parent in (select session_id from reach)),
          walk as (select session_id, 0 as level from reach union select e.child, w.level + 1 from walk w join inside e on e.parent = w.session_id), {_FRESH}
          select w.session_id, cast(w.level as int) as level, coalesce(f.fresh, false) as fresh, case when coalesce(f.fresh, false) then 'skip' else 'run' end as action
          from (select session_id, max(level) as level from walk group by 1) w left join fresh f on f.session_id = w.session_id""", "runs", "file_hashes", "disk", "newest", recursive=True)
def rerun_plan(spark, sf_dir):
    t = load(spark, sf_dir, "runs", "file_hashes", "disk")
    edges = _edges(t)
    return verify.rerun_plan(edges, lineage.reachable(edges, _all_leaves(t)), verify.fresh_runs(t["runs"], t["file_hashes"], t["disk"]), skip_unchanged=True)


@query(f"""with {_CHECKED}, {_verified('v', 'suspect')} select session_id, case status when 'verified' then 0 when 'mismatch' then 12 when 'missing' then 11 else 10 end as code from v""",
       "file_hashes", "runs", "disk")
def run_exit_codes(spark, sf_dir):
    t = load(spark, sf_dir, "runs", "file_hashes", "disk")
    return verify.verify_runs(t["runs"], t["file_hashes"], t["disk"]).select("session_id", codes.run_exit_code(F.col("status")).alias("code"))


@query(f"""with {_EDGES}, {_ALL_LEAVES}, reach as (select session_id from leaves union select e.parent from reach r join edges e on e.child = r.session_id),
          inside as (select child, parent from edges where child in (select session_id from reach) and parent in (select session_id from reach)),
          walk as (select session_id, 0 as level from reach union select e.child, w.level + 1 from walk w join inside e on e.parent = w.session_id),
          placed as (select session_id, max(level) as level from walk group by 1), {_CHECKED},
          bad as (select p.level, c.* from checked c join placed p on p.session_id = c.session_id where c.status in ('mismatch', 'missing')),
          a as (select file_path, session_id from bad order by level, session_id, role <> 'input', file_path limit 1),
          z as (select file_path, session_id from bad order by level desc, session_id desc, role = 'output' desc, file_path desc limit 1)
          select false as ok, a.file_path as root_cause, a.session_id as root_session, z.file_path as failed_node, z.session_id as failed_session from a, z""",
       "runs", "file_hashes", "disk", "newest", recursive=True)
def attribution(spark, sf_dir):
    t = load(spark, sf_dir, "runs", "file_hashes", "disk")
    edges = _edges(t)
    checked = _checked(t)
    dag = verify.verify_dag(edges, lineage.reachable(edges, _all_leaves(t)), verify.run_statuses(t["runs"], checked, propagate=False))
    return verify.attribution(dag, checked)


# --- claims -----------------------------------------------------------------

@query("""select claim_id, 'claim_' || substr(sha256(file_path || ':L' || cast(line_number as varchar) || ':' || claim_type || ':' || claim_value), 1, 12) as made from claims""", "claims")
def claim_ids(spark, sf_dir):
    c = load(spark, sf_dir, "claims")["claims"]
    return c.select("claim_id", hashes.claim_id(F.col("file_path"), F.col("line_number"), F.col("claim_type"), F.col("claim_value")).alias("made"))


_RESOLVED = f"""{_CLAIMS}, flags as (select m.leaf, bool_or(r.provenance = 'exception') as x, bool_or(f.frozen) as f
             from members m join runs r on r.session_id = m.session_id left join (select session_id, bool_or(frozen) as frozen from file_hashes group by 1) f on f.session_id = m.session_id group by 1),
          resolved as (select v.*, case when new_status in ('mismatch', 'missing') then new_status when new_status = 'verified' and coalesce(x, false) then 'exception'
             when new_status = 'verified' and coalesce(f, false) then 'frozen' when new_status in ('verified', 'suspect') then new_status else 'registered' end as resolved
             from verdicts v left join flags g on g.leaf = v.session),
          shown as (select *, case when resolved in ('mismatch', 'missing') then 'failed' when resolved = 'registered' then 'suspect' when resolved = 'frozen' then 'verified' else resolved end as bucket from resolved)"""


def _resolved(spark, sf_dir):
    _, found, marks = _claims(spark, sf_dir)
    rows = claims.marked_flags(found.where("status <> 'superseded'"), marks)
    return rows.withColumn("resolved", claims.resolved_status(F.col("new_status"), F.lit(None).cast("boolean"), F.col("has_exception"), F.col("has_frozen")))


@query(f"""with {_RESOLVED} select claim_id as id, case when claim_type = 'figure' then 'figure' else 'value' end as kind, bucket as status,
            case bucket when 'verified' then '2da44e' when 'suspect' then 'd29922' when 'failed' then 'cf222e' when 'exception' then '8250df' end as colour, source_file as link from shown""",
       *_CLAIM_TABLES, recursive=True)
def claim_entries(spark, sf_dir):
    return claims.render_entries(_resolved(spark, sf_dir))


@query(f"""with {_RESOLVED} select 'hint_' || substr(sha256(claim_id || ':claim-' || resolved), 1, 12) as id, 'claim-' || resolved as kind,
            case when resolved in ('mismatch', 'missing') then 'error' when resolved in ('suspect', 'registered') then 'warning' else 'advice' end as severity,
            file_path as file, line_number as line, claim_id from shown where resolved not in ('verified', 'frozen')""", *_CLAIM_TABLES, recursive=True)
def claim_hints(spark, sf_dir):
    return claims.hint_entries(_resolved(spark, sf_dir)).select("id", "kind", "severity", "location.file", "location.line", "claim_id")


@query(f"""with {_RESOLVED} select count(*) as total, count(*) filter (bucket = 'verified') as n_verified, count(*) filter (bucket = 'suspect') as n_suspect,
            count(*) filter (bucket = 'failed') as n_failed, count(*) filter (bucket = 'exception') as n_exception, count(*) filter (resolved = 'mismatch') as n_mismatch,
            count(*) filter (resolved = 'missing') as n_missing,
            case when bool_or(bucket = 'failed') then 'failing' when bool_and(bucket = 'verified') then 'all_verified' else 'partial' end as badge from shown""", *_CLAIM_TABLES, recursive=True)
def attestation(spark, sf_dir):
    return claims.attestation(_resolved(spark, sf_dir)).drop("n_unsourced")


@query(f"""with {_CLAIMS} select m.leaf, m.session_id, coalesce(nullif(r.exception_reason, ''), 'no reason given') as reason
          from members m join runs r on r.session_id = m.session_id where r.provenance = 'exception'""", *_CLAIM_TABLES, recursive=True)
def exception_reasons(spark, sf_dir):
    t = load(spark, sf_dir, "claims", "runs", "file_hashes")
    leaves = claims.source_sessions(t["claims"], t["file_hashes"]).where("source_file is not null and session is not null").select(F.col("session").alias("session_id"))
    return claims.exception_reasons(claims.exceptional_ancestors(_edges(t), t["runs"], leaves), t["runs"])


@query(f"""with {_CLAIMS} select case code when 0 then 'OK' when 10 then 'UNVERIFIED' when 11 then 'SOURCE_MISSING' when 12 then 'HASH_MISMATCH' when 13 then 'NO_LINEAGE' end as outcome, count(*) as n
          from verdicts group by 1""", *_CLAIM_TABLES, recursive=True)
def claim_outcomes(spark, sf_dir):
    _, found, _ = _claims(spark, sf_dir)
    return claims.outcome_counts(claims.gate_claims(found, codes.resolve_severity(), strict=True)[0])


@query(f"""with {_EDGES}, sourced as (select distinct n.session_id from claims c join newest n on n.file_path = c.source_file where c.status <> 'superseded'),
          reach as (select session_id from sourced union select e.parent from reach r join edges e on e.child = r.session_id), {_CHECKED}, {_verified('v', None)},
          inside as (select child, parent from edges where child in (select session_id from reach) and parent in (select session_id from reach)),
          walk as (select session_id, 0 as level from reach union select e.child, w.level + 1 from walk w join inside e on e.parent = w.session_id),
          own as (select r.session_id, coalesce(v.status, 'unknown') as status from reach r left join v on v.session_id = r.session_id),
          hit as (select session_id from own where status <> 'verified' union select e.child from hit h join inside e on e.parent = h.session_id)
          select o.session_id, cast(w.level as int) as level, o.status, h.session_id is not null as failed
          from own o join (select session_id, max(level) as level from walk group by 1) w on w.session_id = o.session_id left join hit h on h.session_id = o.session_id""",
       *_CLAIM_TABLES, recursive=True)
def claims_dag(spark, sf_dir):
    t = load(spark, sf_dir, "claims", "runs", "file_hashes", "disk")
    verified = verify.verify_runs(t["runs"], t["file_hashes"], t["disk"], propagate=False)
    return claims.claims_dag(claims.source_sessions(t["claims"], t["file_hashes"]), _edges(t), verified)


def _gated(spark, sf_dir):
    t, found, marks = _claims(spark, sf_dir, gated=True)
    return t, materialize(gate.grounded(found, None, t["file_hashes"], t["entries"], marks=marks), "gated"), t["entries"]


@query(f"""with {_CLAIMS}, {_ANCHORS}, wanted as (select claim_id as identifier from claims union select file_path || ':L' || cast(line_number as varchar) from claims union select 'nobody'),
          named as (select w.identifier, c.claim_id from wanted w left join (select claim_id as name, claim_id from claims union all select file_path || ':L' || cast(line_number as varchar), claim_id from claims) c on c.name = w.identifier)
          select n.identifier, coalesce(n.claim_id, n.identifier) as claim_id, m.claim_id is not null as grounded,
            case when n.claim_id is null then 'claim_not_found' when m.claim_id is not null then 'grounded' else 'no_chain_match' end as reason
          from named n left join met m on m.claim_id = n.claim_id""",
       *_CLAIM_TABLES, "sources", recursive=True)
def grounding_verdicts(spark, sf_dir):
    t, gated, entries = _gated(spark, sf_dir)
    c = t["claims"]
    wanted = c.select(F.col("claim_id").alias("identifier")).union(c.select(F.expr("file_path || ':L' || line_number"))).union(spark.createDataFrame([("nobody",)], "identifier string"))
    return gate.grounding_verdicts(wanted, gated, entries).select("identifier", "claim_id", "grounded", "reason")


@query(f"""with {_CLAIMS}, {_ANCHORS} select distinct v.claim_id from verdicts v join met m on m.claim_id = v.claim_id where v.new_status = 'verified'""", *_CLAIM_TABLES, "sources", recursive=True)
def grounded_ids(spark, sf_dir):
    _, gated, _ = _gated(spark, sf_dir)
    return gate.grounded_ids(gated.where("status <> 'superseded'").withColumn("status", F.col("new_status")))


@query(f"""with {_CLAIMS}, {_ANCHORS} select case v.code when 10 then 'unverified' when 11 then 'source_missing' when 12 then 'hash_mismatch' else 'ungrounded' end as finding, v.claim_id
          from verdicts v left join met m on m.claim_id = v.claim_id where v.code in (10, 11, 12) or m.claim_id is null""", *_CLAIM_TABLES, "sources", recursive=True)
def pre_submission(spark, sf_dir):
    t, gated, _ = _gated(spark, sf_dir)
    return gate.pre_submission(gated.withColumn("code", claims.claim_code()), t["runs"], gate_active=True)


# --- citations --------------------------------------------------------------

@query("""select 'key' || cast(doc_id as varchar) as cite_key, case when toxic = 1 then 'stub' when quality = 1 and doc_id % 4 <> 0 then 'verified' else 'unverified' end as status from labels""")
def derived_statuses(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet")
    doi = F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("10.1/"), F.col("doc_id"))).otherwise(F.lit(" "))
    return rows.select(F.concat(F.lit("key"), F.col("doc_id")).alias("cite_key"), citations.derived_status(F.col("quality") == 1, F.col("toxic") == 1, doi).alias("status"))


@query("""select cite_key as id, 'citation' as kind, case status when 'verified' then 'verified' when 'unverified' then 'suspect' else 'failed' end as status,
            coalesce(url, 'https://doi.org/' || doi) as link, case when status in ('stub', 'unverified') then 'warning' end as severity from citations""", "citations")
def citation_entries(spark, sf_dir):
    rows = load(spark, sf_dir, "citations")["citations"]
    severity = rows.select(F.col("cite_key").alias("id"), citations.hint_severity(F.col("status")).alias("severity"))
    return citations.render_entries(rows).join(severity, "id")


_CITED = """e as (select * exclude (k) from (select *, row_number() over (partition by key order by seq desc) as k from entries) where k = 1),
          cited as (select case when c.cite_key is not null and trim(e.doi) <> '' and trim(c.doi) <> '' and lower(trim(e.doi)) <> lower(trim(c.doi)) then 12
              when c.cite_key is not null then case c.status when 'verified' then 0 when 'stub' then 14 else 15 end when coalesce(e.doi, e.journal, e.note, e.title) is null then 16
              when e.note like '%Auto-generated stub%' or e.journal like '%Pending % metadata lookup%' or e.doi is null then 14 else 15 end as code
            from e left join citations c on c.cite_key = e.key)"""


@query(f"""with {_CITED}, {_RANKS} select cast(coalesce((select c.code from cited c join ranks r on r.code = c.code where c.code <> 0 order by r.rank desc limit 1), 0) as int) as exit_code,
            (select string_agg(distinct cast(code as varchar), ',' order by cast(code as varchar)) from cited where code <> 0) as errors""", "entries", "citations")
def citations_exit(spark, sf_dir):
    t = load(spark, sf_dir, "entries", "citations")
    out = citations.citations_exit(materialize(citations.verify_citations(t["entries"], t["citations"]), "verdicts"), codes.resolve_severity())
    return out.select("exit_code", F.concat_ws(",", F.col("errors").cast("array<string>")).alias("errors"))


@query(f"""with {_CITED} select case code when 0 then 'OK' when 12 then 'HASH_MISMATCH' when 14 then 'CITATION_STUB' when 15 then 'CITATION_UNRESOLVED' when 16 then 'CITATION_UNLINKED' end as outcome,
            count(*) as n from cited group by 1""", "entries", "citations")
def citation_outcomes(spark, sf_dir):
    t = load(spark, sf_dir, "entries", "citations")
    return citations.outcome_counts(citations.verify_citations(t["entries"], t["citations"]))


@query("select seq, key, case when seq % 2 = 0 then doi end as doi, case when seq % 2 = 0 then journal end as journal from entries", "entries")
def coerced_entries(spark, sf_dir):
    rows = load(spark, sf_dir, "entries")["entries"]
    given = F.when(F.col("seq") % 2 == 0, F.to_json(F.struct("key", "doi", "journal", "note"))).otherwise(F.col("key"))
    return citations.coerce_entries(rows.select("seq", given.alias("entry"))).select("seq", "key", "doi", "journal")


# --- groupers, estimates ----------------------------------------------------

@query("select session_id, role, 'single:' || file_path as group_id, split_part(file_path, '/', -1) as label, hash as root_hash from contents", "contents")
def lone_files(spark, sf_dir):
    return groupers.groups(groupers.identity()(groupers.start(load(spark, sf_dir, "contents")["contents"]))).select("session_id", "role", "group_id", "label", "root_hash")


@query("""with a as (select session_id, role, file_path, regexp_replace(file_path, '/[^/]*$', '') as folder from contents),
          b as (select *, count(*) over (partition by session_id, role, folder) as n from a),
          c as (select *, case when n < 10 then count(*) filter (n < 10) over (partition by session_id, role) end as rest from b)
          select session_id, role, case when n >= 10 then 'directory:' || folder when rest > 3 then 'session_bundle:' || role else 'single:' || file_path end as group_id, count(*) as size
          from c group by 1, 2, 3""", "contents")
def auto_groups(spark, sf_dir):
    return groupers.groups(groupers.resolve(None)(groupers.start(load(spark, sf_dir, "contents")["contents"]))).select("session_id", "role", "group_id", "size")


@query("""with v as (select session_id, count(*) as n_outputs from file_hashes where role = 'output' group by 1),
          d as (select r.*, cast(date_diff('second', started_at, finished_at) as double) as dur, coalesce(v.n_outputs, 0) as n_outputs from runs r left join v on v.session_id = r.session_id where finished_at is not null),
          h as (select script_hash, count(*) as n, quantile_cont(dur, 0.5) as p50, quantile_cont(dur, 0.9) as p90, avg(case when status = 'success' or exit_code = 0 then 1.0 else 0.0 end) as rate from d group by 1),
          p as (select script_path, count(*) as n, quantile_cont(dur, 0.5) as p50, quantile_cont(dur, 0.9) as p90, avg(case when status = 'success' or exit_code = 0 then 1.0 else 0.0 end) as rate from d group by 1),
          w as (select script_path, max(script_hash) as script_hash from runs group by 1 union all select script_path, 'edited' from runs group by 1 union all select '/new.py', 'new')
          select w.script_path, w.script_hash, case when h.n is not null then 'exact_hash' when p.n is not null then 'path_history' else 'unknown' end as tier, coalesce(h.n, p.n, 0) as n,
            round_even(coalesce(h.p50, p.p50), 1) as p50, round_even(coalesce(h.p90, p.p90), 1) as p90, round_even(coalesce(h.rate, p.rate), 3) as success_rate,
            coalesce(coalesce(h.p90, p.p90) > 300, false) as heavy
          from w left join h on h.script_hash = w.script_hash left join p on p.script_path = w.script_path""", "runs", "file_hashes")
def script_estimates(spark, sf_dir):
    t = load(spark, sf_dir, "runs", "file_hashes")
    known = t["runs"].groupBy("script_path").agg(F.max("script_hash").alias("script_hash"))
    wanted = known.union(known.select("script_path", F.lit("edited"))).union(spark.createDataFrame([("/new.py", "new")], known.schema))
    return estimate.estimates(wanted, t["runs"], t["file_hashes"]).drop("typical_outputs", "typical_bytes")


# --- hints, contracted graphs, re-runs ---------------------------------------

def _told(table: dict[str, str], column: str, default: str) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then '{v.replace(chr(39), chr(39) * 2)}'" for k, v in table.items()) + f" else '{default}' end"


@query(f"""with {_RESOLVED} select 'hint_' || substr(sha256(claim_id || ':claim-' || resolved), 1, 12) as id, 'claim-' || resolved as kind,
            case when resolved in ('mismatch', 'missing') then 'error' when resolved in ('suspect', 'registered') then 'warning' else 'advice' end as severity,
            {_told(claims.MESSAGES, 'resolved', '')} as message, file_path as file, line_number as line, claim_id from shown where resolved not in ('verified', 'frozen')
          union all select 'hint_' || substr(sha256(cite_key || ':citation-' || status), 1, 12), 'citation-' || status, 'warning', {_told(citations.MESSAGES, 'status', '')}, null, null, cite_key
            from citations where status <> 'verified'""", *_CLAIM_TABLES, "citations", recursive=True)
def manuscript_hints(spark, sf_dir):
    found = exports.hint_rows(_resolved(spark, sf_dir), load(spark, sf_dir, "citations")["citations"])
    return found.select("id", "kind", "severity", "message", "location.file", "location.line", "claim_id")


_GRAPH = f"""{_CHECKED}, rows as (select session_id, role, file_path, hash from file_hashes),
          states as (select c.session_id, c.role, c.file_path, r.hash, c.status, split_part(c.file_path, '/', -1) as base, regexp_replace(split_part(c.file_path, '/', -1), '[0-9]+', '{{X}}', 'g') as norm
            from checked c join rows r on r.session_id = c.session_id and r.role = c.role and r.file_path = c.file_path where c.role <> 'script'),
          sized as (select *, case when norm <> base then count(*) over (partition by session_id, role, norm) else 0 end as n from states),
          met as (select session_id, role, case when n >= 2 then string_agg(file_path || '=' || hash, ',' order by file_path) else min(file_path) end as id,
              case when n >= 2 then any_value(norm) || ' (×' || cast(n as varchar) || ')' else any_value(base) end as label, count(*) as size, min(file_path) as first_path,
              bool_and(status = 'verified') as good from sized group by session_id, role, n, case when n >= 2 then norm else file_path end)"""


def _contracted(spark, sf_dir):
    t = load(spark, sf_dir, "runs", "file_hashes", "disk")
    checked = verify.checked(t["runs"], t["file_hashes"], t["disk"])
    scripts = t["runs"].select(F.col("session_id").alias("id"), F.lit("script").alias("kind"), F.col("script_path").alias("label"), F.lit("verified").alias("status"), "session_id")
    return exports.grouped_graph(scripts, checked, {"type": "pattern", "regex": "[0-9]+"})


@query(f"""with {_GRAPH} select any_value(label) as label, case when min(role) = max(role) then min(role) else 'mixed' end as kind, max(size) as size, min(first_path) as first_path,
             case when bool_and(good) then 'verified' else 'failed' end as status from met group by id""", "file_hashes", "runs", "disk")
def grouped_nodes(spark, sf_dir):
    return _contracted(spark, sf_dir)[0].where("kind <> 'script'").select("label", "kind", "size", "first_path", "status")


@query(f"""with {_GRAPH} select m.session_id, m.role, min(first_path) as first_path, sum(size)::bigint as n from met m group by m.session_id, m.role, m.id""", "file_hashes", "runs", "disk")
def grouped_edges(spark, sf_dir):
    nodes, edges = _contracted(spark, sf_dir)
    files = nodes.where("kind <> 'script'").select("id", "first_path")
    reads = edges.join(files, edges["source"] == files["id"]).select(F.col("target").alias("session_id"), F.lit("input").alias("role"), "first_path", "n")
    return reads.union(edges.join(files, edges["target"] == files["id"]).select("source", F.lit("output"), "first_path", "n"))


@query(f"""with {_EDGES}, {_ALL_LEAVES}, reach as (select session_id from leaves union select e.parent from reach r join edges e on e.child = r.session_id),
          inside as (select child, parent from edges where child in (select session_id from reach) and parent in (select session_id from reach)),
          walk as (select session_id, 0 as level from reach union select e.child, w.level + 1 from walk w join inside e on e.parent = w.session_id), {_FRESH}, {_CHECKED}, {_verified('v', None)},
          own as (select w.session_id, max(w.level) as level, any_value(coalesce(f.fresh, false)) as fresh, any_value(case when coalesce(f.fresh, false) then 'verified' else coalesce(v.status, 'unknown') end) as status
            from walk w left join fresh f on f.session_id = w.session_id left join v on v.session_id = w.session_id group by 1),
          below as (select e.child as session_id from inside e join own o on o.session_id = e.parent where o.status <> 'verified'
            union select e.child from below b join inside e on e.parent = b.session_id)
          select o.session_id, cast(o.level as int) as level, case when b.session_id is not null then 'blocked' when o.fresh then 'skip' else 'run' end as action, o.status,
            b.session_id is not null or o.status <> 'verified' as failed from own o left join below b on b.session_id = o.session_id""",
       "runs", "file_hashes", "disk", "newest", recursive=True)
def rerun_outcomes(spark, sf_dir):
    """What a re-run of everything would do if each run ended as its files are now."""
    t = load(spark, sf_dir, "runs", "file_hashes", "disk")
    edges = _edges(t)
    plan = materialize(verify.rerun_plan(edges, lineage.reachable(edges, _all_leaves(t)), verify.fresh_runs(t["runs"], t["file_hashes"], t["disk"]), skip_unchanged=True), "plan")
    ends = verify.verify_runs(t["runs"], t["file_hashes"], t["disk"], propagate=False)
    return verify.rerun_outcomes(edges, plan, ends).select("session_id", "level", "action", "status", "failed")


@query("""with v as (select session_id, count(*) as n_outputs from file_hashes where role = 'output' group by 1),
          d as (select r.*, cast(date_diff('second', started_at, finished_at) as double) as dur from runs r where finished_at is not null),
          stats as (select *, case when status = 'success' or exit_code = 0 then 1.0 else 0.0 end as ok from d),
          h as (select script_hash, count(*) as n, quantile_cont(dur, 0.9) as p90, avg(ok) as rate from stats group by 1),
          p as (select script_path, count(*) as n, quantile_cont(dur, 0.9) as p90, avg(ok) as rate from stats group by 1),
          ids as (select distinct file_path as identifier from file_hashes union select distinct script_path from runs union select '/new.py'),
          named as (select i.identifier, case when i.identifier like '%.py' or d.file_path is null then i.identifier else r.script_path end as script_path
            from ids i left join (select * from disk where "exists") d on d.file_path = i.identifier left join newest w on w.file_path = i.identifier left join runs r on r.session_id = w.session_id),
          hashed as (select n.*, d.current_hash as script_hash from named n left join (select * from disk where "exists") d on d.file_path = n.script_path)
          select x.identifier, x.script_path, case when h.n is not null then 'exact_hash' when p.n is not null then 'path_history' else 'unknown' end as tier, coalesce(h.n, p.n, 0) as n,
            round_even(coalesce(h.p90, p.p90), 1) as p90, round_even(coalesce(h.rate, p.rate), 3) as success_rate
          from hashed x left join h on h.script_hash = x.script_hash left join p on p.script_path = x.script_path""", "runs", "file_hashes", "disk", "newest")
def target_estimates(spark, sf_dir):
    t = load(spark, sf_dir, "runs", "file_hashes", "disk")
    wanted = t["file_hashes"].select(F.col("file_path").alias("identifier")).union(t["runs"].select("script_path")).union(spark.createDataFrame([("/new.py",)], "identifier string"))
    return estimate.target_estimates(wanted, t["runs"], t["file_hashes"], t["disk"]).select("identifier", "script_path", "tier", "n", "p90", "success_rate")


@query(f"""with {_RESOLVED}, {_ANCHORS} select v.claim_id, case when v.new_status in ('mismatch', 'missing') then v.new_status when m.claim_id is null then 'unsourced'
             when new_status = 'verified' and coalesce(g.x, false) then 'exception' when new_status = 'verified' and coalesce(g.f, false) then 'frozen'
             when new_status in ('verified', 'suspect') then new_status else 'registered' end as resolved
          from verdicts v left join flags g on g.leaf = v.session left join met m on m.claim_id = v.claim_id""", *_CLAIM_TABLES, "sources", recursive=True)
def gated_statuses(spark, sf_dir):
    """Resolved statuses with the source gate on."""
    t, found, marks = _claims(spark, sf_dir, gated=True)
    judged = gate.grounded(found.where("status <> 'superseded'"), None, t["file_hashes"], t["entries"], marks=marks)
    rows = claims.marked_flags(judged, marks)
    return rows.select("claim_id", claims.resolved_status(F.col("new_status"), F.col("grounded"), F.col("has_exception"), F.col("has_frozen")).alias("resolved"))


@query(f"""with {_EDGES}, {_CHECKED}, sourced as (select c.claim_id, n.session_id as session from claims c left join newest n on n.file_path = c.source_file),
          hit as (select distinct session_id from checked where status in ('mismatch', 'missing') union select e.child from hit h join edges e on e.parent = h.session_id)
          select s.claim_id, h.session_id is null as still_valid from sourced s left join hit h on h.session_id = s.session""", "claims", "newest", "file_hashes", "runs", "disk", recursive=True)
def split_claims(spark, sf_dir):
    """Claims whose chain meets the blast radius of changed and missing files: what is downstream of a failure holds its own session too."""
    t = load(spark, sf_dir, "claims", "runs", "file_hashes", "disk")
    sourced = claims.source_sessions(t["claims"], t["file_hashes"]).select("claim_id", F.col("session").alias("source_session"))
    blast = verify.blast_radius(_edges(t), verify.checked(t["runs"], t["file_hashes"], t["disk"]))
    return verify.split_claims(sourced, blast.select(F.col("session_id").alias("leaf"), "session_id"), blast).select("claim_id", "still_valid")


_PLACED = f"""{_EDGES}, {_ALL_LEAVES}, reach as (select session_id from leaves union select e.parent from reach r join edges e on e.child = r.session_id),
          inside as (select child, parent from edges where child in (select session_id from reach) and parent in (select session_id from reach)),
          walk as (select session_id, 0 as level from reach union select e.child, w.level + 1 from walk w join inside e on e.parent = w.session_id),
          placed as (select session_id, cast(max(level) as int) as level from walk group by 1), {_CHECKED},
          scripts as (select p.session_id, 'script_' || cast(row_number() over (order by p.level, p.session_id) - 1 as varchar) as id, p.level from placed p),
          named as (select c.*, p.level, 'file_' || translate(split_part(c.file_path, '/', -1), '.- ', '___') || '_' || substr(md5(c.file_path), 1, 8) as id
            from checked c join placed p on p.session_id = c.session_id where c.role <> 'script')"""


def _graph(spark, sf_dir):
    t = load(spark, sf_dir, "runs", "file_hashes", "disk")
    edges = _edges(t)
    placed = materialize(lineage.levels(edges, lineage.reachable(edges, _all_leaves(t))), "placed")
    checked = verify.checked(t["runs"], t["file_hashes"], t["disk"]).select("session_id", "file_path", "role", "status")
    mine = materialize(checked.join(placed.select("session_id"), "session_id", "left_semi"), "checked")
    nodes = exports.graph_nodes(t["runs"], mine, placed)
    return nodes, exports.graph_edges(nodes, mine)


@query(f"""with {_PLACED} select s.id, 'script' as kind, split_part(r.script_path, '/', -1) as label, case when coalesce(g.good, true) then 'verified' else 'failed' end as status, s.level
          from scripts s left join runs r on r.session_id = s.session_id left join (select session_id, bool_and(status = 'verified') as good from checked group by 1) g on g.session_id = s.session_id
          union all select id, min_by(role, {{'l': level, 's': session_id, 'r': role}}), any_value(split_part(file_path, '/', -1)), case when bool_and(status = 'verified') then 'verified' else 'failed' end, min(level)
          from named group by file_path, id""", "file_hashes", "newest", "runs", "disk", recursive=True)
def graph_nodes(spark, sf_dir):
    return _graph(spark, sf_dir)[0].select("id", "kind", "label", "status", "level")


@query(f"""with {_PLACED} select distinct case when n.role = 'input' then n.id else s.id end as source, case when n.role = 'input' then s.id else n.id end as target
          from named n join scripts s on s.session_id = n.session_id""", "file_hashes", "newest", "runs", "disk", recursive=True)
def graph_links(spark, sf_dir):
    return _graph(spark, sf_dir)[1]


@query("""select claim_id, '{"name":"' || claim_type || '","value":"' || claim_value || '","supports":["' || file_path || '"]}' as payload from claims where claim_value is not null""", "claims")
def intermediate_values(spark, sf_dir):
    c = load(spark, sf_dir, "claims")["claims"].where("claim_value is not null")
    return c.select("claim_id", claims.intermediate_payload(F.col("claim_type"), F.col("claim_value"), F.array("file_path")).alias("payload"))
