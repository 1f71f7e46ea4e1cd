"""Registered queries of the ledger operators over the derived ledger, each with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hashloom.functions import codes, hashes
from hashloom.operators import citations, claims, estimate, gate, groupers, lineage, lookups, verify
from hashloom.plans.scratch import materialize
from hashloom.plans.testbed import load, oracle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *names: str, recursive: bool = False):
    """Register a function under its name, with the DuckDB text that gives the same rows."""
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = oracle(sql, *names, recursive=recursive)
        return f
    return add


# --- lookups, lists, counts -------------------------------------------------

@query("""select session_id, script_path, status, started_at from runs where status = 'failed'
          order by started_at desc, session_id limit 100 offset 20""", "runs")
def list_runs(spark, sf_dir):
    return lookups.list_runs(load(spark, sf_dir, "runs")["runs"], "failed", 100, 20).select("session_id", "script_path", "status", "started_at")


@query("select file_path, session_id, max(recorded_at) as at from file_hashes where role = 'output' group by 1, 2", "file_hashes")
def sessions_by_files(spark, sf_dir):
    files = load(spark, sf_dir, "file_hashes")["file_hashes"]
    return lookups.sessions_by_files(files, files, "output")


@query("""select hash, count(distinct session_id) as n_sessions, string_agg(distinct host, ',' order by host) as hosts
          from contents group by 1 having count(*) > 1""", "contents")
def sessions_by_content(spark, sf_dir):
    rows = load(spark, sf_dir, "contents")["contents"]
    return rows.groupBy("hash").agg(F.countDistinct("session_id").alias("n_sessions"), F.array_join(F.array_sort(F.collect_set("host")), ",").alias("hosts"), F.count("*").alias("n")).where("n > 1").drop("n")


@query("""select session_id, level, status, verified_at from (select *, row_number() over (partition by session_id order by verified_at desc, seq desc) as k from results) x
          where k = 1""", "results")
def latest_verifications(spark, sf_dir):
    return lookups.latest_verifications(load(spark, sf_dir, "results")["results"])


@query("""select session_id, seq, status, rank from (select *, row_number() over (partition by session_id order by verified_at desc, seq desc) as rank from results) x
          where rank <= 10""", "results")
def verification_history(spark, sf_dir):
    return lookups.verification_history(load(spark, sf_dir, "results")["results"]).select("session_id", "seq", "status", F.col("rank").cast("long").alias("rank"))


@query("""select r.n_runs, r.n_success, r.n_failed, f.n_file_rows, f.n_files
          from (select count(*) as n_runs, count(*) filter (status = 'success') as n_success, count(*) filter (status = 'failed') as n_failed from runs) r,
               (select count(*) as n_file_rows, count(distinct file_path) as n_files from file_hashes) f""", "runs", "file_hashes")
def ledger_stats(spark, sf_dir):
    t = load(spark, sf_dir, "runs", "file_hashes")
    found = lookups.stats(t["runs"], t["file_hashes"])
    return spark.createDataFrame([tuple(found.values())], ", ".join(f"{k} bigint" for k in found))


@query("""select claim_id, file_path, line_number, claim_type, status from claims
          where status <> 'superseded' and claim_type = 'figure' and (file_path = '/doc' or file_path like '/doc/%')
          order by file_path nulls first, line_number nulls first, claim_id limit 100""", "claims")
def list_claims(spark, sf_dir):
    return lookups.list_claims(load(spark, sf_dir, "claims")["claims"], claim_type="figure", prefix="/doc").select("claim_id", "file_path", "line_number", "claim_type", "status")


@query("""with wanted as (select claim_id as identifier, claim_id from claims union all select file_path || ':L' || cast(line_number as string), claim_id from claims
                          union all select file_path, min_by(claim_id, line_number) from claims group by file_path)
          select distinct identifier, claim_id from wanted""", "claims")
def resolve_claims(spark, sf_dir):
    rows = load(spark, sf_dir, "claims")["claims"]
    return lookups.resolve_claims(rows, rows.select(F.col("claim_id").alias("identifier")).union(
        rows.select(F.expr("file_path || ':L' || line_number"))).union(rows.select("file_path")))


@query("""with wanted as (select session_id as target from runs where exit_code = 1 union select script_path from runs union select file_path from file_hashes where role = 'output' union select '/nowhere'),
          by_script as (select script_path as target, max_by(session_id, (started_at, session_id)) as b from runs group by 1)
          select w.target, coalesce(r.session_id, s.b, n.session_id) as session_id from wanted w left join runs r on r.session_id = w.target
          left join by_script s on s.target = w.target left join newest n on n.file_path = w.target""", "runs", "file_hashes", "newest")
def resolve_targets(spark, sf_dir):
    t = load(spark, sf_dir, "runs", "file_hashes")
    wanted = t["runs"].where("exit_code = 1").select(F.col("session_id").alias("target")).union(t["runs"].select("script_path")).union(
        t["file_hashes"].where("role = 'output'").select("file_path")).union(spark.createDataFrame([("/nowhere",)], "target string"))
    return lookups.resolve_targets(t["runs"], t["file_hashes"], wanted)


@query("""with made as (select f.file_path, f.session_id as producer, r.started_at as "at", max_by(f.hash, f.recorded_at) as hash
            from file_hashes f join runs r on r.session_id = f.session_id where f.role = 'output' group by 1, 2, 3),
          reads as (select distinct session_id, file_path from file_hashes where role = 'input'),
          near as (select r.session_id, r.file_path, m.producer, m."at", m.hash, row_number() over (partition by r.session_id order by m."at" desc nulls last, m.producer, r.file_path) as rank
            from reads r join made m on r.file_path = m.file_path and r.session_id <> m.producer)
          select n.session_id, n.file_path, n.producer, n."at", n.rank from near n join disk d on d.file_path = n.file_path
          where n.rank <= 5 and d."exists" and left(d.current_hash, least(length(d.current_hash), length(n.hash))) = left(n.hash, least(length(d.current_hash), length(n.hash)))""",
       "runs", "file_hashes", "disk")
def reuse_hints(spark, sf_dir):
    t = load(spark, sf_dir, "runs", "file_hashes", "disk")
    return lookups.reuse_hints(t["runs"], t["file_hashes"], t["disk"]).withColumn("rank", F.col("rank").cast("long"))


# --- hashes -----------------------------------------------------------------

@query("""select session_id, sha256(string_agg(k || ':' || hash, '' order by k)) as combined_hash
          from (select session_id, role || ':' || file_path as k, hash from file_hashes
                union all select session_id, 'script', script_hash from runs) x group by 1""", "file_hashes", "runs")
def combined_hashes(spark, sf_dir):
    t = load(spark, sf_dir, "runs", "file_hashes")
    keyed = t["file_hashes"].select("session_id", F.concat_ws(":", "role", "file_path").alias("k"), "hash").union(t["runs"].select("session_id", F.lit("script"), "script_hash"))
    return keyed.groupBy("session_id").agg(hashes.combined_hash(F.col("k"), F.col("hash")).alias("combined_hash"))


@query("""select session_id, role, count(*) as n, case when count(*) = 1 then min(hash) else sha256(unhex(string_agg(hash, '' order by hash))) end as root_hash
          from contents group by 1, 2""", "contents")
def merkle_roots(spark, sf_dir):
    return load(spark, sf_dir, "contents")["contents"].groupBy("session_id", "role").agg(F.count("*").alias("n"), hashes.merkle_root(F.col("hash")).alias("root_hash"))


@query("""select count(*) as run_count, sha256(string_agg(session_id || combined_hash, '' order by session_id)) as root_hash
          from runs where status = 'success' and combined_hash is not null""", "runs")
def ledger_root(spark, sf_dir):
    rows = load(spark, sf_dir, "runs")["runs"].where("status = 'success' and combined_hash is not null")
    return rows.agg(F.count("*").alias("run_count"), hashes.ledger_root(F.col("session_id"), F.col("combined_hash")).alias("root_hash"))


@query("""select file_path, 'file_' || translate(split_part(file_path, '/', -1), '.- ', '___') || '_' || substr(md5(file_path), 1, 8) as node_id,
          case when role = 'input' then 'input' when role = 'output' then 'output' end as node_class from contents""", "contents")
def file_nodes(spark, sf_dir):
    rows = load(spark, sf_dir, "contents")["contents"]
    return rows.select("file_path", hashes.node_id(F.col("file_path")).alias("node_id"), hashes.node_class(F.col("role"), F.col("file_path")).alias("node_class"))


# --- lineage ----------------------------------------------------------------

_EDGES = """edges as (select distinct f.session_id as child, p.session_id as parent from file_hashes f join (
              select file_path, session_id, row_number() over (partition by file_path order by recorded_at desc, session_id) as k from file_hashes where role = 'output') p
            on p.file_path = f.file_path and p.k = 1 where f.role = 'input' and f.session_id <> p.session_id)"""
_CLOSURE = """closed as (select distinct session_id as leaf, session_id, 0 as depth from leaves
              union select c.leaf, e.parent, c.depth + 1 from closed c join edges e on e.child = c.session_id)"""
_MEMBERS = "members as (select leaf, session_id, min(depth) as depth from closed group by 1, 2)"
_ALL_LEAVES = "leaves as (select distinct n.session_id from newest n)"


def _edges(t):
    return materialize(lineage.file_edges(t["file_hashes"]), "edges")


def _all_leaves(t):
    return lineage.newest_producers(t["file_hashes"]).select("session_id").distinct()


@query(f"with {_EDGES} select child, parent from edges", "file_hashes")
def lineage_edges(spark, sf_dir):
    return lineage.file_edges(load(spark, sf_dir, "file_hashes")["file_hashes"])


@query(f"with {_EDGES}, {_ALL_LEAVES}, {_CLOSURE}, {_MEMBERS} select leaf, session_id, cast(depth as int) as depth from members", "file_hashes", "newest", recursive=True)
def lineage_closure(spark, sf_dir):
    t = load(spark, sf_dir, "file_hashes")
    return lineage.closure(_edges(t), _all_leaves(t))


@query(f"""with {_EDGES}, walk as (select child as session_id, 0 as level from edges union select parent, 0 from edges
          union select e.child, w.level + 1 from walk w join edges e on e.parent = w.session_id)
          select session_id, cast(max(level) as int) as level from walk group by 1""", "file_hashes", recursive=True)
def lineage_levels(spark, sf_dir):
    edges = _edges(load(spark, sf_dir, "file_hashes"))
    return lineage.levels(edges, edges.select(F.col("child").alias("session_id")).union(edges.select("parent")))


@query("""with chain as (select session_id as leaf, session_id, parent_session, 0 as depth from runs
          union all select c.leaf, r.session_id, r.parent_session, c.depth + 1 from chain c join runs r on r.session_id = c.parent_session)
          select leaf as session_id, max_by(session_id, depth) as root, max(depth)::bigint as depth from chain group by leaf""", "runs", recursive=True)
def chain_roots(spark, sf_dir):
    return lineage.chain_roots(load(spark, sf_dir, "runs")["runs"])


@query("""with chain as (select session_id as leaf, session_id, parent_session, 0 as depth from runs
          union all select c.leaf, r.session_id, r.parent_session, c.depth + 1 from chain c join runs r on r.session_id = c.parent_session)
          select leaf, session_id, cast(depth as int) as depth from chain""", "runs", recursive=True)
def parent_chains(spark, sf_dir):
    return lineage.chains(load(spark, sf_dir, "runs")["runs"])


# --- verification -----------------------------------------------------------

_CHECKED = """checked as (select f.session_id, f.file_path, f.role, case
              when f.frozen then case when coalesce(d."exists", false) or d.archived_hash is not null then 'verified' else 'missing' end
              when (case when coalesce(d."exists", false) then d.current_hash else d.archived_hash end) is null then 'missing'
              when left(case when coalesce(d."exists", false) then d.current_hash else d.archived_hash end, length(f.hash)) = f.hash then 'verified' else 'mismatch' end as status
            from (select session_id, file_path, hash, role, frozen from file_hashes
                  union all select session_id, script_path, script_hash, 'script', false from runs) f left join disk d on d.file_path = f.file_path)"""


def _verified(name: str, suspect: str | None) -> str:
    propagate = f"when bool_or(role = 'input' and c.status in ('mismatch', 'missing')) then '{suspect}'" if suspect else ""
    return f"""{name} as (select r.session_id, case
              when bool_or(role <> 'input' and c.status = 'mismatch') then 'mismatch' when bool_or(role <> 'input' and c.status = 'missing') then 'missing' {propagate}
              when coalesce(bool_and(c.status = 'verified'), true) then 'verified' when bool_or(c.status = 'mismatch') then 'mismatch' else 'missing' end as status,
              count(c.file_path) as n_files, count(*) filter (c.status = 'mismatch') as n_mismatch, count(*) filter (c.status = 'missing') as n_missing
            from runs r left join checked c on c.session_id = r.session_id group by 1)"""


@query(f"with {_CHECKED} select session_id, file_path, role, status from checked", "file_hashes", "runs", "disk")
def verify_files(spark, sf_dir):
    t = load(spark, sf_dir, "runs", "file_hashes", "disk")
    return verify.checked(t["runs"], t["file_hashes"], t["disk"]).select("session_id", "file_path", "role", "status")


@query(f"with {_CHECKED}, {_verified('v', 'suspect')} select * from v", "file_hashes", "runs", "disk")
def verify_runs(spark, sf_dir):
    t = load(spark, sf_dir, "runs", "file_hashes", "disk")
    return verify.verify_runs(t["runs"], t["file_hashes"], t["disk"])


@query(f"""with {_CHECKED}, {_verified('v', 'suspect')} select count(*) as n_runs, count(*) filter (status = 'verified') as n_verified,
          count(*) filter (status <> 'verified' and n_mismatch > 0) as n_mismatch, count(*) filter (status <> 'verified' and n_mismatch = 0 and n_missing > 0) as n_missing from v""",
       "file_hashes", "runs", "disk")
def status_overview(spark, sf_dir):
    return verify.status_overview(verify_runs(spark, sf_dir))


_WORST = """case when bool_and(coalesce(v.status, 'unknown') = 'verified') then 'verified' when bool_or(v.status = 'mismatch') then 'mismatch'
            when bool_or(v.status = 'missing') then 'missing' when bool_or(v.status = 'suspect') then 'suspect' else 'unknown' end"""


@query(f"""with {_EDGES}, targets as (select distinct p.file_path, n.session_id from file_hashes p left join newest n on n.file_path = p.file_path),
          leaves as (select distinct session_id from targets where session_id is not null), {_CLOSURE}, {_MEMBERS}, {_CHECKED}, {_verified('v', 'suspect')},
          of_leaf as (select m.leaf, {_WORST} as status, count(*) as n_runs from members m left join v on v.session_id = m.session_id group by 1)
          select t.file_path, t.session_id, coalesce(o.status, 'unknown') as status, coalesce(o.n_runs, 0) as n_runs from targets t left join of_leaf o on o.leaf = t.session_id""",
       "file_hashes", "newest", "runs", "disk", recursive=True)
def verify_chains(spark, sf_dir):
    t = load(spark, sf_dir, "runs", "file_hashes", "disk")
    return verify.file_chains(t["runs"], t["file_hashes"], t["disk"])


@query(f"""with {_EDGES}, targets as (select distinct p.file_path, n.session_id from file_hashes p left join newest n on n.file_path = p.file_path),
          leaves as (select distinct session_id from targets where session_id is not null), {_CLOSURE}, {_MEMBERS}, {_CHECKED}, {_verified('v', 'suspect')},
          of_leaf as (select m.leaf, {_WORST} as status from members m left join v on v.session_id = m.session_id group by 1)
          select t.file_path, t.session_id, coalesce(o.status, 'unknown') as status from targets t left join of_leaf o on o.leaf = t.session_id""",
       "file_hashes", "newest", "runs", "disk", recursive=True)
def chain_statuses(spark, sf_dir):
    t = load(spark, sf_dir, "runs", "file_hashes", "disk")
    marks = verify.chain_marks(_edges(t), t["runs"], t["file_hashes"], verify.verify_runs(t["runs"], t["file_hashes"], t["disk"]))
    return verify.chain_statuses(verify.targets_of(t["file_hashes"], t["file_hashes"]), marks)


_DAG = f"""{_EDGES}, {_ALL_LEAVES}, {_CLOSURE}, nodes as (select distinct session_id from closed), {_CHECKED}, {_verified('v', None)},
           own as (select n.session_id, coalesce(v.status, 'unknown') as status from nodes n left join v on v.session_id = n.session_id),
           inner_edges as (select child, parent from edges where child in (select session_id from nodes) and parent in (select session_id from nodes)),
           walk as (select session_id, 0 as level from nodes union select e.child, w.level + 1 from walk w join inner_edges e on e.parent = w.session_id),
           hit as (select session_id from own where status <> 'verified' union select e.child from hit h join inner_edges e on e.parent = h.session_id)"""


@query(f"""with {_DAG} select o.session_id, cast(w.level as int) as level, o.status, h.session_id is not null as failed
          from own o join (select session_id, max(level) as level from walk group by 1) w on w.session_id = o.session_id left join hit h on h.session_id = o.session_id""",
       "file_hashes", "newest", "runs", "disk", recursive=True)
def verify_dag(spark, sf_dir):
    t = load(spark, sf_dir, "runs", "file_hashes", "disk")
    edges = _edges(t)
    return verify.verify_dag(edges, lineage.reachable(edges, _all_leaves(t)), verify.verify_runs(t["runs"], t["file_hashes"], t["disk"], propagate=False))


def _checked(t):
    """Checked files, written once for several uses, without their hashes."""
    return materialize(verify.checked(t["runs"], t["file_hashes"], t["disk"]).select("session_id", "file_path", "role", "status"), "checked")


@query(f"""with {_EDGES}, {_CHECKED}, hit as (select distinct session_id from checked where status in ('mismatch', 'missing') and session_id in (select session_id from runs)
           union select e.child from hit h join edges e on e.parent = h.session_id) select session_id from hit""", "file_hashes", "runs", "disk", recursive=True)
def blast_radius(spark, sf_dir):
    t = load(spark, sf_dir, "runs", "file_hashes", "disk")
    checked = verify.checked(t["runs"], t["file_hashes"], t["disk"]).join(t["runs"].select("session_id"), "session_id", "left_semi")
    return verify.blast_radius(_edges(t), checked)


@query("""select r.session_id, coalesce(x.fresh, false) as fresh from runs r left join (
            select p.session_id, bool_and(coalesce(d."exists", false) and coalesce(d.current_hash = p.hash, false)) and bool_or(p.role = 'script') as fresh
            from (select session_id, file_path, hash, role from file_hashes where role = 'input' union all select session_id, script_path, script_hash, 'script' from runs) p
            left join disk d on d.file_path = p.file_path group by 1) x on x.session_id = r.session_id""", "file_hashes", "runs", "disk")
def fresh_runs(spark, sf_dir):
    t = load(spark, sf_dir, "runs", "file_hashes", "disk")
    return verify.fresh_runs(t["runs"], t["file_hashes"], t["disk"])


@query("""with a as (select * from contents where role = 'output'),
          again as (select file_path, case when seq % 4 = 0 then 'x' || hash else hash end as hash from a where seq % 5 <> 0),
          b as (select split_part(file_path, '/', -1) as base, max_by(hash, file_path) as new_hash from again group by 1)
          select a.file_path, a.hash, b.new_hash, case when b.new_hash is null then 'missing' when b.new_hash = a.hash then 'verified' else 'mismatch' end as status
          from a left join b on b.base = split_part(a.file_path, '/', -1)""", "contents")
def rerun_compare(spark, sf_dir):
    rows = load(spark, sf_dir, "contents")["contents"].where("role = 'output'")
    again = rows.where("seq % 5 <> 0").select("file_path", F.when(F.col("seq") % 4 == 0, F.concat(F.lit("x"), "hash")).otherwise(F.col("hash")).alias("hash"))
    return verify.compare_rerun(rows.select("file_path", "hash"), again)


# --- claims, gate, citations ------------------------------------------------

_CLAIMS = f"""{_EDGES}, sourced as (select c.*, n.session_id as session from claims c left join newest n on n.file_path = c.source_file),
              leaves as (select distinct session as session_id from sourced where session is not null), {_CLOSURE}, {_MEMBERS}, {_CHECKED}, {_verified('v', 'suspect')},
              of_leaf as (select m.leaf, {_WORST} as status from members m left join v on v.session_id = m.session_id group by 1),
              stated as (select s.*, case when s.source_file is null then null when d.file_path is null then 'missing'
                             when s.source_hash is null then 'mismatch' when left(d.current_hash, length(s.source_hash)) = s.source_hash then 'verified' else 'mismatch' end as source_status,
                             coalesce(o.status = 'verified', false) as chain_verified
                         from sourced s left join (select * from disk where "exists") d on d.file_path = s.source_file left join of_leaf o on o.leaf = s.session),
              verdicts as (select *, case when source_status is null then status when source_status <> 'verified' then source_status when chain_verified then 'verified' else 'suspect' end as new_status,
                             case when source_status is null then 10 when source_status = 'missing' then 11 when source_status = 'mismatch' then 12 when not chain_verified then 13 else 0 end as code
                           from stated where status <> 'superseded')"""
_CLAIM_TABLES = ("claims", "newest", "file_hashes", "runs", "disk")
_ANCHORS = """anchors as (select s.ord, s.file_path, s.sha256 from sources s join disk d on d.file_path = s.file_path where d."exists" and lower(d.current_hash) = lower(s.sha256)),
              met as (select distinct x.claim_id from (select claim_id, source_file as file_path, source_hash as hash from sourced
                          union select s.claim_id, f.file_path, f.hash from sourced s join members m on m.leaf = s.session join file_hashes f on f.session_id = m.session_id) x
                      join anchors a on a.file_path = x.file_path where x.hash <> '' and left(lower(x.hash), least(length(x.hash), length(a.sha256))) = left(lower(a.sha256), least(length(x.hash), length(a.sha256))))"""


def _claims(spark, sf_dir, gated=False):
    """(tables, claims with sessions and verdicts, marks of their chains); with ``gated`` marks tell trusted files too.

    Lineage is walked up from the claims' sources first; runs, files and the disk are then looked up for what lies there alone.
    """
    t = load(spark, sf_dir, "claims", "runs", "file_hashes", "disk", "sources")
    sourced = materialize(claims.source_sessions(t["claims"], t["file_hashes"]), "claims")
    targets = sourced.where("source_file is not null").select(F.col("source_file").alias("file_path"), F.col("session").alias("session_id")).distinct()
    edges = _edges(t)
    behind = materialize(lineage.reachable(edges, sourced.where("session is not null").select(F.col("session").alias("session_id"))), "behind")
    t |= claims.behind(behind, t["runs"], t["file_hashes"])
    t["file_hashes"] = materialize(t["file_hashes"].select("session_id", "file_path", "role", "hash", "frozen"), "files")
    t["behind"] = materialize(t["behind"], "runs")
    known = [t["file_hashes"].select("file_path"), t["behind"].select("script_path"), targets.select("file_path")] + ([t["sources"].select("file_path")] if gated else [])
    t["disk"] = materialize(claims.on_disk(t["disk"], *known), "disk")
    anchored = None
    if gated:
        t["entries"] = materialize(gate.manifest_entries(t["sources"], t["disk"]), "entries")
        anchored = gate.anchored_sessions(t["file_hashes"], t["entries"].where("valid"))
    verified = verify.verify_runs(t["behind"], t["file_hashes"], t["disk"])
    inner = materialize(lineage.within(edges, behind), "inner")
    marks = materialize(verify.chain_marks(inner, t["behind"], t["file_hashes"], verified, anchored), "marks")
    return t, materialize(claims.verify_claims(sourced, t["disk"], verify.chain_statuses(targets, marks)), "verified"), marks


@query(f"with {_CLAIMS} select claim_id, source_status, chain_verified, new_status, code from verdicts", *_CLAIM_TABLES, recursive=True)
def verify_claims(spark, sf_dir):
    _, found, _ = _claims(spark, sf_dir)
    rows, _ = claims.gate_claims(found, codes.resolve_severity(), strict=True)
    return rows.select("claim_id", "source_status", "chain_verified", "new_status", "code")


@query(f"""with {_CLAIMS}, {_ANCHORS}, gated as (select v.*, m.claim_id is not null as grounded from verdicts v left join met m on m.claim_id = v.claim_id)
          select claim_id, grounded, case when (case when code = 13 then 0 else code end) = 0 and not grounded then 17 when code = 13 then 0 else code end as code from gated""",
       *_CLAIM_TABLES, "sources", recursive=True)
def gated_claims(spark, sf_dir):
    t, found, marks = _claims(spark, sf_dir, gated=True)
    rows, _ = claims.gate_claims(gate.grounded(found, None, t["file_hashes"], t["entries"], marks=marks), codes.resolve_severity(), gate_active=True)
    return rows.select("claim_id", "grounded", "code")


#: Exit codes from harmless to worst, as the store's users know them, for the SQL below.
_RANKS = "ranks(code, rank) as (values (0, 0), (20, 1), (13, 2), (17, 3), (10, 4), (11, 5), (12, 6), (16, 7), (15, 8), (14, 9))"


@query(f"""with {_CLAIMS}, {_RANKS}, fired as (select v.code, r.rank from verdicts v join ranks r on r.code = v.code)
          select cast(coalesce((select code from fired where code not in (0, 13) order by rank desc limit 1), 0) as int) as exit_code, exists (select 1 from fired where code = 13) as warned""",
       *_CLAIM_TABLES, recursive=True)
def claims_exit(spark, sf_dir):
    _, found, _ = _claims(spark, sf_dir)
    _, out = claims.gate_claims(found, codes.resolve_severity() | {13: "warning"}, strict=True)
    return out.select("exit_code", F.array_contains("warnings", 13).alias("warned"))


@query(f"""with {_CLAIMS}, flags as (select m.leaf, bool_or(r.provenance = 'exception') as x, bool_or(f.frozen) as f
             from members m join runs r on r.session_id = m.session_id left join (select session_id, bool_or(frozen) as frozen from file_hashes group by 1) f on f.session_id = m.session_id group by 1),
          resolved as (select v.claim_id, case when new_status in ('mismatch', 'missing') then new_status when new_status = 'verified' and coalesce(x, false) then 'exception'
             when new_status = 'verified' and coalesce(f, false) then 'frozen' when new_status in ('verified', 'suspect') then new_status else 'registered' end as resolved
             from verdicts v left join flags g on g.leaf = v.session)
          select claim_id, resolved, case when resolved in ('mismatch', 'missing') then 'failed' when resolved = 'registered' then 'suspect' when resolved = 'frozen' then 'verified' else resolved end as bucket
          from resolved""", *_CLAIM_TABLES, recursive=True)
def resolved_claims(spark, sf_dir):
    _, found, marks = _claims(spark, sf_dir)
    rows = claims.marked_flags(found.where("status <> 'superseded'"), marks)
    r = claims.resolved_status(F.col("new_status"), F.lit(None).cast("boolean"), F.col("has_exception"), F.col("has_frozen"))
    return rows.select("claim_id", r.alias("resolved")).withColumn("bucket", claims.bucket(F.col("resolved")))


@query("""select s.ord, s.file_path, case when d.file_path is null then 'MISSING' when lower(d.current_hash) = s.sha256 then 'OK' else 'TAMPERED' end as reason
          from sources s left join (select * from disk where "exists") d on d.file_path = s.file_path""", "sources", "disk")
def manifest_entries(spark, sf_dir):
    t = load(spark, sf_dir, "sources", "disk")
    return gate.manifest_entries(t["sources"], t["disk"]).select("ord", "file_path", "reason")


@query("""with ids as (select 'claim_of_' || cast(c_custkey as string) as claim_id from customer where c_custkey % 43 <> 0)
          select 'missing' as problem, claim_id, string_agg(question_id, ',' order by question_id) as questions from submission where claim_id not in (select claim_id from ids) group by 2
          union all select 'orphan', claim_id, '' from ids where claim_id not in (select claim_id from submission)
          union all select 'duplicate', claim_id, string_agg(question_id, ',' order by question_id) from submission group by 2 having count(*) > 1""", "submission")
def submission_problems(spark, sf_dir):
    t = load(spark, sf_dir, "submission", "customer")
    ids = t["customer"].where("c_custkey % 43 <> 0").select(F.expr("'claim_of_' || c_custkey").alias("claim_id"))
    return gate.submission_problems(t["submission"], ids).withColumn("questions", F.array_join("questions", ","))


@query("""with e as (select * exclude (k) from (select *, row_number() over (partition by key order by seq desc) as k from entries) where k = 1),
          x as (select e.*, c.cite_key, c.status as s, c.doi as d, c.url as u from e left join citations c on c.cite_key = e.key)
          select key as cite_key, case when cite_key is not null and trim(doi) <> '' and trim(d) <> '' and lower(trim(doi)) <> lower(trim(d)) then 'unverified'
              when cite_key is not null then s when coalesce(doi, journal, note, title) is null then 'unknown'
              when note like '%Auto-generated stub%' or journal like '%Pending % metadata lookup%' or doi is null then 'stub' else 'unverified' end as status,
            case when cite_key is not null and trim(doi) <> '' and trim(d) <> '' and lower(trim(doi)) <> lower(trim(d)) then 12
              when cite_key is not null then case s when 'verified' then 0 when 'stub' then 14 else 15 end when coalesce(doi, journal, note, title) is null then 16
              when note like '%Auto-generated stub%' or journal like '%Pending % metadata lookup%' or doi is null then 14 else 15 end as code,
            case when cite_key is not null then coalesce(u, 'https://doi.org/' || trim(d)) else 'https://doi.org/' || nullif(trim(doi), '') end as link from x""", "entries", "citations")
def verify_citations(spark, sf_dir):
    t = load(spark, sf_dir, "entries", "citations")
    return citations.verify_citations(t["entries"], t["citations"]).select("cite_key", "status", "code", "link")


@query("""with x as (select key, lower(trim(doi)) as doi, lower(trim(journal)) as journal, lower(trim(title)) || case when seq % 3 = 0 then ' müller' || chr(9) || '"' || chr(233) else '' end as title from entries)
          select key, sha256('{' || concat_ws(', ', case when doi <> '' then '"doi": "' || doi || '"' end, case when journal <> '' then '"journal": "' || journal || '"' end,
            case when title <> '' then '"title": "' || replace(replace(title, '"', '\\"'), chr(9), '\\t') || '"' end) || '}') as metadata_hash from x where coalesce(doi, journal, title) is not null""", "entries")
def metadata_hashes(spark, sf_dir):
    rows = load(spark, sf_dir, "entries")["entries"]
    title = F.concat(F.col("title"), F.when(F.col("seq") % 3 == 0, F.lit(' Müller\t"É\u00a0\n')).otherwise(F.lit("")))
    fields = {c: F.col(c) for c in ("author", "year", "journal", "doi")} | {"title": title}
    return rows.select("key", hashes.metadata_hash(fields).alias("metadata_hash")).where("metadata_hash is not null")


# --- groupers, estimates ----------------------------------------------------

@query("""with a as (select session_id, role, file_path, hash, split_part(file_path, '/', -1) as base, regexp_replace(split_part(file_path, '/', -1), '[0-9]{3}\\.', '{X}.', 'g') as norm from contents),
          b as (select *, case when norm <> base then count(*) over (partition by session_id, role, norm) else 1 end as n from a),
          c as (select *, case when n >= 2 then 'pattern:' || norm else 'single:' || file_path end as group_id from b)
          select session_id, role, group_id, count(*) as size, case when count(*) = 1 then min(hash) else sha256(unhex(string_agg(hash, '' order by hash))) end as root_hash,
            case when count(*) = 1 then min(base) else min(norm) || ' (×' || count(*) || ')' end as label, case when count(*) = 1 then 'single' else 'pattern:[0-9]{3}\\.' end as kind from c group by 1, 2, 3""", "contents")
def pattern_groups(spark, sf_dir):
    rows = groupers.pattern(r"[0-9]{3}\.", "{X}.")(groupers.start(load(spark, sf_dir, "contents")["contents"]))
    return groupers.groups(rows).select("session_id", "role", "group_id", "size", "root_hash", "label", "kind")


@query("""with a as (select session_id, role, file_path, regexp_replace(file_path, '/[^/]*$', '') as folder from contents),
          b as (select *, count(*) over (partition by session_id, role, folder) as n from a),
          c as (select *, case when n < 10 then count(*) filter (n < 10) over (partition by session_id, role) end as rest from b)
          select session_id, role, case when n >= 10 then 'directory:' || folder when rest > 3 then 'session_bundle:' || role else 'single:' || file_path end as group_id, count(*) as size,
            case when n >= 10 then split_part(min(folder), '/', -1) || '/ (×' || count(*) || ')' when rest > 3 then role || ' bundle (×' || count(*) || ')' else min(split_part(file_path, '/', -1)) end as label,
            case when n >= 10 then 'directory' when rest > 3 then 'session_bundle' else 'single' end as kind from c group by session_id, role, group_id, n >= 10, rest > 3, case when n >= 10 then folder end""", "contents")
def composed_groups(spark, sf_dir):
    rows = groupers.compose(groupers.directory(10), groupers.session_bundle(3))(groupers.start(load(spark, sf_dir, "contents")["contents"]))
    return groupers.groups(rows).select("session_id", "role", "group_id", "size", "label", "kind")


@query("""with v as (select session_id, count(*) as n_outputs, cast(sum(size_bytes) as bigint) as bytes from file_hashes where role = 'output' group by 1),
          d as (select r.*, date_diff('second', started_at, finished_at) as dur, coalesce(v.n_outputs, 0) as n_outputs, v.bytes from runs r left join v on v.session_id = r.session_id where finished_at is not null)
          select script_path, count(*) as n, quantile_cont(cast(dur as double), 0.5) as p50, quantile_cont(cast(dur as double), 0.9) as p90,
            avg(case when status = 'success' or exit_code = 0 then 1.0 else 0.0 end) as success_rate, cast(trunc(median(n_outputs)) as bigint) as typical_outputs,
            cast(trunc(median(bytes)) as bigint) as typical_bytes from d group by 1""", "runs", "file_hashes")
def run_history(spark, sf_dir):
    t = load(spark, sf_dir, "runs", "file_hashes")
    return estimate.history(t["runs"], t["file_hashes"], "script_path")
