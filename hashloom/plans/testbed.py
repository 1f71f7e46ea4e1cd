"""A ledger derived from the TPC-H-like tables, in SQL that Spark and DuckDB both read.

Each relation is one SELECT over the base tables and over relations before it; the few
functions whose names differ come from a dialect.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Dialect:
    name: str

    def sha(self, x: str) -> str:
        return f"sha2({x}, 256)" if self.name == "spark" else f"sha256({x})"

    def after(self, t: str, seconds: str) -> str:
        return f"timestampadd(SECOND, {seconds}, {t})" if self.name == "spark" else f"{t} + to_seconds({seconds})"

    def digits(self, x: str, before: str) -> str:
        """The number that ends a string, after the letter ``before``."""
        return f"cast(regexp_extract({x}, '{before}([0-9]+)$', 1) as bigint)"


def relations(d: Dialect) -> dict[str, str]:
    """SQL of each relation by name, in order of dependence."""
    session = "'S' || lpad(cast({} as string), 10, '0')"
    found = {
        "runs": f"""
            select {session.format('o_orderkey')} as session_id,
                   '/proj/' || o_orderpriority || '_' || cast(o_orderkey % 7 as string) || '.py' as script_path,
                   {d.sha("o_orderpriority || ':' || cast(o_orderkey % 7 as string)")} as script_hash,
                   o_orderdate as started_at,
                   case when o_orderstatus <> 'O' then {d.after('o_orderdate', 'cast(o_orderkey % 600 as int)')} end as finished_at,
                   case o_orderstatus when 'F' then 'success' when 'P' then 'failed' else 'running' end as status,
                   case o_orderstatus when 'F' then 0 when 'P' then 1 end as exit_code,
                   case when o_orderkey > 0 then {session.format('cast(floor(o_orderkey / 4) as bigint)')} end as parent_session,
                   case when o_orderstatus = 'F' then {d.sha("'run:' || cast(o_orderkey as string)")} end as combined_hash,
                   case when o_custkey % 50 = 0 then 'exception' else 'tracked' end as provenance,
                   case when o_custkey % 100 = 0 then 'manual fix ' || cast(o_custkey as string) end as exception_reason
            from orders""",
        "touched": f"""
            select {session.format('l_orderkey')} as session_id,
                   case when l_linenumber = 1 then '/st' || cast(l_orderkey % 8 as string) || '/p' || cast(l_partkey as string)
                        when l_orderkey % 8 = 0 then '/raw/p' || cast(l_partkey as string)
                        else '/st' || cast(l_orderkey % 8 - 1 as string) || '/p' || cast(l_partkey as string) end as file_path,
                   case when l_linenumber = 1 then 'output' else 'input' end as role,
                   max(cast(round(l_extendedprice * 100) as bigint)) as size_bytes,
                   max(case when l_returnflag = 'R' and l_quantity > 45 then 1 else 0 end) = 1 as frozen,
                   max('host' || cast(l_suppkey % 10 as string)) as host,
                   max(l_shipdate) as recorded_at
            from lineitem group by 1, 2, 3""",
        "newest": """
            select file_path, session_id from (
                select file_path, session_id, row_number() over (partition by file_path order by recorded_at desc, session_id) as k
                from touched where role = 'output') t where k = 1""",
        "file_hashes": f"""
            select t.session_id, t.file_path, t.role, t.size_bytes, t.frozen, t.host, t.recorded_at,
                   {d.sha("t.file_path || ':' || case when t.role = 'output' then t.session_id else coalesce(n.session_id, 'raw') end")} as hash
            from touched t left join newest n on t.file_path = n.file_path""",
        "disk": f"""
            select file_path, k % 29 <> 0 as {'`exists`' if d.name == 'spark' else '"exists"'},
                   case when k % 29 = 0 then null when k % 17 = 0 then {d.sha("file_path || ':altered'")} else good end as current_hash,
                   case when k % 58 = 0 then good end as archived_hash
            from (select p.file_path, {d.digits('p.file_path', 'p')} as k,
                         {d.sha("p.file_path || ':' || coalesce(n.session_id, 'raw')")} as good
                  from (select distinct file_path from touched) p left join newest n on p.file_path = n.file_path) x
            union all
            select script_path, true, case when script_path like '%5-%6.py' then {d.sha("script_path")} else max(script_hash) end, null
            from runs group by script_path""",
        "results": """
            select event_id as seq, 'S' || lpad(cast(user_id as string), 10, '0') as session_id, ts as verified_at, event_type as status,
                   case when value < 20 then 'cache' when value < 60 then 'rerun' else 'registered' end as level
            from events""",
        "claims": f"""
            select 'claim_' || substr({d.sha("'/doc/' || c_mktsegment || '.tex:L' || cast(c_custkey + 1 as string) || ':' || kind || ':' || cast(cents as string)")}, 1, 12) as claim_id,
                   '/doc/' || c_mktsegment || '.tex' as file_path, cast(c_custkey + 1 as int) as line_number, kind as claim_type,
                   cast(cents as string) as claim_value, cast(null as string) as source_session, source_file,
                   case when c_custkey % 13 = 0 then null when c_custkey % 11 = 0 then {d.sha("'old'")}
                        else left({d.sha("source_file || ':' || coalesce(n.session_id, 'raw')")}, case when c_custkey % 2 = 0 then 64 else 32 end) end as source_hash,
                   case when c_custkey % 23 = 0 then 'superseded' else 'registered' end as status
            from (select c_custkey, c_mktsegment, cast(round(c_acctbal * 100) as bigint) as cents,
                         case c_custkey % 5 when 0 then 'statistic' when 1 then 'figure' when 2 then 'table' when 3 then 'text' else 'value' end as kind,
                         case when c_custkey % 19 = 0 then null else '/st' || cast(c_custkey % 8 as string) || '/p' || cast((c_custkey * 7) % 2000 as string) end as source_file
                  from customer) c
            left join newest n on c.source_file = n.file_path""",
        "sources": f"""
            select {d.digits('p.file_path', 'p')} as ord, p.file_path,
                   case when {d.digits('p.file_path', 'p')} % 7 = 0 then {d.sha("'forged'")} else {d.sha("p.file_path || ':raw'")} end as sha256
            from (select distinct file_path from touched where file_path like '/raw/%') p
            where {d.digits('p.file_path', 'p')} % 3 = 0""",
        "citations": """
            select 'key' || cast(doc_id as string) as cite_key, case when doc_id % 5 = 0 then null else '10.1/' || cast(doc_id as string) end as doi,
                   case when toxic = 1 then 'stub' when quality = 1 and doc_id % 5 <> 0 then 'verified' else 'unverified' end as status,
                   case when doc_id % 4 = 0 then 'http://x.example/' || cast(doc_id as string) end as url
            from labels""",
        "entries": """
            select doc_id as seq, 'key' || cast(doc_id as string) as key,
                   case when doc_id % 7 = 0 then null when doc_id % 9 = 0 then '10.2/' || cast(doc_id as string) else ' 10.1/' || cast(doc_id as string) end as doi,
                   case when doc_id % 6 = 0 then 'Pending some metadata lookup' when doc_id % 14 = 7 then null else 'Journal ' || lang end as journal,
                   case when doc_id % 10 = 1 then 'Auto-generated stub' end as note,
                   case when doc_id % 14 = 7 then null else source end as title, cast(null as string) as author, cast(null as string) as year
            from documents""",
        "contents": f"""
            select doc_id as seq, 'D' || lang as session_id, '/' || source || '/' || lang || '_' || lpad(cast(doc_id as string), 8, '0') || '.txt' as file_path,
                   case when doc_id % 3 = 0 then 'input' else 'output' end as role, {d.sha('text')} as hash, source as host
            from documents""",
        "submission": """
            select 'q' || cast(c_custkey as string) as question_id,
                   case when c_custkey % 31 = 0 then 'claim_none' || cast(c_custkey as string) else claim_id end as claim_id
            from (select c_custkey, 'claim_of_' || cast(case when c_custkey % 37 = 0 then c_custkey - 1 else c_custkey end as string) as claim_id
                  from customer where c_custkey % 41 <> 0) x""",
    }
    return _dealt(found, d, session) if d.name == "spark" else found


def _dealt(found: dict[str, str], d: Dialect, session: str) -> dict[str, str]:
    """``found`` with the file relations in texts that give the same rows from one deal of line items by path.

    Spark then groups, ranks and joins by path where the rows are; the plain texts deal them
    out by each key in turn, and meet newest writers in joins.
    """
    newest = "partition by file_path order by role desc, recorded_at desc, session_id"  # outputs come before inputs
    own = {"dealt": f"""
            select /*+ repartition(file_path) */ {session.format('l_orderkey')} as session_id,
                   case when l_linenumber = 1 then '/st' || cast(l_orderkey % 8 as string) || '/p' || cast(l_partkey as string)
                        when l_orderkey % 8 = 0 then '/raw/p' || cast(l_partkey as string)
                        else '/st' || cast(l_orderkey % 8 - 1 as string) || '/p' || cast(l_partkey as string) end as file_path,
                   case when l_linenumber = 1 then 'output' else 'input' end as role,
                   cast(round(l_extendedprice * 100) as bigint) as size_bytes, l_returnflag = 'R' and l_quantity > 45 as cold,
                   'host' || cast(l_suppkey % 10 as string) as host, l_shipdate as recorded_at
            from lineitem""",
        "touched": """
            select session_id, file_path, role, max(size_bytes) as size_bytes, max(case when cold then 1 else 0 end) = 1 as frozen, max(host) as host, max(recorded_at) as recorded_at
            from dealt group by 1, 2, 3""",
        "file_hashes": f"""
            select session_id, file_path, role, size_bytes, frozen, host, recorded_at,
                   {d.sha(f"file_path || ':' || case when role = 'output' then session_id else coalesce(first_value(case when role = 'output' then session_id end) over ({newest}), 'raw') end")} as hash
            from touched""",
        "disk": found["disk"].replace("(select distinct file_path from touched) p left join newest n on p.file_path = n.file_path", f"""(
                      select file_path, case when role = 'output' then session_id end as session_id, row_number() over ({newest}) as place from dealt) p where place = 1""").replace("n.session_id", "p.session_id"),
    }
    return {"dealt": own.pop("dealt")} | found | own


#: Base tables of each relation.
BASE = ("orders", "lineitem", "customer", "events", "documents", "labels")


def load(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    """The named relations as DataFrames over the parquet files of ``sf_dir``."""
    out = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE}
    sql = relations(Dialect("spark"))
    for name in sql:
        body = sql[name]
        used = {t: out[t] for t in out if _uses(body, t)}
        out[name] = spark.sql(_braced(body, used), **used)
    return {n: out[n] for n in names} if names else out


def _uses(body: str, name: str) -> bool:
    import re

    return re.search(rf"\b(from|join)\s+{name}\b", body) is not None


def _braced(body: str, used: dict) -> str:
    import re

    for name in used:
        body = re.sub(rf"\b(from|join)\s+{name}\b", lambda m, name=name: f"{m[1]} {{{name}}}", body)
    return body


def oracle(query: str, *names: str, recursive: bool = False) -> str:
    """``query`` in DuckDB with the named relations, and those that they use, as common table expressions."""
    sql, wanted = relations(Dialect("duckdb")), list(names)
    for name in wanted:
        wanted += [n for n in sql if _uses(sql[name], n) and n not in wanted]
    if not wanted:
        return query.strip()
    ctes = ", ".join(f"{n} as ({sql[n].strip()})" for n in sql if n in wanted)
    head = "with recursive " if recursive else "with "
    body = query.strip()
    return f"{head}{ctes}, {body[5:]}" if body.lower().startswith("with ") else f"{head}{ctes} {body}"
