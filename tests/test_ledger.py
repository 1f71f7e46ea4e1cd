"""The store, capture, verification and claims on small hand-made ledgers."""

import hashlib
import tarfile

import pytest
from pyspark.sql import functions as F

from hashloom.functions import codes, hashes
from hashloom.operators import citations, claims, estimate, gate, groupers, lineage, lookups, rerun, verify
from hashloom.plans import exports, queries
from hashloom.plans.testbed import load
from hashloom.sources import documents, files
from hashloom.sources.ledger import Ledger
from hashloom.streaming import capture, live

sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
FILES = "session_id string, file_path string, hash string, role string, frozen boolean, recorded_at string"
RUNS = "session_id string, script_path string, script_hash string, parent_session string, provenance string, exception_reason string"
DISK = "file_path string, exists boolean, current_hash string, archived_hash string"


def table(spark, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return df.withColumn("recorded_at", F.to_timestamp_ntz("recorded_at")) if "recorded_at" in df.columns else df


def three_stages(spark, raw="raw"):
    rows = [("A", "/raw", sha("raw"), "input", False, "2024-01-01"), ("A", "/mid", sha("mid"), "output", False, "2024-01-01"),
            ("B", "/mid", sha("mid"), "input", False, "2024-01-02"), ("B", "/leaf", sha("leaf"), "output", False, "2024-01-02")]
    runs = table(spark, [("A", None, None, None, "tracked", None), ("B", None, None, "A", "exception", "")], RUNS)
    disk = table(spark, [("/raw", True, sha(raw), None), ("/mid", True, sha("mid"), None), ("/leaf", True, sha("leaf"), None)], DISK)
    return runs, table(spark, rows, FILES), disk


def ids(df, *names):
    return sorted(tuple(r) for r in df.select(*names).collect())


def test_edges_take_the_newest_other_producer(spark):
    f = table(spark, [("old", "/x", "h", "output", False, "2024-01-01"), ("new", "/x", "h", "output", False, "2024-01-02"), ("use", "/x", "h", "input", False, "2024-01-03"),
                      ("use", "/config", "h", "input", False, "2024-01-03"), ("new", "/x", "h", "input", False, "2024-01-03"), ("self", "/s", "h", "output", False, "2024-01-01"),
                      ("self", "/s", "h", "input", False, "2024-01-01")], FILES)
    assert ids(lineage.file_edges(f), "child", "parent") == [("new", "old"), ("use", "new")]


def test_closure_stops_at_the_bound_and_on_cycles(spark):
    line = spark.createDataFrame([("s3", "s2"), ("s2", "s1"), ("s1", "s0")], "child string, parent string")
    leaf = spark.createDataFrame([("s3",)], "session_id string")
    assert ids(lineage.closure(line, leaf, 2), "session_id", "depth") == [("s1", 2), ("s2", 1), ("s3", 0)]
    found = {r["session_id"]: r["parents"] for r in lineage.adjacency(line, lineage.closure(line, leaf, 2), 2).collect()}
    assert found == {"s3": ["s2"], "s2": ["s1"], "s1": []}
    ring = spark.createDataFrame([("a", "b"), ("b", "a")], "child string, parent string")
    nodes = spark.createDataFrame([("a",)], "session_id string")
    members = lineage.closure(ring, nodes)
    assert ids(members, "session_id") == [("a",), ("b",)]
    with pytest.raises(ValueError):
        lineage.levels(ring, members)
    assert [r["level"] for r in lineage.roots_first(ring, members).collect()] == [None, None]


def test_strict_attribution_of_a_corrupted_source(spark):
    runs, f, disk = three_stages(spark, "tampered")
    edges = lineage.file_edges(f)
    members = lineage.closure(edges, spark.createDataFrame([("B",)], "session_id string"))
    checked = verify.verify_files(verify.checked_files(runs, f), disk)
    dag = verify.verify_dag(edges, members, verify.verify_runs(runs, f, disk, propagate=False))
    assert ids(dag, "session_id", "status", "failed") == [("A", "mismatch", True), ("B", "verified", True)]
    assert verify.dag_status(dag).head().asDict() == {"status": "mismatch", "n_runs": 2, "n_failed": 2}
    found = verify.attribution(dag, checked).head()
    assert (found["ok"], found["root_cause"], found["root_session"]) == (False, "/raw", "A")
    blast = verify.blast_radius(edges, checked)
    c = spark.createDataFrame([("c1", "A"), ("c2", "B"), ("c3", None)], "claim_id string, source_session string")
    split = verify.split_claims(c, lineage.chains(runs), blast)
    assert ids(split, "claim_id", "still_valid") == [("c1", False), ("c2", False), ("c3", True)]
    targets = verify.targets_of(f, spark.createDataFrame([("/leaf",), ("/none",)], "file_path string"))
    chain = verify.verify_chains(targets, members, verify.verify_runs(runs, f, disk))
    assert ids(chain, "file_path", "status") == [("/leaf", "suspect"), ("/none", "unknown")]
    nodes = exports.graph_nodes(runs, checked, dag.select("session_id", "level"))
    edges_ = exports.graph_edges(nodes, checked)
    assert exports.cascade(nodes, edges_).where("not tainted").count() == 0
    assert "script_0" in exports.to_mermaid(nodes, edges_) and edges_.count() == 4


def test_run_status_ladder(spark):
    f = table(spark, [("frozen", "/a", sha("a"), "output", True, "2024-01-01"), ("gone", "/b", sha("b"), "output", True, "2024-01-01"),
                      ("short", "/a", sha("now")[:32], "input", False, "2024-01-01"), ("archived", "/c", sha("c"), "output", False, "2024-01-01")], FILES)
    disk = table(spark, [("/a", True, sha("now"), None), ("/c", False, None, sha("c"))], DISK)
    runs = table(spark, [(s, None, None, None, None, None) for s in ("empty", "frozen", "gone", "short", "archived")] + [("script", "/s.py", "x", None, None, None)], RUNS)
    assert ids(verify.verify_runs(runs, f, disk), "session_id", "status") == [
        ("archived", "verified"), ("empty", "verified"), ("frozen", "verified"), ("gone", "missing"), ("script", "missing"), ("short", "verified")]


def test_claims_fail_loud(spark):
    runs, f, disk = three_stages(spark)
    rows = [("good", "/leaf", sha("leaf"), "registered"), ("plain", None, None, "registered"), ("tampered", "/leaf", sha("x"), "registered"),
            ("deleted", "/gone", sha("x"), "registered"), ("loose", "/raw", sha("raw"), "registered"), ("old", "/leaf", sha("leaf"), "superseded")]
    c = spark.createDataFrame(rows, "claim_id string, source_file string, source_hash string, status string").withColumn("source_session", F.lit(None).cast("string"))
    sourced = claims.source_sessions(c, f)
    members = lineage.closure(lineage.file_edges(f), sourced.where("session is not null").select(F.col("session").alias("session_id")))
    chains = verify.verify_chains(sourced.where("source_file is not null").select(F.col("source_file").alias("file_path"), F.col("session").alias("session_id")).distinct(), members, verify.verify_runs(runs, f, disk))
    found = claims.verify_claims(sourced, disk, chains)
    strict, out = claims.gate_claims(found, codes.resolve_severity(strict=True), strict=True)
    assert ids(strict, "claim_id", "code") == [("deleted", 11), ("good", 0), ("loose", 13), ("plain", 10), ("tampered", 12)]
    assert out.head().asDict() == {"exit_code": 12, "errors": [10, 11, 12, 13], "warnings": []}
    relaxed, _ = claims.gate_claims(found, codes.resolve_severity())
    assert relaxed.where("claim_id = 'loose'").head()["code"] == 0
    _, none = claims.gate_claims(found.where("false"), codes.resolve_severity())
    assert none.head()["exit_code"] == 20
    sources = spark.createDataFrame([(0, "/raw", sha("raw").upper())], "ord int, file_path string, sha256 string")
    entries = gate.manifest_entries(sources, disk)
    g = gate.grounded(found, members, f, entries)
    assert ids(g.where("grounded"), "claim_id", "matched") == [("good", "/raw"), ("loose", "/raw"), ("old", "/raw"), ("tampered", "/raw")]
    assert gate.grounded(found, members, f, entries, enforced=True).where("grounded").isEmpty()
    flags = claims.chain_flags(found, members, runs, f)
    assert flags.where("claim_id = 'good'").head()["has_exception"] and not flags.where("claim_id = 'plain'").head()["has_exception"]
    assert ids(claims.exception_reasons(members, runs), "session_id", "reason") == [("B", "no reason given")]


def test_completeness(spark):
    grounded = spark.createDataFrame([("c1",), ("c2",)], "claim_id string")
    sub = lambda *rows: spark.createDataFrame(rows, "question_id string, claim_id string")
    gate.assert_complete(sub(("q1", "c1"), ("q2", "c2")), grounded)
    found = gate.submission_problems(sub(("q1", "c1"), ("q2", "c1"), ("q3", "zz")), grounded)
    assert ids(found, "problem", "claim_id") == [("duplicate", "c1"), ("missing", "zz"), ("orphan", "c2")]
    with pytest.raises(ValueError):
        gate.assert_complete(sub(("q1", "c1")), grounded)


def test_citation_matrix(spark):
    rec = spark.createDataFrame([("ver", "10.1/A", "verified", None), ("stb", None, "stub", None), ("unr", None, "unverified", "http://u"), ("dft", "10.1/b", "verified", None)],
                                "cite_key string, doi string, status string, url string")
    rows = [("ver", "10.1/a ", None, None), ("stb", None, None, None), ("unr", None, None, None), ("dft", "10.9/z", None, None), ("note", "10/1", None, "x Auto-generated stub"),
            ("jrn", "10/2", "Pending any metadata lookup", None), ("nodoi", None, "Nature", None), ("full", "10/3", "Nature", None), ("bare", None, None, None)]
    e = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq int, key string, doi string, journal string, note string").withColumns({c: F.lit(None).cast("string") for c in ("title", "author", "year")})
    v = citations.verify_citations(e, rec)
    assert dict(ids(v, "cite_key", "code")) == {"ver": 0, "stb": 14, "unr": 15, "dft": 12, "note": 14, "jrn": 14, "nodoi": 14, "full": 15, "bare": 16}
    assert citations.citations_exit(v, codes.resolve_severity()).head()["exit_code"] == 14
    assert citations.citations_exit(v.where("false"), codes.resolve_severity()).head()["exit_code"] == 20


def test_hash_recipes(spark):
    import json

    one = spark.createDataFrame([("k2", sha("b")), ("k1", sha("a"))], "k string, h string")
    assert one.agg(hashes.combined_hash(F.col("k"), F.col("h"))).head()[0] == sha(f"k1:{sha('a')}k2:{sha('b')}")
    raw = b"".join(bytes.fromhex(x) for x in sorted((sha("a"), sha("b"))))
    assert one.agg(hashes.merkle_root(F.col("h"))).head()[0] == hashlib.sha256(raw).hexdigest()
    assert one.where("k = 'k1'").agg(hashes.merkle_root(F.col("h"))).head()[0] == sha("a")
    assert one.where("false").agg(hashes.merkle_root(F.col("h"))).head()[0] == ""
    assert one.where("false").agg(hashes.ledger_root(F.col("k"), F.col("h"))).head()[0] is None
    cid = spark.range(1).select(hashes.claim_id(F.lit("/a.tex"), F.lit(3), F.lit("value"), F.lit(None).cast("string"))).head()[0]
    assert cid == "claim_" + sha("/a.tex:L3:value:")[:12]
    meta = {"title": '\u00a0Ünï "q"\t\x01\\x \n', "doi": "10/X", "year": ""}
    fields = {k: F.lit(v) for k, v in meta.items()}
    want = json.dumps({k: v.strip().lower() for k, v in meta.items() if v.strip()}, sort_keys=True, ensure_ascii=False)
    assert spark.range(1).select(hashes.metadata_text(fields)).head()[0] == want
    assert spark.range(1).select(hashes.consistent(F.lit("abcd"), F.lit("ab")), hashes.consistent(F.lit(""), F.lit("ab"))).head()[:] == (True, False)


def test_groupers_compose_and_resolve(spark):
    rows = [("s", f"/d/fold_{i}.csv", "output") for i in range(3)] + [("s", "/d/alone.csv", "output"), ("s", "/d/fold_9.csv", "input")]
    f = spark.createDataFrame(rows, "session_id string, file_path string, role string").withColumn("hash", F.sha2("file_path", 256))
    found = groupers.groups(groupers.auto()(groupers.start(f)))
    assert ids(found, "role", "size", "kind") == [("input", 1, "single"), ("output", 1, "single"), ("output", 3, r"pattern:fold_\d+")]
    assert found.where("size = 3").head()["label"] == "{X}.csv (×3)"
    spec = {"type": "compose", "steps": [{"type": "directory", "min_size": 2}, {"type": "session_bundle", "max_files": 0}]}
    assert ids(groupers.groups(groupers.resolve(spec)(groupers.start(f))), "role", "kind") == [("input", "session_bundle"), ("output", "directory")]
    with pytest.raises(ValueError):
        groupers.resolve("nothing")


def test_estimates(spark):
    rows = [("a", "/s.py", "h1", "2024-01-01 00:00:00", "2024-01-01 00:00:10", "success", 0), ("b", "/s.py", "h1", "2024-01-01 00:00:00", "2024-01-01 00:00:20", "failed", 1),
            ("c", "/s.py", "h2", "2024-01-01 00:00:00", None, "running", None)]
    runs = spark.createDataFrame(rows, "session_id string, script_path string, script_hash string, s string, f string, status string, exit_code int").withColumns(
        {"started_at": F.to_timestamp_ntz("s"), "finished_at": F.to_timestamp_ntz("f")})
    f = spark.createDataFrame([("a", "/o", "output", 7), ("a", "/p", "output", None)], "session_id string, file_path string, role string, size_bytes bigint")
    want = spark.createDataFrame([("/s.py", "h1"), ("/s.py", "hx"), ("/new.py", "hy")], "script_path string, script_hash string")
    got = {(r["script_path"], r["script_hash"]): r for r in estimate.estimates(want, runs, f).collect()}
    assert (got["/s.py", "h1"]["tier"], got["/s.py", "h1"]["p50"], got["/s.py", "h1"]["p90"], got["/s.py", "h1"]["success_rate"]) == ("exact_hash", 15.0, 19.0, 0.5)
    assert got["/s.py", "hx"]["tier"] == "path_history" and got["/new.py", "hy"]["n"] == 0 and got["/s.py", "h1"]["typical_bytes"] == 7


def test_rerun_compare(spark):
    pair = lambda *rows: spark.createDataFrame(rows, "file_path string, hash string")
    original = pair(("/a/x", "1"), ("/a/y", "2"))
    status = lambda new: verify.rerun_status(verify.compare_rerun(original, new)).head()[0]
    assert status(pair(("/b/x", "1"), ("/b/y", "2"))) == "verified"
    assert status(pair(("/b/x", "9"), ("/b/y", "2"))) == "mismatch"
    assert status(pair(("/b/x", "1"))) == "unknown"


def test_ledger_views_and_capture(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    raw, mid = tmp_path / "raw.csv", tmp_path / "mid.csv"
    raw.write_text("1")
    with capture.session(ledger, session_id="A") as a:
        capture.record_input(str(raw))
        mid.write_text("2")
        capture.record_output(str(mid))
    with pytest.raises(RuntimeError):
        capture.record_input(str(raw))
    with pytest.raises(KeyError), capture.session(ledger, session_id="B"):
        capture.record_input(str(mid))
        raise KeyError
    runs = {r["session_id"]: r for r in ledger.view("runs").collect()}
    assert runs["A"]["status"] == "success" and runs["A"]["combined_hash"] == a.combined_hash() and runs["B"]["status"] == "error" and runs["B"]["parent_session"] == "A"
    assert ids(ledger.view("session_parents"), "session_id", "parent_session") == [("B", "A")]
    ledger.add_run("A")
    assert lookups.get_run(ledger.view("runs"), "A").head()["finished_at"] is None
    snap = files.disk_snapshot(ledger.view("file_hashes"))
    assert ids(verify.verify_runs(ledger.view("runs"), ledger.view("file_hashes"), snap), "session_id", "status") == [("A", "verified"), ("B", "verified")]
    assert ledger.auto_classify() == 3 and ledger.auto_classify() == 0
    rows = spark.createDataFrame([("/doc/a.tex", "value", 1, str(mid)), ("/doc/b.tex", "value", 2, None), ("/docs.tex", "value", 3, None)], "file_path string, claim_type string, line_number int, source_file string")
    ledger.add_claims(rows, snap)
    assert ids(ledger.view("claims"), "file_path", "source_session") == [("/doc/a.tex", "A"), ("/doc/b.tex", None), ("/docs.tex", None)]
    with pytest.raises(ValueError):
        ledger.add_claims(rows.withColumn("claim_type", F.lit("rumour")), snap)
    assert ledger.preview("/doc") == 2 and ledger.supersede_claims_under("/doc") == 2 and lookups.list_claims(ledger.view("claims")).count() == 1
    ledger.add_claims(rows, snap)
    assert lookups.list_claims(ledger.view("claims")).count() == 3 and ledger.remove_claims_under("/doc") == 2 and ledger.view("claims").count() == 1
    assert ledger.add_citations(spark.createDataFrame([("k", "10/1", True)], "cite_key string, doi string, resolved boolean")) == 1
    assert ledger.view("citations").head()["status"] == "verified"
    with pytest.raises(ValueError):
        ledger.add_citations(spark.createDataFrame([(" ",)], "cite_key string"))
    ledger.finish_run("A", combined_hash="ff")
    stamp = ledger.stamp(proof=str(tmp_path / "proof"))
    assert ledger.check_stamp(stamp)["matches"]
    ledger.finish_run("A", combined_hash="00")
    assert not ledger.check_stamp()["matches"]
    ledger.record_verification("A", "cache", "verified")
    q = live.outcome_counts(live.read_log(spark, ledger.root, "verification_results")).writeStream.format("memory").queryName("outcomes").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("outcomes").head()["n"] == 1
    q = live.latest_outputs(live.read_log(spark, ledger.root, "file_hashes"), str(tmp_path / "latest"), str(tmp_path / "check"))
    q.awaitTermination(60)
    assert ids(live.read_latest(spark, str(tmp_path / "latest")), "session_id") == [("A",)]


def test_rerun_of_scripts(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    ledger.add_run("lost", str(tmp_path / "none.py"))
    (tmp_path / "bad.py").write_text("raise SystemExit(3)")
    ledger.add_run("bad", str(tmp_path / "bad.py"))
    assert (rerun.run_again(ledger, "lost"), rerun.run_again(ledger, "bad"), rerun.run_again(ledger, "nobody")) == ("missing", "mismatch", "unknown")
    assert ids(lookups.latest_verifications(ledger.view("verification_results")), "session_id", "level", "status") == [("bad", "rerun", "mismatch"), ("lost", "rerun", "missing")]


def test_file_hashes_and_archives(spark, tmp_path):
    d = tmp_path / "data"
    d.mkdir()
    (d / ".dot").write_text("x")
    (d / "_u").write_text("y")
    want = {".dot": sha("x"), "_u": sha("y")}
    assert dict(ids(files.hash_directory(spark, str(d)), "rel_path", "hash")) == want
    with tarfile.open(tmp_path / "data.tar.gz", "w:gz") as tar:
        tar.add(d, "data")
    for p in d.iterdir():
        p.unlink()
    d.rmdir()
    assert dict(ids(files.hash_directory(spark, str(d)), "rel_path", "hash")) == want
    snap = files.disk_snapshot(spark.createDataFrame([(str(d / "_u"),), (str(d / "no"),)], "file_path string"))
    assert {r["file_path"][-2:]: r["archived_hash"] for r in snap.collect()} == {"_u": sha("y"), "no": None}
    with pytest.raises(NotADirectoryError):
        files.hash_directory(spark, str(tmp_path / "nothing"))
    md5 = files.hash_paths(spark.createDataFrame([(str(tmp_path / "data.tar.gz"),)], "file_path string"), "md5").head()
    assert md5["hash"] == hashlib.md5((tmp_path / "data.tar.gz").read_bytes()).hexdigest()


def test_documents(spark, tmp_path):
    bib = tmp_path / "r.bib"
    bib.write_text('@article{a,\n title = {The {Big} One},\n doi = "10/1",\n year = 2020\n}\n@comment{x}\n@book{b, journal={J}}\n@article{a, doi={10/2}}\n')
    rows = documents.read_bib(spark, str(bib)).orderBy("seq").collect()
    assert [(r["key"], r["doi"], r["title"], r["year"], r["journal"]) for r in rows] == [
        ("a", "10/1", "The {Big} One", "2020", None), ("b", None, None, None, "J"), ("a", "10/2", None, None, None)]
    art = tmp_path / "c.json"
    art.write_text('{"schema": "tool/citations/v1", "citations": [{"cite_key": "k", "doi": "10/1", "resolved": true, "metadata": {"title": "T"}}, {"cite_key": " "}]}')
    got = documents.read_citation_artifact(spark, str(art)).collect()
    assert [(r["cite_key"], r["title"]) for r in got] == [("k", "T")]
    art.write_text('{"schema": "other"}')
    assert documents.read_citation_artifact(spark, str(art)) is None
    m = str(tmp_path / "sources.json")
    hashed = spark.createDataFrame([("/a", sha("a"))], "file_path string, hash string")
    assert documents.read_manifest(spark, m) is None and documents.register_sources(hashed, m, ["/a"]) == 1
    assert ids(documents.read_manifest(spark, m)[0], "file_path", "sha256") == [("/a", sha("a"))]
    with pytest.raises(FileNotFoundError):
        documents.register_sources(hashed, m, ["/b"])
    assert documents.unregister_sources(m, ["/a", "/b"]) == 1 and documents.unregister_sources(m, ["/a"]) == 0
    (tmp_path / "l.txt").write_text("# no\n\n /a \n")
    assert ids(documents.read_path_list(spark, str(tmp_path / "l.txt")), "file_path") == [("/a",)]
    (tmp_path / "c1.json").write_text('{"verify": {"severity": {"no_lineage": "error"}}}')
    (tmp_path / "c2.json").write_text('{"verify": {"x": 1}}')
    config = documents.load_config(str(tmp_path / "c1.json"), str(tmp_path / "c2.json"))
    assert config == {"verify": {"severity": {"no_lineage": "error"}, "x": 1}}
    assert codes.resolve_severity(config["verify"]["severity"])[13] == "error"
    with pytest.raises(ValueError):
        codes.resolve_severity({"no_such": "error"})


def test_queries_over_all_equal_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    t = load(spark, sf, "claims", "file_hashes")
    rows = t["claims"].collect()
    want = {r["file_path"]: min((x["line_number"], x["claim_id"]) for x in rows if x["file_path"] == r["file_path"])[1] for r in rows}
    want |= {f"{r['file_path']}:L{r['line_number']}": r["claim_id"] for r in rows} | {r["claim_id"]: r["claim_id"] for r in rows}
    got = [tuple(r) for r in queries.resolve_claims(spark, sf).select("identifier", "claim_id").collect()]
    assert len(got) == len(want) > 2 * len(rows) and dict(got) == want

    seen, made, parents = {}, {}, {}
    files = t["file_hashes"].collect()
    for r in sorted((r for r in files if r["role"] == "output"), key=lambda r: (r["recorded_at"], [-ord(c) for c in r["session_id"]])):
        seen[r["file_path"], r["session_id"]] = r["recorded_at"]
        made[r["file_path"]] = r["session_id"]
    got = [tuple(r) for r in queries.sessions_by_files(spark, sf).select("file_path", "session_id", "at").collect()]
    assert sorted(got) == sorted((*k, at) for k, at in seen.items())
    for r in files:
        if r["role"] == "input" and made.get(r["file_path"], r["session_id"]) != r["session_id"]:
            parents.setdefault(r["session_id"], set()).add(made[r["file_path"]])

    def depths(leaf):
        found, now, k = {}, {leaf}, 0
        while now:
            found |= dict.fromkeys(now, k)
            now, k = {p for s in now for p in parents.get(s, ())} - found.keys(), k + 1
        return found
    closed = {leaf: depths(leaf) for leaf in set(made.values())}
    got = [tuple(r) for r in queries.lineage_closure(spark, sf).select("leaf", "session_id", "depth").collect()]
    assert sorted(got) == sorted((leaf, s, k) for leaf, found in closed.items() for s, k in found.items())

    status = {r["session_id"]: r["status"] for r in queries.verify_runs(spark, sf).collect()}
    rank = ("mismatch", "missing", "suspect", "unknown", "verified")
    worst = lambda leaf: min((status.get(s, "unknown") for s in closed[leaf]), key=rank.index)
    want = [(p, s, worst(s), len(closed[s])) if (s := made.get(p)) else (p, None, "unknown", 0) for p in {r["file_path"] for r in files}]
    got = [tuple(r) for r in queries.verify_chains(spark, sf).select("file_path", "session_id", "status", "n_runs").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)

    own = {r["session_id"]: r["status"] for r in verify.verify_runs(*load(spark, sf, "runs", "file_hashes", "disk").values(), propagate=False).collect()}
    level = lambda s: 1 + max(map(level, parents[s])) if parents.get(s) else 0
    nodes = set().union(*closed.values())
    failed = {s for s in nodes if any(own.get(a, "unknown") != "verified" for a in depths(s))}
    got = [tuple(r) for r in queries.verify_dag(spark, sf).select("session_id", "level", "status", "failed").collect()]
    assert sorted(got) == sorted((s, level(s), own.get(s, "unknown"), s in failed) for s in nodes)


def test_links_come_from_the_record_where_there_is_one(spark):
    rec = spark.createDataFrame([("a", None, "verified", None), ("b", "10.1/b", "verified", " "), ("c", None, "stub", "http://u")], "cite_key string, doi string, status string, url string")
    rows = spark.createDataFrame([(i, k, "10.1/x") for i, k in enumerate("abcd")], "seq int, key string, doi string").withColumns(
        {c: F.lit(None).cast("string") for c in ("journal", "note", "title", "author", "year")})
    got = dict(ids(citations.verify_citations(rows, rec), "cite_key", "link"))
    assert got == {"a": None, "b": "https://doi.org/10.1/b", "c": "http://u", "d": "https://doi.org/10.1/x"}


def test_levels_with_and_without_cycles(spark, monkeypatch):
    from hashloom.operators import lineage

    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a"), ("e", "d")], "child string, parent string")
    nodes = spark.createDataFrame([(x,) for x in "abcdef"], "session_id string")
    want = [("a", 0), ("b", 1), ("c", 2), ("d", 0), ("e", 1), ("f", 0)]
    assert ids(lineage.levels(edges, nodes), "session_id", "level") == want
    round_ = edges.union(spark.createDataFrame([("x", "y"), ("y", "x"), ("x", "a"), ("z", "y")], "child string, parent string"))
    more = nodes.union(spark.createDataFrame([("x",), ("y",), ("z",)], "session_id string"))
    monkeypatch.setattr(lineage, "WALKS", 4)
    assert sorted(tuple(r) for r in lineage.levels(round_, more, strict=False).where("level is not null").collect()) == want
    with pytest.raises(ValueError):
        lineage.levels(round_, more)
    only = spark.createDataFrame([("x", "y"), ("y", "x")], "child string, parent string")
    assert {r["level"] for r in lineage.layout(only, only.select(F.col("child").alias("session_id"))).collect()} == {1}


def test_severities_of_hints(spark):
    from hashloom.operators import claims

    states = ["mismatch", "missing", "suspect", "registered", "unsourced", "exception", "verified", "frozen"]
    rows = spark.createDataFrame([(f"c{i}", "/a.tex", i, s) for i, s in enumerate(states)], "claim_id string, file_path string, line_number int, resolved string")
    got = dict(ids(claims.hint_entries(rows), "kind", "severity"))
    assert got == {"claim-mismatch": "error", "claim-missing": "error", "claim-suspect": "warning", "claim-registered": "warning", "claim-unsourced": "advice", "claim-exception": "advice"}


def test_files_are_dealt_by_path_once(spark):
    from hashloom.plans.testbed import Dialect, relations

    sf = "/root/testdata/sf0.001"
    t, plain = load(spark, sf), relations(Dialect("duckdb"))
    got = t["touched"]
    body = plain["touched"].replace("from lineitem", "from {lineitem}")
    want = spark.sql(body, lineitem=t["lineitem"])
    assert got.select(want.columns).exceptAll(want).isEmpty() and want.exceptAll(got.select(want.columns)).isEmpty()
    first = t["newest"].withColumnRenamed("session_id", "made")
    hashed = want.join(first, "file_path", "left").withColumn("hash", F.expr("sha2(file_path || ':' || case when role = 'output' then session_id else coalesce(made, 'raw') end, 256)"))
    assert ids(t["file_hashes"], "session_id", "file_path", "role", "hash") == ids(hashed, "session_id", "file_path", "role", "hash")
    good = dict(ids(first, "file_path", "made"))
    now = {r["file_path"]: r for r in t["disk"].collect()}
    assert {p for p in now if not p.endswith(".py")} == {r["file_path"] for r in want.select("file_path").collect()}
    for p, r in now.items():
        k = int(p.rpartition("p")[2]) if not p.endswith(".py") else 1
        if not p.endswith(".py") and k % 17 and k % 29:
            assert (r["exists"], r["current_hash"]) == (True, sha(f"{p}:{good.get(p, 'raw')}"))
    plan = t["file_hashes"]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    checked = verify.checked(t["runs"], t["file_hashes"], t["disk"])
    assert ids(checked, "session_id", "file_path", "role", "status") == ids(
        verify.verify_files(verify.checked_files(t["runs"], t["file_hashes"]), t["disk"]), "session_id", "file_path", "role", "status")


def test_claims_look_up_only_what_lies_behind_them(spark):
    runs, f, disk = three_stages(spark)
    apart = table(spark, [("C", "/mid", sha("mid"), "input", False, "2024-01-03"), ("C", "/far", sha("far"), "output", False, "2024-01-03")], FILES)
    all_files, edges = f.union(apart), lineage.file_edges(f.union(apart))
    assert ids(edges, "child", "parent") == [("B", "A"), ("C", "A")]
    members = lineage.reachable(edges, spark.createDataFrame([("B",)], "session_id string"))
    assert ids(lineage.within(edges, members), "child", "parent") == [("B", "A")]
    assert lineage.within(edges, lineage.reachable(edges, members.select("session_id"), 0), 0).isEmpty()
    t = claims.behind(members, runs, all_files)
    assert ids(t["file_hashes"], "session_id", "file_path") == ids(f, "session_id", "file_path") and t["behind"].count() == 2
    found = claims.on_disk(disk.union(table(spark, [("/far", True, sha("far"), None)], DISK)), t["file_hashes"].select("file_path"), runs.select("script_path"))
    assert ids(found, "file_path") == [("/leaf",), ("/mid",), ("/raw",)]
    whole, part = (verify.chain_marks(e, r, x, verify.verify_runs(r, x, disk)) for e, r, x in ((edges, runs, all_files), (lineage.within(edges, members), t["behind"], t["file_hashes"])))
    at = spark.createDataFrame([("/leaf", "B")], "file_path string, session_id string")
    assert ids(verify.chain_statuses(at, part), "file_path", "status") == ids(verify.chain_statuses(at, whole), "file_path", "status")


def test_runs_are_told_from_checked_files_in_one_grouping(spark):
    runs, f, disk = three_stages(spark)
    stray = table(spark, [("nobody", "/raw", sha("raw"), "input", False, "2024-01-03")], FILES)
    verified = verify.verify_runs(runs.union(table(spark, [("none", None, None, None, None, None)], RUNS)), f.union(stray), disk)
    assert ids(verified, "session_id", "status", "n_files") == [("A", "verified", 2), ("B", "verified", 2), ("none", "verified", 0)]
    assert "Join" not in verify.run_statuses(runs, verify.checked(runs, f, disk).select("session_id", "file_path", "role", "status").limit(9))._jdf.queryExecution().optimizedPlan().toString().split("GlobalLimit")[0]


def chain_counts(runs, f, disk, max_depth):
    """``verify_chains`` by pairs of leaf and ancestor, for ``file_chains`` to equal."""
    targets = verify.targets_of(f, f)
    leaves = targets.where("session_id is not null").select("session_id").distinct()
    members = lineage.closure(lineage.file_edges(f), leaves, max_depth)
    return verify.verify_chains(targets, members, verify.verify_runs(runs, f, disk))


def test_chains_of_all_files_equal_those_by_pairs(spark):
    import random

    draw = random.Random(9)
    day = lambda: f"2024-01-0{draw.randint(1, 9)}"
    some = lambda k: f"/p{draw.randrange(k)}"
    rows = [(f"s{i}", some(30), draw.choice(["now"] * 28 + ["old", None]), role, draw.random() < 0.1, day()) for i in range(40) for role in ("input", "input", "output", "output")]
    rows += [(f"s{i}", some(30), "now", "script", None, day()) for i in range(0, 40, 5)] + [("s1", "/only", "now", "script", False, day())]
    rows += [(r[0], r[1], "now", "input", False, day()) for r in rows[2::9]]  # a session reads what it wrote
    rows += [(f"s{i}", None, "now", role, False, day()) for i, role in ((2, "output"), (3, "input"))]
    rows += [(s, "/tie", "now", "output", False, "2024-01-05") for s in ("s7", "s6")] + [("s6", "/tie", "now", "input", False, "2024-01-05")]
    f = table(spark, rows, FILES)
    runs = table(spark, [(f"s{i}", *((f"/p{i % 7 + 1}", "old" if i == 13 else "now") if i % 3 else (None, None)), None, None, None) for i in range(40) if i % 8], RUNS)
    disk = table(spark, [(f"/p{k}", k % 11 > 0, "now" if k % 11 else None, "now" if k % 22 == 0 else None) for k in range(29)] + [("/tie", True, "now", None)], DISK)
    statuses, longest = set(), 0
    for bound in (0, 1, 50):
        got, want = (ids(x.fillna("-"), "file_path", "session_id", "status", "n_runs") for x in (
            verify.file_chains(runs, f, disk, bound), chain_counts(runs, f, disk, bound)))
        assert got == want, bound
        statuses, longest = statuses | {r[2] for r in got}, max(r[3] for r in got)
    assert len(statuses) == 5 and longest > 5


def test_long_chains_and_rounds_are_counted_once(spark, monkeypatch):
    chain = [(f"s{i:02}", f"s{i - 1:02}") for i in range(1, 45)] + [(f"s{i:02}", f"s{i - 3:02}") for i in range(3, 45, 3)]
    around = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "c"), ("c", "s40")]
    edges = spark.createDataFrame(chain + around, "child string, parent string")
    own = edges.selectExpr("child as session_id").union(edges.select("parent")).distinct().withColumn("marks", F.when(F.col("session_id") == "s05", 1).otherwise(0).cast("long"))
    for bound in (50, 9):
        pairs = lineage.closure(edges, own.select("session_id"), bound)
        want = pairs.join(own.select("session_id", "marks"), "session_id").groupBy(F.col("leaf").alias("session_id")).agg(F.count("*").alias("n"), F.bit_or("marks").alias("marks"))
        assert ids(lineage.totals(edges, own, bound), "session_id", "n", "marks") == ids(want, "session_id", "n", "marks"), bound
    made = {}
    write = lineage.materialize
    monkeypatch.setattr(lineage, "materialize", lambda df, name: made.setdefault(name, write(df, name)))
    lineage.totals(edges, own)
    assert all(dict(t.dtypes) == {"leaf": "bigint", "at": "bigint", "marks": "bigint"} for n, t in made.items() if n != "totals-own")
    assert {n for n in made if n.startswith("totals-new")} <= {"totals-new-8", "totals-new-16", "totals-new-32"}


def test_chains_meet_files_and_disk_once(spark, monkeypatch):
    seen = {}

    def write(df, name):
        seen[name] = df._jdf.queryExecution().executedPlan().toString()
        return materialize(df, name)

    from hashloom.plans.scratch import materialize
    for module in (verify, lineage, queries):
        monkeypatch.setattr(module, "materialize", write)
    queries.verify_chains(spark, "/root/testdata/sf0.001")
    assert {n for n in seen if not n.startswith("totals-")} == {"met"}
    assert not any("lineitem" in plan for n, plan in seen.items() if n != "met")
