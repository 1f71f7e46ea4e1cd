"""Marks that travel along lineage, chains of parents, hints, groups and re-runs against plain versions."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from hashloom.operators import claims, gate, groupers, lineage, rerun, verify
from hashloom.plans import exports
from hashloom.sources.ledger import Ledger


def pairs(spark, rows, names="child string, parent string"):
    return spark.createDataFrame(rows, names)


def brute_up(edges, start, depth):
    seen, now = {start}, {start}
    for _ in range(depth):
        now = {p for c, p in edges if c in now} - seen
        if not now:
            break
        seen |= now
    return seen


@pytest.mark.parametrize("seed, depth", [(1, 50), (2, 2), (3, 1)])
def test_marks_are_those_of_the_whole_chain(spark, seed, depth):
    rng = random.Random(seed)
    nodes = [f"n{i:02}" for i in range(40)]
    edges = sorted({(rng.choice(nodes), rng.choice(nodes)) for _ in range(55)} | {("n01", "n02"), ("n02", "n01")})
    bits = {n: 1 << rng.randrange(6) for n in nodes if rng.random() < 0.3}
    least = {n: rng.choice("abcdef") for n in nodes if rng.random() < 0.2}
    own = pairs(spark, [(n, bits.get(n, 0), least.get(n)) for n in nodes if n in bits or n in least], "session_id string, marks long, anchor string")
    got = {r["session_id"]: (r["marks"], r["anchor"]) for r in lineage.inherited(pairs(spark, edges), own, {"marks": lineage.BITS, "anchor": lineage.LEAST}, depth).collect()}
    for n in nodes:
        up = brute_up(edges, n, depth)
        marks = 0
        for u in up:
            marks |= bits.get(u, 0)
        anchor = min((least[u] for u in up if u in least), default=None)
        assert got.get(n, (0, None)) == (marks, anchor)
    assert lineage.inherited(pairs(spark, edges), own.where("false"), {"marks": lineage.BITS}, depth).count() == 0


def ledger_of(spark, seed=5):
    """Runs over random files, with changed and missing ones, exceptions, frozen rows and sessions without a run."""
    rng = random.Random(seed)
    sessions = [f"s{i:02}" for i in range(30)]
    runs = [(s, None, None, None, "exception" if i % 9 == 4 else "tracked", None) for i, s in enumerate(sessions[:-2])]
    rows = []
    for i, s in enumerate(sessions):
        rows.append((s, f"/f{i % 20}", f"h{i % 20}", "output", i % 11 == 3, f"2024-01-{i + 1:02}"))
        rows += [(s, f"/f{rng.randrange(30)}", f"h{rng.randrange(30)}" if rng.random() < 0.02 else None, "input", False, "2024-02-01") for _ in range(2)]
    rows = [(s, p, h or "h" + p[2:], *rest) for s, p, h, *rest in rows]
    disk = [(f"/f{i}", i % 17 != 5, "changed" if i % 19 == 6 else f"h{i}", None) for i in range(30)]
    return (spark.createDataFrame(runs, "session_id string, script_path string, script_hash string, parent_session string, provenance string, exception_reason string"),
            spark.createDataFrame(rows, "session_id string, file_path string, hash string, role string, frozen boolean, recorded_at string"),
            spark.createDataFrame(disk, "file_path string, exists boolean, current_hash string, archived_hash string"))


def test_marks_and_members_give_the_same_verdicts(spark):
    runs, files, disk = ledger_of(spark)
    edges = lineage.file_edges(files).cache()
    verified = verify.verify_runs(runs, files, disk).cache()
    targets = verify.targets_of(files, files.select("file_path").union(spark.createDataFrame([("/none",)], "file_path string")))
    members = lineage.closure(edges, targets.where("session_id is not null"))
    entries = spark.createDataFrame([(k, f"/f{i}", h, True) for k, (i, h) in enumerate([(3, "H3"), (3, "h3"), (8, "h8"), (12, "zz")])], "ord int, file_path string, sha256 string, valid boolean")
    marks = verify.chain_marks(edges, runs, files, verified, gate.anchored_sessions(files, entries)).cache()
    rows = lambda df, *c: sorted(map(tuple, df.select(*c).collect()), key=repr)
    assert rows(verify.chain_statuses(targets, marks), "file_path", "status") == rows(verify.verify_chains(targets, members, verified), "file_path", "status")
    assert len({s for _, s in rows(verify.chain_statuses(targets, marks), "file_path", "status")}) >= 3
    c = targets.select(F.concat(F.lit("c"), "file_path").alias("claim_id"), F.col("file_path").alias("source_file"), F.concat(F.lit("h"), F.substring("file_path", 3, 9)).alias("source_hash"), F.col("session_id").alias("session"))
    flags = ("claim_id", "has_exception", "has_frozen")
    assert rows(claims.marked_flags(c, marks), *flags) == rows(claims.chain_flags(c, members, runs, files), *flags)
    judged = ("claim_id", "grounded", "matched")
    assert rows(gate.grounded(c, None, files, entries, marks=marks), *judged) == rows(gate.grounded(c, members, files, entries), *judged)
    assert 0 < gate.grounded(c, None, files, entries, marks=marks).where("grounded").count() < c.count()
    leaves = c.select(F.col("session").alias("session_id")).where("session_id is not null")
    told = ("leaf", "session_id", "reason")
    assert rows(claims.exception_reasons(claims.exceptional_ancestors(edges, runs, leaves), runs), *told) == rows(claims.exception_reasons(members, runs), *told)


def test_roots_of_long_chains_by_doubling(spark, monkeypatch):
    made = []
    keep = lineage.materialize
    monkeypatch.setattr(lineage, "materialize", lambda df, name, *a: (made.append(name), keep(df, name, *a))[1])
    line = spark.range(100_000).select(F.format_string("s%06d", "id").alias("session_id"), F.when(F.col("id") > 0, F.format_string("s%06d", F.col("id") - 1)).alias("parent_session"))
    odd = spark.createDataFrame([("x", "y"), ("y", "x"), ("z", "x"), ("me", "me"), ("lone", None), ("stray", "gone"), ("low", "stray"), ("s000005", "s000004")], "session_id string, parent_session string")
    got = lineage.chain_roots(line.union(odd)).cache()
    assert len(made) - 1 <= 17  # rounds
    assert got.count() == 100_007
    assert got.where("session_id like 's0%' and root = 's000000' and depth = cast(substr(session_id, 2) as int)").count() == 100_000
    rest = {r["session_id"]: (r["root"], r["depth"]) for r in got.where("session_id not like 's0%'").collect()}
    assert rest == {"x": (None, None), "y": (None, None), "z": (None, None), "me": (None, None), "lone": ("lone", 0), "stray": ("stray", 0), "low": ("stray", 1)}
    assert lineage.chain_roots(odd.where("false")).count() == 0
    asked = lineage.chains(odd, spark.createDataFrame([("low",), ("nobody",)], "session_id string"))
    assert sorted(map(tuple, asked.collect())) == [("low", "low", 0), ("low", "stray", 1)]


# --- hints --------------------------------------------------------------------

def test_hints_of_claims_and_citations_share_a_shape(spark, tmp_path):
    resolved = spark.createDataFrame([("c1", "/a.tex", 3, "mismatch"), ("c2", "/a.tex", 4, "verified"), ("c3", "/b.tex", None, "exception")], "claim_id string, file_path string, line_number int, resolved string")
    cited = spark.createDataFrame([("k1", "stub", "/a.tex", 9), ("k2", "verified", None, None), ("k3", "unknown", None, None), ("k4", "semantic_mismatch", "/b.tex", 1), ("k5", "unverified", None, None)],
                                  "cite_key string, status string, manuscript_file string, line_number int")
    rows = {r["claim_id"]: r.asDict(recursive=True) for r in exports.hint_rows(resolved, cited).collect()}
    assert {k: (r["kind"], r["severity"], r["location"]) for k, r in rows.items()} == {
        "c1": ("claim-mismatch", "error", {"file": "/a.tex", "line": 3, "page": None}), "c3": ("claim-exception", "advice", {"file": "/b.tex", "line": None, "page": None}),
        "k1": ("citation-stub", "warning", {"file": "/a.tex", "line": 9, "page": None}), "k3": ("citation-unknown", "advice", {"file": None, "line": None, "page": None}),
        "k4": ("citation-semantic_mismatch", "advice", {"file": "/b.tex", "line": 1, "page": None}), "k5": ("citation-unverified", "warning", {"file": None, "line": None, "page": None})}
    assert all(r["message"] for r in rows.values())
    assert rows["c1"]["id"] == "hint_" + hashlib.sha256(b"c1:claim-mismatch").hexdigest()[:12] and rows["k1"]["id"] == "hint_" + hashlib.sha256(b"k1:citation-stub").hexdigest()[:12]
    bare = exports.hint_rows(resolved.where("false"), cited.select("cite_key", "status"))  # no record of where the manuscript cites
    assert bare.count() == 4 and bare.where("location.file is not null").isEmpty()

    table = str(tmp_path / "hints")
    ours = exports.hint_rows(resolved, cited)
    exports.write_hints(ours.limit(2), table, source="other")
    exports.write_hints(ours, table)
    exports.write_hints(ours.where("severity = 'error'"), table)  # a second run replaces its own rows alone
    count = lambda: {r["source"]: r["count"] for r in exports.read_hints(spark, table).groupBy("source").count().collect()}
    assert count() == {"other": 2, "hashloom": 1}
    exports.write_hints(ours.where("false"), table)
    assert count() == {"other": 2}

    path = tmp_path / "deep" / "hints.json"
    for run in range(2):
        exports.export_hints(resolved, cited, str(path))
        told = json.loads(path.read_text())
        assert [h["id"] for h in told["hints"] if h["source"] == "hashloom"] == sorted(r["id"] for r in rows.values())
        assert told["schema"] == "manuscript-hints/1" and not path.stat().st_mode & 0o222
        foreign = [{"id": "f2", "source": "x"}, {"id": "f1", "source": "x", "message": "ü"}]
        assert [h for h in told["hints"] if h["source"] != "hashloom"] == (foreign if run else []) and told.get("kept") == (1 if run else None)
        path.chmod(0o644)
        path.write_text(json.dumps(told | {"kept": 1, "hints": foreign[:1] + told["hints"] + foreign[1:]}))
    path.write_text("no json")
    exports.export_hints(resolved.where("false"), cited.where("false"), str(path))
    assert json.loads(path.read_text())["hints"] == []


# --- contracted graphs --------------------------------------------------------

def test_groups_contract_a_graph(spark):
    files = [("A", f"/d/part_{i}.csv", "output", "verified") for i in range(3)] + [("B", f"/d/part_{i}.csv", "input", "verified") for i in range(3)]
    files += [("B", "/out.csv", "output", "verified"), ("C", "/d/part_0.csv", "input", "verified"), ("C", "/d/part_1.csv", "input", "verified"), ("C", "/out.csv", "input", "mismatch")]
    checked = spark.createDataFrame(files, "session_id string, file_path string, role string, status string").withColumn("hash", F.sha2("file_path", 256))
    runs = spark.createDataFrame([(s, f"/{s}.py") for s in "ABC"], "session_id string, script_path string")
    levels = spark.createDataFrame([("A", 0), ("B", 1), ("C", 2)], "session_id string, level int")
    nodes = exports.graph_nodes(runs, checked, levels)
    small, edges = exports.grouped_graph(nodes, checked, {"type": "pattern", "regex": "[0-9]+"})
    got = {(r["kind"], r["label"], r["size"], r["status"]) for r in small.where("kind <> 'script'").collect()}
    # what A wrote and B read is one node; C read two of the three, which is another group
    assert got == {("mixed", "part_{X}.csv (×3)", 3, "verified"), ("input", "part_{X}.csv (×2)", 2, "verified"), ("mixed", "out.csv", 1, "failed")}
    label = {r["id"]: r["label"] for r in small.collect()}
    assert sorted((label[r["source"]], label[r["target"]], r["n"]) for r in edges.collect()) == [
        ("A.py", "part_{X}.csv (×3)", 3), ("B.py", "out.csv", 1), ("out.csv", "C.py", 1), ("part_{X}.csv (×2)", "C.py", 2), ("part_{X}.csv (×3)", "B.py", 3)]
    text = exports.to_mermaid(small, edges)
    assert text.count("-->") == 5 and "group_" in text
    plain, whole = exports.grouped_graph(nodes, checked, "identity")
    assert {r["id"] for r in plain.collect()} == {r["id"] for r in nodes.collect()} and whole.count() == exports.graph_edges(nodes, checked).count()
    scripts, links = exports.script_graph(nodes, spark.createDataFrame([("B", "A"), ("C", "A"), ("C", "B"), ("C", "gone")], "child string, parent string"))
    assert scripts.count() == 3 and sorted((r["source"], r["target"]) for r in links.collect()) == [("script_0", "script_1"), ("script_0", "script_2"), ("script_1", "script_2")]
    none, no_edges = exports.grouped_graph(nodes.where("false"), checked.where("false"))
    assert none.count() == 0 and no_edges.count() == 0


def test_graphs_are_written_line_by_line(spark, tmp_path):
    nodes = spark.createDataFrame([("script_0", "script", "a <b>.py", "verified"), ("file_x", "output", "x", "failed")], "id string, kind string, label string, status string")
    edges = spark.createDataFrame([("script_0", "file_x")], "source string, target string")
    for name in ("g.json", "g.mmd", "g.html"):
        exports.render(nodes, edges, str(tmp_path / name), title="T")
    told = json.loads((tmp_path / "g.json").read_text())
    assert [n["id"] for n in told["nodes"]] == ["file_x", "script_0"] and told["links"] == [{"source": "script_0", "target": "file_x"}]
    assert json.loads(exports.to_json(nodes.where("false"), edges.where("false"))) == {"nodes": [], "links": []} and json.loads(exports.to_json(nodes, edges)) == told
    text = (tmp_path / "g.mmd").read_text()
    assert text == exports.to_mermaid(nodes, edges, "T") and text.startswith("---\ntitle: T\n---\ngraph TD\n") and "file_x([\"x\"]):::failed" in text and "script_0 --> file_x" in text
    page = (tmp_path / "g.html").read_text()
    assert "a &lt;b&gt;.py" in page and page.startswith("<!DOCTYPE html>") and page.endswith("</pre></body></html>\n")
    for bad in ("g.svg", "g"):
        with pytest.raises(ValueError):
            exports.render(nodes, edges, str(tmp_path / bad))
    with pytest.raises(ValueError):
        exports.render(nodes.where("false"), edges, str(tmp_path / "g.json"))


def test_groups_across_roles_are_mixed(spark):
    rows = spark.createDataFrame([("s", "/a1", "input"), ("s", "/a2", "output"), ("s", "/b", "output"), ("s", "/b", "input")], "session_id string, file_path string, role string").withColumn("hash", F.sha2("file_path", 256))
    together = lambda r: r.withColumn("group_id", F.when(F.col("file_path").startswith("/a"), "a")).withColumn("kind", F.lit("custom"))
    got = groupers.groups(together(groupers.start(rows)), across_roles=True)
    assert sorted((r["role"], r["size"]) for r in got.collect()) == [("input", 1), ("mixed", 2), ("output", 1)]
    assert groupers.groups(together(groupers.start(rows))).count() == 4


# --- re-runs ------------------------------------------------------------------

def test_failures_stop_what_reads_from_them(spark, tmp_path, monkeypatch):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    parents = {"a": [], "b": ["a"], "c": ["b"], "d": ["a"], "e": []}
    for s, ps in parents.items():
        ledger.add_run(s, f"/{s}.py")
    ledger.add_files(spark.createDataFrame([(s, f"/{s}.out", "output", s) for s in parents], "session_id string, file_path string, role string, hash string"))
    for s, ps in parents.items():
        for p in ps:
            ledger.add_parent(s, p)
    disk = spark.createDataFrame([], "file_path string, exists boolean, current_hash string, archived_hash string")
    ran = []
    ends = {"a": "verified", "b": "mismatch", "c": "verified", "d": "verified", "e": "missing"}
    monkeypatch.setattr(rerun, "run_again", lambda ledger, s, timeout: (ran.append(s), ends[s])[1])
    targets = spark.createDataFrame([(f"/{s}.out",) for s in "cd"], "file_path string")
    got = rerun.run_dag_again(ledger, targets, disk, workers=2)
    assert {r["session_id"]: (r["level"], r["action"], r["status"], r["failed"]) for r in got.collect()} == {
        "a": (0, "run", "verified", False), "b": (1, "run", "mismatch", True), "d": (1, "run", "verified", False), "c": (2, "blocked", "unknown", True)}
    assert sorted(ran) == ["a", "b", "d"] and ran[0] == "a"
    assert verify.rerun_summary(got).head().asDict() == {"status": "mismatch", "n_runs": 4, "n_failed": 2}
    ran.clear()
    nothing = rerun.run_claims_again(ledger, disk)  # no claims
    assert nothing.count() == 0 and verify.rerun_summary(nothing).head()["status"] == "unknown"
    ledger.add_claims(spark.createDataFrame([("/m.tex", "value", 1, None), ("/m.tex", "value", 2, "/e.out"), ("/n.tex", "figure", 1, "/a.out")],
                                            "file_path string, claim_type string, line_number int, source_file string"), disk)
    assert rerun.run_claims_again(ledger, disk, file_path="/nowhere.tex").count() == 0 and not ran
    assert [(r["session_id"], r["failed"]) for r in rerun.run_claims_again(ledger, disk, file_path="/m.tex").collect()] == [("e", True)] and ran == ["e"]
    assert verify.rerun_summary(rerun.run_claims_again(ledger, disk, claim_type="figure")).head()["status"] == "verified"


def test_single_parent_closures_double_their_paths(spark, monkeypatch):
    rng = random.Random(5)
    line = [(f"c{i:02}", f"c{i + 1:02}") for i in range(40)]
    ring = [("r0", "r1"), ("r1", "r2"), ("r2", "r0"), ("q0", "r1"), ("q1", "q0"), ("self", "self"), ("to_self", "self")]
    tree = [(f"t{i}", f"t{rng.randrange(i)}") for i in range(1, 30)]
    edges, made = line + ring + tree, []
    keep = lineage.materialize
    monkeypatch.setattr(lineage, "materialize", lambda df, name, *a, **k: made.append(name) or keep(df, name, *a, **k))
    nodes = sorted({n for e in edges for n in e} | {"alone"})
    got = {tuple(r) for r in lineage.closure(pairs(spark, edges), pairs(spark, [(n,) for n in nodes], "session_id string"), None).collect()}
    up, want = dict(edges), set()
    for n in nodes:
        met, at = [], n
        while at is not None and at not in met:
            met.append(at)
            at = up.get(at)
        want |= {(n, m, k) for k, m in enumerate(met)}
    assert got == want and len(made) <= 8
    some = lineage.closure(pairs(spark, edges), pairs(spark, [("c38",), ("q1",)], "session_id string"), None)
    assert {tuple(r) for r in some.collect()} == {r for r in want if r[0] in ("c38", "q1")}
    forked = lineage.closure(pairs(spark, [*edges, ("c38", "t3")]), pairs(spark, [("c38",)], "session_id string"), None)
    assert {r["session_id"] for r in forked.collect()} == brute_up([*edges, ("c38", "t3")], "c38", 99)


def test_groups_are_written_once(spark, monkeypatch):
    made, keep = [], exports.materialize
    monkeypatch.setattr(exports, "materialize", lambda df, name, *a: made.append(name) or keep(df, name, *a))
    checked = pairs(spark, [("A", "/d/p1", "output", "verified", "x"), ("A", "/d/p2", "output", "mismatch", "y")], "session_id string, file_path string, role string, status string, hash string")
    nodes = pairs(spark, [("a", "script", "A", "verified", "A")], "id string, kind string, label string, status string, session_id string")
    small, edges = exports.grouped_graph(nodes, checked, {"type": "pattern", "regex": "[0-9]+"})
    assert made == ["grouped-files", "groups"]
    assert {(r["kind"], r["status"]) for r in small.collect()} == {("script", "verified"), ("output", "failed")} and [r["n"] for r in edges.collect()] == [2]
