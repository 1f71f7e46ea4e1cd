"""Configuration, lists, artifacts, estimates and claims as users meet them."""

import json
import warnings

import pytest
from pyspark.sql import functions as F

from hashloom.functions import hashes
from hashloom.operators import estimate, groupers
from hashloom.sources import documents
from hashloom.sources.ledger import Ledger


def test_configuration_in_layers(tmp_path):
    user, project = tmp_path / "user", tmp_path / "proj" / ".hashloom"
    (project / "config").mkdir(parents=True)
    user.mkdir()
    (user / "config.yaml").write_text("verify:\n  severity: {no_lineage: warning, unsourced: ignore}\n")
    (user / "config.yml").write_text("never: read\n")
    (project / "config.json").write_text('{"verify": {"severity": {"no_lineage": "error"}}}')
    (project / "config" / "b.yml").write_text("x: 2\n")
    (project / "config" / "a.yaml").write_text("x: 1\ny: 1\n")
    (project / "config" / "empty.yaml").write_text("")
    got = documents.load_config(str(user), str(tmp_path / "absent"), str(project))
    assert got == {"verify": {"severity": {"no_lineage": "error", "unsourced": "ignore"}}, "x": 2, "y": 1}
    (tmp_path / "last.yaml").write_text("x: 3\n")
    assert documents.load_config(str(project), explicit=str(tmp_path / "last.yaml"))["x"] == 3
    with pytest.raises(FileNotFoundError):
        documents.load_config(str(project), explicit=str(tmp_path / "none.yaml"))
    for bad in ("- a list\n", "a: [1\n"):
        (tmp_path / "bad.yaml").write_text(bad)
        with pytest.raises(ValueError):
            documents.load_config(str(tmp_path / "bad.yaml"))


def test_a_projects_grouper(spark, tmp_path):
    deep = tmp_path / "a" / "b"
    deep.mkdir(parents=True)
    assert documents.project_config(str(deep)) == {}
    (tmp_path / ".hashloom").mkdir()
    (tmp_path / ".hashloom" / "config.yaml").write_text("grouper:\n  type: compose\n  steps:\n    - {type: pattern, regex: 'P\\d{2}'}\n    - {type: directory, min_size: 2}\npath_mode: name\n")
    config = documents.project_config(str(deep))
    assert config["path_mode"] == "name"
    rows = spark.createDataFrame([("s", "output", f"/d/P0{i}.csv", "aa") for i in range(3)] + [("s", "output", "/d/x", "aa"), ("s", "output", "/d/y", "aa")], "session_id string, role string, file_path string, hash string")
    got = groupers.groups(groupers.resolve(config["grouper"])(groupers.start(rows)))
    assert sorted((r["kind"].split(":")[0], r["size"]) for r in got.collect()) == [("directory", 2), ("pattern", 3)]


def test_lists_of_sources(spark, tmp_path):
    (tmp_path / "a").write_text("a")
    manifest, listed = str(tmp_path / "m.json"), tmp_path / "list.txt"
    listed.write_text(f"# sources\n{tmp_path}/a\n\n{tmp_path}/a\n{tmp_path}/none\n")
    with pytest.raises(FileNotFoundError, match="none"):
        documents.register_list(spark, str(listed), manifest)
    assert documents.read_manifest(spark, manifest) is None
    listed.write_text(f"{tmp_path}/a\n")
    assert documents.register_list(spark, str(listed), manifest, dry_run=True) == 1 and documents.read_manifest(spark, manifest) is None
    assert documents.register_list(spark, str(listed), manifest) == 1 and documents.read_manifest(spark, manifest)[0].count() == 1
    assert documents.unregister_sources(manifest, [f"{tmp_path}/a"], dry_run=True) == 1 and documents.read_manifest(spark, manifest)[0].count() == 1
    with pytest.raises(FileNotFoundError):
        documents.read_path_list(spark, str(tmp_path / "no.txt"))


@pytest.mark.parametrize("schema, n", [("tool/citations/v1", 1), ("tool/citations/v2.3", 1), ("tool/citations", 1), ("tool/claims/v1", None), ("x y/citations/v1", None), (None, None)])
def test_citation_artifacts_of_any_version(spark, tmp_path, schema, n):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"schema": schema, "citations": [{"cite_key": "k"}]}))
    got = documents.read_citation_artifact(spark, str(path))
    assert (got and got.count()) == n


def test_claims_without_lineage_warn(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "l"))
    ledger.add_files(spark.createDataFrame([("s", "/made", "output", "h")], "session_id string, file_path string, role string, hash string"))
    none = spark.createDataFrame([], "file_path string, exists boolean, current_hash string")
    rows = lambda *src: spark.createDataFrame([("/m.tex", "value", k, s) for k, s in enumerate(src)], "file_path string, claim_type string, line_number int, source_file string")
    with pytest.warns(RuntimeWarning, match="2 source files .* /raw1"):
        ledger.add_claims(rows("/made", "/raw2", "/raw1", None), none)
    told = []
    with warnings.catch_warnings():
        warnings.simplefilter("error", RuntimeWarning)
        ledger.add_claims(rows("/made", None), none, export=lambda l: told.append(l.view("claims").count()))
        ledger.add_claims(rows("/raw1"), none, warn=False)
    assert told == [4]

    def broken(_):
        raise OSError("read-only")
    with pytest.warns(RuntimeWarning, match="not exported"):
        ledger.add_claims(rows("/made"), none, export=broken)
    assert ledger.view("claims").count() == 4  # the source is no part of a claim's id, its line is


def test_hints_of_estimates(spark):
    rows = [("exact_hash", 30.0, 1.0, False, 500), ("path_history", 400.0, 0.75, True, 3 * 1024 ** 2), ("exact_hash", 90.0, 0.5, False, None), ("unknown", None, None, False, None)]
    d = spark.createDataFrame(rows, "tier string, p90 double, rate double, heavy boolean, bytes bigint")
    got = [r[0] for r in d.select(estimate.hint(*map(F.col, ("tier", "p90", "rate", "heavy", "bytes")))).collect()]
    assert got == ["up to 30 s; output of about 500 B", "the script has changed: told from its earlier versions; long: up to 7 min; try a part first, or run it in the background; output of about 3.0 MB; 25% of the runs failed",
                   "up to 2 min; 50% of the runs failed", "no earlier runs: nothing to estimate from"]


def test_paths_as_they_are_shown(spark):
    d = spark.createDataFrame([("/proj/a/b.py",), ("/other/c.py",), ("rel/d.py",), ("",), (None,), ("unknown",)], "p string")
    shown = lambda *a: [r[0] for r in d.select(hashes.display_path(F.col("p"), *a)).collect()]
    assert shown("name") == ["b.py", "c.py", "d.py", "unknown", "unknown", "unknown"]
    assert shown("relative", "/proj") == ["a/b.py", "/other/c.py", "rel/d.py", "unknown", "unknown", "unknown"]
    assert shown("absolute", "/proj/") == ["/proj/a/b.py", "/other/c.py", "/proj/rel/d.py", "unknown", "unknown", "unknown"]
    with pytest.raises(ValueError):
        hashes.display_path(F.col("p"), "short")
