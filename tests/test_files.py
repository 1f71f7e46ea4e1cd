"""Listing, hashing and archives on real folders."""

import hashlib
import io
import os
import tarfile

from pyspark.sql import functions as F

from hashloom.sources import files

sha = lambda x: hashlib.sha256(x.encode()).hexdigest()


def pack(path, members, mode="w:gz"):
    with tarfile.open(path, mode) as tar:
        for name, text in members:
            info = tarfile.TarInfo(name)
            info.size = len(text.encode())
            tar.addfile(info, io.BytesIO(text.encode()))


def test_one_scan_for_all_missing_paths_of_an_archive(spark, tmp_path):
    pack(tmp_path / "run.tar.gz", [(f"run/sub/f{i}.txt", f"{i}") for i in range(1000)] + [("run/sub/f0.txt", "again"), ("./run/dotted", "d")])
    (tmp_path / "run").mkdir()  # the inner folder's archive outranks the outer one's
    pack(tmp_path / "run" / "deep.tar", [("deep/x", "inner")], "w")
    pack(tmp_path / "other.tar.xz", [("other/y", "y")], "w:xz")
    (tmp_path / "bad.tar").write_bytes(b"no archive" * 100)
    (tmp_path / "here").write_text("here")
    wanted = [f"{tmp_path}/run/sub/f{i}.txt" for i in range(1000)] + [f"{tmp_path}/{p}" for p in ("run/dotted", "run/none", "run/deep/x", "other/y", "bad/z", "here", "nowhere/q")]
    paths = spark.createDataFrame([(p,) for p in [*wanted, wanted[0]]], "file_path string").repartition(5)
    found = files.archived_hashes(paths.where("file_path not like '%/here'")).cache()
    assert found.where("file_path like '%/run/sub/%'").select("scan").distinct().count() == 1
    assert found.select("scan").distinct().count() == 3 and found.count() == 1003
    snap = {r["file_path"].removeprefix(f"{tmp_path}/"): (r["exists"], r["current_hash"], r["archived_hash"]) for r in files.disk_snapshot(paths).collect()}
    assert len(snap) == 1007 and all(snap[f"run/sub/f{i}.txt"] == (False, None, sha(str(i))) for i in range(1000))
    assert {k: v for k, v in snap.items() if "sub" not in k} == {
        "run/dotted": (False, None, sha("d")), "run/none": (False, None, None), "run/deep/x": (False, None, sha("inner")), "other/y": (False, None, sha("y")),
        "bad/z": (False, None, None), "here": (True, sha("here"), None), "nowhere/q": (False, None, None)}
    assert files.disk_snapshot(paths.where("false")).count() == 0


def test_conditions_on_members_reach_the_archive(spark, tmp_path):
    a, b = str(tmp_path / "a.tar.gz"), str(tmp_path / "b.tar")
    pack(a, [("top/x.csv", "x"), ("top/in/y.txt", "yy"), ("top/ü z.csv", "z")])
    pack(b, [("x.csv", "bx"), ("q/x.csv", "")], "w")
    t = files.tar_members(spark, [a, b])
    got = lambda df: sorted((r["archive"][-8:], r["member"], r["size_bytes"], r["hash"]) for r in df.collect())
    every = got(t)
    assert len(every) == 5 and t.rdd.getNumPartitions() == 2
    for condition, keep in ((F.col("member") == "x.csv", lambda m: m == "x.csv"), (F.col("member").isin("q/x.csv", "top/x.csv"), lambda m: m in ("q/x.csv", "top/x.csv")),
                            (F.col("member").startswith("top/"), lambda m: m.startswith("top/")), (F.col("member").endswith(".txt"), lambda m: m.endswith(".txt")),
                            (F.col("member").contains("ü") & (F.col("size_bytes") > 0), lambda m: "ü" in m), (F.lower("member") == "x.csv", lambda m: m.lower() == "x.csv")):
        assert got(t.where(condition)) == [r for r in every if keep(r[1])]
    reader = files._TarReader([a], "md5")
    assert list(reader.pushFilters([files.EqualTo(("member",), "x"), files.EqualTo(("archive",), "y")])) == [files.EqualTo(("archive",), "y")] and reader.tests == [("EqualTo", "x")]
    found = files.archive_members(spark, [a, b], "*.csv")
    assert sorted((r["archive"][-8:], r["member"]) for r in found.collect()) == sorted([("a.tar.gz"[-8:], "x.csv"), ("a.tar.gz"[-8:], "ü z.csv"), (b[-8:], "x.csv"), (b[-8:], "q/x.csv")])


def test_trees_are_listed_by_tasks(spark, tmp_path):
    root = tmp_path / "t"
    for k in range(4):
        (root / f"d{k}" / "in").mkdir(parents=True)
        (root / f"d{k}" / "in" / f"f{k}.csv").write_text(str(k))
    (root / ".hidden").write_text("h")
    (root / "d0" / "_x.txt").write_text("x")
    os.symlink(root, root / "d1" / "loop")  # a link to a folder above
    os.symlink(root / "d2" / "in", root / "d2" / "again")
    os.symlink(root / ".hidden", root / "link")
    os.symlink(root / "gone", root / "broken")
    names = lambda df: sorted(r["file_path"].removeprefix(f"{root}/") for r in df.collect())
    want = sorted(str(p.relative_to(root)) for p in root.rglob("*") if p.is_file())
    assert names(files.list_tree(spark, str(root))) == want == [".hidden", "d0/_x.txt", *(f"d{k}/in/f{k}.csv" for k in range(4)), "link"]
    linked = names(files.list_tree(spark, str(root) + "/", follow_links=True))
    assert len(linked) == len(want) and {os.path.basename(p) for p in linked} == {os.path.basename(p) for p in want}
    assert names(files.list_tree(spark, str(root), recursive=False)) == [".hidden", "link"]
    hashed = lambda *a, **k: {r["rel_path"]: r["hash"] for r in files.hash_directory(spark, str(root), *a, **k).collect()}
    assert hashed() == {p: sha((root / p).read_text()) for p in want}
    for pattern in ("*.csv", "in/f[12].csv", "f?.csv", "nothing", ".h*"):
        assert sorted(hashed(pattern)) == sorted(str(p.relative_to(root)) for p in root.rglob(pattern) if p.is_file())
    assert set(hashed("*", recursive=False)) == {".hidden", "link"}
    (tmp_path / "empty").mkdir()
    assert files.hash_directory(spark, str(tmp_path / "empty")).count() == 0
