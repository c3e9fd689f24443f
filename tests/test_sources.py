"""Folder walks, version-control exports as git prints them, and sinks that commit."""

import os

import pytest
from pyspark.sql import functions as F

from codeatlas.operators import tree
from codeatlas.sources import corpus, sinks, vcs, walk


# ---- walks --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def checkouts(tmp_path_factory):
    root = tmp_path_factory.mktemp("checkouts")
    for rel, text in {"one/a.go": "package a", "one/b/c/d.py": "", "one/b/e.txt": "é", "two/x.md": "#", "two/.git/config": "x", "loose.txt": "-"}.items():
        (root / rel).parent.mkdir(parents=True, exist_ok=True)
        (root / rel).write_text(text)
    (root / "one/link").symlink_to("a.go")
    (root / "one/b/up").symlink_to("..")
    os.mkfifo(root / "two/pipe")
    (root / "three/empty").mkdir(parents=True)
    with open(os.fsencode(root) + b"/two/\xff.txt", "w"):
        pass
    here = os.open(root / "three", os.O_RDONLY)
    for _ in range(18):  # the whole path of the last folders is longer than a path may be
        os.mkdir("d" * 255, dir_fd=here)
        below = os.open("d" * 255, os.O_RDONLY, dir_fd=here)
        os.close(here)
        here = below
    os.close(here)
    return str(root)


def rows_of(df):
    return {(r.repo, r.rel): r for r in df.collect()}


@pytest.mark.parametrize("parts", [1, 3, 500])
def test_scan(spark, checkouts, parts):
    found = walk.scan(spark, checkouts, parts=parts).collect()
    got = {(r.repo, r.rel): (r.kind, r.size, r.is_dir, r.special) for r in found if len(r.rel) < 99}
    assert len(found) == len({(r.repo, r.rel) for r in found})
    assert got == {
        ("one", "a.go"): ("file", 9, False, False), ("one", "b"): ("dir", 0, True, False), ("one", "b/c"): ("dir", 0, True, False),
        ("one", "b/c/d.py"): ("file", 0, False, False), ("one", "b/e.txt"): ("file", 2, False, False), ("one", "link"): ("link", 0, False, True),
        ("one", "b/up"): ("link", 0, False, True), ("two", "x.md"): ("file", 1, False, False), ("two", ".git"): ("dir", 0, True, False),
        ("two", ".git/config"): ("file", 1, False, False), ("two", "pipe"): ("pipe", 0, False, True), ("two", "�.txt"): ("file", 0, False, False),
        ("three", "empty"): ("dir", 0, True, False),
    }
    deep = sorted((r.rel for r in found if len(r.rel) > 99), key=len)
    errors = [r for r in found if r.err is not None]
    assert [r.rel for r in errors] == [deep[-1]] and errors[0].err == "File name too long" and errors[0].is_dir
    assert all(r.mtime is not None for r in found if r.err is None)


def test_scan_counts(spark, checkouts):
    scanned = walk.scan(spark, checkouts)
    summary = {r.repo: (r.files, r.skipped, r.unreadable) for r in tree.scan_summary(scanned, tree.ScanOptions(ignore=["c/"])).collect()}
    assert summary == {"one": (2, 3, 0), "two": (2, 2, 0), "three": (0, 0, 1)}
    kept, special = corpus.drop_special(scanned)
    assert {r.repo: r.special for r in special.collect()} == {"one": 2, "two": 1, "three": 0}
    assert kept.where("kind in ('link', 'pipe')").count() == 0


def test_scan_of_one_repository(spark, checkouts):
    rows = rows_of(walk.scan(spark, checkouts + "/one", with_repo=False))
    assert set(rows) == {("one", r) for r in ("a.go", "b", "b/c", "b/c/d.py", "b/e.txt", "b/up", "link")}
    with pytest.raises(Exception, match="No such file"):
        walk.scan(spark, checkouts + "/gone").collect()


def test_read_folder(spark, checkouts):
    got = {(r.repo, r.rel): bytes(r.content) for r in corpus.read_folder(spark, checkouts + "/one", with_repo=False).collect()}
    assert got["one", "b/e.txt"] == "é".encode()


# ---- exports ------------------------------------------------------------------------------------

# Printed by git for two commits: files added, one of them renamed with an odd name, and a binary added.
LOG = (
    "\x1e340334cb\x1fd24d2843\x1f1796174650\0\nA\0bin\0R080\0d/é q\".txt\0d/n w.txt\0"
    "\x1ed24d2843\x1f\x1f1796174650\0\nA\0a => b.go\0A\0d/é q\".txt\0\x1e77\x1f340334cb 99\x1f1796174651\0"
)


@pytest.fixture
def log(spark, tmp_path):
    (tmp_path / "log").write_text(LOG)
    return vcs.parse_log(vcs.read_records(spark, str(tmp_path / "log"), "r"))


def test_log(log):
    rows = {r.commit_id: r for r in log.collect()}
    assert {k: r.parents for k, r in rows.items()} == {"340334cb": ["d24d2843"], "d24d2843": [], "77": ["340334cb", "99"]}
    assert [tuple(c) for c in rows["340334cb"].changes] == [("A", "", "bin"), ("R", 'd/é q".txt', "d/n w.txt")]
    assert [c.path for c in rows["d24d2843"].changes] == ["a => b.go", 'd/é q".txt'] and rows["77"].changes == []
    touched = {(r.commit_id, r.path) for r in vcs.touches(log).collect()}
    assert ("340334cb", 'd/é q".txt') in touched and ("340334cb", "d/n w.txt") in touched and len(touched) == 5
    parents = sorted((r.commit_id, r.parent or "", r["first"]) for r in vcs.commit_parents(log).collect())
    assert parents == [("340334cb", "d24d2843", True), ("77", "340334cb", True), ("77", "99", False), ("d24d2843", "", True)]


def test_commit_changes(spark, log):
    want = lambda *ids: spark.createDataFrame([("r", i) for i in ids], "repo string, commit_id string")
    got = {(r.commit_id, r.base, r.path, r.status) for r in vcs.commit_changes(log, want("d24d2843", "340334cb", "77")).collect()}
    assert got == {
        ("d24d2843", None, "a => b.go", "A"), ("d24d2843", None, 'd/é q".txt', "A"), ("340334cb", "d24d2843", "bin", "A"),
        ("340334cb", "d24d2843", "d/n w.txt", "R"),
    }
    with pytest.raises(ValueError, match="no commit 'zz'"):
        vcs.commit_changes(log, want("zz"))
    with pytest.raises(ValueError, match="shallow"):
        vcs.commit_changes(log, want("d24d2843"), want("d24d2843"))


def exports(spark, *texts):
    return [spark.createDataFrame([("r", t)], "repo string, value string") for t in texts]


def test_diff_both_forms(spark):
    want = {("bin", "A", 0, 0), ("d/n w.txt", "R", 1, 0), ("a => b.go", "M", 3, 4), ('t\tab"é', "D", 0, 7)}
    z = exports(
        spark, "A\0bin\0R080\0d/é q\".txt\0d/n w.txt\0M\0a => b.go\0D\0t\tab\"é\0",
        "-\t-\tbin\0" "1\t0\t\0d/é q\".txt\0d/n w.txt\0" "3\t4\ta => b.go\0" "0\t7\tt\tab\"é\0")
    assert {(r.path, r.status, r.added, r.deleted) for r in vcs.diff(*z).collect()} == want
    lines = [
        ["A\tbin", 'R080\t"d/\\303\\251 q\\".txt"\td/n w.txt', "M\ta => b.go", 'D\t"t\\tab\\"\\303\\251"'],
        ["-\t-\tbin", '1\t0\t"d/\\303\\251 q\\".txt" => d/n w.txt', "3\t4\ta => b.go", '0\t7\t"t\\tab\\"\\303\\251"'],
    ]
    rows = [spark.createDataFrame([("r", x) for x in part], "repo string, value string") for part in lines]
    assert {(r.path, r.status, r.added, r.deleted) for r in vcs.diff(*rows).collect()} == want


def test_rename_in_braces(spark):
    names, numbers = exports(spark, "R100\tsrc/old/a.go\tsrc/new/a.go", "5\t6\tsrc/{old => new}/a.go")
    assert [tuple(r) for r in vcs.diff(names, numbers).select("path", "added", "deleted").collect()] == [("src/new/a.go", 5, 6)]
    names, numbers = exports(spark, "R100\tsrc/a/b.go\tsrc/b.go", "5\t6\tsrc/{a => }/b.go")
    assert [r.path for r in vcs.diff(names, numbers).collect()] == ["src/b.go"]


def test_status_both_forms(spark):
    want = {("bin", "D"), ("c -> d.go", "R"), ("tab\tx", "?"), ("M q", "M"), ("u", "U"), ("C x", "A")}
    z, = exports(spark, "D  bin\0R  c -> d.go\0a => b.go\0?? tab\tx\0 M M q\0AA u\0A  C x\0")
    assert {(r.path, r.status) for r in vcs.status_z(z).collect()} == want
    lines = ["D  bin", 'R  "a => b.go" -> "c -> d.go"', '?? "tab\\tx"', ' M "M q"', "AA u", 'A  "C x"', ""]
    rows = spark.createDataFrame([("r", x) for x in lines], "repo string, value string")
    assert {(r.path, r.status) for r in vcs.parse_status(rows).collect()} == want


def test_unquoted(spark):
    cases = {
        "plain": "plain", '"a b"': "a b", '"\\303\\251\\n\\\\x\\""': 'é\n\\x"', '"\\360\\237\\230\\200"': "\U0001f600", '"': '"', "": "", '""': "",
        '"\\a\\b\\t\\v\\f\\r"': "\a\b\t\v\f\r", 'x"y': 'x"y',
    }
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r.p: r.u for r in df.select("p", vcs.unquoted(F.col("p")).alias("u")).collect()} == cases


# ---- sinks --------------------------------------------------------------------------------------


def test_prompt_files(spark, tmp_path):
    packs = spark.createDataFrame([("r/1", "a b", "é\n"), ("r/1", "c", None), ("s", "../x", "y")], "repo string, name string, text string")
    at = str(tmp_path / "out")
    assert sinks.write_prompt_files(packs, at) == 3
    assert {str(p.relative_to(at)): p.read_text() for p in (tmp_path / "out").rglob("*.txt")} == {
        "r%2F1/a%20b.txt": "é\n", "r%2F1/c.txt": "", "s/..%2Fx.txt": "y"}
    with pytest.raises(FileExistsError):
        sinks.write_prompt_files(packs, at)
    assert sinks.write_prompt_files(packs.limit(1), at, overwrite=True) == 1
    assert len(list((tmp_path / "out").rglob("*.txt"))) == 1


@pytest.mark.parametrize("write", [
    lambda df, at: sinks.write_json(df, "x", at), lambda df, at: sinks.write_prompts(df, at), lambda df, at: sinks.write_prompt_files(df, at)])
def test_a_failed_job_leaves_nothing(spark, tmp_path, write):
    broken = spark.range(0, 40, 1, 4).selectExpr("'r' as repo", "cast(id as string) as name", "if(id = 33, raise_error('late'), 'ok') as text")
    with pytest.raises(Exception, match="late"):
        write(broken, str(tmp_path / "out"))
    assert os.listdir(tmp_path) == []
    write(broken.where("name <> '33'"), str(tmp_path / "out"))
    assert [p for p in os.listdir(tmp_path) if not p.endswith(".crc")] == ["out"]


def test_prompt_table(spark, tmp_path):
    packs = spark.createDataFrame([("r", "n", "t")], "repo string, name string, text string")
    sinks.write_prompts(packs, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).collect() == packs.collect()
