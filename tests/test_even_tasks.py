"""Work that is dear by the row is spread by rows, not by bytes."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codeatlas.extract import golang as go
from codeatlas.plans import catalog, projects, views
from codeatlas.resolve import golang, javascript
from codeatlas.resolve import graph as code_graph
from codeatlas.streaming import incremental

from .corpora import contents

TEXTS = [
    "package p\n\nimport (\n\td \"a/b\"\n\t. \"c\"\n)\n\ntype T struct{ x int }\n\nfunc (t *T) M(a, b int) (*T, error) {\n\tu := newT(a)\n\treturn u.N(d.F1), nil\n}\n",
    "package p\n\nvar a, b = newT(1), T{2}\n\nfunc newT(x ...int) *T {\n\tvar q T\n\treturn &q\n}\n", "", None,
]


def _tables(spark, root, n):
    frame = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{root}/{name}.parquet")
    frame([(k, "A B", "Brand#1", "n") for k in range(n)], "p_partkey long, p_type string, p_brand string, p_name string", "part")
    frame([(k, i, (k + i) % n) for k in range(n) for i in (1, 2)], "l_orderkey long, l_linenumber int, l_partkey long", "lineitem")


def _most(df):
    return df.groupBy(F.input_file_name().alias("f")).count().agg(F.max("count")).first()[0]


@pytest.mark.parametrize("made", [lambda s, d: views.code(s, d, "go"), projects.workspace, projects.exporters])
def test_a_staged_corpus_has_small_files(spark, tmp_path, monkeypatch, made):
    _tables(spark, tmp_path, 30)
    whole = {(r.rel, r.content) for r in made(spark, str(tmp_path)).collect()}
    monkeypatch.setattr(views, "TEXTS_PER_FILE", 4)
    monkeypatch.setattr(projects, "TEXTS_PER_FILE", 4)
    df = made(spark, str(tmp_path))
    assert _most(df) <= 4 and {(r.rel, r.content) for r in df.collect()} == whole and len(whole) >= 60


def test_asked_specs_have_small_files(spark, monkeypatch):
    monkeypatch.setattr(javascript, "SPECS_PER_FILE", 4)
    kept = []
    monkeypatch.setattr(javascript, "stage", lambda *a, **k: kept.append(stage(*a, **k)) or kept[-1])
    from codeatlas.storage import stage

    specs = spark.range(40).selectExpr("'r' as repo", "concat('a/f', id, '.ts') as src", "'a' as dir", "'js' as lang", "0 as ord", "concat('./g', id) as spec")
    sources = spark.range(40).selectExpr("'r' as repo", "concat('a/g', id, '.ts') as rel")
    found = javascript.resolve(specs, sources, specs.selectExpr("repo", "src as rel", "'' as content").where("false"))
    assert found.count() == 40 and _most(kept[0][0]) <= 4


def test_facts_as_columns():
    batch = pa.RecordBatch.from_pydict({
        "repo": pa.array(["r", None, "r", "s"]), "rel": pa.array(["a.go", "b.go", "c.go", "d.go"]), "content": pa.array(TEXTS, pa.string())})
    rows = [{"repo": o, "rel": r, **go.facts(t or "")} for o, r, t in zip(*(batch.column(c).to_pylist() for c in ("repo", "rel", "content")))]
    out = pa.Table.from_batches(list(go._run(iter([batch]))))
    assert out.to_pylist() == rows and out.schema.equals(go._ARROW) and go._lists(rows, go._ARROW.field("refs")).to_pylist() == [r["refs"] for r in rows]


def test_a_place_among_candidates_without_making_them(spark):
    stems = ["a", "a.js", "a.mjs", "a.d", "a/index", "index", "a.b.c", "", "a.", ".x", "é.jsx", "a/b.ts", "a/index.ts"]
    every = sorted({t + e for t in [*stems, "é", "a/b"] for e in ("", "x", ".TS", "/index", *javascript.EXTS, *["/index" + e for e in javascript.EXTS])})
    pairs = spark.createDataFrame([(b, r) for b in [*stems, None] for r in [*every, None]], "base string, rel string")
    base, rel = F.col("base"), F.col("rel")
    rows = pairs.select("base", "rel", F.nullif(F.array_position(javascript.probe_candidates(base), rel), F.lit(0)).alias("want"), javascript._position(base, rel).alias("got"),
                        (javascript._core(rel) == F.regexp_replace(rel, javascript._CORE_END, "")).alias("core")).collect()
    assert [r for r in rows if r.want != r.got or r.core is False] == [] and len({r.want for r in rows}) == 23
    assert "_position" in javascript._first_base.__code__.co_names


def test_go_owners_are_found_once(spark, monkeypatch):
    calls, real = [], golang.owners
    monkeypatch.setattr(golang, "owners", lambda t: calls.append(1) or real(t))
    g = code_graph.build(contents(spark, {"r": {
        "go.mod": "module ex\n", "a/x.go": "package a\n\ntype T int\n\nfunc F() {}\n", "a/y.go": "package a\n\nfunc (t T) M() {}\n\nvar z = F\n",
        "b/u.go": "package b\n\nimport \"ex/a\"\n\nvar q = a.F\n", "a/w.go": "package a\n\nfunc W(p any) { p.M() }\n"}}))
    assert {(r.src, r.dst) for r in g.edges.collect()} == {("a/y.go", "a/x.go"), ("b/u.go", "a/x.go"), ("a/w.go", "a/y.go")} and len(calls) == 1


def test_users_of_moved_names_meet_the_names_first(spark):
    frame = lambda cols, *rows: spark.createDataFrame(list(rows), ", ".join(f"{c} string" for c in cols.split()))
    files = frame("repo src dir pkg is_test walk", ("r", "a/x.go", "a", "a", "", ""), ("r", "a/y.go", "a", "a", "", ""), ("r", "b/z.go", "b", "b", "", ""))
    t = golang.GoTables(
        files, None, None, frame("repo src recv name", ("r", "a/x.go", "T", "m")), frame("repo src name", ("r", "a/y.go", "F"), ("r", "b/z.go", "F"), ("r", "a/x.go", "G")),
        frame("repo src name", ("r", "a/y.go", "m"), ("r", "b/z.go", "m")), frame("repo src to_dir", ("r", "b/z.go", "a")), frame("repo src name", ("r", "b/z.go", "F")))
    none = spark.createDataFrame([], "repo string, dir string")
    moved = frame("repo dir name recv", ("r", "a", "F", ""), ("r", "a", "T", ""))
    found = incremental._users(t, moved, none)
    assert sorted(r.src for r in found.collect()) == ["a/y.go", "b/z.go"]
    # No more than the users of a moved name go on to meet the files.
    assert found._jdf.queryExecution().analyzed().toString().count("LeftSemi") >= 8


def test_specs_of_a_file_travel_together(spark, tmp_path):
    _tables(spark, tmp_path, 30)
    found = catalog.QUERIES["code_specs"](spark, str(tmp_path))
    rows = {(r.repo, r.src, r.spec): r.n for r in found.collect()}
    assert len(rows) == found.count() and sum(rows.values()) > len(rows) >= 30 * 10  # a Rust file asks for one module twice
    shuffles = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning" in line]
    assert shuffles and "spec#" not in "".join(shuffles)
