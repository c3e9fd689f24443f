"""Links are looked up without a row per candidate path, and texts are read once."""

import contextlib
import io

from pyspark.sql import functions as F

from codeatlas.extract import imports
from codeatlas.plans import views
from codeatlas.resolve import graph as code_graph
from codeatlas.resolve import javascript, python, rust

from .corpora import contents


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(True)
    return out.getvalue()


def optimized(df):
    return plan(df).split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]


def source_rows(spark, rels):
    return spark.createDataFrame([("r", rel) for rel in rels], "repo string, rel string")


def test_js_base_meets_its_file_once(spark):
    rels = ["a/x.ts", "a/x.d.ts", "a/y.d.ts", "a/z/index.tsx", "a/index/index.ts", "a/k.foo.ts", "a/k.ts", "a/m.mts", "a/n.ts.ts", "a/index.foo.js", "a/q.tsx", "index.js", "a/p.ts", "a/p.ts"]
    asked = ["a/x", "a/x.js", "a/y", "a/z", "a/index", "a/k.foo", "a/k.bar", "a/m.mjs", "a/m.js", "a/n.ts", "a/index.foo", "a/q.jsx", "index", "a/p", "a/none"]
    bases = spark.createDataFrame([("r", b, 0) for b in asked], "repo string, base string, o int").withColumn("k", F.col("base"))
    found = javascript._first_base(bases, source_rows(spark, rels), ["repo", "k"], ["o"])
    # Every candidate tried in order.
    tried = bases.select("repo", "k", F.posexplode(javascript.probe_candidates(F.col("base"))).alias("i", "rel"))
    want = tried.join(source_rows(spark, rels), ["repo", "rel"]).groupBy("repo", "k").agg(F.min_by("rel", "i").alias("target"))
    got = {r.k: r.target for r in found.collect()}
    assert got == {r.k: r.target for r in want.collect()} and len(got) == 13 and found.count() == 13
    assert "posexplode" not in optimized(found)


def test_texts_are_searched_once(spark):
    rows = contents(spark, {"r": {"a.ts": "import x from './b';\n", "b.py": "import os\n"}})
    specs = imports.import_specs(rows)
    assert sorted((r.src, r.ord, r.spec) for r in specs.collect()) == [("a.ts", 0, "./b"), ("b.py", 0, "os")]
    assert not [line for line in optimized(specs).splitlines() if "Filter" in line and "regexp_extract_all" in line]


def test_asked_repository_alone_is_written(spark, tmp_path):
    frame = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    frame([(1, "A B", "Brand#1", "n m"), (2, "A C", "Brand#2", "o")], "p_partkey long, p_type string, p_brand string, p_name string", "part")
    frame([(1, 1, 1), (1, 2, 2)], "l_orderkey long, l_linenumber int, l_partkey long", "lineitem")
    every = {(r.repo, r.rel, r.content) for r in views.code(spark, str(tmp_path)).collect()}
    for repo in ("js", "py", "java", "rs", "go"):
        alone = {(r.repo, r.rel, r.content) for r in views.code(spark, str(tmp_path), repo).collect()}
        assert alone == {r for r in every if r[0] == repo} and alone


def test_rust_modules_of_many_users(spark, monkeypatch):
    uses = {f"src/use{i}.rs": "use crate::a::b::f;\nfn x() { crate::a::b::g(1); }\n" for i in range(20)}
    files = {"src/lib.rs": "mod a;\n", "src/a.rs": "", "src/a/b.rs": "", "src/a/mod.rs": "", **uses}
    seen = []
    real = rust.first_existing
    monkeypatch.setattr(rust, "first_existing", lambda c, keys, s: (seen.append(c.select(F.explode("cands")).count()), real(c, keys, s))[1])
    edges = {(r.src, r.dst) for r in code_graph.build(contents(spark, {"r": files})).edges.collect()}
    assert edges == {("src/lib.rs", "src/a.rs")} | {(u, "src/a/b.rs") for u in uses}
    assert sum(seen) < 40  # one user's candidates and those of one declaration, not twenty users'


def test_python_folders_without_the_first_part_are_not_tried(spark, monkeypatch):
    uses = {f"p/q/r{i}/use.py": "import kit.part.one\nimport kit.two\nimport lone\n" for i in range(5)}
    files = {"kit/part/one.py": "", "kit/two/__init__.py": "", "p/lone.py": "", "p/q/r1/src/kit/two.py": "", **uses}
    seen = []
    real = python.first_existing
    monkeypatch.setattr(python, "first_existing", lambda c, keys, s: (seen.append(c.select(F.explode("cands")).count()), real(c, keys, s))[1])
    edges = {(r.src, r.dst) for r in code_graph.build(contents(spark, {"r": files})).edges.collect()}
    want = {(u, "kit/part/one.py") for u in uses} | {(u, "p/lone.py") for u in uses}
    want |= {(u, "p/q/r1/src/kit/two.py" if "/r1/" in u else "kit/two/__init__.py") for u in uses}
    assert edges == want
    assert max(seen) < 5 * 3 * 16  # every name in every folder above would be 5 * 16 * (3 whole names and 2 heads)
