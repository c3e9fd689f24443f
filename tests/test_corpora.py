"""Whole repositories: links, reasons, context, impact, tests to run, and reports."""

import json
import os

import pytest
from pyspark.sql import functions as F

from codeatlas import storage
from codeatlas.extract.imports import js_imports, py_imports
from codeatlas.functions import labels
from codeatlas.operators import declarations, explain, impact, rules, testplan
from codeatlas.operators.tree import ScanOptions
from codeatlas.plans import reports
from codeatlas.resolve import graph as code_graph
from codeatlas.sources import corpus, sinks

from .corpora import EXPECTED, RELAY, contents

COUNTER = {
    "go.mod": "module count.test/er\n",
    "tally.go": "package er\n\nfunc Up() int { return 1 }\n\nfunc Down() int { return -1 }\n",
    "view.go": "package er\n\nfunc Show() int { return Up() }\n",
    "tally_test.go": 'package er\n\nimport "testing"\n\nfunc TestShow(t *testing.T) { Show() }\n\nfunc TestDown(t *testing.T) { Up := Down(); _ = Up }\n\n'
    "func TestIdle(t *testing.T) {}\n",
}
QUEUE = {
    "go.mod": "module queue.test/q\n",
    "job.go": "package q\n\nfunc Job() {}\n\nfunc direct() { Job() }\n",
    "worker.go": "package q\n\ntype Worker struct{}\n\nfunc (w *Worker) start() { Job() }\n",
    "timer.go": "package q\n\ntype Timer struct{}\n\nfunc (t *Timer) start() {}\n\nfunc (t *Timer) Tick() { t.start() }\n",
}
LEDGER = {
    "go.mod": "module led.test/ger\n",
    "book/book.go": 'package book\n\ntype Page struct{}\n\nfunc (Page) Title() string { return "" }\n\nfunc (Page) Lines() int { return 0 }\n',
    "print/print.go": 'package print\n\nimport "led.test/ger/book"\n\nfunc Head(p book.Page) string { return p.Title() }\n\nfunc Body(p book.Page) int { return p.Lines() }\n',
    "print/print_test.go": 'package print\n\nimport (\n\t"testing"\n\n\t"led.test/ger/book"\n)\n\nfunc TestHead(t *testing.T) { Head(book.Page{}) }\n\n'
    "func TestBody(t *testing.T) { Body(book.Page{}) }\n\nfunc TestEmpty(t *testing.T) {}\n",
}
KILN = {
    "pyproject.toml": "[tool.pytest.ini_options]\n", "kiln/__init__.py": "", "kiln/heat.py": "def fire():\n    return 1\n",
    "kiln/oven.py": "from kiln import heat\n", "checks/conftest.py": "from kiln.oven import heat\n",
    "checks/test_plain.py": "def test_plain(oven):\n    pass\n", "checks/test_heat.py": "from kiln.heat import fire\n\ndef test_heat():\n    fire()\n",
}
RUNNERS = {
    "svc/pyproject.toml": "[tool.pytest.ini_options]\n", "svc/m.py": "", "svc/test_m.py": "import m\n",
    "front/package.json": '{"devDependencies": {"vitest": "2"}}', "front/calc.ts": "", "front/calc.spec.ts": "import './calc';\n",
    "bare/package.json": '{"name": "bare"}', "bare/a.js": "", "bare/a.test.js": "require('./a');\n",
}
MILLS = {
    "Cargo.toml": '[workspace]\nmembers = ["crates/*"]\n', "crates/mill/Cargo.toml": '[package]\nname = "mill"\n',
    "crates/mill/src/lib.rs": "pub fn grind() {}\n", "crates/mill/tests/grind_ok.rs": "use mill::grind;\n",
}
ALMANAC = {
    "README.md": "# Almanac\n\nPrints when the sun sets.\n", "go.mod": "module al.test/manac\n",
    "cmd/sun/main.go": 'package main\n\nimport "al.test/manac/internal/sky"\n\nfunc main() { println(sky.Set()) }\n',
    "internal/sky/sky.go": "package sky\n\nfunc Set() int { return 19 }\n",
    "internal/sky/sky_test.go": 'package sky\n\nimport "testing"\n\nfunc TestSet(t *testing.T) { Set() }\n',
}
EXTRA = {"counter": COUNTER, "queue": QUEUE, "ledger": LEDGER, "kiln": KILN, "runners": RUNNERS, "mills": MILLS, "almanac": ALMANAC}


@pytest.fixture(scope="module")
def texts(spark):
    return contents(spark, {**{k: v[0] for k, v in EXPECTED.items()}, **EXTRA}).cache()


@pytest.fixture(scope="module")
def graph(texts):
    return code_graph.build(texts)


@pytest.fixture(scope="module")
def symbols(texts, graph):
    return code_graph.all_symbols(texts, graph).cache()


@pytest.fixture(scope="module")
def decls(graph):
    return code_graph.declarations(graph)


def test_links(graph):
    got = {}
    for r in graph.edges.collect():
        got.setdefault(r.repo, {}).setdefault(r.src, []).append(r.dst)
    for repo, (_, want) in EXPECTED.items():
        assert {k: sorted(v) for k, v in got.get(repo, {}).items()} == want, repo


def test_nothing_is_left_out_for_size(spark):
    big = "// " + "x" * (1 << 20) + "\nimport './b';\n"
    rows = contents(spark, {"big": {"a.ts": big, "b.ts": ""}})
    assert [(r.src, r.dst) for r in code_graph.build(rows).edges.collect()] == [("a.ts", "b.ts")]
    many = spark.range(50_010).selectExpr("'many' as repo", "concat('f', id, '.ts') as rel")
    assert corpus.select_sources(many).count() == 50_010


def test_hidden_folders_hold_no_sources(spark):
    link = "import './b';\n"
    rows = contents(spark, {"h": {
        "a.ts": link, "b.ts": "", "node_modules/p/a.ts": link, "node_modules/p/b.ts": "", ".cache/a.ts": link, ".cache/b.ts": "",
        "gen/a.ts": link, "gen/b.ts": ""}})
    edges = lambda **o: sorted(r.src for r in code_graph.build(rows, options=ScanOptions(**o)).edges.collect())
    assert edges() == ["a.ts", "gen/a.ts"] and edges(ignore=["gen/"]) == ["a.ts"]


def test_staged_tables_can_be_cleared(spark):
    df, _ = storage.stage(spark.range(3), "cleared")
    path = storage._staged[spark.sparkContext.applicationId].pop()
    kept, storage._staged[spark.sparkContext.applicationId] = storage._staged[spark.sparkContext.applicationId], [path]
    try:
        assert df.count() == 3 and storage.clear(spark) == 1 and not os.path.exists(path)
    finally:
        storage._staged[spark.sparkContext.applicationId] = kept


def test_specs(spark):
    js = (
        "import def, {\n  part,\n} from './lines';  // import q from './no'\nexport * as all from \"./all\"\n/* require('./never') */\n"
        "const t = `import './text'`;\nconst u = 'http://x.test'; await import( './later' );\nlet r = require( './old' );\n"
    )
    py = "from .sibling import (  # why\n    one,\n    two as deux,\n)\nimport a.b as c, d\nfrom ...up.two import *\nfrom . import here  # x\n"
    row = spark.createDataFrame([(js, py)], "js string, py string").select(js_imports(F.col("js")), py_imports(F.col("py"))).first()
    assert sorted(row[0]) == ["./all", "./later", "./lines", "./old"]
    assert sorted(row[1]) == [".", "...up.two", ".here", ".sibling", ".sibling.one", ".sibling.two", "a.b", "d"]


def test_reasons(graph):
    got = {(r.repo, r.src, r.dst): r.reason for r in explain.edge_reasons(graph).collect()}
    assert got["relay", "wire/wire.go", "spark/spark.go"] == "uses spark.Light" and got["relay", "wire/wire_test.go", "wire/wire.go"] == "uses Carry"
    assert got["relay", "ui/b.ts", "ui/a.ts"] == "imports ./a.js" and got["harbor", "alias.go", "chart/scale.go"] == "uses c.Scale"
    assert got["harbor", "side.go", "chart/plot.go"] == "imports tide.test/harbor/chart" and all(got.values())


def test_dependents_report(graph, spark):
    start = spark.createDataFrame([("relay", "spark/spark.go")], "repo string, rel string")
    rows = reports.related(graph, start, reverse=True, depth=2).orderBy("depth", "is_test", "rel").collect()
    assert [(r.rel, r.depth, r.via, r.reason) for r in rows] == [
        ("wire/wire.go", 1, None, "uses spark.Light"), ("bulb/bulb.go", 2, "wire/wire.go", "uses wire.Carry"), ("wire/wire_test.go", 2, "wire/wire.go", "uses Carry")]
    bare = reports.related(graph, start, reverse=True, depth=None, no_tests=True)
    assert sorted(r.rel for r in bare.collect()) == ["bulb/bulb.go", "wire/wire.go"]


def test_check(graph):
    parsed = rules.parse_rules("wire/ -> spark/\n# none:\nbulb/ -> spark/\n**/b.ts -> ui/a.ts\nroof/ -> spark/\n")
    files, edges = graph.files.where("repo = 'relay'"), graph.edges.where("repo = 'relay'")
    got = sorted((r.line, r["from"], r.to) for r in rules.violations(edges, files, parsed).collect())
    assert got == [(1, "wire/wire.go", "spark/spark.go"), (4, "ui/b.ts", "ui/a.ts")]
    assert [r.line for r in rules.unmatched_rules(files, parsed).collect()] == [5]
    assert {r.line: (r.violations, r.checked) for r in rules.rule_report(edges, files, parsed).collect()} == {1: (1, 5), 3: (0, 5), 4: (1, 5), 5: (0, 5)}


def test_context(graph, texts, symbols, spark):
    start = spark.createDataFrame([("relay", "wire/wire.go"), ("relay", "spark/spark.go")], "repo string, rel string")
    got = {r.rel: r.text for r in reports.context(graph, texts, symbols, start).collect()}
    assert got["wire/wire.go"] == (
        "# wire/wire.go\n1 dependency · 1 direct user · 1 test reach it\n\n## depends on (and what it uses from each)\n"
        "spark/spark.go — uses spark.Light\n  func Light() int\n\n## used by\nbulb/bulb.go — uses wire.Carry\n\n## tests that reach it\ngo test ./wire\n"
        "wire/wire_test.go\n\n## declares\nfunc Carry(n int) int\n"
    )
    assert "2 affected through them" in got["spark/spark.go"]
    small = reports.context(graph, texts, symbols, start.where("rel = 'wire/wire.go'"), budget=40).first().text
    assert "raise --budget" in small and (len(small.encode()) + 3) // 4 <= 60


def test_sections_fit_their_room():
    text, cost = reports._section("names", ["aaaa", "bbbb", "cccc"], 9, 9)
    assert text == "\n## names: 9 (raise --budget)\n" and cost == 6
    text, cost = reports._section("names", ["aaaa", "bbbb", "cccc"], 9, 13)
    assert text == "\n## names\naaaa\nbbbb\ncccc\n" and cost == 9
    text, cost = reports._section("names", ["a" * 11, "b" * 11, "c" * 11], 9, 11)
    assert text == "\n## names\n" + "a" * 11 + "\n" + "b" * 11 + "\n+7 more\n" and cost == 12


def test_symbols(symbols):
    got = {(r.repo, r.rel): r.symbols for r in symbols.collect()}
    assert got["relay", "spark/spark.go"] == ["func Light() int", "type Idle struct"]
    assert got["lantern", "src/glass/tint.rs"] == ["pub(crate) fn shade(of: u8) -> u8"]
    assert got["tide", "kotlin/org/tide/Dock.kt"] == ["fun dock()"] and got["tide", "src/main/java/org/tide/boats/Tug.java"] == ["public record Tug"]
    assert got["queue", "timer.go"] == ["type Timer struct", "func (t *Timer) Tick()", "func (t *Timer) start()"]
    assert got["relay", "ui/b.ts"] == ["export const b"] and got["deep", "deep/a/b/c/d/e/gate.py"] == ["class Gate: ..."]


def reached(graph, decls, repo, file, symbol):
    only = lambda df: df.where(F.col("repo") == repo)
    rows = declarations.symbol_impact(only(graph.edges), only(graph.files), only(decls[0]), only(decls[1]), file, symbol, None)
    return {x.rel: (x.depth, x.reason) for x in rows.collect()}


def test_symbol_impact(graph, decls):
    up = reached(graph, decls, "counter", "tally.go", "Up")
    assert up["view.go"] == (1, "in Show") and up["tally_test.go"] == (2, "in TestShow")
    job = reached(graph, decls, "queue", "job.go", "Job")
    assert job == {"job.go": (1, "in direct"), "worker.go": (1, "in Worker.start")}
    assert reached(graph, decls, "ledger", "book/book.go", "Title")["print/print.go"] == (1, "uses Title")


def narrowed(graph, decls, repo, changed, spark, symbol=None):
    only = lambda df: df.where(F.col("repo") == repo)
    ch = spark.createDataFrame([(repo, c) for c in changed], "repo string, rel string")
    hits = impact.affected(only(graph.edges), only(graph.files), ch)
    seeds = declarations.symbol_keys(only(decls[0]), F.lit(changed[0]), symbol) if symbol else None
    run, whole = declarations.go_test_run(only(graph.edges), only(graph.files), only(decls[0]), only(decls[1]), ch, hits, seeds)
    return sorted((x.dir, x.name) for x in run.collect()), sorted((x.dir, x.reached, x.total) for x in whole.collect())


def test_narrowing(graph, decls, spark):
    assert narrowed(graph, decls, "counter", ["view.go"], spark) == ([(".", "TestShow")], [])
    assert narrowed(graph, decls, "ledger", ["book/book.go"], spark, "Title") == ([("print", "TestHead")], [])


def test_mention_impact_and_fixtures(graph, texts, spark):
    only = lambda df: df.where("repo = 'kiln'")
    rows = declarations.mention_impact(only(graph.edges), only(graph.files), only(texts), "kiln/heat.py", "fire").collect()
    assert [r.rel for r in rows] == ["checks/test_heat.py"]
    changes = spark.createDataFrame([("kiln", "kiln/oven.py", "M"), ("kiln", "glaze.txt", "M"), ("kiln", "cold.py", "D")], "repo string, path string, status string")
    out = reports.impact_report(graph, texts, changes)
    hits = {r.rel: r for r in out["affected"].collect()}
    assert hits["checks/test_plain.py"].reason == "pytest fixtures" and hits["checks/test_plain.py"].depth == 2
    assert sorted(r.rel for r in out["tests"].collect()) == ["checks/test_heat.py", "checks/test_plain.py"]
    assert [r.rel for r in out["not_in_graph"].collect()] == ["glaze.txt"] and [r.rel for r in out["deleted"].collect()] == ["cold.py"]
    assert [(r.dir, r.argv) for r in out["test_commands"].collect()] == [
        (".", ["python", "-m", "pytest", "checks/test_heat.py", "checks/test_plain.py"])]


def test_commands(graph, texts):
    tests = graph.files.where(labels.is_runnable_test(F.col("rel"), F.col("is_test"))).select("repo", "rel")
    got = {(r.repo, r.dir): r.argv for r in testplan.test_commands(tests.where("repo in ('runners', 'mills')"), texts).collect()}
    assert got == {
        ("runners", "svc"): ["python", "-m", "pytest", "test_m.py"], ("runners", "front"): ["npx", "vitest", "run", "calc.spec.ts"],
        ("mills", "crates/mill"): ["cargo", "test", "--test", "grind_ok"],
    }


def test_tour_and_map(graph, texts, symbols):
    only = lambda df: df.where("repo = 'almanac'")
    files = only(texts).select("repo", "rel", "size")
    code = only(graph.files).where("not is_test")
    r = reports.tour(files.withColumn("mtime", F.lit(None).cast("timestamp")), only(texts), only(graph.edges), only(graph.files)).first()
    assert (r.files, r.directories, r.purpose.path, r.purpose.text) == (5, 4, "README.md", "Prints when the sun sets.")
    assert [tuple(p) for p in r.projects] == [("go.mod", "Go", "go modules")] and r.languages["Go"] == 3
    assert [s[0] for s in r.readingOrder] == ["README.md", "cmd/sun/main.go", "internal/sky/sky.go"]
    assert [tuple(d) for d in r.layout] == [("cmd", 1), ("internal", 2)] and r.omittedReading == 0
    text = reports.ai_map(files, only(texts), only(graph.edges), code, only(symbols), 2000).first().text
    assert text == (
        "# almanac\nPrints when the sun sets.\n\nstack: Go (go.mod)\nlanguages: Go 75%, Markdown 25%\nsize: 5 files, 4 directories\n"
        "entry points: cmd/sun/main.go\n\n## structure\n./ README.md go.mod\ncmd/\n  sun/ main.go\ninternal/\n  sky/ sky.go sky_test.go\n\n"
        "## key files (most used first)\ninternal/sky/sky.go (used by 1): func Set() int\n"
    )


def test_graph_dump_and_json(graph):
    rows = sinks.graph_dump(graph).where("repo = 'relay'")
    docs = {d["rel"]: d for d in (json.loads(r.json) for r in sinks.json_rows(rows, "graph").collect())}
    assert docs["ui/b.ts"]["specs"] == ["./a.js"] and docs["ui/b.ts"]["deps"] == ["ui/a.ts"]
    assert docs["spark/spark.go"]["deps"] == [] and docs["spark/spark.go"]["schemaVersion"] == 1 and docs["wire/wire_test.go"]["test"] is True
    assert set(docs) == {k for k in RELAY if k != "go.mod"}
