"""Rules that repositories carry, reach and impact of many starts, batched commands, and the feed with memory."""

import random
import re

import pytest
from pyspark.sql import functions as F

from codeatlas import storage
from codeatlas.functions import globs
from codeatlas.operators import declarations, graph, repo_rules, rules, testplan
from codeatlas.resolve import graph as code_graph
from codeatlas.streaming.rules import violation_feed

from .corpora import contents
from .test_scale_paths import make_graph

# ---- rules in columns ---------------------------------------------------------------------------

GLOBS = [
    "*", "**", "**/", "a/**/b", "a?c", "*.go", "[abc]x", "[!abc]x", "[a-c]*", "[", "[x", "a.b+c(d)", "{a,b}", "\\*x", "\\!y", "a\\", "é*", "[[]x", "[&&a]",
    "**/test_*", "/a/", "^$|", "a b", "#x", "~`'\"<>;:,-=%@",
]
PATHS = ["", "a", "ab", "abc", "a/b", "a/x/b", "a/x/y/b", "x.go", "d/x.go", "ax", "bx", "zx", "[x", "&x", "*x", "!y", "a\\", "été", "a.b+c(d)", "{a,b}", "t/test_1", "a b", "#x", "^$|"]


def test_globs_in_columns(spark):
    df = spark.createDataFrame([(g,) for g in GLOBS], "g string").select(
        "g", globs.glob_regex_of(F.col("g")).alias("r"), globs.rule_side_regex_of(F.col("g")).alias("s")).collect()
    for row in df:
        want, side = re.compile(f"^{globs.glob_regex(row.g)}$"), re.compile(globs.rule_side_regex(row.g))
        assert [bool(re.fullmatch(row.r, p)) for p in PATHS] == [bool(want.match(p)) for p in PATHS], row
        assert [bool(re.match(row.s, p)) for p in PATHS] == [bool(side.match(p)) for p in PATHS], row


LINES = ["*.md", "!x.md", "", "  ", "# no", "a/", "/a/b", "!/c/", "[z-a]q", "[]", "x[!]", "trail  \t", "**/k", "d/*\r", "!", "/"]


def test_ignore_lines_in_columns(spark):
    df = spark.createDataFrame([(x,) for x in LINES], "x string").select(globs.ignore_rule_of(F.col("x")).alias("r"))
    got = [(r.r.regex, r.r.negated, r.r.folders_only, r.r.anchored) for r in df.where("r is not null").collect()]
    assert [(x.regex, x.negated, x.folders_only, x.anchored) for x in globs.ignore_rules(LINES)] == got


OWN = {
    "a": {".atlasignore": "*.log\n!keep.log\nout/\n", "x.log": "", "keep.log": "", "out/keep.log": "", "src/m.ts": "", "node_modules/p.js": ""},
    "b": {".atlasignore": "!node_modules\nsrc/\n", "x.log": "", "src/m.ts": "", "node_modules/p.js": ""},
    "c": {"x.log": "", "src/.atlasignore": "*\n", "src/m.ts": ""},
}


def test_each_repository_by_its_own_ignore_file(spark):
    texts = contents(spark, OWN)
    seen = lambda **o: {(r.repo, r.rel) for r in repo_rules.visible_files(texts, repo_rules.ignore_rows(texts), repo_rules.ScanOptions(**o)).collect()}
    assert seen() == {("a", "keep.log"), ("a", "src/m.ts"), ("b", "x.log"), ("b", "node_modules/p.js"), ("c", "x.log"), ("c", "src/m.ts")}
    assert seen(ignore=["!*.log", "*.ts"]) == {("a", "keep.log"), ("a", "x.log"), ("b", "x.log"), ("b", "node_modules/p.js"), ("c", "x.log")}
    assert ("a", "x.log") in seen(no_ignore=True) and ("b", "src/m.ts") in seen(no_ignore=True)


def test_rule_files_with_errors(spark):
    at = lambda text: contents(spark, {"ok": {"atlas.rules": "a/ -> b/\n"}, "r": {"atlas.rules": text}, "none": {"x": ""}})
    got = repo_rules.arch_rules(at("# c\n\n *.ts->/d/ -> e \n")).collect()
    assert {(r.repo, r.line, r.rule) for r in got} == {("ok", 1, "a/ -> b/"), ("r", 3, "*.ts -> /d/ -> e")}
    for bad, match in {"a/ -> \n": "r/atlas.rules, line 1", "x\n": "line 1", "a -> b\n->\n": "line 2", "# only\n": "holds no rule", "": "holds no rule"}.items():
        with pytest.raises(ValueError, match=match):
            repo_rules.arch_rules(at(bad))


def test_own_rules_agree_with_one_list(spark):
    """The same rules in every repository give what one list for all gives."""
    rng = random.Random(2)
    rels = [f"{rng.choice(['web', 'db', 'api/v1'])}/f{i}.{rng.choice(['ts', 'test.ts', 'go'])}" for i in range(60)]
    files = spark.createDataFrame([(r, i, rel, ".test." in rel) for r in ("p", "q") for i, rel in enumerate(rels)], "repo string, id bigint, rel string, is_test boolean")
    edges = spark.createDataFrame([(r, rng.randrange(60), rng.randrange(60)) for r in ("p", "q") for _ in range(300)], "repo string, src bigint, dst bigint").distinct()
    text = "web/ -> db/\n**/*.go -> web/\nnope/ -> web/\napi/** -> db/*.ts\n"
    own = repo_rules.arch_rules(spark.createDataFrame([(r, "atlas.rules", text) for r in ("p", "q")], "repo string, rel string, content string"))
    one = rules.parse_rules(text)
    key = lambda df: sorted(map(tuple, df.collect()))
    changed = files.where("id < 20").select("repo", "rel")
    for only in (None, changed):
        assert key(repo_rules.violations(edges, files, own, only)) == key(rules.violations(edges, files, one, only))
        columns = ["repo", "line", "rule", "violations", "unmatched", "checked"]
        assert key(repo_rules.report(edges, files, own, only).select(columns)) == key(rules.rule_report(edges, files, one, only).select(columns))


def test_feed_reports_a_link_once(spark, tmp_path):
    at = str(tmp_path)
    for own in (False, True):
        place = f"{at}/{own}"
        made = spark.createDataFrame([("r", "atlas.rules", "web/ -> db/\n")], "repo string, rel string, content string")
        parsed = repo_rules.arch_rules(made) if own else rules.parse_rules("web/ -> db/\n")
        links = lambda *pairs: spark.createDataFrame([("r", a, b) for a, b in pairs], "repo string, from string, to string")

        def run():
            stream = spark.readStream.schema("repo string, from string, to string").parquet(place + "/in")
            violation_feed(stream, parsed, place + "/out", place + "/checkpoint").trigger(availableNow=True).start().awaitTermination()
            return sorted((r["from"], r["to"]) for r in spark.read.parquet(place + "/out").collect())

        links(("web/a.ts", "db/x"), ("web/a.ts", "db/x"), ("web/a.test.ts", "db/x"), ("api/a.ts", "db/x")).write.parquet(place + "/in")
        assert run() == [("web/a.ts", "db/x")]
        # a repeated batch after a restart, with one new link
        links(("web/a.ts", "db/x"), ("web/b.ts", "db/x")).write.mode("append").parquet(place + "/in")
        assert run() == [("web/a.ts", "db/x"), ("web/b.ts", "db/x")] == run()


# ---- many starts --------------------------------------------------------------------------------


def plain_reach(edges, seeds, skip=()):
    users = {}
    for a, b in edges:
        users.setdefault(b, []).append(a)
    depth, frontier, d = {}, list(seeds), 0
    while frontier:
        d += 1
        frontier = sorted({c for p in frontier for c in users.get(p, ()) if c not in depth and c not in seeds and c not in skip})
        depth.update(dict.fromkeys(frontier, d))
    return depth


@pytest.mark.parametrize("numbers, forced", [(1, False), (2, True), (16, False)])
def test_reach_of_all_nodes(spark, monkeypatch, numbers, forced):
    """More starts than one row's numbers hold, hubs split, without and with broadcasts."""
    rng = random.Random(numbers)
    n = 230
    edges = sorted({(rng.randrange(n), rng.randrange(0, n, 1 + i % 40)) for i in range(500)} | {(i, 3) for i in range(4, 90)} | {(i + 1, i) for i in range(150, 190)})
    edges = [(a, b) for a, b in edges if a != b]
    files, rows = make_graph(spark, edges, n, {7, 9, 40, 160})
    monkeypatch.setattr(graph, "SET_NUMBERS", numbers)
    if forced:
        monkeypatch.setattr(graph, "NEIGHBOURS_PER_KEY", 7)
        monkeypatch.setattr(storage, "BROADCAST_BYTES", -1)
    starts = files.select("repo", F.col("id").alias("start"), "id")
    got = graph.reach(rows, files, starts, reverse=True).collect()
    want = {(s, i): d for s in range(n) for i, d in plain_reach(edges, [s]).items()}
    assert {(r.start, r.id): r.depth for r in got} == want and len(got) == len(want)
    assert {r.id: (r.rel, r.is_test) for r in got}.items() <= {r.id: (r.rel, r.is_test) for r in files.collect()}.items()
    cut = graph.reach(rows, files, starts, reverse=True, depth=2, no_tests=True).collect()
    assert {(r.start, r.id): r.depth for r in cut} == {
        (s, i): d for s in range(n) for i, d in plain_reach(edges, [s], {7, 9, 40, 160}).items() if d <= 2}


def test_reach_of_starts_with_several_seeds(spark):
    files, rows = make_graph(spark, [(1, 0), (2, 1), (3, 2), (5, 4), (2, 4)], 7)
    starts = spark.createDataFrame([("r", "x", 0), ("r", "x", 4), ("r", "y", 4), ("r", "z", 6), ("r", "w", 99)], "repo string, start string, id bigint")
    got = {(r.start, r.id): r.depth for r in graph.reach(rows, files, starts, reverse=True).collect()}
    assert got == {("x", 1): 1, ("x", 2): 1, ("x", 5): 1, ("x", 3): 2, ("y", 5): 1, ("y", 2): 1, ("y", 3): 2}


PACKAGES = {
    "go.mod": "module m.test/m\n",
    "a/a.go": "package a\n\ntype T struct{}\n\nfunc (t *T) Run() int { return help() }\n\nfunc help() int { return 1 }\n\nfunc Make() *T { return nil }\n",
    "a/b.go": "package a\n\nfunc Twice() int {\n\tt := Make()\n\treturn t.Run() + t.Run()\n}\n",
    "a/a_test.go": "package a\n\nimport \"testing\"\n\nfunc TestTwice(t *testing.T) { Twice() }\n",
    "use/u.go": "package use\n\nimport \"m.test/m/a\"\n\nfunc Go() int { return a.Twice() }\n",
    "top/t.go": "package top\n\nimport \"m.test/m/use\"\n\nfunc Up() int { return use.Go() }\n",
}


def test_impact_of_many_declarations(spark):
    """All starts at once give what each start gives by itself, also when two repositories have the same paths."""
    texts = contents(spark, {"one": PACKAGES, "two": {**PACKAGES, "use/u.go": "package use\n\nfunc Go() int { return 0 }\n"}})
    g = code_graph.build(texts)
    decls, refs = code_graph.declarations(g)
    starts = [("a/a.go", "help"), ("a/a.go", "Make"), ("a/a.go", "T"), ("a/b.go", "Twice"), ("use/u.go", "Go")]
    table = spark.createDataFrame([(r, f"{f}:{s}", f, s) for r in ("one", "two") for f, s in starts], "repo string, start string, rel string, symbol string")
    got = {}
    for r in declarations.symbol_impacts(g.edges, g.files, decls, refs, table).collect():
        got.setdefault((r.repo, r.start), set()).add((r.rel, r.is_test, r.depth, r.reason))
    for file, symbol in starts:
        alone = declarations.symbol_impact(g.edges, g.files, decls, refs, file, symbol).collect()
        for repo in ("one", "two"):
            assert got.get((repo, f"{file}:{symbol}"), set()) == {(r.rel, r.is_test, r.depth, r.reason) for r in alone if r.repo == repo}
    assert got["one", "a/b.go:Twice"] == {("a/a_test.go", True, 1, "in TestTwice"), ("use/u.go", False, 1, "uses Twice"), ("top/t.go", False, 2, None)}
    assert got["two", "a/b.go:Twice"] == {("a/a_test.go", True, 1, "in TestTwice")}
    assert got["one", "a/a.go:help"] == {
        ("a/a.go", False, 1, "in T.Run"), ("a/b.go", False, 2, "in Twice"), ("a/a_test.go", True, 2, "in TestTwice"), ("use/u.go", False, 2, "uses Twice"), ("top/t.go", False, 2, None)}


def test_links_between_names_are_made_once(spark, monkeypatch):
    """A traversal reads its links and nodes several times: they are tables, not joins."""
    given, reach = [], declarations.reach
    monkeypatch.setattr(declarations, "reach", lambda edges, nodes, *a, **k: given.extend((edges, nodes)) or reach(edges, nodes, *a, **k))
    decls = spark.createDataFrame([("r", "a", "a/x.go", n) for n in ("F", "G", "H", "T.m")], "repo string, dir string, file string, name string")
    refs = spark.createDataFrame(
        [("r", "a", "a/x.go", n, ref) for n, ref in (("G", "F"), ("H", ".m"), ("T.m", "G"))], "repo string, dir string, file string, name string, ref string")
    seeds = spark.createDataFrame([("r", "a", "F")], "repo string, dir string, name string")
    assert {r.name for r in declarations.reaching(decls, refs, seeds).collect()} == {"F", "G", "T.m", "H"}
    assert len(given) == 2 and not [df for df in given if re.search("Join|Aggregate|Union", df._jdf.queryExecution().optimizedPlan().toString())]


def test_mentions_of_many_words(spark):
    texts = contents(spark, {"r": {
        "a.ts": "export const one = 1, two = 2;\n", "b.ts": "import { one } from './a';\n", "c.ts": "import { two } from './a';\nconst t = one$two;\n",
        "d.ts": "import './b';\n", "e.ts": "import * as a from './a';\na . two\n",
    }})
    g = code_graph.build(texts)
    starts = spark.createDataFrame([("r", k, "a.ts", w) for k, w in enumerate(["one", "two", "a . two", "gone", "on"])], "repo string, start int, rel string, symbol string")
    got = {}
    for r in declarations.mention_impacts(g.edges, g.files, texts, starts).collect():
        got.setdefault(r.start, set()).add((r.rel, r.depth, r.via))
    assert got == {0: {("b.ts", 1, None), ("c.ts", 1, None), ("d.ts", 2, "b.ts")}, 1: {("c.ts", 1, None), ("e.ts", 1, None)}, 2: {("e.ts", 1, None)}}


def test_many_tests_make_many_commands(spark):
    n = 100_000
    tests = spark.range(n).selectExpr("'r' as repo", "concat('svc/test_', lpad(id, 7, '0'), '.py') as rel")
    texts = contents(spark, {"r": {"svc/pyproject.toml": "[tool.pytest.ini_options]\n"}})
    rows = testplan.test_commands(tests, texts).collect()
    assert all(sum(len(a) + 1 for a in r.argv[3:]) <= testplan.ARGUMENT_BYTES and r.argv[:3] == testplan.PYTEST for r in rows)
    assert [a for r in sorted(rows, key=lambda r: r.batch) for a in r.argv[3:]] == [f"test_{k:07d}.py" for k in range(n)]
