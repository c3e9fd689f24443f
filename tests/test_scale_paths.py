"""The ways taken for large or skewed input give the same rows as the small ones."""

import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeatlas import storage
from codeatlas.operators import churn, graph, ranking, tree
from codeatlas.operators import structure as structure_module
from codeatlas.operators.structure import TRUNCATED, structure


def make_graph(spark, edges, n, tests=()):
    files = spark.createDataFrame([("r", i, f"d{i % 3}/f{i:03}.ts", i in tests) for i in range(n)], "repo string, id bigint, rel string, is_test boolean")
    rows = spark.createDataFrame([("r", a, b) for a, b in edges] or [], "repo string, src bigint, dst bigint")
    return files, rows


def plain_bfs(edges, seeds, names, tests=(), no_tests=False, depth=None):
    """Dependents by level, each with the first frontier file that reached it."""
    users = {}
    for a, b in sorted(edges, key=lambda e: names[e[0]].split("/")):
        users.setdefault(b, []).append(a)
    seen, frontier, out, d = set(seeds), sorted(seeds, key=lambda s: names[s]), {}, 0
    while frontier and (depth is None or d < depth):
        d, nxt = d + 1, []
        for p in frontier:
            for c in users.get(p, []):
                if c in seen or (no_tests and c in tests):
                    continue
                seen.add(c)
                nxt.append(c)
                out[c] = (d, names[p] if d > 1 else None)
        frontier = nxt
    return out


@pytest.mark.parametrize("parents", [True, False])
def test_starts_are_asked_for_once(spark, monkeypatch, parents):
    """Starts may come from a long query; paths are laid out only for a walk that reports parents."""
    columns, stage = {}, graph.stage
    monkeypatch.setattr(graph, "stage", lambda df, label, *a, **m: columns.setdefault(label, df.columns) and stage(df, label, *a, **m))
    files, rows = make_graph(spark, [(i + 1, i) for i in range(6)], 8)
    asked = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            asked.add(batch.num_rows)
            yield batch

    starts = spark.createDataFrame([("r", "x", 0), ("r", "y", 4)], "repo string, start string, id bigint").mapInArrow(counted, "repo string, start string, id bigint")
    got = {(r.start, r.id): (r.depth, r.rel) for r in graph.reach(rows, files, starts, reverse=True, parents=parents).collect()}
    assert got == {(s, i): (i - a, f"d{i % 3}/f{i:03}.ts") for s, a in (("x", 0), ("y", 4)) for i in range(a + 1, 7)}
    assert asked.value == 2 and ("next_rel" in columns["neighbours"]) == parents



def reach_rows(df):
    return {r.id: (r.depth, r.via) for r in df.collect()}


@pytest.fixture
def skewed():
    rng = random.Random(7)
    hub = [(i, 0) for i in range(1, 60)]  # one file has most dependents
    return hub + [(rng.randrange(80), rng.randrange(80)) for _ in range(120)]


@pytest.mark.parametrize("forced", [False, True])
def test_reach_with_a_hub(spark, monkeypatch, skewed, forced):
    edges = sorted({(a, b) for a, b in skewed if a != b})
    tests = {5, 9, 33, 70}
    files, rows = make_graph(spark, edges, 80, tests)
    names = {r.id: r.rel for r in files.collect()}
    if forced:  # salt the hub and never broadcast
        monkeypatch.setattr(graph, "NEIGHBOURS_PER_KEY", 7)
        monkeypatch.setattr(storage, "BROADCAST_BYTES", -1)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        starts = spark.createDataFrame([("r", "s", 0), ("r", "s", 11)], "repo string, start string, id bigint")
        got = graph.reach(rows, files, starts, reverse=True, parents=True)
        assert reach_rows(got) == plain_bfs(edges, [0, 11], names)
        cut = graph.reach(rows, files, starts, reverse=True, parents=True, no_tests=True, depth=2)
        assert reach_rows(cut) == plain_bfs(edges, [0, 11], names, tests, True, 2)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_cycles_and_missing_seeds(spark):
    files, rows = make_graph(spark, [(1, 0), (0, 1), (2, 1)], 4)
    starts = spark.createDataFrame([("r", 0, 0), ("r", 3, 3)], "repo string, start bigint, id bigint")
    got = {(r.start, r.id): r.depth for r in graph.reach(rows, files, starts, reverse=True).collect()}
    assert got == {(0, 1): 1, (0, 2): 2}
    none = graph.reach(rows, files, starts.where("id = 3"), reverse=True, parents=True)
    assert none.count() == 0 and "via" in none.columns


def test_numbering_one_big_group(spark):
    values = list(range(500))
    random.Random(3).shuffle(values)
    df = spark.createDataFrame([("big" if v < 450 else "small", v, v % 7 + 1) for v in values], "k string, v bigint, c bigint").repartition(6)
    ranks = ranking.number_rows(df, ["k"], [F.col("v").desc()])
    assert {(r.k, r.v): r["rank"] for r in ranks.collect()} == {
        **{("big", v): 450 - v for v in range(450)}, **{("small", v): 500 - v for v in range(450, 500)}}
    totals = ranking.running_total(df, ["k"], [F.col("v")], "c", "t")
    want, run = {}, {"big": 0, "small": 0}
    for v in range(500):
        k = "big" if v < 450 else "small"
        run[k] += v % 7 + 1
        want[v] = run[k]
    assert {r.v: r.t for r in totals.collect()} == want


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 11), st.integers(0, 11)), max_size=30))
def test_reach_is_the_shortest_distance(spark, pairs):
    edges = sorted({(a, b) for a, b in pairs if a != b})
    files, rows = make_graph(spark, edges, 12)
    names = {i: f"d{i % 3}/f{i:03}.ts" for i in range(12)}
    starts = spark.createDataFrame([("r", "s", 0)], "repo string, start string, id bigint")
    got = {r.id: r.depth for r in graph.reach(rows, files, starts, reverse=True).collect()}
    assert got == {k: d for k, (d, _) in plain_bfs(edges, [0], names).items()}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=4), st.integers(0, 99)), min_size=1, max_size=25))
def test_folder_totals_add_up(spark, rows):
    named = {"/".join(p) + f"/f{i}": n for i, (p, n) in enumerate(rows)}
    files = spark.createDataFrame([("r", k, v) for k, v in named.items()], "repo string, rel string, size bigint")
    got = {r.dir: r["size"] for r in tree.rollup_folders(files, ["size"]).collect()}
    want = {".": sum(named.values())}
    for k, v in named.items():
        p = k.split("/")
        for i in range(1, len(p)):
            want["/".join(p[:i])] = want.get("/".join(p[:i]), 0) + v
    assert got == want


LOW = {"tests", "examples"}


def plain_structure(rels, tokens):
    """Breadth-first opening over a nested dict, written for clarity."""
    root = {}
    for r in rels:
        at = root
        *folders, name = r.split("/")
        for f in folders:
            at = at.setdefault(f + "/", {})
        at[name] = None
    dirs = lambda n: sorted(k for k, v in n.items() if v is not None)
    names = lambda n: sorted((k for k, v in n.items() if v is None), key=lambda k: (k.startswith("."), k))

    def every(n):
        return [k for k, v in n.items() if v is None] + [x for k, v in n.items() if v is not None for x in every(v)]

    def summary(n):
        fs, count = every(n), {}
        for f in fs:
            e = "." + f.rsplit(".", 1)[1] if "." in f else ""
            count[e] = count.get(e, 0) + 1
        best = min(((-c, e) for e, c in count.items() if e), default=(0, ""))
        return f"{len(fs)} file{'' if len(fs) == 1 else 's'}" + (f", mostly {best[1]}" if -best[0] * 2 > len(fs) else "")

    def listed(n, cap):
        fs = names(n)
        return " ".join(fs[:cap] + ([f"+{len(fs) - cap} more"] if len(fs) > cap else []))

    closed = lambda k, n, d: "  " * d + k + f" ({summary(n)})\n"
    opened = lambda k, n, d, cap: "  " * d + k + (" " + listed(n, cap) if names(n) else "") + "\n"

    def render(n, d, is_open, cap):
        out = ""
        for k in dirs(n):
            c = n[k]
            if is_open is None or id(c) in is_open:
                out += opened(k, c, d, cap) + render(c, d + 1, is_open, cap)
            else:
                out += closed(k, c, d)
        return out

    head = lambda cap: "./ " + listed(root, cap) + "\n" if names(root) else ""
    room = tokens * 4
    full = head(10**9) + render(root, 0, None, 10**9)
    if len(full.encode()) <= room:
        return full
    used = len(head(40)) + sum(len(closed(k, root[k], 0)) for k in dirs(root))
    first = [(k, root[k], 0) for k in dirs(root)]
    queue, later, is_open = [x for x in first if x[0][:-1] not in LOW], [x for x in first if x[0][:-1] in LOW], set()
    while queue or later:
        if not queue:
            queue, later = later, []
        k, n, d = queue.pop(0)
        delta = len(opened(k, n, d, 8)) - len(closed(k, n, d)) + sum(len(closed(c, n[c], d + 1)) for c in dirs(n))
        if used + delta <= room:
            used += delta
            is_open.add(id(n))
            for c in dirs(n):
                (later if c[:-1] in LOW else queue).append((c, n[c], d + 1))
    out = head(40) + render(root, 0, is_open, 8)
    return out + (TRUNCATED if len(out.encode()) > room else "")


@pytest.mark.parametrize("at_once", [4096, 3])
def test_structure_against_a_plain_walk(spark, monkeypatch, at_once):
    monkeypatch.setattr(structure_module, "AT_ONCE", at_once)
    words = ["a", "b", "core", "tests", "examples", "x-y", "z"]
    repos, budgets = {}, {}
    for seed in range(4):
        rng = random.Random(seed)
        dirs = sorted({"/".join(rng.choice(words) for _ in range(rng.randrange(0, 4))) for _ in range(60)})
        rels = {f"{r}/f{i % 9}{rng.choice(['.go', '.ts', '', '.py'])}".lstrip("/") for r in dirs for i in range(rng.randrange(1, 14))}
        for tokens in (5, 60, 120, 300, 100_000):
            repos[f"{seed}-{tokens}"], budgets[f"{seed}-{tokens}"] = sorted(rels | {".env", "README.md"}), tokens
    files = spark.createDataFrame([(k, r) for k, rels in repos.items() for r in rels], "repo string, rel string")
    tokens = spark.createDataFrame(list(budgets.items()), "repo string, tokens bigint")
    got = {r.repo: r.text for r in structure(files, tokens).collect()}
    for k, rels in repos.items():
        assert got[k] == plain_structure(rels, budgets[k]), k


def test_churn_holds_touches_only_after_they_met(spark):
    """No map of touches is filled in the tasks that read them: these grow with the pieces of the input."""
    touches = spark.range(100).selectExpr("concat('r', id % 2) as repo", "id % 9 as commit_id", "timestamp'2020-01-01' as ts", "concat('a/b', id % 4, '/f', id % 7) as path")
    counts = churn.churn(touches)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    above = [part.split("Range (")[0] for part in re.split(r"Exchange hashpartitioning\((?:repo#\d+, )?commit_id#\d+L?, path#\d+,", plan)[1:] if "Range (" in part]
    assert above and all("Aggregate" not in part for part in above)
    rows = {(f"r{i % 2}", i % 9, f"a/b{i % 4}/f{i % 7}") for i in range(100)}
    got = {(r.repo, r.path): r.commits for r in counts.collect()}
    assert all(got[repo, path] == sum((repo, c, path) in rows for c in range(9)) for repo, _, path in rows)
    assert got["r0", "a"] == len({c for repo, c, _ in rows if repo == "r0"})
