"""Further operators bound to the given tables: folder walks, the repositories' own rules, version-control exports, impact of many starts, sinks."""

from __future__ import annotations

import os
import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import declarations, graph, repo_rules, testplan, tree
from ..resolve import graph as code_graph
from ..sources import corpus, sinks, vcs, walk
from ..storage import scratch_root
from ..streaming import rules as rule_stream
from . import views
from .catalog import ALL, bound


def _new_folder(spark, label: str) -> str:
    return f"{scratch_root(spark)}/codeatlas/{label}-{uuid.uuid4().hex[:8]}"


# ---- a written tree: every part is a file, some are links and pipes, and one folder lies too deep to be listed ------

_LINK, _PIPE, _DEEP = 7, 9, 17


def _plant(root: str):
    def run(batches):
        for batch in batches:
            for id, rel in zip(*(batch.column(c).to_pylist() for c in ("id", "rel"))):
                at = os.path.join(root, rel)
                os.makedirs(os.path.dirname(at), exist_ok=True)
                if os.path.lexists(at):
                    continue  # an earlier attempt of this task
                if id % 50 == _LINK:
                    os.symlink("nowhere", at)
                elif id % 50 == _PIPE:
                    os.mkfifo(at)
                else:
                    with open(at, "wb") as out:
                        out.write(b"x" * (id % 50))
            yield pa.RecordBatch.from_pylist([{"n": batch.num_rows}], pa.schema([("n", pa.int64())]))

    return run


def _plant_deep(root: str) -> None:
    """Folders whose whole path is longer than any path may be: not even their owner can list the last ones by name."""
    here = os.open(root, os.O_RDONLY)
    for _ in range(_DEEP):
        os.mkdir("d" * 255, dir_fd=here)
        below = os.open("d" * 255, os.O_RDONLY, dir_fd=here)
        os.close(here)
        here = below
    os.close(here)


def _planted(spark, sf) -> str:
    root = _new_folder(spark, "tree").removeprefix("file://")
    os.makedirs(f"{root}/deep")
    rows = views.files(spark, sf).select("id", F.concat(F.lit("atlas/"), "rel").alias("rel"))
    rows.mapInArrow(_plant(root), "n bigint").agg(F.sum("n")).collect()
    _plant_deep(f"{root}/deep")
    return root


# A path ends at 4,095 bytes: below any root of 15 to 250 bytes the sixteenth folder of 255 is the first too long.
@bound("corpus_scan", f"""
with t as (select id, rel, case id % 50 when {_LINK} then 'link' when {_PIPE} then 'pipe' else 'file' end as kind from b_files)
select 'atlas' as repo, rel, kind, false as is_dir, kind <> 'file' as special, case kind when 'file' then id % 50 else 0 end as size, null as err from t
union all select distinct 'atlas', dir, 'dir', true, false, 0, null from b_dirs
union all select 'deep', repeat(repeat('d', 255) || '/', cast(k as integer)) || repeat('d', 255), 'dir', true, false, 0,
  case when k = 15 then 'File name too long' end from range(16) r(k)""")
def corpus_scan(spark, sf):
    return walk.scan(spark, _planted(spark, sf), parts=16).drop("mtime")


@bound("scan_summary", f"""
select 'atlas' as repo, count(*) filter (id % 50 not in ({_LINK}, {_PIPE}) and not rel like 'small/%') as files,
  count(*) filter (id % 50 in ({_LINK}, {_PIPE}) and not rel like 'small/%') + max(cast(rel like 'small/%' as integer)) as skipped, cast(0 as bigint) as unreadable from b_files
union all select 'deep', 0, 0, 1""")
def scan_summary(spark, sf):
    return tree.scan_summary(walk.scan(spark, _planted(spark, sf)), tree.ScanOptions(ignore=["small/"]))


@bound("scan_special", f"""
select 'atlas' as repo, count(*) filter (id % 50 in ({_LINK}, {_PIPE})) as special from b_files union all select 'deep', 0""")
def scan_special(spark, sf):
    return corpus.drop_special(walk.scan(spark, _planted(spark, sf)))[1]


# ---- two repositories with contrary rules of their own ---------------------------------------------------------------

_SIDE = "case when id % 2 = 0 then 'even' else 'odd' end"


def _halves(spark, sf):
    """Files and links of two repositories: the parts with even and with odd numbers."""
    files = views.files(spark, sf).withColumn("repo", F.expr(_SIDE))
    of = files.select("repo", "id")
    edges = views.edges(spark, sf).drop("repo").join(of.withColumnRenamed("id", "src"), "src").join(of.withColumnRenamed("id", "dst"), ["repo", "dst"])
    return files, edges


def _own_files(spark, sf, name: str, texts: dict[str, str]):
    """The repositories' rules files, as contents."""
    rows = views.files(spark, sf).select(F.expr(_SIDE).alias("repo")).distinct()
    text = F.when(F.col("repo") == "even", texts["even"]).otherwise(texts["odd"])
    return rows.select("repo", F.lit(name).alias("rel"), text.alias("content"))


IGNORES = {
    "even": "# ours\n*.md\nsmall/\n!small/brand1*/\n\n/large/brand2?/*_test*  \n[z-a]bad\n",
    "odd": "large/\n*.go\n!*_5*.go\n**/test_*\n!promo/*/test_*.py\n\\!x\n",
}


@bound("repo_ignore_filter", f"""
with h as (select *, {_SIDE} as side from b_files),
m as (select side, id, rel, case side
    when 'even' then starts_with(rel, 'small/') or rel like '%.md' or regexp_matches(rel, '^large/brand2[^/]/[^/]*_test[^/]*$')
    else starts_with(rel, 'large/') or (
      (rel like '%.go' and not regexp_matches(string_split(rel,'/')[-1], '_5.*\\.go$') or starts_with(string_split(rel,'/')[-1], 'test_'))
      and not regexp_matches(rel, '^promo/[^/]*/test_[^/]*\\.py$')) end as hidden from h)
select side as repo, id, rel from m where not hidden""")
def repo_ignore_filter(spark, sf):
    rules = repo_rules.ignore_rows(_own_files(spark, sf, repo_rules.IGNORE_FILE, IGNORES))
    return repo_rules.visible_files(_halves(spark, sf)[0], rules).select("repo", "id", "rel")


ARCH = {
    "even": "economy/ -> small/\n# a note\n\n  **/*.ts -> /large/  \nnope/ -> small/\n",
    "odd": "small/ -> economy/\n/large/ -> **/*.ts\n",
}
_ARCH_SQL = f"""
with own(repo, line, rule, from_re, to_re) as (values
  ('even', 1, 'economy/ -> small/', '^economy/.*$', '^small/.*$'), ('even', 4, '**/*.ts -> /large/', '^(?:.*/)?[^/]*\\.ts$', '^large/.*$'),
  ('even', 5, 'nope/ -> small/', '^nope/.*$', '^small/.*$'), ('odd', 1, 'small/ -> economy/', '^small/.*$', '^economy/.*$'),
  ('odd', 2, '/large/ -> **/*.ts', '^large/.*$', '^(?:.*/)?[^/]*\\.ts$')),
half as (select * exclude (repo), {_SIDE} as repo from b_files),
broken as (select s.repo, r.line, r.rule, s.rel as "from", t.rel as "to" from b_edges e join half s on s.id = e.src join half t on t.id = e.dst and t.repo = s.repo
  join own r on r.repo = s.repo and regexp_matches(s.rel, r.from_re) and regexp_matches(t.rel, r.to_re) where not s.is_test)
"""


def _arch(spark, sf):
    return repo_rules.arch_rules(_own_files(spark, sf, repo_rules.RULES_FILE, ARCH))


@bound("repo_check_rules", _ARCH_SQL + "\nselect * from broken")
def repo_check_rules(spark, sf):
    files, edges = _halves(spark, sf)
    return repo_rules.violations(edges, files, _arch(spark, sf))


@bound("repo_rule_report", _ARCH_SQL + """
select o.repo, o.line, o.rule, (select count(*) from broken b where b.repo = o.repo and b.line = o.line) as violations,
  not (exists (select 1 from half h where h.repo = o.repo and regexp_matches(h.rel, o.from_re))
    and exists (select 1 from half h where h.repo = o.repo and regexp_matches(h.rel, o.to_re))) as unmatched,
  (select count(*) from half h where h.repo = o.repo and not h.is_test) as checked from own o""")
def repo_rule_report(spark, sf):
    files, edges = _halves(spark, sf)
    return repo_rules.report(edges, files, _arch(spark, sf))


# ---- reach of every file, to the end ---------------------------------------------------------------------------------


def _levels_sql(n: int) -> str:
    """Pairs by distance, level by level: each level leaves out all earlier ones."""
    out = "l0 as materialized (select id as start, id from b_files)"
    for k in range(1, n + 1):
        seen = " union all ".join(f"select * from l{j}" for j in range(k))
        out += f""",
l{k} as materialized (select distinct w.start, e.src as id from l{k-1} w join b_edges e on e.dst = w.id anti join ({seen}) s on s.start = w.start and s.id = e.src)"""
    return out


_LEVELS = 14


@bound("reach_all_whole", f"""
with {_levels_sql(_LEVELS)}
select 'corpus' as repo, start, cast(depth as integer) as depth, count(*) as files, cast(sum(id) as bigint) as ids from (
  {' union all '.join(f'select start, id, {k} as depth from l{k}' for k in range(1, _LEVELS + 1))}) group by start, depth""")
def reach_all_whole(spark, sf):
    files = views.files(spark, sf)
    hits = graph.reach(views.edges(spark, sf), files, files.select("repo", F.col("id").alias("start"), "id"), reverse=True)
    return hits.groupBy("repo", "start", "depth").agg(F.count(F.lit(1)).alias("files"), F.sum("id").alias("ids"))


# ---- version-control exports -----------------------------------------------------------------------------------------
# Every order is a commit on its predecessor, its lines are the changes; names hold spaces, quotes and letters of two bytes.


def _odd_name(column: str) -> str:
    return f"replace(replace({column}, 'e', 'é'), '_', ' \"')"


_LOG_SQL = f"""
with o as (select distinct l_orderkey as o from lineitem),
c as (select o.o, p.o as before from o left join o p on p.o = o.o - 1),
lines as (select distinct l_orderkey as o, case when l_partkey % 5 = 0 then 'R' when l_partkey % 7 = 0 then 'D' else 'M' end as status,
    {_odd_name('rel')} as path, case when l_partkey % 5 = 0 then 'old => ' || rel else '' end as old
  from lineitem join b_files on id = l_partkey)
"""


def _log_records(spark, sf):
    """The log as it would be printed: one record per order."""
    items = views.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("id")).distinct()
    named = items.join(views.files(spark, sf).select("id", "rel"), "id").withColumn("path", F.expr(_odd_name("rel")))
    entry = F.when(F.col("id") % 5 == 0, F.concat(F.lit("R087\0old => "), "rel", F.lit("\0"), "path")).when(
        F.col("id") % 7 == 0, F.concat(F.lit("D\0"), "path")).otherwise(F.concat(F.lit("M\0"), "path"))
    body = named.groupBy("o").agg(F.array_join(F.sort_array(F.collect_list(F.concat(entry, F.lit("\0")))), "").alias("body"))
    before = body.select((F.col("o") + 1).alias("o"), F.col("o").alias("before"))
    placed = body.join(before, "o", "left")
    value = F.concat(
        F.lit("c"), F.col("o").cast("string"), F.lit("\x1f"), F.coalesce(F.concat(F.lit("c"), F.col("before").cast("string")), F.lit("")),
        F.lit("\x1f"), (F.lit(1_700_000_000) + F.col("o")).cast("string"), F.lit("\0\n"), "body")
    return placed.select(F.lit(views.REPO).alias("repo"), value.alias("value"))


@bound("vcs_log_touches", _LOG_SQL + """
select distinct 'corpus' as repo, 'c' || o as commit_id, to_timestamp(1700000000 + o)::timestamp as ts, path from lines
union select 'corpus', 'c' || o, to_timestamp(1700000000 + o)::timestamp, old from lines where old <> ''""")
def vcs_log_touches(spark, sf):
    rows = vcs.touches(vcs.parse_log(_log_records(spark, sf)))
    return rows.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@bound("vcs_commit_changes", _LOG_SQL + """
select 'corpus' as repo, 'c' || c.o as commit_id, 'c' || before as base, path, status from c join lines using (o)
where c.o % 50 = 0 or before is null""")
def vcs_commit_changes(spark, sf):
    log = vcs.parse_log(_log_records(spark, sf))
    wanted = log.where("cast(substring(commit_id, 2) as bigint) % 50 = 0 or size(parents) = 0").select("repo", "commit_id")
    return vcs.commit_changes(log, wanted)


def _exports(spark, sf):
    """One repository per first folder: its changed files, with odd names, as whole ``-z`` exports."""
    d = views.diff(spark, sf).select(
        F.substring_index("path", "/", 1).alias("repo"), "path", F.expr(_odd_name("path")).alias("odd"), "status", "added", "deleted", (F.length("path") % 7 == 0).alias("moved"))
    name = F.when(F.col("moved"), F.concat(F.lit("R090\0M\tx"), "path", F.lit("\0"), "odd")).otherwise(F.concat("status", F.lit("\0"), "odd"))
    plus = F.when(F.length("path") % 5 == 0, "-").otherwise(F.col("added").cast("string"))
    number = F.concat(F.concat_ws("\t", plus, F.col("deleted").cast("string"), F.lit("")), F.when(F.col("moved"), F.concat(F.lit("\0M\tx"), "path", F.lit("\0"))).otherwise(""), "odd")
    whole = lambda c: d.groupBy("repo").agg(F.array_join(F.collect_list(F.concat(c, F.lit("\0"))), "").alias("value"))
    return whole(name), whole(number)


@bound("diff_source_z", f"""
select string_split(path,'/')[1] as repo, {_odd_name('path')} as path, case when length(path) % 7 = 0 then 'R' else status end as status,
  case when length(path) % 5 = 0 then 0 else added end as added, deleted from b_diff""")
def diff_source_z(spark, sf):
    return vcs.diff(*_exports(spark, sf))


@bound("diff_source_quoted", """
select repo, replace(path, 'e', 'é') as path, status, case when length(path) % 5 = 0 then 0 else added end as added, deleted from (
  select repo, case when length(path) % 3 = 0 then 'a => ' || path else path end as path, status, added, deleted from b_diff)""")
def diff_source_quoted(spark, sf):
    """Lines with octal bytes in quotes, and plain names that look like renames."""
    d = views.diff(spark, sf).withColumn("path", F.when(F.length("path") % 3 == 0, F.concat(F.lit("a => "), "path")).otherwise(F.col("path")))
    quoted = F.when(F.col("path").contains("e"), F.concat(F.lit('"'), F.replace(F.col("path"), F.lit("e"), F.lit("\\303\\251")), F.lit('"'))).otherwise(F.col("path"))
    plus = F.when(F.length("path") % 5 == 0, "-").otherwise(F.col("added").cast("string"))
    names = d.select("repo", F.concat_ws("\t", "status", quoted).alias("value"))
    return vcs.diff(names, d.select("repo", F.concat_ws("\t", plus, F.col("deleted").cast("string"), quoted).alias("value")))


_STATUS = "['??','UU','AA',' M','A ','AM',' D','R ']"


@bound("status_source_z", f"""
select string_split(rel,'/')[1] as repo, {_odd_name('rel')} as path, ['?','U','U','M','A','M','D','R'][1 + id % 8] as status from b_files""")
def status_source_z(spark, sf):
    xy = F.expr("array('??','UU','AA',' M','A ','AM',' D','R ')[cast(id % 8 as int)]")
    rows = views.files(spark, sf).select(F.substring_index("rel", "/", 1).alias("repo"), F.concat(
        xy, F.lit(" "), F.expr(_odd_name("rel")), F.lit("\0"), F.when(F.col("id") % 8 == 7, F.concat(F.lit("?? "), "rel", F.lit("\0"))).otherwise("")).alias("v"))
    return vcs.status_z(rows.groupBy("repo").agg(F.array_join(F.collect_list("v"), "").alias("value")))


@bound("status_source_quoted", """
select repo, replace(rel, 'a', 'ä') as path, ['?','U','U','M','A','M','D','R'][1 + id % 8] as status from b_files""")
def status_source_quoted(spark, sf):
    xy = F.expr("array('??','UU','AA',' M','A ','AM',' D','R ')[cast(id % 8 as int)]")
    quoted = F.when(F.col("rel").contains("a"), F.concat(F.lit('"'), F.replace(F.col("rel"), F.lit("a"), F.lit("\\303\\244")), F.lit('"'))).otherwise(F.col("rel"))
    old = F.when(F.col("id") % 8 == 7, '"an \\"old\\" -> name.go" -> ').otherwise("")
    return vcs.parse_status(views.files(spark, sf).select("repo", F.concat(xy, F.lit(" "), old, quoted).alias("value")))


# ---- the violation feed, on its stream -------------------------------------------------------------------------------


@bound("violation_feed", _ARCH_SQL + "\nselect * from broken")
def violation_feed(spark, sf):
    """Links arrive in two parts that overlap; the stream stops in between and goes on from its checkpoint."""
    files, edges = _halves(spark, sf)
    rel = files.select("repo", "id", "rel")
    links = edges.join(rel.select("repo", F.col("id").alias("src"), F.col("rel").alias("from")), ["repo", "src"]).join(
        rel.select("repo", F.col("id").alias("dst"), F.col("rel").alias("to")), ["repo", "dst"])
    at = _new_folder(spark, "feed")
    parts = (links.where("(src + dst) % 3 <> 0"), links.where("(src + dst) % 3 <> 1"))
    rules = _arch(spark, sf)
    for part in parts:
        part.select("repo", "from", "to").write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema("repo string, from string, to string").parquet(f"{at}/in")
        rule_stream.violation_feed(stream, rules, f"{at}/out", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out").select("repo", "line", "rule", "from", "to")


# ---- a refresh of Go: some functions move into another file of their package -----------------------------------------


@bound("go_refresh", """
with keep as (select dir, arg_min(stem, id) as keeper, min(id) as first from c_place group by dir),
moved as (select p.id, p.dir || '/' || p.stem || '.go' as old, p.dir || '/' || k.keeper || '.go' as new from c_place p join keep k using (dir)
  where p.id % 97 = 0 and p.id <> k.first)
select distinct e.repo, e.src, coalesce(m.new, e.dst) as dst from c_edges e left join moved m on m.old = e.dst where e.repo = 'go'""")
def go_refresh(spark, sf):
    from ..streaming import incremental

    old = views.code(spark, sf, "go")
    g = code_graph.build(old)
    part = old.where("rel rlike '[.]go$' and not contains(rel, '/use_')").select(
        "repo", "rel", paths.parent(F.col("rel")).alias("dir"), F.regexp_extract("rel", "_([0-9]+)[.]go$", 1).cast("long").alias("id"))
    first = part.groupBy("dir").agg(F.min_by("rel", "id").alias("keeper"))
    moved = part.where("id % 97 = 0").join(first, "dir").where("rel <> keeper")
    added = moved.groupBy(F.col("keeper").alias("rel")).agg(F.array_join(F.sort_array(F.collect_list(
        F.concat(F.lit("func F"), F.col("id").cast("string"), F.lit("(a, b int) int { return a }\n")))), "").alias("more"))
    gone = moved.select("rel", F.lit(True).alias("gone"))
    body = F.when(F.col("gone"), F.regexp_replace("content", "func F", "func gone")).otherwise(F.concat("content", F.coalesce("more", F.lit(""))))
    new = old.join(added, "rel", "left").join(gone, "rel", "left").select("repo", "rel", body.alias("content"))
    new = new.withColumn("size", F.octet_length("content").cast("long"))
    stamped = lambda df: df.select("repo", "rel", "size", F.lit(0).alias("mtime"))
    changed = incremental.changes(stamped(old), stamped(new))
    return incremental.update_go(g.go.facts, g.edges, g.files, changed, new, corpus.select_sources(new))[1]


# ---- impact of many starts -------------------------------------------------------------------------------------------


@bound("symbol_impact_all", """
with s as (select id, 'F' || id as start, dir from c_place),
near as (
  select s.start, u.src_dir || '/' || tag || '.go' as rel, 'in ' || tag as reason from c_use u join s on s.id = u.src
  union select s.start, u.src_dir || '/' || tag || '.go', 'in ' || tag from c_use u join s on s.id = u.dst where u.src_dir = u.dst_dir),
out as (select s.start, u.src_dir || '/' || tag || '.go' as rel, 'uses ' || s.start as reason from c_use u join s on s.id = u.dst where u.src_dir <> u.dst_dir)
select 'go' as repo, start, rel, false as is_test, cast(1 as integer) as depth, reason from (select * from near union all select * from out)""")
def symbol_impact_all(spark, sf):
    """Every declared function of the derived packages as a start."""
    g = code_graph.build(views.code(spark, sf, "go"))
    decls, refs = code_graph.declarations(g)
    starts = decls.where("name like 'F%'").select("repo", F.col("name").alias("start"), F.col("file").alias("rel"), F.col("name").alias("symbol"))
    return declarations.symbol_impacts(g.edges, g.files, decls, refs, starts)


@bound("mention_impact_all", """
select 'js' as repo, dst as start, src as rel, false as is_test, cast(1 as integer) as depth, cast(null as varchar) as via from c_edges
where repo = 'js' and length(dst) % 3 <> 0""")
def mention_impact_all(spark, sf):
    """Every part's file as a start; its word is its name, or for a third of them one that nobody says."""
    contents = views.code(spark, sf, "js")
    g = code_graph.build(contents)
    own = F.regexp_replace(paths.base(F.col("rel")), r"\.ts\z", "")
    starts = g.files.where("not contains(rel, '/use_')").select(
        "repo", F.col("rel").alias("start"), "rel", F.when(F.length("rel") % 3 == 0, "never_said").otherwise(own).alias("symbol"))
    return declarations.mention_impacts(g.edges, g.files, contents, starts)


@bound("test_commands_batched", """
with t as (select rel, strlen(rel) + 1 as cost from b_files where rel like '%.py' and is_test
    and (starts_with(string_split(rel,'/')[-1], 'test_') or rel like '%_test.py')),
p as (select *, cast(sum(cost) over (order by rel) as bigint) as used from t)
select 'corpus' as repo, '.' as dir, (used - cost) // 1000 as batch, list_concat(['python','-m','pytest'], list(rel order by rel)) as argv from p group by all""")
def test_commands_batched(spark, sf):
    files = views.files(spark, sf)
    root = files.select("repo").distinct().select("repo", F.lit("pyproject.toml").alias("rel"), F.lit("[tool.pytest.ini_options]").alias("content"))
    tests = files.where("rel like '%.py' and is_test").where(r"rel rlike '(^|/)test_[^/]*$' or rel like '%\\_test.py'").select("repo", "rel")
    return testplan.test_commands(tests, root, 2000)


# ---- sinks, read back ------------------------------------------------------------------------------------------------


@bound("json_sink", ALL + "\nselect repo, path, is_dir, commits, 1 as \"schemaVersion\", 'churn' as command from churn")
def json_sink(spark, sf):
    from ..operators import churn

    at = _new_folder(spark, "report")
    sinks.write_json(churn.churn(views.touches(spark, sf)), "churn", at)
    schema = "schemaVersion int, command string, repo string, path string, is_dir boolean, commits bigint"
    return spark.read.text(at).select(F.from_json("value", schema).alias("j")).select("j.*")


@bound("prompt_sink", """
with n as (select array_to_string(list_slice(string_split(rel,'/'),1,2),'/') as dir, rel, size from b_files)
select 'corpus' as repo, dir as name, string_agg(rel || ' ' || size, chr(10) order by rel) || chr(10) as text from n group by dir""")
def prompt_sink(spark, sf):
    files = views.files(spark, sf).withColumn("dir", paths.parent(F.col("rel")))
    lines = F.array_sort(F.collect_list(F.struct("rel", F.concat_ws(" ", "rel", F.col("size").cast("string")).alias("line"))))
    packs = files.groupBy("repo", F.col("dir").alias("name")).agg(F.concat(F.array_join(F.transform(lines, lambda s: s["line"]), "\n"), F.lit("\n")).alias("text"))
    at = _new_folder(spark, "prompts")
    sinks.write_prompt_files(packs, at)
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(at)
    parts = F.split("path", "/")
    name = F.regexp_replace(F.url_decode(F.element_at(parts, -1)), r"\.txt\z", "")
    return read.select(F.url_decode(F.element_at(parts, -2)).alias("repo"), F.url_decode(name).alias("name"), F.decode("content", "UTF-8").alias("text"))
