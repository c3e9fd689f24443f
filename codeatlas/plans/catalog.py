"""Every operator bound to the given tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import globs, labels, paths, text
from ..operators import churn as churn_ops
from ..operators import graph, impact, quality, ranking, rules, tree
from . import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def bound(name: str, sql: str | None = None, recursive: bool = False):
    """Register a query; ``sql`` may use the bound views."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            body = sql.strip()
            extra = ""
            if body.startswith("with "):
                extra, body = "," + body[5:].split("\nselect", 1)[0], "select" + body.split("\nselect", 1)[1]
            ORACLES[name] = f"with {'recursive ' if recursive else ''}{views.SQL.strip()}{extra}\n{body}"
        return fn

    return add


# ---- graph ------------------------------------------------------------------------------

USED_BY = """
with used as (
  select e.dst as id, count(*) as used_by from b_edges e join b_files s on s.id = e.src
  where not s.is_test group by e.dst)
"""


@bound("rank_used_by", USED_BY + """
select 'corpus' as repo, f.id, f.rel, u.used_by,
  row_number() over (order by u.used_by desc, f.rel) as rank
from used u join b_files f using (id) where not f.is_test""")
def rank_used_by(spark, sf):
    return graph.ranked(views.edges(spark, sf), views.files(spark, sf))


@bound("edges_distinct", "select repo, src, dst from b_edges")
def edges_distinct(spark, sf):
    return graph.distinct_edges(views.links(spark, sf))


@bound("used_by", USED_BY + "\nselect 'corpus' as repo, id, used_by from used")
def used_by(spark, sf):
    return graph.used_by(views.edges(spark, sf), views.files(spark, sf))


@bound("deps_one_hop", """
select e.repo, e.src as start, e.dst as id, f.rel, f.is_test
from b_edges e join b_files f on f.id = e.dst""")
def deps_one_hop(spark, sf):
    files = views.files(spark, sf)
    return graph.one_hop(views.edges(spark, sf), files, files.select("repo", "id"), reverse=False)


@bound("dependents_one_hop", """
select e.repo, e.dst as start, e.src as id, f.rel, f.is_test
from b_edges e join b_files f on f.id = e.src""")
def dependents_one_hop(spark, sf):
    files = views.files(spark, sf)
    return graph.one_hop(views.edges(spark, sf), files, files.select("repo", "id"), reverse=True)


def _reach_sql(here: str, there: str, depth: int = 60, no_tests: bool = False, seeds: str = "b_hubs") -> str:
    live = "and not f.is_test" if no_tests else ""
    return f"""
with walk(id, depth) as (
  select id, 0 from {seeds}
  union
  select e.{there}, w.depth + 1 from walk w join b_edges e on e.{here} = w.id
  join b_files f on f.id = e.{there} where w.depth < {depth} {live}),
near as (select id, min(depth) as depth from walk group by id),
path(id, depth, trail, via) as (
  select n.id, 0, [f.rel], cast(null as varchar) from near n join b_files f using (id) where n.depth = 0
  union all
  select id, depth, trail, via from (
    select n.id, p.depth + 1 as depth, min(list_append(p.trail, translate(f.rel, '/', chr(1)))) as trail,
      arg_min(pf.rel, list_append(p.trail, translate(f.rel, '/', chr(1)))) as via
    from path p join b_edges e on e.{here} = p.id join near n on n.id = e.{there} and n.depth = p.depth + 1
    join b_files f on f.id = n.id join b_files pf on pf.id = p.id
    group by n.id, p.depth) s)
select f.repo, f.id, f.rel, f.is_test, cast(p.depth as integer) as depth,
  case when p.depth > 1 then p.via end as via
from path p join b_files f using (id) where p.depth > 0"""


def _hub_reach(spark, sf, seeds=views.hubs, **options):
    files = views.files(spark, sf)
    starts = seeds(spark, sf).select("repo", F.lit("hubs").alias("start"), "id")
    hits = graph.reach(views.edges(spark, sf), files, starts, parents=True, **options)
    return hits.select("repo", "id", "rel", "is_test", "depth", "via")


@bound("dependents_all", _reach_sql("dst", "src"), recursive=True)
def dependents_all(spark, sf):
    return _hub_reach(spark, sf, reverse=True)


@bound("deps_all", _reach_sql("src", "dst", seeds="b_loaders"), recursive=True)
def deps_all(spark, sf):
    return _hub_reach(spark, sf, views.loaders)


@bound("dependents_no_tests", _reach_sql("dst", "src", no_tests=True), recursive=True)
def dependents_no_tests(spark, sf):
    return _hub_reach(spark, sf, reverse=True, no_tests=True)


@bound("dependents_depth2", _reach_sql("dst", "src", depth=2), recursive=True)
def dependents_depth2(spark, sf):
    return _hub_reach(spark, sf, reverse=True, depth=2)


@bound("reach_all_seeds", """
with walk(start, id, depth) as (
  select id, id, 0 from b_files
  union
  select w.start, e.src, w.depth + 1 from walk w join b_edges e on e.dst = w.id where w.depth < 2),
near as (select start, id, min(depth) as depth from walk group by start, id)
select f.repo, n.start, f.id, f.rel, f.is_test, cast(n.depth as integer) as depth
from near n join b_files f using (id) where n.depth > 0""", recursive=True)
def reach_all_seeds(spark, sf):
    files = views.files(spark, sf)
    starts = files.select("repo", F.col("id").alias("start"), "id")
    return graph.reach(views.edges(spark, sf), files, starts, reverse=True, depth=2)


# ---- impact -----------------------------------------------------------------------------

IMPACT = """
with seeds as (select f.id from b_files f join b_diff d on d.path = f.rel where d.status <> 'D'
    and f.rel not like '%.md'),
walk(id, depth) as (
  select id, 0 from seeds
  union
  select e.src, w.depth + 1 from walk w join b_edges e on e.dst = w.id
  join b_files f on f.id = e.src where w.depth < 60),
near as (select id, min(depth) as depth from walk group by id)
"""


def _graph_files(spark, sf):
    """The graph holds source code only: Markdown is a changed path outside it."""
    return views.files(spark, sf).where(~F.col("rel").endswith(".md"))


def _change(spark, sf):
    return impact.split_changes(views.diff(spark, sf))[0]


@bound("impact_affected", IMPACT + """
select f.repo, f.id, f.rel, f.is_test, cast(n.depth as integer) as depth
from near n join b_files f using (id) where n.depth > 0""", recursive=True)
def impact_affected(spark, sf):
    return impact.affected(views.edges(spark, sf), views.files(spark, sf), _change(spark, sf).where("rel not like '%.md'"))


RUNNABLE = """(f.is_test and (f.rel not like '%.py' or contains(f.rel, '/test_') or ends_with(f.rel, '_test.py')))"""


@bound("impact_tests", IMPACT + f"\nselect f.repo, f.rel from near n join b_files f using (id) where {RUNNABLE}",
       recursive=True)
def impact_tests(spark, sf):
    files, changed = views.files(spark, sf), _change(spark, sf).where("rel not like '%.md'")
    hits = impact.affected(views.edges(spark, sf), files, changed)
    return impact.tests_to_run(files, changed, hits)


@bound("impact_not_in_graph", "select repo, path as rel from b_diff where status <> 'D' and path like '%.md'")
def impact_not_in_graph(spark, sf):
    return impact.not_in_graph(_change(spark, sf), _graph_files(spark, sf))


@bound("impact_seeds", "select f.repo, f.id, f.rel from b_files f join b_diff d on d.path = f.rel where d.status <> 'D' and f.rel not like '%.md'")
def impact_seeds(spark, sf):
    return impact.seeds(_change(spark, sf), _graph_files(spark, sf)).select("repo", "id", "rel")


@bound("impact_deleted", "select repo, path as rel from b_diff where status = 'D'")
def impact_deleted(spark, sf):
    return impact.split_changes(views.diff(spark, sf))[1]


@bound("go_test_packages", """
select distinct repo, './' || array_to_string(list_slice(string_split(rel,'/'), 1, len(string_split(rel,'/'))-1), '/') as package
from b_files where ends_with(rel, '_test.go')""")
def go_test_packages(spark, sf):
    return impact.go_test_packages(views.files(spark, sf))


@bound("direct_importers", """
with folder as (select id, rel, array_to_string(list_slice(string_split(rel,'/'),1,len(string_split(rel,'/'))-1),'/') as dir from b_files),
changed as (select distinct f.dir from b_diff d join folder f on f.rel = d.path where d.status <> 'D' and d.path like '%.go'),
seed as (select distinct f.id from b_diff d join folder f on f.rel = d.path where d.status <> 'D' and d.path like '%.go'),
hit as (select distinct f.* from b_edges e join seed s on s.id = e.dst join folder f on f.id = e.src where f.id not in (select id from seed)),
go as (select * from hit where rel like '%.go' and dir not in (select dir from changed)),
unsafe as (select distinct g.dir from go g join b_edges e on e.src = g.id join hit h on h.id = e.dst
  where h.dir <> g.dir and h.dir not in (select dir from changed))
select distinct 'corpus' as repo, dir from go where dir not in (select dir from unsafe)""")
def direct_importers(spark, sf):
    files, edges = views.files(spark, sf), views.edges(spark, sf)
    go = _change(spark, sf).where("rel like '%.go'")
    hits = impact.affected(edges, files, go, depth=1).select("repo", "id", "rel")
    dirs = go.select("repo", paths.parent(F.col("rel")).alias("dir"))
    return impact.direct_importer_packages(edges, files, dirs, hits)


# ---- architecture rules -----------------------------------------------------------------

VIOLATIONS = """
with broken as (
  select s.repo, r.line, r.rule, s.rel as "from", t.rel as "to"
  from b_edges e join b_files s on s.id = e.src join b_files t on t.id = e.dst
  join b_rules r on regexp_matches(s.rel, r.from_re) and regexp_matches(t.rel, r.to_re)
  where not s.is_test)
"""


@bound("check_rules", VIOLATIONS + "\nselect * from broken")
def check_rules(spark, sf):
    return rules.violations(views.edges(spark, sf), views.files(spark, sf), views.RULES)


@bound("check_rules_changed", VIOLATIONS + """
select * from broken where "from" in (select path from b_diff where status <> 'D')""")
def check_rules_changed(spark, sf):
    return rules.violations(views.edges(spark, sf), views.files(spark, sf), views.RULES, _change(spark, sf))


@bound("unmatched_rules", """
select 'corpus' as repo, line, rule from b_rules
where not (exists (select 1 from b_files where regexp_matches(rel, from_re))
       and exists (select 1 from b_files where regexp_matches(rel, to_re)))""")
def unmatched_rules(spark, sf):
    return rules.unmatched_rules(views.files(spark, sf), views.RULES)


@bound("rule_report", VIOLATIONS + """
select 'corpus' as repo, r.line, r.rule, (select count(*) from broken b where b.line = r.line) as violations,
  r.line = 3 as unmatched, (select count(*) from b_files where not is_test) as checked
from b_rules r""")
def rule_report(spark, sf):
    return rules.rule_report(views.edges(spark, sf), views.files(spark, sf), views.RULES)


# ---- churn ------------------------------------------------------------------------------

CHURN = """
with each as (
  select distinct commit_id, i = len(string_split(path,'/')) as leaf,
    array_to_string(list_slice(string_split(path,'/'),1,i),'/') as path
  from b_touches, unnest(range(1, len(string_split(path,'/'))+1)) u(i) where {where}),
churn as (select 'corpus' as repo, path, not leaf as is_dir, count(*) as commits from each group by path, leaf)
"""
ALL = CHURN.format(where="true")
SINCE = "2001-01-01 00:00:00"


@bound("churn_paths", ALL + "\nselect * from churn")
def churn_paths(spark, sf):
    return churn_ops.churn(views.touches(spark, sf))


@bound("churn_since", CHURN.format(where=f"ts >= timestamp '{SINCE}'") + "\nselect * from churn")
def churn_since(spark, sf):
    return churn_ops.churn(views.touches(spark, sf), F.lit(SINCE).cast("timestamp_ntz"))


@bound("churn_max", ALL + "\nselect repo, is_dir, max(commits) as max_commits from churn group by all")
def churn_max(spark, sf):
    return churn_ops.churn_max(churn_ops.churn(views.touches(spark, sf)))


@bound("churn_level", ALL + """
select c.*, m as max_commits, cast((commits*8-1)//m + 1 as integer) as level,
  substr('▁▂▃▄▅▆▇█', cast((commits*8-1)//m + 1 as bigint), 1) || ' ' || commits as bar,
  cast(case when commits*3 > m*2 then 2 when commits*3 > m then 1 else 0 end as integer) as heat
from (select *, max(commits) over (partition by is_dir) as m from churn) c""".replace("c.*,", "repo, path, is_dir, commits,"))
def churn_level(spark, sf):
    return churn_ops.churn_levels(churn_ops.churn(views.touches(spark, sf)))


@bound("hot_top5", CHURN.format(where=f"ts >= timestamp '{SINCE}'") + """
select repo, path, is_dir, commits, row_number() over (order by commits desc, path) as rank
from churn where not is_dir order by rank limit 5""")
def hot_top5(spark, sf):
    counts = churn_ops.churn(views.touches(spark, sf), F.lit(SINCE).cast("timestamp_ntz"))
    return churn_ops.hottest(counts, views.files(spark, sf))


# ---- the file tree ----------------------------------------------------------------------

UP = """
with up as (
  select rel, size, mtime, array_to_string(list_slice(string_split(rel,'/'),1,i),'/') as dir
  from {src}, unnest(range(1, len(string_split(rel,'/')))) u(i)
  union all select rel, size, mtime, '.' from {src})
"""


@bound("dir_totals", UP.format(src="b_files") + """
select 'corpus' as repo, dir, cast(sum(size) as bigint) as size, count(*) as files, max(mtime) as mtime
from up group by dir""")
def dir_totals(spark, sf):
    return tree.folder_totals(views.files(spark, sf))


@bound("dir_totals_geo", UP.format(src="(select *, 0 as mtime from b_geo)") + """
select 'corpus' as repo, dir, cast(sum(size) as bigint) as size from up group by dir""")
def dir_totals_geo(spark, sf):
    return tree.rollup_folders(views.geo(spark, sf), ["size"])


DIFF_UP = """
with up as (
  select path, added, deleted, array_to_string(list_slice(string_split(path,'/'),1,i),'/') as dir, i as lvl
  from b_diff, unnest(range(1, len(string_split(path,'/')))) u(i)
  union all select path, added, deleted, '.', 0 from b_diff)
"""


@bound("diff_rollup", DIFF_UP + """
select 'corpus' as repo, dir, cast(sum(added) as bigint) as added, cast(sum(deleted) as bigint) as deleted,
  count(*) as changes, lvl = 1 as truncated
from up where lvl <= 1 group by dir, lvl""")
def diff_rollup(spark, sf):
    return tree.diff_rollup(views.diff(spark, sf), max_depth=1)


@bound("diff_change_counts", DIFF_UP + "\nselect 'corpus' as repo, dir, count(*) as changes from up where dir <> '.' group by dir")
def diff_change_counts(spark, sf):
    return tree.change_counts(views.diff(spark, sf))


@bound("dir_summary", UP.format(src="b_files") + """, ext as (
  select dir, regexp_extract(rel, '(\\.[^./]*)$', 1) as ext, count(*) as n from up group by all),
best as (select dir, cast(sum(n) as bigint) as files, max(n) as top from ext group by dir),
lead as (select e.dir, min(e.ext) as ext from ext e join best b on b.dir = e.dir and e.n = b.top group by e.dir)
select 'corpus' as repo, b.dir, b.files,
  b.files || case when b.files = 1 then ' file' else ' files' end ||
  case when b.top * 2 > b.files then ', mostly ' || l.ext else '' end as summary
from best b join lead l using (dir)""")
def dir_summary(spark, sf):
    return tree.folder_summary(views.files(spark, sf))


@bound("stats_corpus", """
select 'corpus' as repo, count(*) as files, (select count(distinct dir) from b_dirs) as directories,
  cast(sum(size) as bigint) as total_size from b_files""")
def stats_corpus(spark, sf):
    return tree.corpus_stats(views.files(spark, sf))


LANG = """
with lang as (
  select case id%6 when 0 then 'Go' when 1 then 'TypeScript' when 2 then 'Python' when 3 then 'Rust'
    when 4 then 'Java' else 'Markdown' end as language, count(*) as files from b_files group by 1)
"""


@bound("stats_languages", LANG + "\nselect 'corpus' as repo, language, files from lang")
def stats_languages(spark, sf):
    return tree.languages(views.files(spark, sf))


@bound("language_share", LANG + """, total as (select cast(sum(files) as bigint) as t from lang)
select 'corpus' as repo, language, files, row_number() over (order by files desc, language) as rank,
  cast((files*100 + t//2) // t as bigint) as percent
from lang, total order by rank limit 6""")
def language_share(spark, sf):
    return tree.language_shares(views.files(spark, sf))


IGNORE = ["*.md", "small/", "!small/brand1*/", "large/brand2?/*_test*", "!*_5*.md", "**/test_*"]
OPTIONS = tree.ScanOptions(ignore=IGNORE)
# Spelled out: promoted has no rule; a re-included folder stays hidden below a hidden one.
HIDDEN = """
with marked as (
  select *, case
    when starts_with(rel, 'small/') then 'small'
    when regexp_matches(rel, '^(?:.*/)?test_[^/]*$') then rel
    when regexp_matches(rel, '(^|/)[^/]*_5[^/]*\\.md$') then null
    when regexp_matches(rel, '^large/brand2[^/]/[^/]*_test[^/]*$') then rel
    when rel like '%.md' then rel end as hidden_at
  from b_files)
"""


@bound("ignore_filter", HIDDEN + "\nselect repo, id, rel from marked where hidden_at is null")
def ignore_filter(spark, sf):
    return tree.visible_files(views.files(spark, sf), OPTIONS).select("repo", "id", "rel")


@bound("skipped_entries", HIDDEN + "\nselect repo, count(distinct hidden_at) as skipped from marked group by repo")
def skipped_entries(spark, sf):
    return tree.skipped(tree.mark_hidden(views.files(spark, sf), OPTIONS))


@bound("vcs_visible", """
select repo, id, rel from b_files where rel in (select path from b_touches)""")
def vcs_visible(spark, sf):
    seen = tree.with_parents(views.touches(spark, sf).select("repo", "path"))
    options = tree.ScanOptions(vcs_aware=True)
    return tree.visible_files(views.files(spark, sf), options, seen).select("repo", "id", "rel")


@bound("only_filter", """
with kept as (select * from b_files where rel like '%.go' or regexp_matches(rel, '^promo/[^/]*/[^/]*$'))
select repo, rel, false as is_dir from kept
union all select distinct d.repo, d.dir, true from b_dirs d join kept k on k.rel = d.file""")
def only_filter(spark, sf):
    kept = tree.visible_files(views.files(spark, sf), tree.ScanOptions(only=["*.go", "promo/*/*"]))
    return tree.entries(kept).select("repo", "rel", "is_dir")


@bound("changed_within", """
select repo, id, rel from b_files where mtime >= timestamp '2024-03-01 00:00:00'""")
def changed_within(spark, sf):
    options = tree.ScanOptions(since=datetime(2024, 3, 1), show_hidden=True, no_ignore=True)
    return tree.visible_files(views.files(spark, sf), options).select("repo", "id", "rel")


@bound("depth_truncate", UP.format(src="b_files") + """
select 'corpus' as repo, dir as rel, cast(sum(size) as bigint) as size, true as is_dir, contains(dir, '/') as truncated
from up where dir <> '.' and length(dir) - length(replace(dir,'/','')) < 2 group by dir""")
def depth_truncate(spark, sf):
    return tree.truncate_depth(tree.entries(views.files(spark, sf)), 2).select("repo", "rel", "size", "is_dir", "truncated")


@bound("sibling_order_size", """
select repo, rel, row_number() over (partition by repo, array_to_string(list_slice(string_split(rel,'/'),1,len(string_split(rel,'/'))-1),'/')
  order by size desc, string_split(rel,'/')[-1]) as pos from b_files""")
def sibling_order_size(spark, sf):
    files = _leaf_entries(spark, sf)
    return ranking.sibling_order(files, "size").select("repo", "rel", "pos")


@bound("sibling_order_time_reversed", UP.format(src="b_files") + """, every as (
  select rel, false as is_dir, mtime from b_files
  union all select dir, true, max(mtime) from up where dir <> '.' group by dir)
select 'corpus' as repo, rel, is_dir, row_number() over (
  partition by array_to_string(list_slice(string_split(rel,'/'),1,len(string_split(rel,'/'))-1),'/')
  order by is_dir desc, mtime asc, string_split(rel,'/')[-1]) as pos from every""")
def sibling_order_time_reversed(spark, sf):
    entries = tree.entries(views.files(spark, sf))
    return ranking.sibling_order(entries, "time", reverse=True, dirs_first=True).select("repo", "rel", "is_dir", "pos")


def _leaf_entries(spark, sf):
    rel = F.col("rel")
    return views.files(spark, sf).select(
        "repo", "rel", F.lit(False).alias("is_dir"), paths.base(rel).alias("name"), paths.parent(rel).alias("dir"), "size", "mtime"
    )


@bound("cap_files", """
with n as (select *, array_to_string(list_slice(string_split(rel,'/'),1,2),'/') as dir from b_files)
select repo, dir, rel, m as more from (
  select *, row_number() over (partition by dir order by string_split(rel,'/')[-1]) as k,
    greatest(count(*) over (partition by dir) - 3, 0) as m from n) where k <= 3""")
def cap_files(spark, sf):
    kept, more = ranking.cap_files(_leaf_entries(spark, sf), [F.col("name")], 3)
    return kept.join(more, ["repo", "dir"], "left").select("repo", "dir", "rel", F.coalesce("more", F.lit(0)).cast("long").alias("more"))


@bound("capped_list", """
with n as (select *, array_to_string(list_slice(string_split(rel,'/'),1,2),'/') as dir from b_files),
g as (select repo, dir, list(rel order by rel) as l from n group by all)
select repo, dir, array_to_string(l[1:4], ', ') || case when len(l) > 4 then ', +' || (len(l)-4) || ' more' else '' end as items,
  len(l) as total, greatest(len(l) - 4, 0) as omitted from g""")
def capped_list(spark, sf):
    return ranking.capped_names(_leaf_entries(spark, sf), ["repo", "dir"], [F.col("rel")], "rel", 4)


@bound("reading_order", USED_BY + """, step as (
  select f.rel, 'used by ' || u.used_by || case when u.used_by = 1 then ' file' else ' files' end as reason,
    row_number() over (order by u.used_by desc, f.rel) as rank
  from used u join b_files f using (id) where not f.is_test)
select 'corpus' as repo, rank, rel, reason from step where rank <= 15""")
def reading_order(spark, sf):
    files = views.files(spark, sf)
    return graph.reading_order(files, views.edges(spark, sf), files, 15)


@bound("layout", """
with n as (select string_split(rel,'/')[1] as dir, count(*) as files from b_files group by 1)
select 'corpus' as repo, dir, files, row_number() over (order by dir) as rank, greatest((select count(*) from n) - 4, 0) as omitted
from n order by dir limit 4""")
def layout(spark, sf):
    shown, omitted = tree.layout(views.files(spark, sf), 4)
    return shown.join(omitted, "repo").select("repo", "dir", "files", "rank", F.col("omitted").cast("long").alias("omitted"))


@bound("tree_with_changes", """
with gone as (select path, status from b_diff where path like '%.py'),
disk as (select rel from b_files where rel not like '%.py'),
dirs as (select distinct d.dir from b_dirs d join disk k on k.rel = d.file),
every as (
  select k.rel, false as is_dir, false as missing, d.status from disk k left join b_diff d on d.path = k.rel
  union all select dir, true, false, null from dirs
  union all select path, false, true, status from gone
  union all select distinct d.dir, true, true, null from b_dirs d join gone g on g.path = d.file where d.dir not in (select dir from dirs))
select 'corpus' as repo, rel, is_dir, missing, status from every""")
def tree_with_changes(spark, sf):
    disk = views.files(spark, sf).where("rel not like '%.py'")
    changes = views.diff(spark, sf)
    return tree.insert_changes(tree.entries(disk), changes).select("repo", "rel", "is_dir", "missing", "status")


@bound("fingerprint", """
with h as (select sha256(rel || '|' || size || '|' || strftime(mtime, '%Y-%m-%d %H:%M:%S')) as x from b_files),
s as (select count(*) as n, sum(cast('0x'||substr(x,1,15) as bigint)) as a, sum(cast('0x'||substr(x,17,15) as bigint)) as b,
  sum(cast('0x'||substr(x,33,15) as bigint)) as c from h)
select 'corpus' as repo, sha256(n || '|' || a || '|' || b || '|' || c) as fingerprint from s""")
def fingerprint(spark, sf):
    return tree.fingerprint(views.files(spark, sf))


# ---- labels and scalars -----------------------------------------------------------------


@bound("test_files", "select repo, id, rel, is_test from b_files")
def test_files(spark, sf):
    return views.files(spark, sf).select("repo", "id", "rel", "is_test")


@bound("runnable_tests", f"select f.repo, f.rel, {RUNNABLE} as runnable from b_files f")
def runnable_tests(spark, sf):
    return views.files(spark, sf).select("repo", "rel", labels.is_runnable_test(F.col("rel")).alias("runnable"))


@bound("low_value", """
select page_id, url, len(list_intersect(string_split(url,'/')[1:-2], ['test','tests','testdata','__tests__','examples','example','_examples',
  'tutorial','tutorials','samples','script','scripts','docs_src','fixtures','vendor','third_party'])) > 0 as low_value,
  string_split(url,'/')[-1] in ('main.go','app.py','index.js') as entry from pages""")
def low_value(spark, sf):
    pages = views.table(spark, sf, "pages")
    return pages.select(
        "page_id", "url", labels.is_low_value(F.col("url")).alias("low_value"),
        paths.base(F.col("url")).isin("main.go", "app.py", "index.js").alias("entry"),
    )


@bound("path_parts", """
select id, rel, string_split(rel,'/')[-1] as base, array_to_string(list_slice(string_split(rel,'/'),1,2),'/') as parent,
  regexp_extract(rel, '(\\.[^./]*)$', 1) as ext, cast(len(string_split(rel,'/')) - 1 as integer) as depth,
  string_split(rel,'/')[1] || '/' || string_split(rel,'/')[3] as cleaned from b_files""")
def path_parts(spark, sf):
    rel = F.col("rel")
    messy = F.concat(F.lit("./"), paths.parent(rel), F.lit("/..//./"), paths.base(rel))
    return views.files(spark, sf).select(
        "id", "rel", paths.base(rel).alias("base"), paths.parent(rel).alias("parent"), paths.ext(rel).alias("ext"),
        paths.depth(rel).alias("depth"), paths.clean(messy).alias("cleaned"),
    )


@bound("glob_match", """
select id, regexp_matches(rel, '^[^/]*/brand[12][^/]*/[^/]*$') as two_level, regexp_matches(rel, '^(?:.*/)?[^/]*\\.ts$') as any_ts,
  regexp_matches(rel, '^[^l]arge/.*$') as class from b_files""")
def glob_match(spark, sf):
    rel = F.col("rel")
    hit = lambda g: rel.rlike(f"^{globs.glob_regex(g)}$")
    return views.files(spark, sf).select(
        "id", hit("*/brand[12]*/*").alias("two_level"), hit("**/*.ts").alias("any_ts"), hit("[!l]arge/**").alias("class")
    )


@bound("token_estimate", "select conv_id, turn, cast((strlen(text)+3)//4 as bigint) as tokens from conversations")
def token_estimate(spark, sf):
    return views.table(spark, sf, "conversations").select("conv_id", "turn", text.tokens(F.col("text")).alias("tokens"))


@bound("budget_prefix", """
select conv_id, turn, cost, used from (
  select *, cast(sum(cost) over (partition by conv_id order by turn, text rows unbounded preceding) as bigint) as used from (
    select conv_id, turn, text, cast((strlen(text)+4)//4 as bigint) as cost from conversations)) where used <= 60""")
def budget_prefix(spark, sf):
    lines = views.table(spark, sf, "conversations").select(
        "conv_id", "turn", "text", text.tokens(F.concat("text", F.lit("\n"))).alias("cost")
    )
    return ranking.budget_prefix(lines, ["conv_id"], [F.col("turn"), F.col("text")], "cost", 60).select("conv_id", "turn", "cost", "used")


@bound("url_redact", r"""
select page_id, regexp_replace(regexp_replace(x, '([a-zA-Z][a-zA-Z0-9+.-]*://)[^\s<>"''/?#]*@', '\1', 'g'),
  '([a-zA-Z][a-zA-Z0-9+.-]*://[^\s<>"''?#]+)[?#][^\s<>"'']*', '\1', 'g') as clean
from (select page_id, html || ' ' || replace(url, '://', '://user:pw@') || '?token=1#frag end' as x from pages)""")
def url_redact(spark, sf):
    x = F.concat("html", F.lit(" "), F.replace(F.col("url"), F.lit("://"), F.lit("://user:pw@")), F.lit("?token=1#frag end"))
    return views.table(spark, sf, "pages").select("page_id", text.redact_urls(x).alias("clean"))


@bound("printable", r"select doc_id, regexp_replace(text, '[\p{Cc}\p{Cf}]', ' ', 'g') as clean from documents")
def printable(spark, sf):
    return views.table(spark, sf, "documents").select("doc_id", text.printable(F.col("text")).alias("clean"))


@bound("one_line", r"""
select doc_id, case when length(t) > 140 then substr(t, 1, 140) || '…' else t end as line from (
  select doc_id, trim(regexp_replace(text, '[\s\x{0B}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) as t from documents)""")
def one_line(spark, sf):
    return views.table(spark, sf, "documents").select("doc_id", text.one_line(F.col("text")).alias("line"))


@bound("plain_text", r"""
select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x,
  '\]\([^)]*\)', ']', 'g'), '\]\[[^\]]*\]', ']', 'g'), '!?\[([^\]]*)\]', '\1', 'g'), '[*_]{2}|`', '', 'g'),
  '\\([^\w\s])', '\1', 'g'), '-*_> ' || chr(8194) || chr(8195)) as plain
from (select doc_id, text as x from documents)""")
def plain_text(spark, sf):
    return views.table(spark, sf, "documents").select("doc_id", text.plain_text(F.col("text")).alias("plain"))


@bound("first_sentences", r"""
with c as (select doc_id, text, substr(text, 1, 200) as cut from documents),
p as (select *, regexp_extract(cut, '(?s)^(.*)\. ', 1) as pre from c)
select doc_id, case when length(text) <= 200 then text
  when contains(cut, '. ') and strlen(pre) >= strlen(cut)//2 then pre || '.' else cut || '…' end as lead
from p""")
def first_sentences(spark, sf):
    return views.table(spark, sf, "documents").select("doc_id", text.first_sentences(F.col("text")).alias("lead"))


def _size_sql(unit: int, small: str, labels_: list[str], trim: bool) -> str:
    out = ""
    for exp in range(1, 6):
        num = f"printf('%.1f', cast(n as double)/{unit**exp}.0)"
        num = f"regexp_replace({num}, '\\.0$', '')" if trim else num
        out += f" when n < {unit**(exp+1)} then {num} || '{labels_[exp-1]}'"
    return f"case when n < {unit} then n || '{small}'{out} end"


@bound("human_size", f"""
select o_orderkey, {_size_sql(1024, 'B', text.HUMAN_UNITS, True)} as size, {_size_sql(1000, 'B', text.HUMAN_UNITS, True)} as si
from (select o_orderkey, cast(floor(o_totalprice) as bigint) * (1 + o_orderkey % 900) as n from orders)""")
def human_size(spark, sf):
    n = F.floor("o_totalprice").cast("long") * (1 + F.col("o_orderkey") % 900)
    return views.table(spark, sf, "orders").select("o_orderkey", text.human_size(n).alias("size"), text.human_size(n, si=True).alias("si"))


@bound("format_size", f"""
select o_orderkey, {_size_sql(1024, ' B', [' ' + u for u in text.BINARY_UNITS], False)} as size,
  {_size_sql(1000, ' B', [' ' + u for u in text.DECIMAL_UNITS], False)} as si
from (select o_orderkey, cast(floor(o_totalprice) as bigint) * (1 + o_orderkey % 900) as n from orders)""")
def format_size(spark, sf):
    n = F.floor("o_totalprice").cast("long") * (1 + F.col("o_orderkey") % 900)
    return views.table(spark, sf, "orders").select("o_orderkey", text.format_size(n).alias("size"), text.format_size(n, si=True).alias("si"))


@bound("plural", """
select id, (id%4) || case when id%4=1 then ' file' else ' files' end as f,
  (id%4) || case when id%4=1 then ' directory' else ' directories' end as d from b_files""")
def plural(spark, sf):
    n = F.col("id") % 4
    return views.files(spark, sf).select("id", text.plural(n, "file").alias("f"), text.plural(n, "directory").alias("d"))


@bound("paste_safe", r"""
select doc_id, regexp_matches(source, '^[A-Za-z0-9_./][A-Za-z0-9_./-]*$') as source_safe,
  regexp_matches(text, '^[A-Za-z0-9_./][A-Za-z0-9_./-]*$') as text_safe from documents""")
def paste_safe(spark, sf):
    safe = text.is_paste_safe
    return views.table(spark, sf, "documents").select("doc_id", safe(F.col("source")).alias("source_safe"), safe(F.col("text")).alias("text_safe"))


@bound("word_mention", r"""
select doc_id, regexp_matches(text, '\bdata\b') as word,
  regexp_matches(text, '(?:^|[^A-Za-z0-9_$])data(?:[^A-Za-z0-9_$]|$)') as identifier from documents""")
def word_mention(spark, sf):
    t = F.col("text")
    return views.table(spark, sf, "documents").select(
        "doc_id", text.mentions_word(t, "data").alias("word"), text.mentions_word(t, "data", dollar_is_word=True).alias("identifier")
    )


@bound("language_label", """
select doc_id, case when doc_id%5=0 then 'Makefile' when doc_id%5=1 then null when doc_id%5=2 then 'TypeScript'
  when doc_id%5=3 then upper(source) else null end as label from documents""")
def language_label(spark, sf):
    k = F.col("doc_id") % 5
    path = F.when(k == 0, "a/Makefile").when(k == 1, "a/.env").when(k == 2, "a/b.TSX").when(k == 3, F.concat(F.lit("a/x."), "source")).otherwise("a/plain")
    return views.table(spark, sf, "documents").select("doc_id", labels.language(path).alias("label"))


@bound("reason_list", """
with g as (select e.src, list(f.rel order by f.rel) as l from b_edges e join b_files f on f.id = e.dst group by e.src)
select src, 'uses ' || array_to_string(l[1:3], ', ') || case when len(l) > 3 then ' +' || (len(l)-3) || ' more' else '' end as reason from g""")
def reason_list(spark, sf):
    names = views.edges(spark, sf).join(views.files(spark, sf).select(F.col("id").alias("dst"), "rel"), "dst")
    return graph.reason_text(names, ["src"], "rel", "uses ").select("src", "reason")


# ---- extraction and resolution of source texts derived from the tables ------------------


@bound("code_specs", """
with use as (select repo, prefix||src_dir||'/'||tag||ext as src, u.* exclude (src), u.src as a from c_lang, c_use u),
spec as (
  select repo, src, unnest(case repo
    when 'js' then ['../../'||src_dir||'/'||src_stem, '../../'||dst_dir||'/'||dst_stem]
    when 'py' then ['.', '.'||src_stem, 'os', replace(dst_dir,'/','.')||'.'||dst_stem]
    when 'java' then [replace(src_dir,'/','.')||'.'||src_stem, replace(dst_dir,'/','.')||'.'||dst_stem]
    when 'rs' then ['super::'||src_stem, 'super::'||src_stem||'::f'||a, 'super::'||src_stem, 'crate::'||replace(dst_dir,'/','::')||'::'||dst_stem||'::f'||dst] end) as spec
  from use where repo <> 'go')
select repo, src, spec, count(*) as n from spec group by all""")
def code_specs(spark, sf):
    from ..extract.imports import import_specs

    # A file's specs travel side by side and are packed together; scattered by spec, each would bring the path again.
    specs = import_specs(views.code(spark, sf)).repartition("repo", "src")
    return specs.groupBy("repo", "src", "spec").agg(F.count(F.lit(1)).alias("n"))


@bound("code_symbols", """
select repo, prefix||dir||'/'||stem||ext as rel, case repo
  when 'js' then 'export function F'||id||'(a: number = 1): number' when 'py' then 'def F'||id||'(a: int = 1) -> int'
  when 'java' then 'public final class '||stem when 'rs' then 'pub fn f'||id||'(a: u8) -> u8'
  when 'go' then 'func F'||id||'(a, b int) int' end as symbol
from c_lang, c_place""")
def code_symbols(spark, sf):
    from ..resolve.graph import all_symbols

    rows = all_symbols(views.code(spark, sf))
    return rows.select("repo", "rel", F.explode("symbols").alias("symbol"))


def _language_links(repo: str):
    def run(spark, sf):
        from ..resolve import graph as code_graph

        return code_graph.build(views.code(spark, sf, repo)).edges

    return run


for _repo in ("js", "py", "java", "rs"):
    bound(f"code_edges_{_repo}", f"select repo, src, dst from c_edges where repo = '{_repo}'")(_language_links(_repo))
# The package of a used file is linked whole only where no used name is found: here all are.
bound("code_edges_go", "select repo, src, dst from c_edges where repo = 'go'")(_language_links("go"))


@bound("go_token_facts", """
select prefix||dir||'/'||stem||ext as rel, 'declares' as fact, 'F'||id as name from c_lang, c_place where repo = 'go'
union all select src_dir||'/'||tag||'.go', 'declares', tag from c_use
union all select src_dir||'/'||tag||'.go', 'imports', 'ex/'||dst_dir from c_use where src_dir <> dst_dir
union all select src_dir||'/'||tag||'.go', 'selects', 'd.F'||dst from c_use where src_dir <> dst_dir
union all select prefix||dir||'/'||stem||ext, 'package', string_split(dir,'/')[2] from c_lang, c_place where repo = 'go'
union all select src_dir||'/'||tag||'.go', 'package', string_split(src_dir,'/')[2] from c_use""")
def go_token_facts(spark, sf):
    from ..extract import golang as go

    rows = go.file_facts(views.code(spark, sf, "go"))
    fact = lambda df, kind, name: df.select("rel", F.lit(kind).alias("fact"), name.alias("name"))
    out = fact(go.declares(rows), "declares", F.col("name"))
    out = out.unionByName(fact(go.imports(rows), "imports", F.col("path")))
    out = out.unionByName(fact(go.selectors(rows), "selects", F.concat_ws(".", "pkg", "name")))
    return out.unionByName(fact(go.packages(rows), "package", F.col("pkg")))


# ---- ancestor, prefix and suffix joins --------------------------------------------------


@bound("nearest_ancestor", """
with folder as (select id, rel, array_to_string(list_slice(string_split(rel,'/'),1,2),'/') as dir from b_files),
marks as (select distinct array_to_string(list_slice(string_split(rel,'/'),1,1 + id % 2),'/') as at from b_files where id % 50 = 0 and id % 3 <> 2
  union select '.')
select distinct 'corpus' as repo, dir, coalesce(m2.at, m1.at, '.') as at from folder
left join marks m2 on m2.at = dir left join marks m1 on m1.at = string_split(dir,'/')[1]""")
def nearest_ancestor(spark, sf):
    from ..resolve.common import nearest

    rel = F.col("rel")
    files = views.files(spark, sf)
    dirs = files.select("repo", paths.parent(rel).alias("dir")).distinct()
    marks = files.where("id % 50 = 0 and id % 3 <> 2").select(
        "repo", F.when(F.col("id") % 2 == 0, F.substring_index(rel, "/", 1)).otherwise(paths.parent(rel)).alias("at")
    ).unionByName(files.select("repo", F.lit(".").alias("at"))).distinct()
    return nearest(dirs, marks, F.lit(1)).select("repo", "dir", "at")


@bound("longest_prefix", """
with known as (select distinct string_split(rel,'/')[1] as key from b_files
  union select distinct array_to_string(list_slice(string_split(rel,'/'),1,2),'/') from b_files where id % 7 = 0)
select f.repo, f.rel, max_by(k.key, length(k.key)) as key from b_files f join known k on f.rel = k.key or starts_with(f.rel, k.key||'/')
group by f.repo, f.rel""")
def longest_prefix(spark, sf):
    from ..resolve.common import longest_prefix as join

    files = views.files(spark, sf)
    known = files.select("repo", F.substring_index("rel", "/", 1).alias("key")).unionByName(
        files.where("id % 7 = 0").select("repo", paths.parent(F.col("rel")).alias("key"))
    ).distinct()
    return join(files, "rel", known)


@bound("suffix_first", """
with tails as (select rel, array_to_string(list_slice(string_split(regexp_replace(rel,'\\.[^./]*$',''),'/'),i,3),'/') as suffix
  from b_files, range(1,4) r(i))
select 'corpus' as repo, suffix, min(rel) as rel from (select *, translate(rel,'/',chr(1)) as k from tails) group by suffix""".replace(
    "min(rel) as rel", "arg_min(rel, k) as rel"))
def suffix_first(spark, sf):
    from ..resolve.common import suffix_index

    return suffix_index(views.files(spark, sf))


# ---- quality, runs, freshness -----------------------------------------------------------


@bound("graph_score", """
with f as (select coalesce(w.src,g.src) as src, coalesce(w.dst,g.dst) as dst, w.src is not null as wanted, g.src is not null as drawn
  from b_edges w full join b_got g on w.src=g.src and w.dst=g.dst)
select 'corpus' as repo, count(*) filter (wanted) as want, count(*) filter (wanted and drawn) as hit, count(*) filter (drawn) as got,
  count(*) filter (drawn and wanted) as correct, count(*) filter (wanted and not drawn) as missed, count(*) filter (drawn and not wanted) as wrong,
  count(*) filter (wanted and drawn) / count(*) filter (wanted) as recall, count(*) filter (drawn and wanted) / count(*) filter (drawn) as precision
from f""")
def graph_score(spark, sf):
    return quality.graph_score(quality.compare_edges(*views.truth(spark, sf)))


@bound("missed_wrong", """
select repo, src, dst, 'missed' as kind from (select * from b_edges except select * from b_got)
union all select repo, src, dst, 'wrong' from (select * from b_got except select * from b_edges)""")
def missed_wrong(spark, sf):
    flags = quality.compare_edges(*views.truth(spark, sf))
    return quality.missed(flags).withColumn("kind", F.lit("missed")).unionByName(
        quality.wrong(flags).withColumn("kind", F.lit("wrong")))


@bound("run_summary", """
select event_type, count(*) as runs, count(*) filter (not ok) as failed, count(*) filter (ok and exact) as exact,
  avg(value) filter (ok) as mean_value, sum(value) filter (ok) as sum_value, median(value) filter (ok) as median_value
from (select *, event_id % 11 <> 0 as ok, user_id % 3 = 0 as exact from events) group by event_type""")
def run_summary(spark, sf):
    runs = views.table(spark, sf, "events").withColumn("ok", F.expr("event_id % 11 <> 0")).withColumn("exact", F.expr("user_id % 3 = 0"))
    return quality.run_summary(runs, "event_type", ["value"])


@bound("folder_edges", """
with folder as (select id, array_to_string(list_slice(string_split(rel,'/'),1,2),'/') as dir from b_files)
select distinct e.repo, e.src, d.dir as dst from b_edges e join folder s on s.id = e.src join folder d on d.id = e.dst where s.dir <> d.dir""")
def folder_edges(spark, sf):
    return quality.folder_edges(views.edges(spark, sf), views.files(spark, sf))


# ---- declarations reaching a change -----------------------------------------------------
# Parts are declarations: a method "T.m" of type brand and name word, or a function; edges are references.

DECL = """
decl as (
  select f.id, case when id % 3 = 0 then lower(replace(p_brand,'#',''))||'.'||string_split(p_name,' ')[1] else 'fn'||id end as name,
    case when id % 3 = 0 then string_split(p_name,' ')[1] end as method
  from b_files f join part on p_partkey = id),
refs as (
  select s.name as name, case when d.method is not null and e.src % 2 = 0 then '.'||d.method else d.name end as ref
  from b_edges e join decl s on s.id = e.src join decl d on d.id = e.dst)
"""


@bound("decl_reach", f"""
with {DECL.strip()},
seed as (select d.name from b_hubs h join decl d using (id)),
link as (
  select r.name, d.name as target from refs r join decl d on d.name = r.ref
  union select r.name, d.name from refs r join decl d on '.'||d.method = r.ref),
hit(name) as (select name from seed union select l.name from hit h join link l on l.target = h.name)
select 'corpus' as repo, 'pkg' as dir, name from hit""", recursive=True)
def decl_reach(spark, sf):
    from ..operators import declarations

    decls, refs = _declarations(spark, sf)
    seeds = views.hubs(spark, sf).join(decls.select("id", "name"), "id").select("repo", F.lit("pkg").alias("dir"), "name").distinct()
    return declarations.reaching(decls.select("repo", "dir", "name").distinct(), refs, seeds)


def _declarations(spark, sf):
    word = "split(p_name, ' ')[0]"
    decls = views.table(spark, sf, "part").selectExpr(
        "'corpus' as repo", "'pkg' as dir", "p_partkey as id",
        f"case when p_partkey % 3 = 0 then concat(lower(translate(p_brand, '#', '')), '.', {word}) else concat('fn', p_partkey) end as name",
        f"case when p_partkey % 3 = 0 then {word} end as method",
    )
    a = decls.selectExpr("id as src", "name")
    b = decls.selectExpr("id as dst", "name as to_name", "method")
    refs = views.edges(spark, sf).join(a, "src").join(b, "dst").selectExpr(
        "repo", "'pkg' as dir", "name", "case when method is not null and src % 2 = 0 then concat('.', method) else to_name end as ref"
    ).distinct()
    return decls, refs


@bound("test_narrowing", """
with t as (select array_to_string(list_slice(string_split(rel,'/'),1,2),'/') as dir, 'Test'||id as name, id in (select src from b_edges) as hit
  from b_files where is_test),
g as (select dir, count(*) as total, count(*) filter (hit) as reached from t group by dir)
select 'corpus' as repo, g.dir, t.name from g join t using (dir) where t.hit and reached > 0 and reached <= total // 2""")
def test_narrowing(spark, sf):
    from ..operators import declarations

    files = views.files(spark, sf)
    tests = files.where("is_test").select("repo", paths.parent(F.col("rel")).alias("dir"), F.concat(F.lit("Test"), F.col("id").cast("string")).alias("name"), "id")
    reached = tests.join(views.edges(spark, sf).select(F.col("src").alias("id")).distinct(), "id", "left_semi").select("repo", "dir", "name")
    return declarations.narrowed_tests(tests.select("repo", "dir", "name"), reached).select("repo", "dir", "name")


@bound("fingerprint_changed", """
select repo, rel, 'modified' as change from b_files where id % 97 = 0 and id % 50 <> 0
union all select repo, rel, 'removed' from b_files where id % 50 = 0
union all select repo, 'new/' || rel, 'added' from b_files where id % 50 = 0""")
def fingerprint_changed(spark, sf):
    from ..streaming.incremental import changes

    old = views.files(spark, sf)
    grown = F.when((F.col("id") % 97 == 0) & (F.col("id") % 50 != 0), F.col("size") + 1).otherwise(F.col("size"))
    moved = F.when(F.col("id") % 50 == 0, F.concat(F.lit("new/"), "rel")).otherwise(F.col("rel"))
    return changes(old, old.withColumn("size", grown).withColumn("rel", moved))


# ---- streams: the events table read as commit touches -----------------------------------

_STREAM = """
with t as (select 'corpus' as repo, 'u' || user_id || '/' || event_type as path, ts from events),
last as (select max(ts) - interval 2 day as closed from t)
"""


def _event_stream(spark, sf):
    from ..streaming.churn import read_touches

    schema = views.table(spark, sf, "events").schema
    raw = read_touches(spark, sf, schema, "events.parquet")
    return raw.select(
        F.lit(views.REPO).alias("repo"), F.col("event_id").alias("commit_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("/"), "event_type").alias("path"),
    )


def _drained(spark, stream):
    import uuid

    from ..storage import scratch_root
    from ..streaming.churn import drain

    at = f"{scratch_root(spark)}/codeatlas/stream-{uuid.uuid4().hex[:8]}"
    out = drain(stream, at + "/out", at + "/checkpoint")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


@bound("stream_churn_day", _STREAM + """, w as (
  select repo, path, date_trunc('day', ts) as start, count(*) as commits from t group by all)
select repo, path, cast(start as timestamp) as start, cast(start + interval 1 day as timestamp) as "end", commits
from w, last where start + interval 1 day <= closed""")
def stream_churn_day(spark, sf):
    from ..streaming.churn import windowed_churn

    return _drained(spark, windowed_churn(_event_stream(spark, sf), "1 day", late="2 days"))


@bound("stream_churn_sliding", _STREAM + """, w as (
  select repo, path, date_trunc('day', ts) - k * interval 1 day as start, count(*) as commits from t, range(0, 7) r(k) group by all)
select repo, path, cast(start as timestamp) as start, cast(start + interval 7 day as timestamp) as "end", commits
from w, last where start + interval 7 day <= closed""")
def stream_churn_sliding(spark, sf):
    from ..streaming.churn import windowed_churn

    return _drained(spark, windowed_churn(_event_stream(spark, sf), "7 days", "1 day", late="2 days"))


@bound("stream_bursts", _STREAM + """, gaps as (
  select *, case when ts - lag(ts) over (partition by path order by ts) < interval 6 hour then 0 else 1 end as cut from t),
runs as (select *, sum(cut) over (partition by path order by ts rows unbounded preceding) as run from gaps),
w as (select repo, path, run, min(ts) as start, max(ts) + interval 6 hour as "end", count(*) as commits from runs group by all)
select repo, path, start, "end", commits from w, last where "end" <= closed""")
def stream_bursts(spark, sf):
    from ..streaming.churn import bursts

    return _drained(spark, bursts(_event_stream(spark, sf), "6 hours", late="2 days"))


@bound("churn_by_day_window", """
select 'corpus' as repo, 'u' || user_id || '/' || event_type as path, cast(date_trunc('day', ts) as timestamp) as start, count(*) as commits
from events group by all""")
def churn_by_day_window(spark, sf):
    rows = views.table(spark, sf, "events").select(
        F.lit(views.REPO).alias("repo"), F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("/"), "event_type").alias("path"),
        F.window(F.col("ts").cast("timestamp"), "1 day")["start"].cast("timestamp_ntz").alias("start"),
    )
    return rows.groupBy("repo", "path", "start").agg(F.count(F.lit(1)).alias("commits"))


@bound("violation_links", """
with e as (select s.repo, s.rel as "from", t.rel as "to" from b_edges e join b_files s on s.id = e.src join b_files t on t.id = e.dst where not s.is_test)
select e.*, r.line, r.rule from e join b_rules r on regexp_matches("from", r.from_re) and regexp_matches("to", r.to_re)""")
def violation_links(spark, sf):
    files = views.files(spark, sf)
    named = views.edges(spark, sf).join(files.select(F.col("id").alias("src"), F.col("rel").alias("from")), "src").join(
        files.select(F.col("id").alias("dst"), F.col("rel").alias("to")), "dst")
    return rules.broken_links(named.select("repo", "from", "to"), views.RULES)


# ---- version-control exports ------------------------------------------------------------


@bound("diff_source", """
select repo, path, status, case when length(path) % 5 = 0 then 0 else added end as added, deleted from b_diff""")
def diff_source(spark, sf):
    from ..sources import vcs

    d = views.diff(spark, sf)
    renamed = F.length("path") % 7 == 0
    names = d.select("repo", F.when(renamed, F.concat("status", F.lit("100\told/"), "path", F.lit("\t"), "path")).otherwise(
        F.concat_ws("\t", "status", "path")).alias("value"))
    plus = F.when(F.length("path") % 5 == 0, "-").otherwise(F.col("added").cast("string"))
    numbers = d.select("repo", F.concat_ws("\t", plus, F.col("deleted").cast("string"), F.when(
        renamed, F.concat(F.lit("old/"), "path", F.lit(" => "), "path")).otherwise(F.col("path"))).alias("value"))
    return vcs.diff(names, numbers)


@bound("status_source", """
select repo, rel as path, ['?','U','U','M','A','M','D','R'][1 + id % 8] as status from b_files""")
def status_source(spark, sf):
    from ..sources import vcs

    codes = F.array(*[F.lit(c) for c in ("??", "UU", "AA", " M", "A ", "AM", " D", "R ")])
    xy = F.get(codes, (F.col("id") % 8).cast("int"))
    old = F.when(F.col("id") % 8 == 7, "old.go -> ").otherwise("")
    return vcs.parse_status(views.files(spark, sf).select("repo", F.concat(xy, F.lit(" "), old, "rel").alias("value")))


# ---- reports ----------------------------------------------------------------------------


@bound("report_tour_layout", """
with n as (select string_split(rel,'/')[1] as path, count(*) as files from b_files group by 1)
select 'corpus' as repo, path, files from n order by path limit 4""")
def report_tour_layout(spark, sf):
    from . import reports

    files = views.files(spark, sf)
    texts = files.select("repo", "rel", F.lit("").alias("content"))
    r = reports.tour(files, texts, views.edges(spark, sf), files, 4)
    return r.select("repo", F.explode("layout").alias("l")).select("repo", "l.path", "l.files")


@bound("report_tour_reading", USED_BY + """, step as (
  select f.rel as path, 'used by ' || u.used_by || case when u.used_by = 1 then ' file' else ' files' end as reason,
    row_number() over (order by u.used_by desc, f.rel) as rank, count(*) over () as n
  from used u join b_files f using (id) where not f.is_test)
select 'corpus' as repo, path, reason, greatest(n - 8, 0) as omitted from step where rank <= 8""")
def report_tour_reading(spark, sf):
    from . import reports

    files = views.files(spark, sf)
    texts = files.select("repo", "rel", F.lit("").alias("content"))
    r = reports.tour(files, texts, views.edges(spark, sf), files, 8)
    return r.select("repo", F.explode("readingOrder").alias("s"), F.col("omittedReading").alias("omitted")).select("repo", "s.path", "s.reason", "omitted")


@bound("report_key_files", USED_BY + """, l as (
  select f.rel || ' (used by ' || u.used_by || ')' as line, row_number() over (order by u.used_by desc, f.rel) as k
  from used u join b_files f using (id) where not f.is_test),
c as (select *, sum((strlen(line) + 4) // 4) over (order by k) + (strlen(chr(10) || '## key files (most used first)' || chr(10)) + 3) // 4 as used from l)
select 'corpus' as repo, chr(10) || '## key files (most used first)' || chr(10) || string_agg(line, chr(10) order by k) || chr(10) as text
from c where used <= 300""")
def report_key_files(spark, sf):
    from . import reports

    files = views.files(spark, sf)
    none = files.select("repo", "rel", F.array().cast("array<string>").alias("symbols"))
    budget = files.select("repo").distinct().withColumn("tokens", F.lit(300))
    return reports.key_file_lines(views.edges(spark, sf), files, none, budget)


@bound("report_structure")
def report_structure(spark, sf):
    from ..operators.structure import structure

    files = views.files(spark, sf)
    return structure(files, files.select("repo").distinct().withColumn("tokens", F.lit(2000)))


@bound("report_ai_map")
def report_ai_map(spark, sf):
    from . import reports

    files = views.files(spark, sf)
    texts = files.select("repo", "rel", F.lit("").alias("content"))
    none = files.select("repo", "rel", F.array().cast("array<string>").alias("symbols"))
    return reports.ai_map(files, texts, views.edges(spark, sf), files, none, 2500, views.touches(spark, sf))


@bound("report_hotspots", ALL + """, m as (select *, max(commits) over (partition by is_dir) as top from churn)
select repo, path, is_dir, commits, top as max_commits, cast((commits*8-1)//top + 1 as integer) as level,
  substr('▁▂▃▄▅▆▇█', cast((commits*8-1)//top + 1 as bigint), 1) || ' ' || commits as bar,
  cast(case when commits*3 > top*2 then 2 when commits*3 > top then 1 else 0 end as integer) as heat from m""")
def report_hotspots(spark, sf):
    from . import reports

    return reports.hotspots(views.touches(spark, sf), views.files(spark, sf))


@bound("report_diff_tree", DIFF_UP + """
select 'corpus' as repo, dir as rel, true as is_dir, null as status, cast(sum(added) as bigint) as added, cast(sum(deleted) as bigint) as deleted,
  count(*) as changes, false as truncated from up where dir <> '.' group by dir
union all select repo, path, false, status, added, deleted, null, false from b_diff""")
def report_diff_tree(spark, sf):
    from . import reports

    return reports.diff_tree(views.diff(spark, sf))


@bound("report_file_tree", HIDDEN + """, vis as (select * from marked where hidden_at is null),
up as (select rel, size, mtime, array_to_string(list_slice(string_split(rel,'/'),1,i),'/') as dir from vis, unnest(range(1, len(string_split(rel,'/')))) u(i)),
every as (select rel, false as is_dir, size from vis union all select dir, true, cast(sum(size) as bigint) from up group by dir)
select 'corpus' as repo, rel, is_dir, size, row_number() over (
  partition by array_to_string(list_slice(string_split(rel,'/'),1,len(string_split(rel,'/'))-1),'/')
  order by is_dir desc, size desc, string_split(rel,'/')[-1]) as pos from every""")
def report_file_tree(spark, sf):
    from . import reports

    out = reports.file_tree(views.files(spark, sf), OPTIONS, sort="size", dirs_first=True)
    return out.select("repo", "rel", "is_dir", "size", "pos")


@bound("report_context_go", """
with top as (select u.src_dir||'/'||tag||'.go' as rel, u.* from c_use u)
select 'go' as repo, rel, '# ' || rel || chr(10) || case when src = dst then '1 dependency' else '2 dependencies' end ||
  ' · 0 direct users · 0 tests reach it' || chr(10) || chr(10) || '## depends on (and what it uses from each)' || chr(10) ||
  array_to_string(list_sort([src_dir||'/'||src_stem||'.go — uses F'||src||chr(10)||'  func F'||src||'(a, b int) int'||chr(10),
    dst_dir||'/'||dst_stem||'.go — uses '||case when src_dir = dst_dir then '' else 'd.' end||'F'||dst||chr(10)||'  func F'||dst||'(a, b int) int'||chr(10)]), '') as text
from top""")
def report_context_go(spark, sf):
    from ..resolve import graph as code_graph
    from . import reports

    contents = views.code(spark, sf, "go")
    g = code_graph.build(contents)
    starts = g.files.where("contains(rel, '/use_')").select("repo", "rel")
    return reports.context(g, contents, code_graph.all_symbols(contents, g), starts)


@bound("report_deps_why", """
select repo, src as start, dst as rel, cast(1 as integer) as depth, cast(null as varchar) as via, 'imports ' || spec as reason from (
  select 'js' as repo, prefix||src_dir||'/'||tag||ext as src, prefix||src_dir||'/'||src_stem||ext as dst, '../../'||src_dir||'/'||src_stem as spec from c_lang, c_use where repo='js'
  union all select 'js', prefix||src_dir||'/'||tag||ext, prefix||dst_dir||'/'||dst_stem||ext, '../../'||dst_dir||'/'||dst_stem from c_lang, c_use where repo='js')""")
def report_deps_why(spark, sf):
    from ..resolve import graph as code_graph
    from . import reports

    g = code_graph.build(views.code(spark, sf, "js"))
    starts = g.files.select("repo", "rel")
    return reports.related(g, starts, reverse=False).drop("is_test")


# Further queries register themselves here.
from . import more_queries, projects  # noqa: E402, F401
