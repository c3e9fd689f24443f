"""Operators on whole projects derived from the given tables: workspaces, aliases, re-exports, crates, fixtures, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels, paths, text
from ..operators import graph, testplan, tree
from ..resolve import graph as code_graph
from ..sources import sinks
from ..storage import TEXTS_PER_FILE, stage
from . import reports, views
from .catalog import bound

# ---- one workspace of JavaScript packages, a brand each ----------------------------------------------------------------
# A part is a module of its brand's package; an edge is a module that imports both ends: its own brand's through a "#" name,
# others by package name, by an alias of the inherited config, or through the package's main file.


def _brands(spark: SparkSession, sf: str) -> DataFrame:
    return views.table(spark, sf, "part").selectExpr(
        "p_partkey as id", "lower(translate(p_brand, '#', '')) as brand", "concat(translate(p_name, ' ', '_'), '_', p_partkey) as stem")


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    p = _brands(spark, sf)
    a, b = (p.selectExpr(f"id as {s}", f"brand as {s}_brand", f"stem as {s}_stem") for s in ("src", "dst"))
    return views.edges(spark, sf).join(a, "src").join(b, "dst").drop("repo")


def workspace(spark: SparkSession, sf: str) -> DataFrame:
    """(repo, rel, size, content) of the JavaScript workspace, written once."""
    brand = _brands(spark, sf).select("brand").distinct()
    fixed = brand.selectExpr("inline(array("
        "struct(concat('packages/', brand, '/package.json') as rel, concat('{\"name\": \"@atlas/', brand, '\", \"exports\": {\".\": {\"types\": \"./none.d.ts\", \"import\": \"./main.ts\"},"
        " \"./parts/*\": [\"./gone/*.ts\", \"./parts/*.ts\"]}, \"imports\": {\"#own/*\": \"./parts/*.ts\"}}') as content),"
        "struct(concat('packages/', brand, '/main.ts') as rel, concat('export const ', brand, ' = 1;\\n') as content)))")
    lone = spark.range(1).selectExpr("inline(array("
        "struct('tsconfig.json' as rel, '{\\n // inherited\\n \"extends\": \"./config/base.json\",}' as content),"
        "struct('config/base.json' as rel, '{\"extends\": \"./none.json\", \"compilerOptions\": {\"baseUrl\": \"..\", \"paths\": {\"~/*\": [\"packages/*\"], \"~/deep/*\": [\"nowhere/*\"],},}}' as content),"
        "struct('config/unrelated.json' as rel, '{\"extends\": \"./base.json\"}' as content)))")
    parts = _brands(spark, sf).selectExpr("concat('packages/', brand, '/parts/', stem, '.ts') as rel", "concat('export const f', id, ' = 1;\\n') as content")
    target = (
        "case when src_brand = dst_brand then concat('#own/', dst_stem) when (src + dst) % 3 = 0 then concat('@atlas/', dst_brand, '/parts/', dst_stem)"
        " when (src + dst) % 3 = 1 then concat('~/', dst_brand, '/parts/', dst_stem) else concat('@atlas/', dst_brand) end")
    uses = _pairs(spark, sf).selectExpr(
        "concat('packages/', src_brand, '/uses/use_', src, '_', dst, '.ts') as rel",
        f"concat('import {{ x }} from \\'#own/', src_stem, '\\';\\nimport \\'', {target}, '\\';\\n') as content")
    every = fixed.unionByName(lone).unionByName(parts).unionByName(uses)
    return stage(every.selectExpr("'shop' as repo", "rel", "cast(octet_length(content) as bigint) as size", "content"), "workspace", TEXTS_PER_FILE)[0]


WORKSPACE = """
with p as (select p_partkey as id, lower(replace(p_brand,'#','')) as brand, replace(p_name,' ','_')||'_'||p_partkey as stem from part),
u as (select e.src, e.dst, a.brand as src_brand, a.stem as src_stem, b.brand as dst_brand, b.stem as dst_stem
  from b_edges e join p a on a.id = e.src join p b on b.id = e.dst),
w as (
  select 'packages/'||src_brand||'/uses/use_'||src||'_'||dst||'.ts' as src, 'packages/'||src_brand||'/parts/'||src_stem||'.ts' as dst, '#own/'||src_stem as spec from u
  union all select 'packages/'||src_brand||'/uses/use_'||src||'_'||dst||'.ts',
    case when src_brand <> dst_brand and (src + dst) % 3 = 2 then 'packages/'||dst_brand||'/main.ts' else 'packages/'||dst_brand||'/parts/'||dst_stem||'.ts' end,
    case when src_brand = dst_brand then '#own/'||dst_stem when (src + dst) % 3 = 0 then '@atlas/'||dst_brand||'/parts/'||dst_stem
      when (src + dst) % 3 = 1 then '~/'||dst_brand||'/parts/'||dst_stem else '@atlas/'||dst_brand end from u)
"""


@bound("workspace_edges", WORKSPACE + "\nselect distinct 'shop' as repo, src, dst from w")
def workspace_edges(spark, sf):
    return code_graph.build(workspace(spark, sf)).edges


@bound("graph_dump", WORKSPACE + """
select 'shop' as repo, rel, 'js' as lang, false as test, specs, deps from (
  select src as rel, list_sort(list(distinct spec)) as specs, list_sort(list(distinct dst)) as deps from w group by src
  union all select distinct 'packages/'||brand||'/parts/'||stem||'.ts', [], [] from p
  union all select distinct 'packages/'||brand||'/main.ts', [], [] from p)""")
def graph_dump(spark, sf):
    return sinks.graph_dump(code_graph.build(workspace(spark, sf)))


# The parts that changed are those divisible by 50; what uses them follows at one step, and nothing uses a use.
_REPORT = WORKSPACE + """, c as (select 'packages/'||brand||'/parts/'||stem||'.ts' as rel from p where id % 50 = 0),
hit as (select w.src as rel, min(w.dst) as by_ from w join c on c.rel = w.dst group by w.src)
"""


def _report(spark, sf):
    contents = workspace(spark, sf)
    g = code_graph.build(contents)
    rel = "concat('packages/', brand, '/parts/', stem, '.ts') as path"
    p = _brands(spark, sf)
    changes = p.where("id % 50 = 0").selectExpr("'shop' as repo", rel, "'M' as status").unionByName(
        p.where("id % 50 = 1").selectExpr("'shop' as repo", "concat('packages/', brand, '/old/', stem, '.ts') as path", "'D' as status")).unionByName(
        p.select("brand").distinct().selectExpr("'shop' as repo", "concat('packages/', brand, '/package.json') as path", "'M' as status"))
    return reports.impact_report(g, contents, changes)


@bound("report_impact_affected", _REPORT + """
select 'shop' as repo, h.rel, cast(1 as integer) as depth, cast(null as varchar) as via, 'imports ' || arg_min(w.spec, case when starts_with(w.spec, '#own/') and w.dst = 'packages/'||
    string_split(h.rel,'/')[2]||'/parts/'||replace(w.spec,'#own/','')||'.ts' then 0 else 1 end) as reason, false as is_test
from hit h join w on w.src = h.rel and w.dst = h.by_ group by h.rel, h.by_""")
def report_impact_affected(spark, sf):
    return _report(spark, sf)["affected"]


@bound("report_impact_changes", _REPORT + """
select 'shop' as repo, rel, 'changed' as part from c
union all select 'shop', 'packages/'||brand||'/old/'||stem||'.ts', 'deleted' from p where id % 50 = 1
union all select distinct 'shop', 'packages/'||brand||'/package.json', 'not_in_graph' from p""")
def report_impact_changes(spark, sf):
    out = _report(spark, sf)
    part = lambda name: out[name].select("repo", "rel", F.lit(name).alias("part"))
    return part("changed").unionByName(part("deleted")).unionByName(part("not_in_graph"))


# ---- Python packages whose names are handed on twice -------------------------------------------------------------------


def exporters(spark: SparkSession, sf: str) -> DataFrame:
    """One package of packages: a brand's __init__ hands on its parts' names, the top one those of every brand's even parts."""
    p = _brands(spark, sf)
    ordered = lambda line: F.array_join(F.sort_array(F.collect_list(line)), "")
    inits = p.groupBy("brand").agg(ordered(F.expr("concat('from .', stem, ' import f', id, '\\n')")).alias("content")).selectExpr(
        "concat('kit/', brand, '/__init__.py') as rel", "content")
    top = p.where("id % 2 = 0").groupBy("brand").agg(F.expr("concat('from .', brand, ' import (', array_join(sort_array(collect_list(concat('f', id))), ', '), ')\\n')").alias("line"))
    top = top.groupBy().agg(ordered(F.col("line")).alias("content")).selectExpr("'kit/__init__.py' as rel", "content")  # a line a brand
    parts = p.selectExpr("concat('kit/', brand, '/', stem, '.py') as rel", "concat('def f', id, '():\\n    pass\\n') as content")
    uses = _pairs(spark, sf).selectExpr(
        "concat('apps/use_', src, '_', dst, '.py') as rel",
        "concat('from kit.', src_brand, ' import f', src, '\\n', case when dst % 2 = 0 then 'from kit import f' else concat('import kit.', dst_brand, '.', dst_stem, '  # f') end, dst, '\\n') as content")
    lone = spark.range(1).selectExpr("'pyproject.toml' as rel", "'[project]\\nname = \"kit\"\\n' as content")
    every = inits.unionByName(top).unionByName(parts).unionByName(uses).unionByName(lone)
    return stage(every.selectExpr("'kit' as repo", "rel", "cast(octet_length(content) as bigint) as size", "content"), "exporters", TEXTS_PER_FILE)[0]


@bound("reexport_edges", """
with p as (select p_partkey as id, lower(replace(p_brand,'#','')) as brand, replace(p_name,' ','_')||'_'||p_partkey as stem from part),
part_of as (select id, 'kit/'||brand||'/'||stem||'.py' as rel, 'kit/'||brand||'/__init__.py' as init from p),
u as (select 'apps/use_'||src||'_'||dst||'.py' as src, src as a, dst as b from b_edges)
select distinct 'kit' as repo, src, dst from (
  select u.src, o.rel as dst from u join part_of o on o.id = u.a
  union all select u.src, o.init from u join part_of o on o.id = u.a
  union all select u.src, o.rel from u join part_of o on o.id = u.b
  union all select u.src, 'kit/__init__.py' from u where b % 2 = 0
  union all select init, rel from part_of
  union all select 'kit/__init__.py', init from part_of where id % 2 = 0
  union all select 'kit/__init__.py', rel from part_of where id % 2 = 0)""")
def reexport_edges(spark, sf):
    return code_graph.build(exporters(spark, sf)).edges


@bound("fixture_links", """
with dirs as (select distinct string_split(rel,'/')[1] as dir from b_files where id % 3 = 0),
tests as (select rel from b_files where rel like '%.py' and is_test and (starts_with(string_split(rel,'/')[-1], 'test_') or rel like '%_test.py'))
select 'corpus' as repo, t.rel as src, d.dir || '/conftest.py' as dst from tests t join dirs d on starts_with(t.rel, d.dir || '/')""")
def fixture_links(spark, sf):
    files = views.files(spark, sf).select("repo", F.col("rel").alias("id"), "rel", "is_test")
    made = views.files(spark, sf).where("id % 3 = 0").select("repo", F.concat(F.substring_index("rel", "/", 1), F.lit("/conftest.py")).alias("id")).distinct()
    return graph.fixture_links(files.unionByName(made.select("repo", "id", F.col("id").alias("rel"), F.lit(False).alias("is_test"))))


# ---- crates ------------------------------------------------------------------------------------------------------------


@bound("cargo_commands", """
with p as (select p_partkey as id, lower(replace(p_brand,'#','')) as brand, replace(p_name,' ','_')||'_'||p_partkey as stem from part where p_partkey % 4 = 0),
named as (select brand, 'crates/'||brand||'/tests/'||stem||'.rs' as rel,
    case when id % 5 = 0 then 'named_'||id when not (brand like '%1') then stem end as name from p)
select 'mill' as repo, 'crates/'||brand as dir, cast(0 as bigint) as batch, list_concat(['cargo','test'], flatten(list(['--test', name] order by rel))) as argv
from named where name is not null group by brand""")
def cargo_commands(spark, sf):
    """A crate a brand; every fifth test is declared by name, and brands that end in 1 run declared ones only."""
    p = _brands(spark, sf).where("id % 4 = 0")
    tests = p.selectExpr("'mill' as repo", "concat('crates/', brand, '/tests/', stem, '.rs') as rel")
    declared = F.expr("case when id % 5 = 0 then concat('[[test]]\\nname = \"named_', id, '\"\\npath = \"tests/', stem, '.rs\"\\n') else '' end")
    manifests = p.groupBy("brand").agg(F.array_join(F.collect_list(declared), "").alias("declared")).selectExpr(
        "'mill' as repo", "concat('crates/', brand, '/Cargo.toml') as rel",
        "concat('[package]\\nname = \"', brand, '\"\\n', case when brand like '%1' then 'autotests = false\\n' else '' end, declared) as content")
    return testplan.test_commands(tests, manifests, 1 << 24)


# ---- ecosystems, readme, order, names ----------------------------------------------------------------------------------

_MANIFESTS = ["go.mod", "package.json", "requirements.txt", "pyproject.toml", "Cargo.toml", "build.gradle", "build.gradle.kts"]


def _rooted(spark, sf):
    """A repository a part: its manifests are those of the list whose place divides its number."""
    some = F.array(*[F.when(F.col("p_partkey") % (i + 2) == 0, F.lit(m)) for i, m in enumerate(_MANIFESTS)])
    return views.table(spark, sf, "part").select(
        F.concat(F.lit("r"), F.col("p_partkey").cast("string")).alias("repo"), F.explode(F.array_compact(some)).alias("rel"))


_ECO = "(values (0,'go.mod','Go','go modules',0), (1,'package.json','JavaScript/TypeScript','npm',1), (2,'requirements.txt','Python','pip',3), (3,'pyproject.toml','Python','pip/poetry/uv',2), (4,'Cargo.toml','Rust','cargo',4), (5,'build.gradle','Java/Kotlin','gradle',6), (6,'build.gradle.kts','Kotlin','gradle',7)) v(i, manifest, language, package_manager, ord)"


@bound("ecosystems", f"""
select 'r' || p_partkey as repo, cast(ord as integer) as ord, manifest, language, package_manager from part, {_ECO} where p_partkey % (i + 2) = 0""")
def ecosystems(spark, sf):
    return tree.ecosystems(_rooted(spark, sf))


@bound("ecosystem_lines", f"""
select 'r' || p_partkey as repo, language, cast(min(ord) as integer) as ord, string_agg(manifest, ', ' order by ord) as manifests,
  case when language <> 'Python' then min(package_manager) when bool_or(manifest = 'pyproject.toml') then 'pip/poetry/uv' else 'pip' end as managers
from part, {_ECO} where p_partkey % (i + 2) = 0 group by p_partkey, language""")
def ecosystem_lines(spark, sf):
    return tree.ecosystem_lines(tree.ecosystems(_rooted(spark, sf)))


@bound("entry_config", """
with n as (select id, dir || '/' || name as path, name, dir from (select id, array_to_string(list_slice(string_split(rel,'/'),1,1 + id % 2),'/') as dir,
  ['main.go','app.py','index.ts','Makefile','tsconfig.json','vite.config.ts','notes.md','main.rs'][1 + id % 8] as name from b_files))
select id, path, name in ('main.go','app.py','index.ts','main.rs') as entry,
  name in ('Makefile','tsconfig.json') or (name = 'vite.config.ts' and not contains(dir, '/')) as config from n""")
def entry_config(spark, sf):
    names = F.expr("array('main.go','app.py','index.ts','Makefile','tsconfig.json','vite.config.ts','notes.md','main.rs')[cast(id % 8 as int)]")
    folder = F.when(F.col("id") % 2 == 0, F.substring_index("rel", "/", 1)).otherwise(F.substring_index("rel", "/", 2))
    path = F.concat(folder, F.lit("/"), names)
    return views.files(spark, sf).select("id", path.alias("path")).select(
        "id", "path", labels.is_entry_point(F.col("path")).alias("entry"), labels.is_config(F.col("path")).alias("config"))


@bound("exported_names", r"""
select doc_id, word, regexp_matches(word, '^\p{Lu}') as exported from (select doc_id, unnest(regexp_split_to_array(text, '\s+')) as word from documents) where word <> ''""")
def exported_names(spark, sf):
    words = views.table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", r"\s+")).alias("word")).where("word <> ''")
    return words.select("doc_id", "word", labels.is_exported_name(F.col("word")).alias("exported"))


@bound("hit_order", """
with near as (select e.src as id, 1 as depth from b_edges e join b_hubs h on h.id = e.dst),
hits as (select distinct f.rel, f.is_test from near n join b_files f using (id) where n.id not in (select id from b_hubs))
select 'corpus' as repo, rel, is_test, cast(1 as integer) as depth, row_number() over (order by is_test, rel) as pos from hits""")
def hit_order(spark, sf):
    from ..operators.ranking import number_rows

    files = views.files(spark, sf)
    starts = views.hubs(spark, sf).select("repo", F.lit("hubs").alias("start"), "id")
    hits = graph.reach(views.edges(spark, sf), files, starts, reverse=True, depth=1)
    return number_rows(hits.select("repo", "rel", "is_test", "depth"), ["repo"], graph.hit_order(), "pos")


@bound("entities", """
select doc_id, text as plain from documents""")
def entities(spark, sf):
    """Texts with their letters and signs written as entities, by name and by number, decoded again."""
    t = F.col("text")
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), ("é", "&eacute;"), ("è", "&#232;"), ("ü", "&#xFC;"), ("ñ", "&ntilde;"), ("ß", "&szlig;"), (">", "&gt;")):
        t = F.replace(t, F.lit(sign), F.lit(entity))
    return views.table(spark, sf, "documents").select("doc_id", text.unescape(t).alias("plain"))


@bound("readme_purposes", """
with o as (select array_to_string(list_slice(string_split(rel,'/'),1,2),'/') as repo, count(*) as n, min(id) as first from b_files group by 1)
select repo, case when n % 2 = 0 then 'README.md' else 'Readme.rst' end as path, 'Holds ' || n || ' parts & more, from ' || first || '.' as text from o""")
def readme_purposes(spark, sf):
    """A repository a folder, with a README of badges, headings, links and one sentence."""
    from ..extract import readme

    o = views.files(spark, sf).groupBy(F.substring_index("rel", "/", 2).alias("repo")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    content = F.format_string(
        "<!-- hidden -->\n# Title\n\n[![badge](b.svg)](x)\n```\ncode\n```\n\nHolds **%d** [parts](y) &amp; more,\nfrom `%d`.\n\nLater text.\n", F.col("n"), F.col("first"))
    name = F.when(F.col("n") % 2 == 0, "README.md").otherwise("Readme.rst")
    return readme.purposes(o.select("repo", name.alias("rel"), content.alias("content")))


# ---- tour and map over the derived packages ----------------------------------------------------------------------------


def _described(spark, sf):
    """The Go packages with a README: files, texts, graph."""
    made = views.code(spark, sf, "go")
    readme = spark.range(1).selectExpr("'go' as repo", "'README.md' as rel", "cast(40 as bigint) as size", "'# Atlas\\n\\nParts of *all* [sizes](x).\\n' as content")
    texts = stage(made.unionByName(readme), "described", TEXTS_PER_FILE)[0]
    return texts, code_graph.build(texts)


@bound("report_tour_texts", """
with u as (select dir || '/' || stem || '.go' as rel, count(distinct c.src) as n from c_place p join c_edges c on c.repo = 'go' and c.dst = dir || '/' || stem || '.go' group by all),
r as (select rel, n, row_number() over (order by n desc, rel) as k from u),
every as (select dir || '/' || stem || '.go' as rel from c_place union all select src_dir || '/' || tag || '.go' from c_use)
select 'go' as repo, 'README.md' as purpose_path, 'Parts of *all* sizes.' as purpose, 2 + (select count(*) from every) as files,
  (select count(distinct x) from (select string_split(rel,'/')[1] as x from every union all select array_to_string(list_slice(string_split(rel,'/'),1,2),'/') from every)) as directories,
  ['README.md'] || (select list(rel order by k) from r where k <= 7) as reading, ['project overview (README)'] || (select list('used by ' || n || case when n = 1 then ' file' else ' files' end order by k) from r where k <= 7) as reasons,
  greatest((select count(*) from r) + 1 - 8, 0) as omitted""")
def report_tour_texts(spark, sf):
    texts, g = _described(spark, sf)
    files = texts.select("repo", "rel", "size", F.lit(None).cast("timestamp").alias("mtime"))
    r = reports.tour(files, texts, g.edges, g.files, 8)
    return r.select(
        "repo", F.col("purpose.path").alias("purpose_path"), F.col("purpose.text").alias("purpose"), "files", "directories",
        F.transform("readingOrder", lambda s: s["path"]).alias("reading"), F.transform("readingOrder", lambda s: s["reason"]).alias("reasons"),
        F.col("omittedReading").alias("omitted"))


@bound("report_key_files_texts", """
with u as (select p.id, dir || '/' || stem || '.go' as rel, count(distinct c.src) as n from c_place p join c_edges c on c.repo = 'go' and c.dst = dir || '/' || stem || '.go' group by all),
l as (select rel || ' (used by ' || n || '): func F' || id || '(a, b int) int' as line, row_number() over (order by n desc, rel) as k from u),
c as (select *, sum((strlen(line) + 4) // 4) over (order by k) + (strlen(chr(10) || '## key files (most used first)' || chr(10)) + 3) // 4 as used from l)
select 'go' as repo, chr(10) || '## key files (most used first)' || chr(10) || string_agg(line, chr(10) order by k) || chr(10) as text from c where used <= 900""")
def report_key_files_texts(spark, sf):
    texts, g = _described(spark, sf)
    budget = texts.select("repo").distinct().withColumn("tokens", F.lit(900))
    return reports.key_file_lines(g.edges, g.files, code_graph.all_symbols(texts, g), budget)


# ---- narrowing that narrows, and a version-controlled set that hides --------------------------------------------------


@bound("test_narrowing_change", """
with recursive walk(id, depth) as (
  select f.id, 0 from b_files f join b_diff d on d.path = f.rel where d.status <> 'D' and f.id % 40 = 0
  union select e.src, w.depth + 1 from walk w join b_edges e on e.dst = w.id where w.depth < 1),
t as (select array_to_string(list_slice(string_split(rel,'/'),1,2),'/') as dir, 'Test'||id as name, id in (select id from walk where depth > 0) as hit from b_files where is_test),
g as (select dir, count(*) as total, count(*) filter (hit) as reached from t group by dir)
select 'corpus' as repo, g.dir, t.name, reached, total from g join t using (dir) where t.hit and reached > 0 and reached <= total // 2""".replace("with recursive", "with"), recursive=True)
def test_narrowing_change(spark, sf):
    """The tests that a small change set reaches in one step, where they are at most half of their folder's."""
    from ..operators import declarations, impact

    files, edges = views.files(spark, sf), views.edges(spark, sf)
    changed = impact.split_changes(views.diff(spark, sf))[0].join(files.where("id % 40 = 0").select("repo", "rel"), ["repo", "rel"], "left_semi")
    starts = impact.seeds(changed, files).select("repo", F.lit("change").alias("start"), "id")
    hits = graph.reach(edges, files, starts, reverse=True, depth=1)
    # A seed that another seed uses is reached too.
    again = edges.join(starts.select("repo", F.col("id").alias("dst")), ["repo", "dst"]).select("repo", F.col("src").alias("id"))
    reached = hits.select("repo", "id").unionByName(again).distinct()
    named = files.where("is_test").select("repo", paths.parent(F.col("rel")).alias("dir"), F.concat(F.lit("Test"), F.col("id").cast("string")).alias("name"), "id")
    return declarations.narrowed_tests(named.select("repo", "dir", "name"), named.join(reached, ["repo", "id"], "left_semi").select("repo", "dir", "name"))


@bound("vcs_visible_some", """
with seen as (select path from b_touches where length(path) % 3 <> 0 and not starts_with(path, 'promo/brand1'))
select repo, id, rel from b_files where rel in (select path from seen)""")
def vcs_visible_some(spark, sf):
    """A third of the files are untracked, and whole folders."""
    tracked = views.touches(spark, sf).where("length(path) % 3 <> 0 and not startswith(path, 'promo/brand1')").select("repo", "path")
    return tree.visible_files(views.files(spark, sf), tree.ScanOptions(vcs_aware=True), tree.with_parents(tracked)).select("repo", "id", "rel")


@bound("vcs_hidden_at", """
with seen as (select distinct path from b_touches where length(path) % 3 <> 0 and not starts_with(path, 'promo/brand1')),
up as (select distinct array_to_string(list_slice(string_split(path,'/'),1,i),'/') as path from seen, range(1, 4) r(i))
select f.repo, f.rel, min_by(array_to_string(list_slice(string_split(rel,'/'),1,i),'/'), i) as hidden_at from b_files f, range(1, 4) r(i)
where array_to_string(list_slice(string_split(rel,'/'),1,i),'/') not in (select path from up) group by f.repo, f.rel""")
def vcs_hidden_at(spark, sf):
    """The topmost entry that the version-controlled set hides."""
    tracked = views.touches(spark, sf).where("length(path) % 3 <> 0 and not startswith(path, 'promo/brand1')").select("repo", "path")
    marked = tree.mark_hidden(views.files(spark, sf), tree.ScanOptions(vcs_aware=True), tree.with_parents(tracked))
    return marked.where("hidden_at is not null").select("repo", "rel", "hidden_at")
