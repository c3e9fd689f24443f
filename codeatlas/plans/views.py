"""The given tables read as repositories: parts as files, line items as commits and links.

Each view has a DataFrame form and the DuckDB text of the same relation for the checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels
from ..operators.rules import ArchRule
from ..sources.vcs import change_set
from ..storage import TEXTS_PER_FILE, stage

REPO = "corpus"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, id, rel, size, mtime, is_test): one file per part."""
    size, key = F.col("p_size"), F.col("p_partkey")
    exts = F.array(*[F.lit(e) for e in (".go", ".ts", ".py", ".rs", ".java", ".md")])
    rel = F.concat(
        F.lower("p_type"), F.lit("/"), F.lower(F.translate("p_brand", "#", "")), F.lit("/"),
        F.when(size <= 5, "test_").otherwise(""), F.translate("p_name", " ", "_"), F.lit("_"), key.cast("string"),
        F.when(size > 45, "_test").otherwise(""), F.get(exts, (key % 6).cast("int")),
    )
    mtime = F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(key * 100_003, F.lit(31_536_000))).cast("timestamp_ntz")
    return table(spark, sf_dir, "part").select(
        F.lit(REPO).alias("repo"), key.alias("id"), rel.alias("rel"),
        F.floor("p_retailprice").cast("long").alias("size"), mtime.alias("mtime"),
    ).withColumn("is_test", labels.is_test(F.col("rel")))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, src, dst): the parts of consecutive lines of an order."""
    return links(spark, sf_dir).where("src <> dst").distinct()


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with repeats and self links."""
    items = table(spark, sf_dir, "lineitem")
    a = items.select(F.col("l_orderkey").alias("o"), (F.col("l_linenumber") + 1).alias("n"), F.col("l_partkey").alias("src"))
    b = items.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("dst"))
    return a.join(b, ["o", "n"]).select(F.lit(REPO).alias("repo"), "src", "dst")


def touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, commit_id, ts, path): every line item is a commit touching a part's file."""
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("commit_id"), F.col("l_shipdate").alias("ts"), F.col("l_partkey").alias("id")
    )
    return items.join(files(spark, sf_dir).select("id", F.col("rel").alias("path")), "id").select(
        F.lit(REPO).alias("repo"), "commit_id", "ts", "path"
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, source, rev, path, status, added, deleted): every line item changes a file, in the revision of its month."""
    status = F.when(F.col("l_returnflag") == "N", "M").when(F.col("l_returnflag") == "R", "D").otherwise("A")
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("id"), F.date_format("l_shipdate", "yyyy-MM").alias("rev"), status.alias("status"),
        F.floor("l_quantity").cast("long").alias("added"), F.col("l_linenumber").cast("long").alias("deleted"),
    )
    return items.join(files(spark, sf_dir).select("id", F.col("rel").alias("path")), "id").select(
        F.lit(REPO).alias("repo"), F.lit("diff").alias("source"), "rev", "path", "status", "added", "deleted"
    )


REVISION = "2001-10"


def diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, path, status, added, deleted): the files that one revision changed."""
    return change_set(changes(spark, sf_dir), "diff", REVISION).groupBy("repo", "path").agg(
        F.max("status").alias("status"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted")
    )


RULES = [
    ArchRule(1, "economy/ -> small/", "^economy/.*$", "^small/.*$"),
    ArchRule(2, "**/*.ts -> large/", r"^(?:.*/)?[^/]*\.ts$", "^large/.*$"),
    ArchRule(3, "nope/ -> small/", "^nope/.*$", "^small/.*$"),
]


def geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, rel, size): suppliers as files below region and nation."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    rows = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(
        F.lit(REPO).alias("repo"), F.concat_ws("/", "r_name", "n_name", "s_name").alias("rel"),
        F.floor("s_acctbal").cast("long").alias("size"),
    )


def truth(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Wanted edges, and drawn ones that miss a tenth and add some."""
    want = edges(spark, sf_dir)
    kept = want.where((F.col("src") + F.col("dst")) % 10 != 0)
    made = want.select("repo", "src", (F.col("src") % 7).alias("dst")).where("src <> dst")
    return want, kept.unionByName(made).distinct()


def hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five files with the most dependents."""
    count = edges(spark, sf_dir).groupBy("repo", F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return count.orderBy(F.col("n").desc(), "id").limit(5).select("repo", "id")


def loaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five files with the most dependencies."""
    count = edges(spark, sf_dir).groupBy("repo", F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return count.orderBy(F.col("n").desc(), "id").limit(5).select("repo", "id")


SQL = """
b_files as (
  select 'corpus' as repo, id, rel, size,
    cast(make_timestamp((1700000000 + (id * 100003) % 31536000) * 1000000) as timestamp) as mtime,
    case when rel like '%.go' then ends_with(rel, '_test.go')
         else contains(rel, '/test_') or ends_with(rel, '_test.py') end as is_test
  from (select p_partkey as id, cast(floor(p_retailprice) as bigint) as size,
      lower(p_type)||'/'||lower(replace(p_brand,'#',''))||'/'||
      case when p_size<=5 then 'test_' else '' end||replace(p_name,' ','_')||'_'||
      cast(p_partkey as varchar)||case when p_size>45 then '_test' else '' end||
      case p_partkey%6 when 0 then '.go' when 1 then '.ts' when 2 then '.py'
                       when 3 then '.rs' when 4 then '.java' else '.md' end as rel
    from part)),
b_edges as (
  select distinct 'corpus' as repo, a.l_partkey as src, b.l_partkey as dst
  from lineitem a join lineitem b on a.l_orderkey=b.l_orderkey and b.l_linenumber=a.l_linenumber+1
  where a.l_partkey<>b.l_partkey),
b_touches as (
  select 'corpus' as repo, l_orderkey as commit_id, l_shipdate as ts, rel as path
  from lineitem join b_files on id=l_partkey),
b_diff as (
  select 'corpus' as repo, rel as path,
    max(case l_returnflag when 'N' then 'M' when 'R' then 'D' else 'A' end) as status,
    cast(sum(floor(l_quantity)) as bigint) as added, cast(sum(l_linenumber) as bigint) as deleted
  from lineitem join b_files on id=l_partkey
  where strftime(l_shipdate, '%Y-%m') = '2001-10' group by rel),
b_rules(line, rule, from_re, to_re) as (
  values (1, 'economy/ -> small/', '^economy/.*$', '^small/.*$'),
         (2, '**/*.ts -> large/', '^(?:.*/)?[^/]*\\.ts$', '^large/.*$'),
         (3, 'nope/ -> small/', '^nope/.*$', '^small/.*$')),
b_geo as (
  select 'corpus' as repo, r_name||'/'||n_name||'/'||s_name as rel, cast(floor(s_acctbal) as bigint) as size
  from supplier join nation on s_nationkey=n_nationkey join region on n_regionkey=r_regionkey),
b_got as (
  select repo, src, dst from b_edges where (src+dst)%10<>0
  union select repo, src, src%7 from b_edges where src<>src%7),
b_hubs as (
  select 'corpus' as repo, dst as id from b_edges group by dst order by count(*) desc, dst limit 5),
b_loaders as (
  select 'corpus' as repo, src as id from b_edges group by src order by count(*) desc, src limit 5),
b_dirs as (
  select distinct f.repo, f.rel as file, array_to_string(list_slice(string_split(f.rel,'/'),1,i),'/') as dir
  from b_files f, unnest(range(1, len(string_split(f.rel,'/')))) u(i))
"""


# ---- source texts derived from the tables -----------------------------------------------
# Every part becomes a file that declares F<id>; every edge becomes a file beside its source
# that uses both ends. One repository per language, so no list is ever collected into a text.

_DIR = "concat(lower(p_type), '/', lower(translate(p_brand, '#', '')))"


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, dir, stem): where a part's file lies, without extension."""
    name = "concat(translate(p_name, ' ', '_'), '_', p_partkey)"
    return table(spark, sf_dir, "part").selectExpr("p_partkey as id", f"{_DIR} as dir", f"{name} as stem")


def _uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _places(spark, sf_dir)
    a = p.selectExpr("id as src", "dir as src_dir", "stem as src_stem")
    b = p.selectExpr("id as dst", "dir as dst_dir", "stem as dst_stem")
    return edges(spark, sf_dir).join(a, "src").join(b, "dst").drop("repo")


def code(spark: SparkSession, sf_dir: str, repo: str | None = None) -> DataFrame:
    """(repo, rel, size, content) of the derived corpus, written once as a corpus would be stored."""
    parts_, uses_ = _places(spark, sf_dir), _uses(spark, sf_dir)
    part_text = {
        "js": ("concat(dir, '/', stem, '.ts')",
               "concat('// export function gone(): void;\\nexport function F', id, '(a: number = 1): number {\\n  return a;\\n}\\n')"),
        "py": ("concat(dir, '/', stem, '.py')",
               "concat('def F', id, '(a: int = 1) -> int:\\n    return a\\n\\ndef _hidden', id, '():\\n    pass\\n')"),
        "java": ("concat('src/main/java/', dir, '/', stem, '.java')",
                 "concat('package x;\\n\\npublic final class ', stem, ' {\\n}\\n')"),
        "rs": ("concat('src/', dir, '/', stem, '.rs')", "concat('pub fn f', id, '(a: u8) -> u8 { a }\\n')"),
        "go": ("concat(dir, '/', stem, '.go')",
               "concat('package ', split(dir, '/')[1], '\\n\\nfunc F', id, '(a, b int) int {\\n\\tF', id + 1, ' := a + b\\n\\treturn F', id + 1, '\\n}\\n')"),
    }
    tag = "concat('use_', src, '_', dst)"
    mod = lambda w: f"concat({w}_dir, '/', {w}_stem)"
    dotted = lambda w: f"translate({mod(w)}, '/', '.')"
    use_text = {
        "js": (f"concat(src_dir, '/', {tag}, '.ts')",
               f"concat('import {{\\n  a,\\n}} from \\'../../', {mod('src')}, '\\';\\n// import x from \\'./none\\';\\nconst b = require(\\'../../', {mod('dst')}, '\\');\\n')"),
        "py": (f"concat(src_dir, '/', {tag}, '.py')",
               f"concat('from . import ', src_stem, '  # here\\nimport os, ', {dotted('dst')}, ' as d\\n')"),
        "java": (f"concat('src/main/java/', src_dir, '/', {tag}, '.java')",
                 f"concat('package x;\\nimport ', {dotted('src')}, ';\\nimport static ', {dotted('dst')}, ';\\n// import none.None;\\n')"),
        "rs": (f"concat('src/', src_dir, '/', {tag}, '.rs')",
               f"concat('use super::', src_stem, '::{{self, f', src, '}};\\n/* use crate::none; /* nested */ */\\nfn x() {{ crate::', replace({mod('dst')}, '/', '::'), '::f', dst, '(1); }}\\n')"),
        "go": (f"concat(src_dir, '/', {tag}, '.go')",
               f"concat('package ', split(src_dir, '/')[1], '\\n\\nimport d \"ex/', dst_dir, '\"\\n\\nvar ', {tag}, ' = F', src, '(1, 2) + ',"
               f" case when src_dir = dst_dir then '' else 'd.' end, 'F', dst, '(3, 4)\\n')"),
    }
    # A file in its own package can't import it: such an edge is a plain use.
    use_text["go"] = (use_text["go"][0], use_text["go"][1].replace(
        "'\\n\\nimport d \"ex/', dst_dir, '\"\\n\\nvar '", "case when src_dir = dst_dir then '\\n\\nvar ' else concat('\\n\\nimport d \"ex/', dst_dir, '\"\\n\\nvar ') end"))
    fixed = {"rs": ("src/lib.rs", "// root\\n"), "go": ("go.mod", "module ex\\n\\ngo 1.22\\n")}
    if repo is not None:  # only that repository's texts are made
        part_text, use_text, fixed = ({k: v for k, v in texts.items() if k == repo} for texts in (part_text, use_text, fixed))
    rows = lambda texts: "inline(array(" + ", ".join(
        f"struct('{repo}' as repo, {rel} as rel, {text} as content)" for repo, (rel, text) in texts.items()) + "))"
    out = parts_.selectExpr(rows(part_text)).unionByName(uses_.selectExpr(rows(use_text)))
    if fixed:
        out = out.unionByName(spark.range(1).selectExpr(rows({k: (f"'{rel}'", f"'{text}'") for k, (rel, text) in fixed.items()})))
    return stage(out.selectExpr("repo", "rel", "cast(octet_length(content) as bigint) as size", "content"), "code", TEXTS_PER_FILE)[0]


SQL += """,
c_place as (
  select p_partkey as id, lower(p_type)||'/'||lower(replace(p_brand,'#','')) as dir, replace(p_name,' ','_')||'_'||p_partkey as stem from part),
c_use as (
  select e.src, e.dst, a.dir as src_dir, a.stem as src_stem, b.dir as dst_dir, b.stem as dst_stem, 'use_'||e.src||'_'||e.dst as tag
  from b_edges e join c_place a on a.id = e.src join c_place b on b.id = e.dst),
c_lang(repo, prefix, ext) as (values ('js','','.ts'), ('py','','.py'), ('java','src/main/java/','.java'), ('rs','src/','.rs'), ('go','','.go')),
c_edges as (
  select distinct repo, prefix||src_dir||'/'||tag||ext as src, prefix||to_dir||'/'||to_stem||ext as dst
  from c_lang, (select src_dir, tag, src_dir as to_dir, src_stem as to_stem from c_use
    union all select src_dir, tag, dst_dir, dst_stem from c_use) u)
"""
