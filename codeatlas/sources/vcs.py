"""Version-control exports as tables: logs, diffs, status, and what a change set is.

Exports are what ``git`` prints, one repository per ``repo`` value, best with ``-z``: its records end in NUL, so a name may hold anything,
and each pattern below consumes exactly one record, from the first on. The line forms quote odd
names in C style with octal bytes, which ``unquoted`` undoes. All of it is expressions on columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: How to print a log for ``parse_log``; a file per repository.
LOG_COMMAND = "git log -z --root -m --first-parent --find-renames --name-status --format=%x1e%H%x1f%P%x1f%ct"

# C-style escapes of one character, and the byte each stands for.
ESCAPES = {"a": "07", "b": "08", "t": "09", "n": "0A", "v": "0B", "f": "0C", "r": "0D", '"': "22", "\\": "5C"}


def unquoted(path: Column) -> Column:
    """A path as it is: without quotes, escapes and octal bytes if it is quoted."""
    inner = F.substring(path, F.lit(2), F.length(path) - 2)
    pieces = F.regexp_extract_all(inner, F.lit(r"(?s)\\[0-7]{3}|\\.|[^\\]+"), F.lit(0))

    def as_hex(p: Column) -> Column:
        octal = F.lpad(F.conv(F.substring(p, F.lit(2), F.lit(3)), 8, 16), 2, "0")
        one = F.create_map(*[F.lit(x) for kv in ESCAPES.items() for x in kv])
        return F.when(p.rlike(r"\A\\[0-7]{3}\z"), octal).when(
            p.startswith("\\"), F.try_element_at(one, F.substring(p, F.lit(2), F.lit(1)))
        ).otherwise(F.hex(p.cast("binary")))

    plain = F.decode(F.unhex(F.array_join(F.transform(pieces, as_hex), "")), "UTF-8")
    return F.when(path.startswith('"') & path.endswith('"') & (F.length(path) > 1), plain).otherwise(path)


def read_export(spark: SparkSession, path: str, repo: str) -> DataFrame:
    """(repo, value): one whole export, such as a diff or status printed with ``-z``."""
    return spark.read.option("wholetext", "true").text(path).select(F.lit(repo).alias("repo"), "value")


# ---- logs -----------------------------------------------------------------------------------


def read_records(spark: SparkSession, path: str, repo: str) -> DataFrame:
    """(repo, value): one row per commit of a log printed with ``LOG_COMMAND``; records begin with the byte 0x1e."""
    return spark.read.option("lineSep", "\x1e").text(path).select(F.lit(repo).alias("repo"), "value").where("value <> ''")


# A rename or copy has two paths, every other change one.
_NAME_STATUS = r"(?:([RC])[0-9]*\x00([^\x00]*)|([A-Z])[0-9]*)\x00([^\x00]*)\x00"


def _changes(text: Column) -> Column:
    """array<struct<status, old, path>> of ``--name-status -z``; ``old`` is empty but for a rename or copy."""
    part = lambda n: F.regexp_extract_all(text, F.lit(_NAME_STATUS), F.lit(n))
    zipped = F.arrays_zip(part(1).alias("moved"), part(2).alias("old"), part(3).alias("plain"), part(4).alias("path"))
    return F.transform(zipped, lambda c: F.struct(F.concat(c["moved"], c["plain"]).alias("status"), c["old"].alias("old"), c["path"].alias("path")))


def parse_log(records: DataFrame) -> DataFrame:
    """(repo, commit_id, parents, ts, changes) of ``read_records``; ``changes`` are structs of status, old and path."""
    fields = F.split("value", "\x1f", 3)
    rest = F.get(fields, F.lit(2))
    # A commit's time ends at the first NUL or line end; its records follow.
    body = F.regexp_replace(rest, r"\A[0-9]*\x00?\n?", "")
    return records.select(
        "repo", F.get(fields, F.lit(0)).alias("commit_id"), F.filter(F.split(F.get(fields, F.lit(1)), " "), lambda p: p != "").alias("parents"),
        F.timestamp_seconds(F.regexp_extract(rest, r"\A[0-9]+", 0).cast("long")).alias("ts"), _changes(body).alias("changes"),
    )


def touches(log: DataFrame) -> DataFrame:
    """(repo, commit_id, ts, path): every path a commit touched, the old one of a rename too."""
    paths_ = F.flatten(F.transform("changes", lambda c: F.when((c["old"] != "") & (c["status"] == "R"), F.array(c["path"], c["old"])).otherwise(F.array(c["path"]))))
    return log.select("repo", "commit_id", "ts", F.explode(F.array_distinct(paths_)).alias("path"))


def read_log(spark: SparkSession, path: str, repo: str) -> DataFrame:
    """(repo, commit_id, ts, path) of a log printed with ``LOG_COMMAND``."""
    return touches(parse_log(read_records(spark, path, repo)))


def commit_parents(log: DataFrame) -> DataFrame:
    """(repo, commit_id, parent, first): one row per parent, in order; a first commit has one row without parent."""
    return log.select("repo", "commit_id", F.posexplode_outer("parents").alias("_at", "parent")).select(
        "repo", "commit_id", "parent", (F.coalesce("_at", F.lit(0)) == 0).alias("first")
    )


def commit_changes(log: DataFrame, wanted: DataFrame, shallow: DataFrame | None = None) -> DataFrame:
    """(repo, commit_id, base, path, status) of each ``wanted(repo, commit_id)``: what it changed against its first parent.

    A first commit is compared with nothing: ``base`` is null and all its files are added. A commit at the edge of a
    ``shallow(repo, commit_id)`` clone has a parent that isn't there, which is an error and not a first commit; so is a commit the log doesn't hold.
    """
    wanted = wanted.select("repo", "commit_id").distinct()
    missing = wanted.join(log.select("repo", "commit_id"), ["repo", "commit_id"], "left_anti").orderBy("repo", "commit_id").first()
    if missing is not None:
        raise ValueError(f"{missing.repo}: no commit {missing.commit_id!r} in its log")
    if shallow is not None:
        cut = wanted.join(shallow.select("repo", "commit_id"), ["repo", "commit_id"], "left_semi").orderBy("repo", "commit_id").first()
        if cut is not None:
            raise ValueError(f"{cut.repo}: the commit before {cut.commit_id!r} isn't in this shallow clone")
    rows = log.join(wanted, ["repo", "commit_id"], "left_semi").select(
        "repo", "commit_id", F.get("parents", F.lit(0)).alias("base"), F.explode("changes").alias("c"))
    return rows.select("repo", "commit_id", "base", F.col("c.path").alias("path"), F.col("c.status").alias("status"))


# ---- diffs ----------------------------------------------------------------------------------


def _number(text: Column) -> Column:
    return F.coalesce(text.try_cast("long"), F.lit(0).cast("long"))


def name_status_z(exports: DataFrame) -> DataFrame:
    """(repo, path, status) of whole ``--name-status -z`` exports; a rename keeps its new path."""
    return exports.select("repo", F.explode(_changes(F.col("value"))).alias("c")).select("repo", F.col("c.path").alias("path"), F.col("c.status").alias("status"))


def numstat_z(exports: DataFrame) -> DataFrame:
    """(repo, path, added, deleted) of whole ``--numstat -z`` exports; ``-`` of binary files counts as 0."""
    pattern = F.lit(r"(-|[0-9]+)\t(-|[0-9]+)\t(?:\x00[^\x00]*\x00)?([^\x00]*)\x00")
    part = lambda n: F.regexp_extract_all("value", pattern, F.lit(n))
    rows = exports.select("repo", F.explode(F.arrays_zip(part(1).alias("a"), part(2).alias("d"), part(3).alias("p"))).alias("n"))
    return rows.select("repo", F.col("n.p").alias("path"), _number(F.col("n.a")).alias("added"), _number(F.col("n.d")).alias("deleted"))


def parse_name_status(lines: DataFrame) -> DataFrame:
    """(repo, path, status) of ``--name-status`` lines (repo, value); a rename keeps its new path."""
    f = F.split("value", "\t")
    return lines.where(F.size(f) >= 2).select("repo", unquoted(F.element_at(f, -1)).alias("path"), F.substring(F.get(f, 0), 1, 1).alias("status"))


def parse_numstat(lines: DataFrame) -> DataFrame:
    """(repo, path, renamed, added, deleted) of ``--numstat`` lines.

    ``path`` is the name as it stands. ``renamed`` is the new path if the line tells of a rename, as ``dir/{old => new}/x`` or ``old => new`` do;
    a plain name that holds the arrow looks the same, so the name-status export decides (:func:`diff`).
    """
    f = F.split("value", "\t", 3)
    raw = F.get(f, 2)
    braces = F.regexp_replace(raw, r"\{[^{}]* => ([^{}]*)\}", "$1")
    new = F.when(braces != raw, F.regexp_replace(braces, "//", "/")).when(
        raw.contains(" => "), unquoted(F.regexp_replace(raw, r'\A(?:"(?:[^"\\]|\\.)*"|.*?) => ', "")))
    return lines.where(F.size(f) >= 3).select(
        "repo", unquoted(raw).alias("path"), new.alias("renamed"), _number(F.get(f, 0)).alias("added"), _number(F.get(f, 1)).alias("deleted"))


def diff(names: DataFrame, numbers: DataFrame) -> DataFrame:
    """(repo, path, status, added, deleted): both exports of one revision range, lines or ``-z``, by path."""
    if "\0" in (names.select(F.max(F.when(F.instr("value", "\0") > 0, "\0"))).first()[0] or ""):
        status, lines = name_status_z(names), numstat_z(numbers).withColumn("renamed", F.lit(None).cast("string"))
    else:
        status, lines = parse_name_status(names), parse_numstat(numbers)
    either = lines.select("repo", F.posexplode(F.array_compact(F.array("path", "renamed"))).alias("_at", "path"), "added", "deleted")
    best = status.join(either, ["repo", "path"], "left").groupBy("repo", "path", "status").agg(
        F.min_by(F.struct("added", "deleted"), F.when((F.col("status").isin("R", "C")), -F.col("_at")).otherwise(F.col("_at"))).alias("n"))
    zero = lambda c: F.coalesce(F.col(f"n.{c}"), F.lit(0).cast("long")).alias(c)
    return best.select("repo", "path", "status", zero("added"), zero("deleted"))


# ---- status ---------------------------------------------------------------------------------


def status_code(xy: Column) -> Column:
    """One letter for a two-letter working status: ? untracked, U conflicted, else worktree before index."""
    x, y = F.substring(xy, 1, 1), F.substring(xy, 2, 1)
    return (
        F.when(xy == "??", "?").when((x == "U") | (y == "U") | xy.isin("AA", "DD"), "U").when(y == " ", x).otherwise(y)
    )


def status_z(exports: DataFrame) -> DataFrame:
    """(repo, path, status) of whole ``status --porcelain=v1 -z`` exports; the old path of a rename is left out."""
    pattern = F.lit(r"(?s)(?:([RC].) ([^\x00]+)\x00[^\x00]*|(..) ([^\x00]+))\x00")
    part = lambda n: F.regexp_extract_all("value", pattern, F.lit(n))
    rows = exports.select("repo", F.explode(F.arrays_zip(*[part(n).alias(f"g{n}") for n in range(1, 5)])).alias("s"))
    return rows.select("repo", F.concat("s.g2", "s.g4").alias("path"), status_code(F.concat("s.g1", "s.g3")).alias("status"))


def parse_status(lines: DataFrame) -> DataFrame:
    """(repo, path, status) of ``status --porcelain=v1`` lines (repo, value)."""
    long = lines.where(F.length("value") >= 4)
    name = F.substring("value", F.lit(4), F.length("value"))
    moved = F.substring("value", 1, 2).rlike("[RC]")  # only these name the old path too
    new = F.regexp_replace(name, r'\A(?:"(?:[^"\\]|\\.)*"|.*?) -> ', "")
    path = unquoted(F.when(moved, new).otherwise(name))
    return long.select("repo", path.alias("path"), status_code(F.substring("value", 1, 2)).alias("status"))


# ---- change sets ----------------------------------------------------------------------------


def change_set(changes: DataFrame, source: str, rev: str | None = None) -> DataFrame:
    """One change set of ``changes(repo, source, rev, path, status, ...)``; further columns stay.

    ``source`` is ``uncommitted``, ``staged``, ``diff`` or ``commit``; the last two need ``rev``. For the commits of a log, see :func:`commit_changes`.
    """
    if source not in ("uncommitted", "staged", "diff", "commit"):
        raise ValueError(f"unknown change set {source!r}")
    chosen = changes.where(F.col("source") == source)
    if source in ("diff", "commit"):
        if not rev or rev.startswith("-"):
            raise ValueError(f"invalid revision {rev!r}")
        chosen = chosen.where(F.col("rev") == rev)
    return chosen.drop("source", "rev")
