"""Commands that run tests: grouped by the project they belong to, with that project's runner."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..extract.manifests import cargo_tests, js_packages
from ..functions import labels, paths
from ..resolve.common import nearest
from .ranking import running_total

# Project files by preference, and runners by dependency.
PY_PROJECT_FILES = ["pyproject.toml", "setup.cfg", "tox.ini", "pytest.ini", "setup.py"]
PYTEST = ["python", "-m", "pytest"]
JS_RUNNERS = {"vitest": ["npx", "vitest", "run"], "jest": ["npx", "jest"], "ava": ["npx", "ava"], "mocha": ["npx", "mocha"]}


#: Bytes of arguments that one command may have; more tests go into further commands.
ARGUMENT_BYTES = 96 * 1024


def _strings(words: list[str]):
    return F.array(*[F.lit(w) for w in words])


def py_runners(contents: DataFrame) -> DataFrame:
    """(repo, at, runner): folders with a Python project file; pytest if one names it or conftest.py isn't empty."""
    name = paths.base(F.col("rel"))
    marks = contents.where(name.isin("conftest.py", *PY_PROJECT_FILES)).select(
        "repo", paths.parent(F.col("rel")).alias("at"), name.isin(*PY_PROJECT_FILES).alias("project"),
        F.when(name == "conftest.py", F.col("content") != "").otherwise(F.col("content").contains("pytest")).alias("uses"),
    )
    found = marks.groupBy("repo", "at").agg(F.max("project").alias("project"), F.max("uses").alias("uses")).where("project")
    return found.select("repo", "at", F.when(F.col("uses"), _strings(PYTEST)).alias("runner"))


def js_runners(contents: DataFrame) -> DataFrame:
    """(repo, at, runner) of every package.json: the first runner among its dependencies, else null."""
    choice = F.lit(None).cast("array<string>")
    for dep, argv in reversed(JS_RUNNERS.items()):
        choice = F.when(F.array_contains("deps", dep), _strings(argv)).otherwise(choice)
    listed = contents.where(paths.base(F.col("rel")) == "package.json").select("repo", paths.parent(F.col("rel")).alias("at"))
    return listed.join(js_packages(contents).select("repo", "at", choice.alias("runner")), ["repo", "at"], "left")


def _batched(args: DataFrame, most: int) -> DataFrame:
    """(repo, dir, runner, batch, words) of ``args(repo, dir, runner, ord, words)``, in order, with at most ``most`` bytes a batch.

    The running size decides, so a project of any number of tests is never gathered in one row. A single argument over the bound is a batch.
    """
    cost = F.expr("cast(aggregate(words, 0, (n, w) -> n + octet_length(w) + 1) as bigint)")
    placed = running_total(args.withColumn("_cost", cost).withColumn("_by", F.to_json("runner")), ["repo", "dir", "_by"], [F.col("ord")], "_cost", "_used")
    # A batch begins where the running size passes a multiple of half the bound: no batch is larger than the bound but for one argument.
    batch = F.floor((F.col("_used") - F.col("_cost")) / (most // 2)).cast("long")
    listed = F.array_sort(F.collect_list(F.struct("ord", "words")))  # at most ``most`` bytes
    return placed.groupBy("repo", "dir", "runner", batch.alias("batch")).agg(F.flatten(F.transform(listed, lambda s: s["words"])).alias("words"))


def test_commands(tests: DataFrame, contents: DataFrame, most: int = ARGUMENT_BYTES) -> DataFrame:
    """(repo, dir, batch, argv): one command per project and runner, or several if the arguments pass ``most`` bytes.

    Tests without a runner get none. Paths are relative to ``dir``. The nearest project decides, even if it names no runner.
    """
    rel = F.col("rel")
    lang = labels.source_lang(rel)
    rows = tests.select("repo", "rel", lang.alias("lang"), paths.parent(rel).alias("dir"))
    found = None
    for name, runners in (("py", py_runners(contents)), ("js", js_runners(contents))):
        mine = rows.where(F.col("lang") == name)
        # An absent runner must still win over one further up, so it travels as an empty list.
        marked = runners.withColumn("runner", F.coalesce("runner", F.array().cast("array<string>")))
        near = nearest(mine.select("repo", "dir").distinct(), marked, F.col("runner"))
        own = mine.join(near, ["repo", "dir"]).where(F.size("value") > 0)
        below = F.when(F.col("at") == ".", rel).otherwise(F.substring(rel, F.length("at") + 2, F.length(rel)))
        one = own.select("repo", F.col("at").alias("dir"), F.col("value").alias("runner"), below.alias("arg"))
        found = one if found is None else found.unionByName(one)
    plain = found.select("repo", "dir", "runner", F.col("arg").alias("ord"), F.array("arg").alias("words"))
    every = plain.unionByName(_cargo_targets(rows.where("lang = 'rs'"), contents))
    return _batched(every, most).select("repo", "dir", "batch", F.concat("runner", "words").alias("argv"))


def _cargo_targets(tests: DataFrame, contents: DataFrame) -> DataFrame:
    """Files right in a crate's tests folder, and declared targets there, by name."""
    declared, auto = cargo_tests(contents)
    crate = tests.where((F.col("dir") == "tests") | F.col("dir").endswith("/tests")).select(
        "repo", paths.parent(F.col("dir")).alias("at"), "rel", F.concat(F.lit("tests/"), paths.base(F.col("rel"))).alias("file")
    )
    rows = crate.join(auto, ["repo", "at"]).join(declared, ["repo", "at", "file"], "left")
    name = F.coalesce("name", F.when(F.col("auto"), F.regexp_replace(paths.base(F.col("rel")), r"\.rs\z", "")))
    named = rows.select("repo", "at", "rel", name.alias("name")).where("name is not null")
    return named.select(
        "repo", F.col("at").alias("dir"), _strings(["cargo", "test"]).alias("runner"), F.col("rel").alias("ord"), F.array(F.lit("--test"), "name").alias("words")
    )
