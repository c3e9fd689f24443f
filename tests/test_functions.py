"""Scalar semantics: globs, labels, sizes, ages, signatures, prose."""

import time
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from codeatlas.extract.decls import signature
from codeatlas.extract.readme import prose
from codeatlas.extract.rust import specs_of
from codeatlas.functions import globs, labels, paths, text
from codeatlas.operators import rules


def col_values(spark, values, column, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


MATCHES = [  # patterns, rel, is_dir, selected
    (["*.log"], "a/b.log", False, True),
    (["*.log"], "a/b.txt", False, False),
    (["*.log", "!keep.log"], "keep.log", False, False),
    (["!keep.log", "*.log"], "keep.log", False, True),
    (["build/"], "build", True, True),
    (["build/"], "build", False, False),
    (["build/"], "a/build", True, True),
    (["/build"], "a/build", True, True),  # a leading slash alone doesn't anchor below
    (["a/b"], "a/b", False, True),
    (["a/b"], "x/a/b", False, False),
    (["a/*"], "a/b", False, True),
    (["a/*"], "a/b/c", False, False),
    (["a/**"], "a/b/c", False, True),
    (["**/c"], "a/b/c", False, True),
    (["**/c"], "c", False, True),
    (["x?z"], "xyz", False, True),
    (["x?z"], "x/z", False, False),
    (["[ab].c"], "a.c", False, True),
    (["[!ab].c"], "a.c", False, False),
    (["[ab"], "[ab", False, True),
    ([r"\!x"], "!x", False, True),
    (["# c", "", "a b.txt  "], "a b.txt", False, True),
    (["a.c"], "abc", False, False),
    (["[a&&b].c"], "&.c", False, True),
]


def test_ignore_rules(spark):
    for patterns, rel, is_dir, want in MATCHES:
        compiled = globs.ignore_rules(patterns)
        (got,) = col_values(spark, [rel], lambda c: globs.matches(compiled, c, paths.base(c), is_dir))
        anchored = patterns == ["/build"]
        assert got is (False if anchored else want), (patterns, rel)


def test_languages(spark):
    cases = {
        "main.go": "Go", "a/b.TSX": "TypeScript", "x.jsonl": "JSONL", "Makefile": "Makefile", "go.sum": "Go modules",
        ".env": None, "LICENSE": None, "a.tar.gz": "GZ", ".eslintrc.json": "JSON", "x.d.ts": "TypeScript", "Rakefile": "Ruby",
    }
    assert col_values(spark, list(cases), labels.language) == list(cases.values())


def test_test_files(spark):
    cases = {
        "a_test.go": True, "test/util.go": False, "test_x.go": False, "a.spec.ts": True, "a.test.js": True, "test_a.py": True,
        "a_test.py": True, "tests/conftest.py": True, "__tests__/a.js": True, "src/latest.ts": False, "tests": False,
    }
    assert col_values(spark, list(cases), labels.is_test) == list(cases.values())
    runnable = {"tests/conftest.py": False, "tests/test_a.py": True, "a.spec.ts": True, "a.py": False}
    assert col_values(spark, list(runnable), labels.is_runnable_test) == list(runnable.values())


def test_entry_and_config(spark):
    entry = {"cmd/x/main.go": True, "a/b/c/d/main.go": False, "examples/main.py": False, "src/index.ts": True, "x.ts": False}
    assert col_values(spark, list(entry), labels.is_entry_point) == list(entry.values())
    config = {"Dockerfile": True, "a/b/vite.config.ts": False, "a/vite.config.ts": True, ".github/workflows/ci.yml": True, "x/.gitlab-ci.yml": True, "a.ts": False}
    assert col_values(spark, list(config), labels.is_config) == list(config.values())


def test_sizes(spark):
    n = [0, 512, 1023, 1024, 1536, 4300, 1 << 20, 5 * (1 << 30), 1000, 1500]
    assert col_values(spark, n, text.human_size, "bigint") == ["0B", "512B", "1023B", "1K", "1.5K", "4.2K", "1M", "5G", "1000B", "1.5K"]
    assert col_values(spark, n, lambda c: text.format_size(c, si=True), "bigint")[3:6] == ["1.0 kB", "1.5 kB", "4.3 kB"]


def test_ages():
    for s, want in {"30m": 1800, "12h": 43200, "7d": 604800, "1.5d": 129600, "2w": 1209600, "1h30m": 5400}.items():
        assert text.parse_age(s) == timedelta(seconds=want)
    for s in ("", "7", "-1d", "d", "1x", "1d2h", "-5m"):
        with pytest.raises(ValueError):
            text.parse_age(s)


def test_plural_and_lists(spark):
    assert col_values(spark, [0, 1, 2], lambda c: text.plural(c, "entry"), "bigint") == ["0 entries", "1 entry", "2 entries"]
    lists = [["b", "a"], ["d", "c", "b", "a"], []]
    assert col_values(spark, lists, text.some_of, "array<string>") == ["a, b", "a, b, c +1 more", ""]
    assert col_values(spark, lists, lambda c: text.cap_list(c, 2), "array<string>") == [["b", "a"], ["d", "c", "+2 more"], []]


def test_bars(spark):
    df = spark.createDataFrame([(1, 8), (8, 8), (1, 100), (100, 100), (5, 8)], "n bigint, top bigint")
    level = (F.floor((F.col("n") * 8 - 1) / F.col("top")) + 1).cast("int")
    assert [r[0] for r in df.select(text.churn_bar(level, F.col("n"))).collect()] == ["▁ 1", "█ 8", "▁ 1", "█ 100", "▅ 5"]


def test_clean_paths(spark):
    cases = {"a/./b/../c": "a/c", "a/..": ".", "../x": "../x", "a//b": "a/b", "./x": "x", "a/../../b": "../b", ".": "."}
    assert col_values(spark, list(cases), paths.clean) == list(cases.values())


def test_redaction(spark):
    cases = {
        "see https://u:p@x.dev/a?t=1#f now": "see https://x.dev/a now", "ssh://git@h/r": "ssh://h/r", "no url": "no url",
        "https://x.dev/a@b": "https://x.dev/a@b",
    }
    assert col_values(spark, list(cases), text.redact_urls) == list(cases.values())


def test_signatures():
    for line, want in {
        "export abstract class Kettle<Size = Large> extends Pot {": "export abstract class Kettle<Size = Large> extends Pot",
        "export type Steam = Hot | Cold;": "export type Steam",
        "export function pour(into: Cup, how: How = {slow: true}): void {": "export function pour(into: Cup, how: How = {slow: true}): void",
        "export let warm = (cup) => cup.heat": "export let warm",
        "def brew(leaves: dict[str, int] = None, *, hot=True) -> Tea:": "def brew(leaves: dict[str, int] = None, *, hot=True) -> Tea",
        "class Spoon(": "class Spoon(…)",
        "pub fn stir<F: Fn(u8) -> bool>(f: F) -> Cup {": "pub fn stir<F: Fn(u8) -> bool>(f: F) -> Cup",
        "export function full(n: number): boolean { return n == 1 }": "export function full(n: number): boolean",
        "export const " + "x" * 200: "export const " + "x" * 127 + "…",
    }.items():
        assert signature(line) == want


def test_rust_specs():
    src = (
        "mod door; // mod window;\npub mod roof ;\n/* use a::b; /* use c::d; */ use e::f; */\nuse crate::{beam::Oak, nail::{self, Long as L}};\n"
        "fn f() { let s = \"use g::h;\"; let r = r##\"use i::\"# j;\"##; let c = '\"'; brick::lay(1); std::mem::drop(s); }\n"
        "mod tests {\n    use super::roof_of;\n    mod inner { use super::super::super::hill; use self::near; }\n}\n"
    )
    assert specs_of(src)[:8] == [
        "door", "roof", "crate::beam::Oak", "crate::nail", "crate::nail::Long", "self::roof_of", "super::hill", "self::near"]
    assert "brick::lay" in specs_of(src)[8:]
    assert not {"a::b", "c::d", "e::f", "g::h", "std::mem::drop"} & set(specs_of(src))


PROSE = {
    "# Loom\n\nWeaves **threads** into `cloth`.\n\nMore about it.\n": "Weaves threads into cloth.",
    "Loom\n----\nWeaves [threads](x) &amp; cloth\nfrom wool.\n": "Weaves threads & cloth from wool.",
    "```\nnpm install loom\n```\n~~~sh\nmake\n~~~\nA loom.\n": "A loom.",
    "<!-- licence:\nfree -->\nA loom<!-- old --> that hums.\n": "A loom that hums.",
    "> [!TIP]\n> Oil it.\n> Often.\n\nA quiet loom.\n": "A quiet loom.",
    "> Cloth for everyone.\n": "Cloth for everyone.",
    "![logo](l.png)\n[![build](b)](c)\n<img src='w.gif'>\nWoven daily.\n| a | b |\n": "Woven daily.",
    "<div>\n<b>One loom for all rooms</b>\n</div>\nLater.\n": "One loom for all rooms",
    "1. Thread it\n2. Run it\n": "1. Thread it",
    "* Fast\n\nBut also prose.\n": "But also prose.",
    "Docs: https://loom.test/docs\n\nIt has docs.\n": "It has docs.",
    "\n" * 60 + "Far down.\n": "Far down.",
    "# Only a title\n": "",
    "": "",
}


def test_readme_prose():
    assert {k: prose(k) for k in PROSE} == PROSE


def test_entities(spark):
    cases = {"a &lt;b&gt; &#65;&#x1F600; &amp;lt;": "a <b> A\U0001f600 &lt;", "&#0;&#xD800;": "\ufffd\ufffd", "no & &&": "no & &&"}
    assert col_values(spark, list(cases), text.unescape) == list(cases.values())


def test_many_entities(spark):
    """Time grows with the number of entities in a text, not with its square."""
    n, start = 20_000, time.monotonic()
    got = col_values(spark, ["&zwnj;x&#233;&nosuch;" * n, "&", None, ""], text.unescape)
    assert got == ["\u200cxé&nosuch;" * n, "&", None, ""] and time.monotonic() - start < 60


def test_first_sentences(spark):
    long = "Word " * 30 + "end. " + "More " * 30
    assert col_values(spark, [long, "short", "x" * 300], text.first_sentences) == [("Word " * 30).strip() + " end.", "short", "x" * 200 + "…"]


def test_rule_files():
    parsed = rules.parse_rules("# layers\nweb/ -> db/\n\n**/*.tsx -> /server/\n")
    assert [(r.line, r.rule) for r in parsed] == [(2, "web/ -> db/"), (4, "**/*.tsx -> /server/")]
    for bad in ("web/ db/\n", "-> x\n", "# only a comment\n", "x ->\n"):
        with pytest.raises(ValueError):
            rules.parse_rules(bad)
