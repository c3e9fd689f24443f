"""Import specs of JavaScript/TypeScript, Python, Java, Kotlin and Rust files, in file order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels, paths
from .rust import rust_specs

# A quoted name, after the word that asks for it.
_QUOTED = r"""(["'])([^"']+)\1"""
JS_FORMS = (rf"\bfrom\s*{_QUOTED}", rf"\bimport\b\s*\(?\s*{_QUOTED}", rf"\brequire\s*\(\s*{_QUOTED}\s*\)")

_START = r"(?md)^\h*"
PY_FROM = _START + r"from\h+([.\w]+)\h+import\h+(?:\(([^)]*)\)|([^#;\n]*))"
PY_IMPORT = _START + r"import\h+([^#;\n]+)"
JVM_IMPORT = _START + r"import\h+(?:{static})?([.\w]+){end}"
JAVA_IMPORT = JVM_IMPORT.format(static=r"static\h+", end=r"\h*;")
KT_IMPORT = JVM_IMPORT.format(static="", end="")

# Strings are matched first, so a comment marker inside one stays text.
_JS_BLANK = (
    r"""("[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"?|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'?)"""
    r"""|//[^\n]*|/\*(?s:.*?)(?:\*/|\z)|(`)[^`\\]*+(?:\\(?s:.)[^`\\]*+)*+(`?)"""
)


def all_groups(content: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(content, F.lit(pattern), F.lit(group))


def js_code(content: Column) -> Column:
    """JavaScript without comments and template text; strings stay."""
    return F.regexp_replace(content, _JS_BLANK, "$1$2$3 ")


def js_imports(content: Column) -> Column:
    # The forms share one cleaned text: bound by a function, as branches of a condition have no common subexpressions.
    found = lambda code: F.concat(*[all_groups(code, p, 2) for p in JS_FORMS])
    return F.get(F.transform(F.array(js_code(content)), found), 0)


def _listed(names: Column) -> Column:
    """``a, b as c`` or the bracketed form, as words per item; comments after a name are cut."""
    flat = F.translate(F.regexp_replace(names, r"#[^\n]*", ""), "()\\", "   ")
    words = lambda part: F.filter(F.split(part, r"\s+"), lambda w: w != "")
    return F.filter(F.transform(F.split(flat, ","), words), lambda w: F.size(w) > 0)


def py_from_clauses(content: Column) -> Column:
    """Every ``from M import ...`` as struct(mod, names, bound)."""
    parts = F.arrays_zip(*[all_groups(content, PY_FROM, k).alias(n) for k, n in enumerate(("mod", "inner", "plain"), 1)])

    def clause(p):
        items = _listed(F.concat(p["inner"], p["plain"]))  # one of them is empty
        return F.struct(
            p["mod"].alias("mod"), F.transform(items, lambda w: w[0]).alias("names"),
            F.transform(items, lambda w: F.element_at(w, -1)).alias("bound"),
        )

    return F.transform(parts, clause)


def py_imports(content: Column) -> Column:
    """``from M import a`` gives M and M.a (a may be a submodule); ``import a, b`` gives both."""

    def expand(c):
        mod = c["mod"]
        dotted = F.when(mod.rlike(r"\A\.*\z"), mod).otherwise(F.concat(mod, F.lit(".")))
        named = F.filter(c["names"], lambda n: n != "*")
        return F.concat(F.array(mod), F.transform(named, lambda n: F.concat(dotted, n)))

    froms = F.flatten(F.transform(py_from_clauses(content), expand))
    plain = F.flatten(F.transform(all_groups(content, PY_IMPORT), lambda l: F.transform(_listed(l), lambda w: w[0])))
    return F.concat(froms, plain)


def import_specs(contents: DataFrame) -> DataFrame:
    """(repo, src, dir, lang, ord, spec) for every file but Go, in file order."""
    c, lang = F.col("content"), F.col("lang")
    rows = contents.withColumn("lang", labels.source_lang(F.col("rel"))).where("lang is not null and lang <> 'go'")
    native = F.when(lang == "js", js_imports(c)).when(lang == "py", py_imports(c)).when(
        lang == "java", all_groups(c, JAVA_IMPORT)
    ).when(lang == "kt", all_groups(c, KT_IMPORT))
    found = rows.where("lang <> 'rs'").select("repo", "rel", "lang", native.alias("specs")).unionByName(
        rows.where("lang = 'rs'").select("repo", "rel", "lang", rust_specs("content").alias("specs"))
    )
    # An inner explode would filter by the size of the list first, and so read every text several times.
    return found.select(
        "repo", F.col("rel").alias("src"), paths.parent(F.col("rel")).alias("dir"), "lang",
        F.posexplode_outer("specs").alias("ord", "spec"),
    ).where("ord is not null")
