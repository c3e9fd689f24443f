"""Path globs and ordered ignore rules as native predicates.

Patterns a user supplies are a short list: they are compiled once on the driver into literal regular
expressions. Patterns that stand in the repositories' own files are translated by columns, row by row, and meet the
entries of their own repository only. Matching stays in the JVM either way.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_GLOB_TOKEN = re.compile(r"\*\*/|\*\*|\*|\?|\[[^\]]*\]|\\.|.", re.S)


def _quote(char: str) -> str:
    return char if char.isalnum() or char in "_/" or not char.isascii() else "\\" + char


def glob_regex(glob: str) -> str:
    """The regular expression for a glob: ``*`` and ``?`` stay in one path element, ``**`` doesn't."""
    wild = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    out = []
    for token in _GLOB_TOKEN.findall(glob):
        if token in wild:
            out.append(wild[token])
        elif token[0] == "[" and len(token) > 1:
            chars = token[1:-1]
            negated = chars.startswith("!")
            body = chars[1:] if negated else chars
            # Java also reads "[" and "&&" inside a class as operators.
            body = body.replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append("[" + ("^" if negated else "") + body + "]")
        elif token[0] == "\\" and len(token) > 1:
            out.append(_quote(token[1]))
        else:
            out.append(_quote(token))
    return "".join(out)


@dataclass(frozen=True)
class IgnoreRule:
    regex: str
    negated: bool
    folders_only: bool
    anchored: bool


def ignore_rules(patterns: list[str]) -> list[IgnoreRule]:
    """Compile ignore-file lines, in order. Blank, comment and malformed lines are left out."""
    rules = []
    for line in patterns:
        text = line.rstrip(" \t\r")
        if not text or text.startswith("#"):
            continue
        negated = text.startswith("!")
        text = text[1:] if negated else text
        folders_only = text.endswith("/")
        text = text.rstrip("/") if folders_only else text
        regex = f"^{glob_regex(text.removeprefix('/'))}$"
        try:
            re.compile(regex)
        except re.error:
            continue
        rules.append(IgnoreRule(regex, negated, folders_only, "/" in text))
    return rules


def matches(rules: list[IgnoreRule], rel: Column, name: Column, is_dir: Column | bool, start: Column | None = None) -> Column:
    """Whether the rules select an entry: the last rule that matches it decides, ``start`` (else no) if none does."""
    decision = F.lit(False) if start is None else start
    for rule in rules:
        hit = (rel if rule.anchored else name).rlike(rule.regex)
        if rule.folders_only:
            hit = hit & (F.lit(is_dir) if isinstance(is_dir, bool) else is_dir)
        decision = F.when(hit, F.lit(not rule.negated)).otherwise(decision)
    return decision


def touched(rules: list[IgnoreRule], dotted: bool) -> str:
    """One regular expression found in every path that a rule matches, or that has a folder a rule matches; with ``dotted``, also hidden names.

    Most paths hold nothing of the kind, and need no look at their folders one by one.
    """
    inner = [r.regex.removeprefix("^").removesuffix("$") for r in rules]
    named = [body for body, r in zip(inner, rules) if not r.anchored] + [r"\..*"] * dotted
    rooted = [body for body, r in zip(inner, rules) if r.anchored]
    forms = [rf"(?:^|/)(?:{'|'.join(named)})(?:/|$)"] * bool(named) + [rf"^(?:{'|'.join(rooted)})(?:/|$)"] * bool(rooted)
    return "(?s)" + ("|".join(forms) or "(?!)")


def rule_side_regex(glob: str) -> str:
    """One side of an architecture rule: a glob from the root, a trailing slash means all below."""
    glob = glob.removeprefix("/")
    return f"^{glob_regex(glob + '**' if glob.endswith('/') else glob)}$"


# ---- patterns in columns --------------------------------------------------------------------

_COLUMN_TOKEN = r"(?s)\*\*/|\*\*|\*|\?|\[[^\]]*\]|\\.|."


def _column_quote(char: Column) -> Column:
    return F.when(char.rlike(r"\A[\x21-\x2e\x3a-\x40\x5b-\x5e\x60\x7b-\x7e]\z"), F.concat(F.lit("\\"), char)).otherwise(char)


def _column_class(token: Column) -> Column:
    """A character class; Java also reads "[" and "&&" inside a class as operators."""
    body = F.substring(token, F.lit(2), F.length(token) - 2)
    negated = body.startswith("!")
    body = F.when(negated, F.substring(body, F.lit(2), F.length(body))).otherwise(body)
    for plain, quoted in (("\\", "\\\\"), ("[", "\\["), ("&&", "&\\&")):
        body = F.replace(body, F.lit(plain), F.lit(quoted))
    return F.concat(F.lit("["), F.when(negated, "^").otherwise(""), body, F.lit("]"))


def glob_regex_of(glob: Column) -> Column:
    """``glob_regex`` of a column."""
    def piece(t: Column) -> Column:
        return (
            F.when(t == "**/", "(?:.*/)?").when(t == "**", ".*").when(t == "*", "[^/]*").when(t == "?", "[^/]")
            .when(t.startswith("[") & (F.length(t) > 1), _column_class(t))
            .when(t.startswith("\\") & (F.length(t) > 1), _column_quote(F.substring(t, F.lit(2), F.lit(1)))).otherwise(_column_quote(t))
        )

    return F.array_join(F.transform(F.regexp_extract_all(glob, F.lit(_COLUMN_TOKEN), F.lit(0)), piece), "")


def rule_side_regex_of(glob: Column) -> Column:
    """``rule_side_regex`` of a column."""
    glob = F.regexp_replace(glob, r"\A/", "")
    return F.concat(F.lit("^"), glob_regex_of(F.when(glob.endswith("/"), F.concat(glob, F.lit("**"))).otherwise(glob)), F.lit("$"))


def ignore_rule_of(line: Column) -> Column:
    """``ignore_rules`` of one line in a column: a struct like ``IgnoreRule``, null for blank, comment and malformed lines."""
    text = F.regexp_replace(line, r"[ \t\r]+\z", "")
    real = (text != "") & ~text.startswith("#")
    negated = text.startswith("!")
    text = F.when(negated, F.substring(text, F.lit(2), F.length(text))).otherwise(text)
    folders_only = text.endswith("/")
    text = F.regexp_replace(text, r"/+\z", "")
    regex = F.concat(F.lit("^"), glob_regex_of(F.regexp_replace(text, r"\A/", "")), F.lit("$"))
    # A class that Java can't compile: an empty one, or a range that runs backwards.
    backwards = F.exists(
        F.flatten(F.transform(F.regexp_extract_all(text, F.lit(r"\[[^\]]*\]"), F.lit(0)), lambda c: F.regexp_extract_all(c, F.lit(r"(?s)[^\[]-[^\]]"), F.lit(0)))),
        lambda r: F.substring(r, F.lit(1), F.lit(1)) > F.substring(r, F.lit(3), F.lit(1)),
    )
    malformed = text.rlike(r"\[!?\]") | backwards
    return F.when(real & ~malformed, F.struct(
        regex.alias("regex"), negated.alias("negated"), folders_only.alias("folders_only"), text.contains("/").alias("anchored")
    ))


def matches_rows(rules: Column, rel: Column, name: Column, is_dir: Column | bool, start: Column) -> Column:
    """``matches`` by an ordered array of such structs; a null array leaves ``start``."""
    folder = F.lit(is_dir) if isinstance(is_dir, bool) else is_dir

    def step(decision: Column, rule: Column) -> Column:
        subject = F.when(rule["anchored"], rel).otherwise(name)
        hit = (folder | ~rule["folders_only"]) & F.regexp_like(subject, rule["regex"])
        return F.when(hit, ~rule["negated"]).otherwise(decision)

    return F.coalesce(F.aggregate(rules, start, step), start)
