"""Sizes, plurals, token estimates and text clean-up as native columns."""

from __future__ import annotations

import json
import re
from html.entities import html5
from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit letters and labels, the bar glyphs, and the age units.
HUMAN_UNITS = ["K", "M", "G", "T", "P", "E"]
BINARY_UNITS = ["KiB", "MiB", "GiB", "TiB", "PiB", "EiB"]
DECIMAL_UNITS = ["kB", "MB", "GB", "TB", "PB", "EB"]
BARS = "▁▂▃▄▅▆▇█"
AGE_SECONDS = {
    "ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800,
}


def _one_decimal(n: Column, unit: int, exp: int) -> Column:
    return F.call_function("format_number", n.cast("double") / F.lit(float(unit**exp)), F.lit("0.0"))


def _scaled(n: Column, unit: int, small: Column, label) -> Column:
    out = label(6)
    for exp in range(5, 0, -1):
        out = F.when(n < F.lit(unit ** (exp + 1)), label(exp)).otherwise(out)
    return F.when(n < unit, small).otherwise(out)


def human_size(n: Column, si: bool = False) -> Column:
    """Short size: 512B, 4.2K, 3M."""
    unit = 1000 if si else 1024
    return _scaled(
        n, unit, F.concat(n.cast("string"), F.lit("B")),
        lambda e: F.concat(F.regexp_replace(_one_decimal(n, unit, e), r"\.0$", ""), F.lit(HUMAN_UNITS[e - 1])),
    )


def format_size(n: Column, si: bool = False) -> Column:
    """Labelled size: 512 B, 1.5 KiB (kB with ``si``)."""
    unit, units = (1000, DECIMAL_UNITS) if si else (1024, BINARY_UNITS)
    return _scaled(
        n, unit, F.concat(n.cast("string"), F.lit(" B")),
        lambda e: F.concat(_one_decimal(n, unit, e), F.lit(" " + units[e - 1])),
    )


def parse_age(text: str) -> timedelta:
    """An age such as 90m, 1h30m, 7d or 1.5w; days and weeks stand alone."""
    day_like = re.fullmatch(r"(\d+(?:\.\d*)?|\.\d+)([dw])", text)
    if day_like:
        return timedelta(seconds=float(day_like[1]) * AGE_SECONDS[day_like[2]])
    step = r"(\d+(?:\.\d*)?|\.\d+)(ns|us|µs|ms|s|m|h)"
    if text == "0" or text == "+0":
        return timedelta(0)
    if not re.fullmatch(rf"\+?(?:{step})+", text):
        raise ValueError(f"expected an age like 30m, 12h, 7d or 2w, not {text!r}")
    return timedelta(seconds=sum(float(v) * AGE_SECONDS[u] for v, u in re.findall(step, text)))


def plural(n: Column, word: str) -> Column:
    """``1 file``, ``2 files``, ``3 directories``."""
    many = word[:-1] + "ies" if word.endswith("y") else word + "s"
    return F.concat(n.cast("string"), F.when(n == 1, F.lit(" " + word)).otherwise(F.lit(" " + many)))


def tokens(text: Column) -> Column:
    """About four bytes a token, rounded up."""
    return F.floor((F.octet_length(text) + 3) / 4).cast("long")


def one_line(text: Column) -> Column:
    """Collapse whitespace and cut after 140 characters."""
    flat = F.trim(F.regexp_replace(text, r"[\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", " "))
    return F.when(F.length(flat) > 140, F.concat(F.substring(flat, 1, 140), F.lit("…"))).otherwise(flat)


def printable(text: Column) -> Column:
    """Control and format characters become spaces."""
    return F.regexp_replace(text, r"[\p{Cc}\p{Cf}]", " ")


def redact_urls(text: Column) -> Column:
    """Drop user, query and fragment from every URL in a text."""
    no_user = F.regexp_replace(text, r"([a-zA-Z][a-zA-Z0-9+.-]*://)[^\s<>\"'/?#]*@", "$1")
    return F.regexp_replace(no_user, r"([a-zA-Z][a-zA-Z0-9+.-]*://[^\s<>\"'?#]+)[?#][^\s<>\"']*", "$1")


def is_paste_safe(text: Column) -> Column:
    """Safe as one plain shell argument: letters, digits and ``_ . / -``, no leading dash."""
    return text.rlike(r"\A[A-Za-z0-9_./][A-Za-z0-9_./-]*\z")


def mentions_word(text: Column, name: str, dollar_is_word: bool = False) -> Column:
    """Whether ``name`` occurs as a whole word; with ``dollar_is_word``, as a whole identifier."""
    quoted = re.escape(name)
    if dollar_is_word:
        return text.rlike(rf"(?<![A-Za-z0-9_$]){quoted}(?![A-Za-z0-9_$])")
    return text.rlike(rf"\b{quoted}\b")


def some_of(names: Column) -> Column:
    """A sorted list shortened to three names and ``+N more``."""
    ordered = F.array_sort(names)
    head = F.array_join(F.slice(ordered, 1, 3), ", ")
    extra = F.size(ordered) - 3
    return F.when(extra > 0, F.concat(head, F.lit(" +"), extra.cast("string"), F.lit(" more"))).otherwise(head)


def cap_list(items: Column, n: int) -> Column:
    """The first ``n`` items and, if there are more, ``+N more``."""
    extra = F.size(items) - n
    more = F.array(F.concat(F.lit("+"), extra.cast("string"), F.lit(" more")))
    return F.when(extra > 0, F.concat(F.slice(items, 1, n), more)).otherwise(items)


def churn_bar(level: Column, n: Column) -> Column:
    """One of eight block heights and the count; ``level`` counts from 1."""
    glyphs = F.array(*[F.lit(c) for c in BARS])
    return F.concat(F.get(glyphs, level - 1), F.lit(" "), n.cast("string"))


# Markdown that goes, step by step: where a link leads, the brackets around its words, emphasis, and the escape in front of a sign.
MARKDOWN = [(r"\]\([^)]*\)", "]"), (r"\]\[[^\]]*\]", "]"), (r"!?\[([^\]]*)\]", r"\1"), (r"[*_]{2}|`", ""), (r"\\([^\w\s])", r"\1")]
# What may be left over at either end of a line.
EDGES = "-*_> \u2002\u2003"


def plain_text(line: Column) -> Column:
    """Markdown without links, emphasis and escapes, trimmed; entities unescaped."""
    out = line
    for pattern, to in MARKDOWN:
        out = F.regexp_replace(out, pattern, to.replace("\\", "$"))
    return F.trim(unescape(out), F.lit(EDGES))


_ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"


def _named_entities() -> Column:
    """The standard's table, one literal: names without ``&`` and ``;`` to characters, by first letter, as a map is searched key by key."""
    table: dict[str, dict[str, str]] = {}
    for name, chars in html5.items():
        if name.endswith(";"):
            table.setdefault(name[0], {})[name[:-1]] = chars
    return F.from_json(F.lit(json.dumps(table)), "map<string, map<string, string>>")


def unescape(text: Column) -> Column:
    """Replace HTML entities by name and number, in one pass, so nothing is unescaped twice; unknown names stay."""
    known = _named_entities()
    gaps, hits = F.split(text, _ENTITY), F.regexp_extract_all(text, F.lit(_ENTITY), F.lit(0))

    def char(e: Column) -> Column:
        inner = F.substring(e, F.lit(2), F.length(e) - 2)
        point = F.when(F.lower(F.substring(inner, 2, 1)) == "x", F.conv(F.substring(inner, F.lit(3), F.length(inner)), 16, 10)).otherwise(
            F.substring(inner, F.lit(2), F.length(inner))).cast("int")
        valid = ((point > 0) & (point < 0xD800)) | ((point > 0xDFFF) & (point < 0x110000))
        numeric = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")).otherwise(F.lit("\ufffd"))
        named = F.try_element_at(F.try_element_at(known, F.substring(inner, 1, 1)), inner)
        return F.when(inner.startswith("#"), numeric).otherwise(F.coalesce(named, e))

    # Each gap meets its entity once: looked up by place, all entities would be decoded again for every gap.
    joined = F.array_join(F.zip_with(gaps, hits, lambda g, e: F.concat(g, F.coalesce(char(e), F.lit("")))), "")
    return F.when(text.contains("&"), joined).otherwise(text)


def first_sentences(text: Column, limit: int = 200) -> Column:
    """Shorten to ``limit`` characters, ending at a full stop when one falls in the second half."""
    cut = F.substring(text, 1, limit)
    stop = F.length(F.regexp_extract(cut, r"(?s)\A(.*)\. ", 1))
    at_stop = cut.contains(". ") & (F.octet_length(F.substring(cut, F.lit(1), stop)) >= F.floor(F.octet_length(cut) / 2))
    short = F.when(at_stop, F.substring(cut, F.lit(1), stop + 1)).otherwise(F.concat(cut, F.lit("…")))
    return F.when(F.length(text) <= limit, text).otherwise(short)
