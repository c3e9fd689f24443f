"""Slash-separated path functions as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parts(path: Column) -> Column:
    return F.split(path, "/")


def base(path: Column) -> Column:
    """The last element."""
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """The folder holding ``path``; ``.`` at the top."""
    cut = F.length(path) - F.length(base(path)) - 1
    return F.when(cut > 0, F.substring(path, F.lit(1), cut)).otherwise(F.lit("."))


def ext(path: Column) -> Column:
    """The extension with its dot, from the last dot of the name; empty without one."""
    return F.regexp_extract(base(path), r"(\.[^.]*)$", 1)


def stem(path: Column) -> Column:
    """``path`` without its extension."""
    return F.substring(path, F.lit(1), F.length(path) - F.length(ext(path)))


def depth(path: Column) -> Column:
    """Number of slashes: 0 at the top."""
    return F.size(parts(path)) - 1


def prefixes(path: Column) -> Column:
    """Every ancestor folder and the path itself, top first."""
    p = parts(path)
    return F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, F.lit(1), i), "/"))


def ancestors(path: Column) -> Column:
    """The folders above ``path``, top first, without ``.``."""
    every = prefixes(path)
    return F.slice(every, F.lit(1), F.size(every) - 1)


def ancestors_up(path: Column) -> Column:
    """The folders above ``path``, nearest first, ending with ``.``."""
    return F.concat(F.reverse(ancestors(path)), F.array(F.lit(".")))


def folders_up(folder: Column) -> Column:
    """``folder`` itself and every folder above it, nearest first, ending with ``.``."""
    return F.when(folder == ".", F.array(F.lit("."))).otherwise(
        F.concat(F.reverse(prefixes(folder)), F.array(F.lit(".")))
    )


def suffixes(path: Column) -> Column:
    """Every tail of ``path`` that starts at a path element, longest first."""
    p = parts(path)
    n = F.size(p)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(p, i, n), "/"))


def clean(path: Column) -> Column:
    """Resolve ``.``, ``..`` and empty elements; a leading ``..`` stays; ``.`` when nothing is left."""
    kept = F.aggregate(
        parts(path),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s.isin("", "."), acc)
        .when(
            (s == "..") & (F.size(acc) > 0) & (F.coalesce(F.element_at(acc, -1), F.lit("")) != ".."),
            F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))),
        )
        .otherwise(F.concat(acc, F.array(s))),
    )
    text = F.array_join(kept, "/")
    return F.when(text == "", F.lit(".")).otherwise(text)


def join(folder: Column, rest: Column) -> Column:
    return clean(F.concat_ws("/", folder, rest))


def walk_key(path: Column) -> Column:
    """A string that sorts like a walk visits files: folder by folder, each by entry name.

    The separator becomes the lowest character, so plain string order compares elements.
    """
    return F.translate(path, "/", "\u0001")


def in_folder(path: Column, names: list[str]) -> Column:
    """Whether a folder on the way to ``path`` has one of these names."""
    p = parts(path)
    folders = F.slice(p, F.lit(1), F.size(p) - 1)
    return F.arrays_overlap(folders, F.array(*[F.lit(n) for n in names])) & (F.size(folders) > 0)
