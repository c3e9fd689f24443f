"""Go facts, one row per file.

A text is read once, token by token; nesting, declaration, spec and scope are carried along, and what the file declares,
imports, binds, uses and mentions comes out as one row of lists. No token ever becomes a row, no text is shuffled: everything after
this is joins of names. Names bound anywhere in a declaration (parameters, fields, locals) aren't uses of
package-level names in that declaration. Positions count tokens without comments.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..storage import stage

# What a token is, and the keywords.
TOKEN = re.compile(
    r"""//[^\n]*|/\*(?s:.*?)\*/|`[^`]*+`|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"""
    r"""|[^\W\d]\w*|[0-9][0-9A-Za-z_]*(?:\.[0-9][0-9A-Za-z_]*)?|:=|\.\.\.|\n|[^ \t\n\x0b\f\r]"""
)
KEYWORDS = frozenset([
    "break", "case", "chan", "const", "continue", "default", "defer", "else", "fallthrough", "for", "func", "go",
    "goto", "if", "import", "interface", "map", "package", "range", "return", "select", "struct", "switch", "type",
    "var",
])
DECLARING = frozenset(["func", "type", "var", "const", "import"])
TYPE_START = frozenset(["func", "map", "chan", "struct", "interface", "..."])
LINE_START, ITEM_START = frozenset(["\n", "{", ";"]), frozenset(["(", ",", "\n", "{", ";"])
OPENING, CLOSING = frozenset(["(", "[", "{"]), frozenset([")", "]", "}"])
DECL_AFTER, SPEC_AFTER, NO_SPEC = frozenset([None, "\n", ";"]), frozenset(["(", "\n", ";"]), frozenset(["\n", ";", ")"])
LOCAL, PLACE = frozenset(["var", "const", "type"]), frozenset(["case", "{", "\n"])

SCHEMA = (
    "repo string, rel string, pkg string, imports array<struct<ord: int, path: string, name: string>>,"
    " names array<struct<decl: int, spec: int, pos: int, kind: string, name: string, recv: string>>,"
    " uses array<string>, called array<string>, picks array<struct<pkg: string, name: string>>,"
    " refs array<struct<name: string, ref: string, fn: string, member: string>>,"
    " results array<struct<name: string, result: string>>,"
    " signatures array<struct<late: int, decl: int, spec: int, text: string>>"
)


def _word(token: str | None) -> bool:
    return token is not None and (token[0] == "_" or token[0].isalpha()) and token not in KEYWORDS


class _File:
    """The tokens of one text, and what is known of each: depth before it, declaration, spec."""

    def __init__(self, text: str):
        shared: dict[str, str] = {}
        found = [shared.setdefault(t, t) for t in TOKEN.findall(text) if t[0] != "/" or not t.startswith(("//", "/*"))]
        self.n = len(found)
        at = [None, None, None, *found, None, None, None, None]
        self.found, self.at = found, at  # token i is at[i + 3]
        words = {t for t in shared if _word(t)}
        self.word = [t in words for t in found]
        self.depth, self.decl, self.spec = [], [], []
        self.kind: list[str | None] = [None]  # by declaration; 0 is what comes before the first
        self.grouped, self.first, self.body = [False], [0], [None]
        self.heads: dict[int, int] = {}  # spec -> position of its first token after keyword
        depth = decl = spec = 0
        kind = before = None
        for i, tok in enumerate(found):
            if depth == 0 and tok in DECLARING and before in DECL_AFTER:
                kind = tok
                decl += 1
                self.kind.append(tok)
                self.grouped.append(at[i + 4] == "(")
                self.first.append(i)
                self.body.append(None)
                spec += 1
                self.heads[spec] = i + 1
            elif depth == 1 and self.grouped[decl] and kind != "func" and before in SPEC_AFTER and tok not in NO_SPEC:
                spec += 1
                self.heads[spec] = i
            self.depth.append(depth)
            self.decl.append(decl)
            self.spec.append(spec)
            if tok in OPENING:
                if tok == "{" and depth == 0 and kind == "func" and self.body[decl] is None:
                    self.body[decl] = i
                depth += 1
            elif tok in CLOSING:
                depth -= 1
            before = tok
        self.first.append(self.n)
        self.read = [k not in (None, "import") for k in self.kind]  # by declaration: whether its words are names

    def tok(self, i: int) -> str | None:
        return self.at[i + 3]

    def span(self, decl: int) -> range:
        return range(self.first[decl], self.first[decl + 1])


def _package(f: _File) -> str | None:
    for i in range(f.first[1] if len(f.kind) > 1 else f.n):
        if f.tok(i) == "package" and f.depth[i] == 0 and f.tok(i + 1) is not None:
            return f.tok(i + 1)
    return None


def _imports(f: _File, decl: int) -> Iterator[dict]:
    for i in f.span(decl):
        if f.tok(i)[0] in "\"`":
            before = f.tok(i - 1)
            yield {"ord": i, "path": f.tok(i)[1:-1], "name": None if before in ("\n", ";", "(", "import") else before}


def _function(f: _File, decl: int) -> dict | None:
    """A function's name is its first word outside brackets; a receiver's type is the last word directly in the first bracket."""
    start, receiver = f.first[decl] + 1, None
    has_receiver = f.tok(start) == "("
    for i in range(start, f.first[decl + 1]):
        if _word(f.tok(i)):
            if f.depth[i] == 0:
                return {"decl": decl, "spec": f.spec[i], "pos": i, "kind": "func", "name": f.tok(i), "recv": (receiver or "") if has_receiver else None}
            if f.depth[i] == 1:
                receiver = f.tok(i)
    return None


def _listed(f: _File, decl: int) -> Iterator[dict]:
    """A var or const spec starts with words between commas, a type spec with one word."""
    kind = f.kind[decl]
    if f.first[decl] == f.first[decl + 1]:
        return
    for spec in range(f.spec[f.first[decl]], f.spec[f.first[decl + 1] - 1] + 1):
        i, k = f.heads[spec], 0
        while i < f.first[decl + 1] and f.spec[i] == spec and (_word(f.tok(i)) if k % 2 == 0 else f.tok(i) == ","):
            if k % 2 == 0 and f.tok(i) != "_" and (kind != "type" or k == 0):
                yield {"decl": decl, "spec": spec, "pos": i, "kind": kind, "name": f.tok(i), "recv": None}
            i, k = i + 1, k + 1


def _type_at(f: _File, i: int) -> str | None:
    """T where T or *T stands at ``i``, and is a name of this package."""
    if f.tok(i) == "*":
        i += 1
    return f.tok(i) if _word(f.tok(i)) and f.tok(i + 1) != "." else None


def _made_at(f: _File, i: int) -> str | None:
    """T of T{...} and &T{...}, @g of g(...)."""
    if f.tok(i) == "&":
        return f.tok(i + 1) if _word(f.tok(i + 1)) and f.tok(i + 2) == "{" else None
    if _word(f.tok(i)) and f.tok(i + 1) in ("{", "("):
        return f.tok(i) if f.tok(i + 1) == "{" else "@" + f.tok(i)
    return None


def _typed(f: _File, i: int) -> bool:
    """Does a type follow this word? Two words side by side, "x []T" and "x ...T" occur nowhere else."""
    if f.at[i + 2] not in ITEM_START:
        return False
    n1, n2, before = f.tok(i + 1), f.tok(i + 2), f.tok(i - 1)
    if _word(n1) or n1 in TYPE_START:
        return True
    if n1 == "[":
        return n2 == "]" or (n2 is not None and n2[0].isdigit() and n2[0].isascii() and f.tok(i + 3) == "]")
    if n1 == "*" and _word(n2):
        body = f.body[f.decl[i]]
        return before in LINE_START or (f.kind[f.decl[i]] == "func" and (body is None or i < body))
    return False


def _bindings(f: _File) -> Iterator[tuple[int, str, str | None]]:
    """(position, name, type) of parameters, fields and locals, last first. In a list such as ``a, b T`` every name gets the type."""
    at, words, depths, decls, read = f.at, f.word, f.depth, f.decl, f.read
    lead: list[bool] = [False] * f.n  # whether a var, const or type inside a body leads the list a word is in
    var = False
    for i, tok in enumerate(f.found):
        if not read[decls[i]]:
            continue
        lead[i] = var
        if tok in LOCAL and depths[i] > 0:
            var = True
        elif tok != "," and not words[i]:
            var = False
    after: tuple[str, str | None] | None = None  # what ends the list of names a word is in
    for i in range(f.n - 1, -1, -1):
        decl = decls[i]
        if not read[decl]:
            continue
        tok = at[i + 3]
        if not words[i]:
            if tok == ":=":
                after = ("made", _made_at(f, i + 1))
            elif tok != ",":
                after = ("no", None)
            continue
        typed = _typed(f, i)
        before, n1 = at[i + 2], at[i + 4]
        if before != ".":
            found, bound, kind = None, True, f.kind[decl]
            if typed:
                found = _type_at(f, i + 1)
            elif n1 == "," and before in ITEM_START and after is not None and after[0] == "typed":
                found = after[1]
            elif n1 in (",", ":=") and after is not None and after[0] == "made":
                found = after[1]
                if (before == "," or before is None) and found is not None and found[0] == "@":
                    found = None
            elif lead[i] and before in ("var", "const", "type", ","):
                found = _type_at(f, i + 1) if before in ("var", "const") else None
            else:
                bound = kind == "type" and before in LINE_START and n1 == "(" and depths[i] > 0
            # Names that a var or const line declares at the top are package-level.
            top = kind in ("var", "const") and (depths[i] == 0 or (f.grouped[decl] and depths[i] == 1))
            if bound and not (top and (after is None or after[0] != "made")):
                yield i, tok, found
        if typed:
            after = ("typed", _type_at(f, i + 1))


def _first_result(f: _File, function: dict) -> str | None:
    """A function's first result, when it is a type of this package: what stands behind its parameters."""
    for i in range(function["pos"] + 1, f.first[function["decl"] + 1]):
        if f.tok(i) == ")" and f.depth[i] == 1:
            break
    else:
        return None
    n1, n2, n3, n4 = (f.tok(i + k) for k in range(1, 5))
    plain = lambda name, following: None if following == "." else name
    if n1 == "*" and _word(n2):
        return plain(n2, n3)
    if _word(n1):
        return plain(n1, n2)
    if n1 == "(" and n2 == "*" and _word(n3):
        return plain(n3, n4)
    if n1 == "(" and _word(n2):
        if _word(n3):
            return plain(n3, n4)
        if n3 == "*" and _word(n4):
            return n4
        return plain(n2, n3)
    return None


def _spaced(f: _File, decl: int) -> str:
    """A function's header in printed form: spaces between words, after commas, and before a result."""
    end = f.body[decl] if f.body[decl] is not None else f.first[decl + 1]
    out, before = [], None
    for i in range(f.first[decl], end):
        tok = f.tok(i)
        if tok == "\n":
            continue
        word = tok[0].isalnum() or tok[0] in "_\""
        gap = ""
        if before is None:
            pass
        elif before == "," or (before == "func" and tok == "(" and f.depth[i] == 0):
            gap = " "
        elif (before[0].isalnum() or before[0] == "_") and (word or tok in ("*", "...")):
            gap = " "
        elif before in (")", "]", "}") and (word or tok in ("*", "(", "[")) and (f.depth[i] == 0 or tok != "("):
            gap = "" if before == "]" else " "
        elif (before[0].isalpha() or before[0] == "_") and tok == "[" and f.tok(i + 1) is not None and (f.tok(i + 1) == "]" or f.tok(i + 1)[0] in "0123456789"):
            gap = " "
        out.append(gap + tok)
        before = tok
    return "".join(out)


def _signature(f: _File, name: dict) -> dict | None:
    if name["kind"] == "func":
        if name["name"] == "init":
            return None
        spec, text = 0, _spaced(f, name["decl"])
    elif name["kind"] == "type":
        n1 = f.tok(name["pos"] + 1)
        spec, text = name["spec"], f"type {name['name']} {n1 if n1 in ('struct', 'interface', 'func', 'map') else ''}".rstrip(" ")
    else:
        return None
    return {"late": 0 if name["name"][0].isupper() else 1, "decl": name["decl"], "spec": spec, "text": text}


def facts(text: str) -> dict:
    """What one text declares and mentions, as a row of ``SCHEMA`` without repo and rel."""
    f = _File(text)
    imports, names = [], []
    for decl in range(1, len(f.kind)):
        if f.kind[decl] == "import":
            imports += _imports(f, decl)
        elif f.kind[decl] == "func":
            names += filter(None, [_function(f, decl)])
        else:
            names += _listed(f, decl)
    own = {n["pos"] for n in names if n["kind"] == "func"}
    called_as: dict[tuple[int, int], list[str]] = {}  # (declaration, spec) -> how others name it
    for n in names:
        called_as.setdefault((n["decl"], n["spec"]), []).append(n["name"] if n["recv"] is None else f"{n['recv']}.{n['name']}")
    bound: set[tuple[int, str]] = set()
    types: dict[tuple[int, str], str] = {}  # the first binding with a type counts; they come last first
    for i, name, kind in _bindings(f):
        bound.add((f.decl[i], name))
        if kind is not None:
            types[f.decl[i], name] = kind
    uses, called, picks, refs = set(), set(), set(), set()
    special = None
    at, words, decls, read = f.at, f.word, f.decl, f.read
    for i, tok in enumerate(f.found):
        decl = decls[i]
        if words[i] and read[decl]:
            before, n1 = at[i + 2], at[i + 4]
            mentions = () if i in own else called_as.get((decl, f.spec[i]), ())
            if before == ".":
                called.add(tok)
                base = f.tok(i - 2) if f.tok(i - 3) != "." else None
                if base is not None:
                    picks.add((base, tok))
                of = types.get((decl, base))
                fn = of[1:] if of is not None and of[0] == "@" else None
                for name in mentions:
                    refs.add((name, f"{'' if of is None or fn is not None else of}.{tok}", fn, tok))
            elif i not in own and (decl, tok) not in bound:
                uses.add(tok)
                key = n1 in (":", None) and (before in ("{", "\n") or (n1 is not None and before == "," and special != "case"))
                if not key:
                    for name in mentions:
                        refs.add((name, tok, None, None))
        elif tok in PLACE:
            special = tok
    results = {}
    for n in names:
        if n["kind"] == "func" and n["recv"] is None:
            result = _first_result(f, n)
            if result is not None:
                results[n["name"]] = max(results.get(n["name"], result), result)
    return {
        "pkg": _package(f), "imports": imports, "names": names, "uses": sorted(uses), "called": sorted(called),
        "picks": [{"pkg": p, "name": n} for p, n in sorted(picks)],
        "refs": [{"name": n, "ref": r, "fn": g, "member": m} for n, r, g, m in sorted(refs, key=repr) if g is not None or n != r],
        "results": [{"name": n, "result": r} for n, r in sorted(results.items())],
        "signatures": [s for s in map(lambda n: _signature(f, n), names) if s is not None],
    }


_TEXT, _INT = pa.string(), pa.int32()
_ARROW = pa.schema([
    ("repo", _TEXT), ("rel", _TEXT), ("pkg", _TEXT), ("imports", pa.list_(pa.struct([("ord", _INT), ("path", _TEXT), ("name", _TEXT)]))),
    ("names", pa.list_(pa.struct([("decl", _INT), ("spec", _INT), ("pos", _INT), ("kind", _TEXT), ("name", _TEXT), ("recv", _TEXT)]))),
    ("uses", pa.list_(_TEXT)), ("called", pa.list_(_TEXT)), ("picks", pa.list_(pa.struct([("pkg", _TEXT), ("name", _TEXT)]))),
    ("refs", pa.list_(pa.struct([("name", _TEXT), ("ref", _TEXT), ("fn", _TEXT), ("member", _TEXT)]))),
    ("results", pa.list_(pa.struct([("name", _TEXT), ("result", _TEXT)]))),
    ("signatures", pa.list_(pa.struct([("late", _INT), ("decl", _INT), ("spec", _INT), ("text", _TEXT)]))),
])


def _lists(found: list[dict], field: pa.Field) -> pa.Array:
    """One column of lists, built from what all its lists hold; no row is told apart by Arrow."""
    of = field.type.value_type
    each = [f[field.name] for f in found]
    flat = [v for values in each for v in values]
    if pa.types.is_struct(of):
        inner = pa.StructArray.from_arrays([pa.array([v[part.name] for v in flat], part.type) for part in of], fields=list(of))
    else:
        inner = pa.array(flat, of)
    return pa.ListArray.from_arrays(pa.array(accumulate(map(len, each), initial=0), pa.int32()), inner, type=field.type)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            found = [facts(t or "") for t in part.column("content").to_pylist()]
            plain = [part.column("repo").cast(_TEXT), part.column("rel").cast(_TEXT), pa.array([f["pkg"] for f in found], _TEXT)]
            yield pa.RecordBatch.from_arrays([*plain, *[_lists(found, field) for field in list(_ARROW)[3:]]], schema=_ARROW)


def file_facts(contents: DataFrame) -> DataFrame:
    """One row of facts per Go file, written once."""
    texts = contents.where(F.col("rel").endswith(".go")).select("repo", "rel", "content")
    return stage(texts.mapInArrow(_run, SCHEMA), "go-facts")[0]


_KEY = ["repo", "rel"]


def packages(rows: DataFrame) -> DataFrame:
    """(repo, rel, pkg): the package clause."""
    return rows.where("pkg is not null").select(*_KEY, "pkg")


def imports(rows: DataFrame) -> DataFrame:
    """(repo, rel, ord, path, name): imports in file order; name is null unless renamed."""
    return rows.select(*_KEY, F.inline("imports"))


def names(rows: DataFrame) -> DataFrame:
    """(repo, rel, decl, spec, pos, kind, name, recv) of every top-level declared name; recv for methods."""
    return rows.select(*_KEY, F.inline("names"))


def declares(rows: DataFrame) -> DataFrame:
    """(repo, rel, name, ord): package-level names a file declares."""
    return names(rows).where("recv is null and not (kind = 'func' and name in ('main', 'init'))").select(*_KEY, "name", F.col("pos").alias("ord"))


def methods(rows: DataFrame) -> DataFrame:
    """(repo, rel, recv, name): methods a file declares."""
    return names(rows).where("recv is not null").select(*_KEY, "recv", "name").distinct()


def uses(rows: DataFrame) -> DataFrame:
    """(repo, rel, name): words that can only be package-level names, here or in another file."""
    return rows.select(*_KEY, F.explode("uses").alias("name"))


def called(rows: DataFrame) -> DataFrame:
    """(repo, rel, name): every x.name, for methods."""
    return rows.select(*_KEY, F.explode("called").alias("name"))


def _local_names(each: Column) -> Column:
    """The names an import may have in its file: its own, or the likely ones of its package."""
    clean = lambda c: F.regexp_replace(F.regexp_replace(c, r"(?<=.)\..*\z", ""), r"\Ago-", "")
    parts = F.split(each["path"], "/")
    base = F.element_at(parts, -1)
    above = F.when(base.rlike(r"\Av[0-9]+\z") & (F.size(parts) > 1), clean(F.try_element_at(parts, F.lit(-2))))
    return F.when(each["name"].isNotNull(), F.array(each["name"])).otherwise(F.array_compact(F.array(clean(base), above)))


def selectors(rows: DataFrame) -> DataFrame:
    """(repo, rel, pkg, name): pkg.Name where pkg may be an imported package."""
    local = F.flatten(F.transform("imports", _local_names))
    picked = F.filter("picks", lambda p: F.array_contains(local, p["pkg"]))
    return rows.select(*_KEY, F.inline(picked))


def refs(rows: DataFrame) -> DataFrame:
    """(repo, dir, file, name, ref): what each declaration mentions.

    A method is named T.m. A reference is a plain name, ".m" for x.m, or "T.m" where x is bound to
    this package's type T in the declaration; x := newT(...) is settled by newT's first result.
    """
    rows = rows.withColumn("dir", paths.parent(F.col("rel")))
    every = rows.select("repo", "dir", F.col("rel").alias("file"), F.inline("refs"))
    results = rows.select("repo", "dir", F.inline("results")).groupBy("repo", "dir", F.col("name").alias("fn")).agg(F.max("result").alias("result"))
    made = every.where("fn is not null").join(results, ["repo", "dir", "fn"], "left").withColumn(
        "ref", F.concat(F.coalesce("result", F.lit("")), F.lit("."), "member"))
    columns = ["repo", "dir", "file", "name", "ref"]
    return every.where("fn is null").select(columns).unionByName(made.select(columns)).where("ref <> name").distinct()


def signature_symbols(rows: DataFrame) -> DataFrame:
    """(repo, rel, symbols): function and type signatures, exported ones first."""
    from ..functions.text import one_line

    lines = F.transform("signatures", lambda s: F.struct(s["late"], s["decl"], s["spec"], one_line(s["text"]).alias("text")))
    return rows.where(F.size("signatures") > 0).select(*_KEY, F.transform(F.array_sort(lines), lambda s: s["text"]).alias("symbols"))
