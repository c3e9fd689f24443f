"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust a score.

All of it is native expressions on the row: no shuffle, no user functions. A pattern's matches and the
pieces between them (``regexp_extract_all`` and ``split``) give the places of the matches as running
lengths in code points; the split runs only where something matched. Patterns use look-behind and
possessive repeats, which match what the plain forms match but stay linear and don't recurse.

Kinds: ``email``, ``ip``, ``card`` (14 to 19 digits passing Luhn), ``phone`` (international), which always
stay; ``iban`` (mod-97), and ``local_phone``, a national number that only a nearby word such as "tel" makes
personal data. Scores add a bonus for a context word within ``CONTEXT`` code points before the span.

Cost is linear in the text, but for running sums over the matches, which go through blocks of the square root of their number: no
match looks at the text again from its beginning.

Defined cases: a null or empty text has no spans; repeated rows are judged each for itself; working columns
carry a ``_p_`` prefix and all columns of the input stay.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTEXT = 40
ACCEPT = 0.5


@dataclass(frozen=True)
class Kind:
    """``quick`` is a cheap test of the text, ``valid`` one of a match ``m``; ``near`` a pattern of context words."""

    name: str
    pattern: str
    quick: str
    valid: str
    score: float
    near: str
    base: bool = True


def luhn(digits: str) -> str:
    """SQL: does the digit string pass the Luhn check?"""
    d = f"cast(substring({digits}, length({digits}) - i, 1) as int)"
    twice = f"{d} * 2 - case when {d} > 4 then 9 else 0 end"
    return f"aggregate(sequence(0, length({digits}) - 1), 0, (n, i) -> n + case when i % 2 = 1 then {twice} else {d} end) % 10 = 0"


def mod97(code: str) -> str:
    """SQL: does the account code, first four characters moved behind and letters as 10 to 35, leave 1 mod 97?"""
    turned = f"concat(substring({code}, 5), substring({code}, 1, 4))"
    step = "case when c >= 'A' then (n * 100 + ascii(c) - 55) % 97 else (n * 10 + ascii(c) - 48) % 97 end"
    return f"aggregate(filter(split({turned}, ''), c -> c <> ''), 0, (n, c) -> {step}) = 1"


_DIGITS = r"regexp_replace(m, '[^0-9]', '')"
_CODE = r"replace(m, ' ', '')"

KINDS = (
    Kind(
        "email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "contains(text, '@')", "true", 0.9, r"(?i)\b(?:e-?mail|contact|courriel|correo)\b",
    ),
    Kind(
        "ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
        "contains(text, '.')",
        r"forall(split(m, '[.]'), p -> length(ltrim('0', p)) < 4 and cast(concat('0', substring(ltrim('0', p), 1, 3)) as int) <= 255)",
        0.6, r"(?i)\b(?:ip|host|server|address)\b",
    ),
    Kind(
        "card", r"[0-9](?:[\x20-]?[0-9]){13,}+",
        "true", f"length({_DIGITS}) between 14 and 19 and {luhn(_DIGITS)}", 0.7, r"(?i)\b(?:card|visa|credit|carte|karte|tarjeta)\b",
    ),
    Kind(
        "phone", r"\+[0-9][\x20().0-9-]+[0-9]",
        "contains(text, '+')", f"length({_DIGITS}) between 10 and 15", 0.7, r"(?i)\b(?:tel|phone|call|mobile|fax)\b",
    ),
    Kind(
        "iban", r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b",
        "true", f"length({_CODE}) between 15 and 34 and {mod97(_CODE)}", 0.8, r"(?i)\b(?:iban|account|konto|compte|cuenta)\b", False,
    ),
    Kind(
        "local_phone", r"(?<![0-9+(])\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
        "true", "true", 0.3, r"(?i)\b(?:tel|phone|call|mobile|fax|numéro|telefon|teléfono)\b", False,
    ),
)


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", "''") + "'"


#: Matches whose texts, with what stands between them, hold CONTEXT code points at least: none has under four.
_REACH = CONTEXT // 4


def _scanned(rows: DataFrame, column: str, step: str, out: str) -> DataFrame:
    """``out``: the running values of an array column of numbers, by ``step`` of ``{a}`` and ``{b}``; null where the array is empty.

    Blocks of the square root of the length are run through one by one, then moved on by what came before them.
    """
    def run(values: str, first: str) -> str:
        moved = step.format(a="s.at", b="x")
        return (
            f"aggregate({values}, named_struct('at', {first}, 'out', cast(array() as array<int>)), (s, x) -> named_struct('at', {moved},"
            f" 'out', concat(s.out, array({moved}))), s -> s.out)"
        )

    size = f"cast(ceil(sqrt(size({column}))) as int)"
    parts = f"transform(sequence(0, (size({column}) - 1) div {size}), c -> slice({column}, cast(c * {size} + 1 as int), {size}))"
    rows = rows.withColumn(f"{out}_b", F.expr(f"case when size({column}) > 0 then transform({parts}, p -> {run('p', '0')}) end"))
    before = run(f"transform({out}_b, p -> element_at(p, -1))", "0")
    rows = rows.withColumn(f"{out}_o", F.expr(f"case when size({out}_b) > 0 then concat(array(0), {before}) end"))
    moved = step.format(a="o", b="x")
    return rows.withColumn(out, F.expr(
        f"case when size({out}_b) > 0 then flatten(zip_with({out}_b, slice({out}_o, 1, size({out}_b)), (p, o) -> transform(p, x -> {moved}))) end"
    )).drop(f"{out}_b", f"{out}_o")


def _places(kind: Kind) -> str:
    """SQL: the valid matches of ``_p_hit`` as (start, stop, score), by start, from the running lengths ``_p_end``."""
    hit, tail, end = f"_p_hit_{kind.name}", f"_p_tail_{kind.name}", f"_p_end_{kind.name}"
    found = f"transform({hit}, (h, i) -> struct({end}[i] - length(h) as start, {end}[i] as stop, h as m, i as i))"
    # The code points before a match: ends of the gaps before it and the matches between them.
    first = f"greatest(x.i - {_REACH}, 0)"
    before = f"right(array_join(transform(sequence({first}, x.i), j -> concat(case when j > {first} then {hit}[j - 1] else '' end, {tail}[j])), ''), {CONTEXT})"
    score = f"case when {before} rlike {_quoted(kind.near)} then 0.3D else 0D end + {kind.score}D"
    some = f"transform(filter({found}, x -> {kind.valid.replace('m,', 'x.m,')}), x -> struct(x.start as start, x.stop as stop, least({score}, 1D) as score))"
    kept = f"filter({some}, x -> x.score >= {ACCEPT}D)" if not kind.base else some
    # The second mention of the tails keeps them a column of their own, not an expression inside the loop.
    return f"case when size({hit}) > 0 and size({tail}) > 0 then {kept} else cast(array() as array<struct<start: int, stop: int, score: double>>) end"


def spans(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, name: str = "pii") -> DataFrame:
    """``docs`` with an array of (start, rank, kind, stop, score), by start and then the order of ``kinds``.

    A column that has the array's name is replaced.
    """
    docs = docs.drop(name)
    own = {c: f"_p_in_{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()], F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumns({
        f"_p_hit_{k.name}": F.expr(
            f"case when {k.quick} then regexp_extract_all(text, {_quoted(k.pattern)}, 0) else cast(array() as array<string>) end"
        ) for k in kinds
    })
    rows = rows.withColumns({
        f"_p_gap_{k.name}": F.expr(f"case when size(_p_hit_{k.name}) > 0 then split(text, {_quoted(k.pattern)}, -1) end") for k in kinds
    })
    rows = rows.withColumns({
        f"_p_len_{k.name}": F.expr(f"case when size(_p_hit_{k.name}) > 0 then transform(_p_hit_{k.name}, (h, i) -> length(_p_gap_{k.name}[i]) + length(h)) end") for k in kinds
    } | {f"_p_tail_{k.name}": F.expr(f"transform(_p_gap_{k.name}, g -> right(g, {CONTEXT}))") for k in kinds})
    for k in kinds:
        rows = _scanned(rows, f"_p_len_{k.name}", "{a} + {b}", f"_p_end_{k.name}")
    rows = rows.withColumns({f"_p_{k.name}": F.expr(_places(k)) for k in kinds})
    tagged = [
        f"transform(_p_{k.name}, x -> struct(x.start as start, {rank} as rank, '{k.name}' as kind, x.stop as stop, x.score as score))"
        for rank, k in enumerate(kinds)
    ]
    return rows.withColumn("_p_all", F.expr(f"sort_array(concat({', '.join(tagged)}))")).select(
        *[F.col(n).alias(c) for c, n in own.items()], F.col("_p_all").alias(name)
    )


def joined(column: str, base: tuple[str, ...] | None = None) -> str:
    """SQL: ``kind:start:end`` of the spans, comma-joined; only kinds in ``base`` where given."""
    only = f"filter({column}, x -> x.kind in ({', '.join(repr(k) for k in base)}))" if base else column
    return f"array_join(transform({only}, x -> concat_ws(':', x.kind, x.start, x.stop)), ',')"


#: Code points of the pieces a text is cut into, so that a place in it is found without walking there.
PIECE = 1024


def _between(begin: str, end: str) -> str:
    """SQL: the text from one place to another, from its pieces ``_p_piece``."""
    a, b = f"({begin}) div {PIECE}", f"({end}) div {PIECE}"
    piece = lambda at: f"coalesce(get(_p_piece, cast({at} as int)), '')"
    return (
        f"case when {a} = {b} then substring({piece(a)}, cast(({begin}) % {PIECE} + 1 as int), cast(({end}) - ({begin}) as int))"
        f" else concat(substring({piece(a)}, cast(({begin}) % {PIECE} + 1 as int)), array_join(slice(_p_piece, cast({a} + 2 as int), cast({b} - {a} - 1 as int)), ''),"
        f" substring({piece(b)}, 1, cast(({end}) % {PIECE} as int))) end"
    )


def redact(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans become one. Null texts stay null."""
    rows = spans(docs, kinds, "_p_spans").withColumns({
        "_p_stops": F.expr("transform(_p_spans, x -> x.stop)"),
        "_p_piece": F.expr(f"case when size(_p_spans) > 0 then regexp_extract_all(text, '(?s).{{1,{PIECE}}}', 0) end"),
    })
    rows = _scanned(rows, "_p_stops", "greatest({a}, {b})", "_p_upto")
    # A span that begins where all before it have ended heads a group; the others only make a group longer.
    heads = "filter(transform(_p_spans, (x, i) -> struct(x.start as start, case when i = 0 then 0 else _p_upto[i - 1] end as gone, upper(x.kind) as kind)), x -> x.start >= x.gone)"
    rows = rows.withColumn("_p_heads", F.expr(f"case when size(_p_upto) > 0 then {heads} end"))
    labelled = f"array_join(transform(_p_heads, x -> concat({_between('x.gone', 'x.start')}, '[', x.kind, ']')), '')"
    last = "element_at(_p_upto, -1)"
    text = f"concat({labelled}, {_between(last, 'length(text)')})"
    out = rows.withColumn("text", F.expr(f"case when size(_p_spans) > 0 and size(_p_piece) > 0 then {text} else text end"))
    return out.select(*[f"`{c}`" for c in docs.columns])
