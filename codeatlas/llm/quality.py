"""Quality rules: a table of thresholds compiled into native projections, without user functions.

Every measure is row-local, so the job is one scan and no shuffle. Repeated passages are found by
hashing each window of eight words and sorting the hashes inside the row, only where a document
holds a hash twice. Windows are compared by 64-bit hashes of 64-bit word hashes.

Defined cases: a null or empty text has no words and is rejected; repeated rows are judged each
for itself; a rule over an undefined ratio (no words, no lines) isn't broken by it. Working columns
carry a ``_q_`` prefix, and all columns of the input stay.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8

# Frequent function words of English, French, German and Spanish; they count as written here or
# with a capital, so a text all in capitals has none.
STOP_WORDS = """
the of and to in that is for it with as was on are be by this from or have an but not
de la le les des et en un une du que qui dans pour sur par au avec est pas
der die und das den von zu mit sich dem ist nicht ein eine auf für im
el los las y por con para una del se lo como más su al es
""".split()


@dataclass(frozen=True)
class Rule:
    """``name`` is broken where ``measure`` (an SQL expression over the measures) leaves [low, high]."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None

    def broken(self) -> str:
        sides = [f"{self.measure} < {self.low}"] * (self.low is not None) + [f"{self.measure} > {self.high}"] * (self.high is not None)
        return f"coalesce({' or '.join(sides)}, false)"


RULES = (
    Rule("words", "n_words", 20),
    Rule("repeated_words", "100.0 * n_repeat_words / nullif(n_words, 0)", None, 30),
    Rule("word_length", "1.0 * word_chars / nullif(n_words, 0)", 2, 15),
    Rule("symbols", "1.0 * n_symbols / nullif(n_words, 0)", None, 0.25),
    Rule("stop_words", "1.0 * n_stop_words / nullif(n_words, 0)", 0.02, None),
    Rule("repeated_lines", "1.0 * n_dup_lines / nullif(n_lines, 0)", None, 0.5),
)
# The contract of ``base_failed``; a text has no upper bound.
BASE = "n_words < 20 or 100 * n_repeat_words > 30 * n_words"


def measures(docs: DataFrame) -> DataFrame:
    """``docs`` with the measures the rules speak of, all long."""
    text = F.coalesce(F.col("text"), F.lit(""))
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys([*STOP_WORDS, *[w.capitalize() for w in STOP_WORDS]]))
    out = docs.withColumns({
        "_q_words": F.array_remove(F.split(text, SPACE), ""),
        "_q_lines": F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
        "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
    })
    out = out.withColumns({
        "n_words": F.size("_q_words").cast("long"),
        "n_lines": F.size("_q_lines").cast("long"),
        "n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
        "word_chars": F.length(F.array_join("_q_words", "")).cast("long"),
        "n_stop_words": F.expr(f"cast(size(filter(_q_words, w -> w in ({stop}))) as bigint)"),
        "_q_hash": F.transform("_q_words", lambda w: F.xxhash64(w)),
    })
    for k in (1, 2, 4):  # each step doubles how many words a hash stands for
        out = out.withColumn("_q_hash", F.expr(f"transform(_q_hash, (h, i) -> xxhash64(h, get(_q_hash, i + {k})))"))
    out = out.withColumn("_q_win", F.expr(f"slice(_q_hash, 1, greatest(cast(n_words as int) - {WINDOW - 1}, 0))"))
    out = out.withColumn("_q_sorted", F.expr(
        "case when size(array_distinct(_q_win)) < size(_q_win)"
        " then sort_array(transform(_q_win, (h, i) -> struct(h as h, i as i)))"
        " else cast(array() as array<struct<h: bigint, i: int>>) end"
    ))
    out = out.withColumn("_q_at", F.expr(
        "sort_array(transform(filter(_q_sorted, (e, j) -> coalesce(e.h = get(_q_sorted, j - 1).h, false)"
        " or coalesce(e.h = get(_q_sorted, j + 1).h, false)), e -> e.i))"
    ))
    covered = f"transform(_q_at, (p, j) -> least({WINDOW}, coalesce(get(_q_at, j + 1) - p, {WINDOW})))"
    out = out.withColumn("n_repeat_words", F.expr(f"aggregate({covered}, 0L, (n, k) -> n + k)"))
    return out.drop("_q_words", "_q_lines", "_q_hash", "_q_win", "_q_sorted", "_q_at")


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measures, ``base_failed``, ``kept`` and the names of the broken rules."""
    broken = {r.name: f"case when {r.broken()} then '{r.name}' end" for r in rules}
    return (
        measures(docs)
        .withColumns({"base_failed": F.expr(BASE), "broken": F.expr(f"array_compact(array({', '.join(broken.values())}))")})
        .withColumn("kept", F.size("broken") == 0)
    )


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that break no rule, as they came."""
    names = {c: f"_q_in_{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], F.col("text"))
    # The row number keeps the optimizer from moving the test below the projections, which would write every measure out
    # again wherever it is used.
    marked = judged(renamed, rules).withColumn("_q_row", F.monotonically_increasing_id())
    return marked.where("kept and _q_row >= 0").select(*[F.col(n).alias(c) for c, n in names.items()])
