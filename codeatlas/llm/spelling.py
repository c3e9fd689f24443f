"""Spelling variants: words one edit apart, found by walking all words through a trie at once.

The trie is a table of edges (node, first character, label, child), chains without a branch drawn together into one label. A
frontier of states (word, position, node, edits) starts at the root with every word; each level joins it with the edges of
that level. A state without an edit follows its own word, and may spend the edit where its word and the trie part:
another character for the next one, or one character more. A state whose edit is spent must follow exactly. One that ends at a word
with an edit spent is a neighbour. Words with a character less are the same pairs seen from the other side.

Two strings one edit apart agree on a half of each, so two tries are walked, one of the words and one of the words read
backwards, and edits are tried only from the middle on. This keeps the frontier to a few states a word: near the root, where
every word would try every letter, nothing branches.

Levels are the branches on a path, not characters, so long words don't lengthen the loop; a node's number costs the
square of a word's length. Nodes with over a thousandth of all words below them are under a thousand a level, and are met by broadcast; all others by
a shuffle. Every level is written to the shared folder. Nothing is capped.

All other joins are told to shuffle: Spark sizes what an explode makes by the bytes before it, so it would broadcast every prefix of every word.

Nulls: a null text has no words, a null ``doc_id`` counts as empty text. Repeated rows count as often as they occur. Ties of the form go to the least word in code-point
order. Other columns of the documents aren't read. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stage
from .common import HOT_SHARE

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fewest code points and occurrences of a word, and how many times as frequent its form must be.
LENGTH, OCCURS, TIMES = 6, 5, 5
#: One run in so many loses a letter, as a writer's slip would take it.
SLIP = 199


def occurrences(docs: DataFrame, length: int = LENGTH, slip: int | None = SLIP) -> DataFrame:
    """(word) once for every occurrence in ``docs(doc_id, text)`` with at least ``length`` code points after slips."""
    runs = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(rf"[a-zÀ-ÿ]{{{length},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    if slip is None:
        return rows.select(F.col("run").alias("word"))
    rows = rows.select("run", F.expr("crc32(cast(concat(id, ':', run) as binary))").alias("h"))
    slipped = F.expr("concat(left(run, cast(h % length(run) as int)), substring(run, cast(h % length(run) as int) + 2))")
    return rows.select(F.when(F.col("h") % slip == 0, slipped).otherwise(F.col("run")).alias("word")).where(F.length("word") >= length)


def vocabulary(words: DataFrame, occurs: int = OCCURS) -> DataFrame:
    """(word, n) of the words that occur at least ``occurs`` times."""
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= occurs)


def _shuffled(df: DataFrame) -> DataFrame:
    """A side whose join is never a broadcast, whatever Spark takes its size for."""
    return df.hint("merge")


def trie(words: DataFrame, total: int) -> DataFrame:
    """Edges of the tries of ``words(word, n)``, forward (side 0) and backward (side 1), by level; written.

    ``target`` is the word that ends at the child, ``next`` the first characters of the child's edges; ``hot`` and ``child_hot`` say
    whether more than 1/HOT_SHARE of the words are below.
    """
    sides = words.select(
        "word", "n", F.expr("explode(array(named_struct('side', 0, 'text', word), named_struct('side', 1, 'text', reverse(word)))) as s")
    ).select("word", "n", "s.side", "s.text")
    steps = F.expr(
        "transform(sequence(0, length(text)), i -> named_struct('d', i, 'node', xxhash64(side, left(text, i)), 'ch', substring(text, i + 1, 1)))"
    )
    prefixes = sides.select("side", "word", "n", "text", F.explode(steps).alias("p")).select("side", "word", "n", "text", "p.*")
    kept = (
        prefixes.groupBy("node").agg(F.min("ch").alias("low"), F.max("ch").alias("high"), F.min("d").alias("d"), F.count(F.lit(1)).alias("below"))
        .where("d = 0 or low = '' or low <> high").select("node", (F.col("below") * HOT_SHARE > total).alias("hot"))
    )
    paths = (
        prefixes.join(_shuffled(kept), "node").groupBy("side", "text", "word", "n")
        .agg(F.array_sort(F.collect_list(F.struct("d", "node", "hot"))).alias("path"))  # as long as the word at most
    )
    hops = F.expr(
        "transform(sequence(0, size(path) - 2), i -> named_struct('level', i, 'node', path[i].node, 'hot', path[i].hot, 'child', path[i + 1].node,"
        " 'child_hot', path[i + 1].hot, 'label', substring(text, path[i].d + 1, path[i + 1].d - path[i].d), 'last', i = size(path) - 2))"
    )
    edges = (
        paths.select("word", "n", F.explode(hops).alias("h")).select("word", "n", "h.*")
        .groupBy("level", "node", "hot", "child", "child_hot", "label")
        .agg(F.max(F.when(F.col("last"), F.struct("word", "n"))).alias("target"))
        .withColumn("ch", F.left("label", F.lit(1)))
    )
    edges, _ = stage(edges, "trie")
    after = edges.groupBy(F.col("node").alias("child")).agg(F.array_join(F.collect_set("ch"), "").alias("next"))
    return stage(edges.join(_shuffled(after), "child", "left"), "edges")[0]


def _met(states: DataFrame, edges: DataFrame, on: list[str]) -> DataFrame:
    """States and the edges of their nodes: hot nodes, fewer than HOT_SHARE a level, by broadcast, others by a shuffle."""
    part = lambda hot: (states.where(F.col("hot") == hot).drop("hot"), edges.where(F.col("hot") == hot).drop("hot"))
    (hot, hot_edges), (cold, cold_edges) = part(True), part(False)
    return hot.join(F.broadcast(hot_edges), on).unionByName(cold.join(_shuffled(cold_edges), on))


_REST = "substring(text, pos + 1)"
_PARTED = f"array_position(zip_with(split(left({_REST}, length(label)), ''), split(label, ''), (a, b) -> a <=> b), false) - 1"


def _step(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """The states one level on, and the neighbours found (``other`` isn't null)."""
    edges = edges.drop("level")
    here = frontier.withColumn("ch", F.expr("substring(text, pos + 1, 1)"))
    follow = _met(here.where("ch <> ''"), edges, ["node", "ch"]).withColumn("same", F.lit(True))
    branch = _met(
        here.where("edits = 0 and pos >= half").withColumnRenamed("ch", "own"), edges, ["node"]
    ).where("ch <> own").drop("own").withColumn("same", F.lit(False))
    tried = follow.unionByName(branch).withColumn("exact", F.expr(f"same and startswith({_REST}, label)")).withColumn(
        "c", F.expr(f"case when exact or edits = 1 then -1 when same then {_PARTED} else 0 end")
    )
    moves = F.expr(f"""filter(array(
        case when exact then named_struct('pos', pos + length(label), 'edits', edits) end,
        case when c >= 0 and pos + c >= half and pos + c < length(text) and startswith(substring(text, pos + c + 2), substring(label, c + 2))
             then named_struct('pos', pos + length(label), 'edits', 1) end,
        case when c >= 0 and pos + c >= half and startswith(substring(text, pos + c + 1), substring(label, c + 2))
             then named_struct('pos', pos + length(label) - 1, 'edits', 1) end), m -> m is not null)""")
    moved = tried.withColumn("m", F.explode(moves)).select(
        "text", "word", "n", "half", F.col("m.pos").alias("pos"), F.col("child").alias("node"), F.col("m.edits").alias("edits"),
        F.col("child_hot").alias("hot"), "target", "next",
    )
    found = F.expr("case when edits = 1 and pos = length(text) then target end")
    alive = "next is not null and case when edits = 1 then pos < length(text) and instr(next, substring(text, pos + 1, 1)) > 0 else true end"
    return moved.withColumn("target", found).withColumn("alive", F.expr(alive)).where("target is not null or alive")


def neighbours(words: DataFrame) -> DataFrame:
    """(word, other, other_n): every ordered pair of ``words(word, n)`` that is one edit apart, once."""
    words, seen = stage(words.select("word", "n"), "words")
    edges = trie(words, seen["rows"])
    depth = (edges.agg(F.max("level")).first()[0] if seen["rows"] else None)
    frontier = words.select(
        F.expr("explode(array(named_struct('side', 0, 'text', word), named_struct('side', 1, 'text', reverse(word)))) as s"), "word", "n"
    ).select(
        "s.text", "word", "n", F.expr("cast(floor(length(word) / 2) as int) as half"), F.lit(0).alias("pos"),
        F.expr("xxhash64(s.side, '') as node"), F.lit(0).alias("edits"), F.lit(True).alias("hot"),
    )
    pairs = None
    for level in range(0 if depth is None else depth + 1):
        reached, _ = stage(_step(frontier, edges.where(F.col("level") == level)), "frontier")
        got = reached.where("target is not null").select("word", "n", F.col("target.word").alias("other"), F.col("target.n").alias("other_n"))
        pairs = got if pairs is None else pairs.unionByName(got)
        frontier = reached.where("alive").drop("target", "next", "alive")
    if pairs is None:
        return words.select("word", F.col("word").alias("other"), F.col("n").alias("other_n")).limit(0)
    back = pairs.where("length(other) > length(word)").select(F.col("other").alias("word"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    # Node numbers are 64-bit hashes: a pair met through two nodes of one number isn't one.
    return pairs.select("word", "other", "other_n").unionByName(back).distinct().where("levenshtein(word, other, 1) = 1")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms(word, form)``: follow forms to the last, the way doubled in every round."""
    ways, _ = stage(forms.select("word", F.col("form").alias("root")), "ways")
    while True:
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        longer = ways.join(_shuffled(on), "root", "left").select("word", F.coalesce("_further", "root").alias("root"), F.col("_further").isNotNull().alias("moved"))
        longer, seen = stage(longer, "ways", moved=F.coalesce(F.sum(F.col("moved").cast("int")), F.lit(0)))
        ways = longer.drop("moved")
        if not seen["moved"]:
            return ways


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of ``words(word, n)``: the form is the most frequent neighbour, if ``times`` as frequent."""
    words, _ = stage(words.select("word", "n"), "vocabulary")
    near = neighbours(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best")
    )
    form = words.join(_shuffled(near), "word", "left").withColumn("frequent", -F.col("best.less") >= times * F.col("n")).select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("frequent"), F.col("best.other")).alias("form"),
        F.when(F.col("frequent"), -F.col("best.less")).alias("form_n"),
    )
    form, _ = stage(form, "forms")
    return form.join(_shuffled(roots(form.where("form is not null").select("word", "form"))), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
