"""Refreshing a corpus gives what a rebuild gives, and streams give what batches give."""

import uuid

import pytest

from pyspark.sql import functions as F

from codeatlas.operators import rules
from codeatlas.resolve import graph as code_graph
from codeatlas.sources.corpus import select_sources
from codeatlas.storage import scratch_root
from codeatlas.streaming import incremental
from codeatlas.streaming.rules import violation_feed

from .corpora import contents

OLD = {
    "still": {"a.ts": "import './b';\n", "b.ts": "", "c.ts": "import './d';\n"},
    "edited": {"a.ts": "import './b';\n", "b.ts": "", "c.ts": ""},
    "moved": {"a.ts": "import './x';\n", "x/index.ts": "", "b.ts": "import './x/index';\n"},
}
NEW = {
    "still": OLD["still"],
    "edited": {"a.ts": "import './b'; import './c';\n", "b.ts": "", "c.ts": ""},
    "moved": {"a.ts": "import './x';\n", "x.ts": "", "b.ts": "import './x/index';\n"},  # x.ts takes a's import over
}


def test_refresh_equals_rebuild(spark):
    old, new = contents(spark, OLD), contents(spark, NEW)
    stamped = lambda df: df.select("repo", "rel", "size", F.lit(0).alias("mtime"))
    before, after = code_graph.build(old), code_graph.build(new)
    changed = incremental.changes(stamped(old), stamped(new))
    assert sorted((r.repo, r.rel, r.change) for r in changed.collect()) == [
        ("edited", "a.ts", "modified"), ("moved", "x.ts", "added"), ("moved", "x/index.ts", "removed")]
    assert [r.repo for r in incremental.repos_to_resolve(changed).collect()] == ["moved"]
    specs, links = incremental.update(before.specs, before.links, changed, new, select_sources(new.select("repo", "rel")), new.select("repo", "rel"))
    rows = lambda df, *c: sorted(tuple(r[x] for x in c) for r in df.collect())
    assert rows(specs, "repo", "src", "spec") == rows(after.specs, "repo", "src", "spec")
    assert rows(links, "repo", "src", "target") == rows(after.links, "repo", "src", "target")


SHIP = {
    "go.mod": "module ship.test/s\n", "hull/plank.go": "package hull\nfunc Plank() int { return nail() }\n", "hull/nail.go": "package hull\nfunc nail() int { return 1 }\ntype Keel struct{}\n",
    "hull/keel.go": "package hull\nfunc (k *Keel) Lay() {}\n", "hull/lay.go": "package hull\nfunc all(k *Keel) { k.Lay() }\n",
    "deck/deck.go": "package deck\nimport \"ship.test/s/hull\"\nfunc D() int { return hull.Plank() }\n",
    "side/side.go": "package side\nimport _ \"ship.test/s/hull\"\n", "far/far.go": "package far\nfunc F() {}\n", "far/use.go": "package far\nfunc g() { F() }\n",
}
EDITS = {
    "body only": ({"hull/plank.go": "package hull\nfunc Plank() int { return 2 }\n"}, {"hull/plank.go"}),
    "name moves": ({"hull/nail.go": "package hull\ntype Keel struct{}\n", "hull/keel.go": "package hull\nfunc (k *Keel) Lay() {}\nfunc nail() int { return 1 }\n"},
                   {"hull/nail.go", "hull/keel.go", "hull/plank.go"}),
    "name goes": ({"hull/plank.go": "package hull\nfunc Board() int { return nail() }\n"}, {"hull/plank.go", "deck/deck.go"}),
    "method moves": ({"hull/keel.go": "package hull\n", "hull/plank.go": "package hull\nfunc Plank() int { return nail() }\nfunc (k *Keel) Lay() {}\n"},
                     {"hull/keel.go", "hull/plank.go", "hull/lay.go"}),
    "file comes": ({"hull/mast.go": "package hull\nfunc Mast() {}\n"}, {"hull/mast.go", "deck/deck.go", "side/side.go"}),
    "file goes": ({"hull/lay.go": None}, {"hull/lay.go", "deck/deck.go", "side/side.go"}),
    "clause changes": ({"far/far.go": "package near\nfunc F() {}\n"}, {"far/far.go", "far/use.go"}),
    "module moves": ({"go.mod": "module ship.test/t\n"}, {r for r in SHIP if r.endswith(".go")}),
}


@pytest.mark.parametrize("edit", EDITS)
def test_go_refresh_equals_rebuild(spark, edit):
    texts, expected = EDITS[edit]
    new_files = {k: v for k, v in {**SHIP, **texts}.items() if v is not None}
    old, new = contents(spark, {"s": SHIP, "other": SHIP}), contents(spark, {"s": new_files, "other": SHIP})
    # Texts of one size differ too: the time tells.
    stamped = lambda df: df.select("repo", "rel", "size", F.hash("content").alias("mtime"))
    before, after = code_graph.build(old), code_graph.build(new)
    changed = incremental.changes(stamped(old), stamped(new))
    facts, edges, again = incremental.update_go(before.go.facts, before.edges, before.files, changed, new, after.files, old)
    rows = lambda df, *c: sorted(tuple(r[x] for x in c) for r in df.collect())
    assert rows(edges, "repo", "src", "dst") == rows(after.edges, "repo", "src", "dst")
    assert sorted(map(repr, facts.collect())) == sorted(map(repr, after.go.facts.collect()))
    assert {(r.repo, r.src) for r in again.collect()} == {("s", r) for r in expected}


def test_violation_feed(spark):
    at = f"{scratch_root(spark)}/feed-{uuid.uuid4().hex[:8]}"
    parsed = rules.parse_rules("web/ -> db/\n")
    links = spark.createDataFrame(
        [("r", "web/a.ts", "db/x.ts"), ("r", "web/a.test.ts", "db/x.ts"), ("r", "api/a.ts", "db/x.ts")], "repo string, from string, to string")
    links.write.parquet(at + "/in")
    stream = spark.readStream.schema(links.schema).parquet(at + "/in")
    violation_feed(stream, parsed, at + "/out", at + "/checkpoint").trigger(availableNow=True).start().awaitTermination()
    assert [(r["from"], r.rule) for r in spark.read.parquet(at + "/out").collect()] == [("web/a.ts", "web/ -> db/")]
