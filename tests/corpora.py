"""Small invented repositories and the links they must give: {name: ({path: text}, {path: targets})}."""

FERRY_ALIASES = {
    "tsconfig.json": '{"extends": "./config/paths.json"}',
    "config/paths.json": '{\n  // from the root\n  "compilerOptions": {"baseUrl": "..", "paths": {"~/*": ["sources/*"], "metrics": ["sources/metrics/main.ts"],},},\n}',
    "pages/home.ts": "import { plot } from '~/charts/plot';\nexport { gauge } from \"metrics\";\nimport fs from 'fs';\n",
    "sources/charts/plot.ts": "export const plot = 0;\n", "sources/metrics/main.ts": "export const gauge = 0;\n",
}
ORCHARD_PACKAGES = {
    "modules/core/package.json": '{"name": "@orchard/core", "exports": {".": {"import": "./main.ts"}, "./seeds/*": "./seeds/*.ts"}}',
    "modules/core/main.ts": "", "modules/core/seeds/apple.ts": "",
    "modules/tools/package.json": '{"name": "@orchard/tools", "main": "entry.js"}', "modules/tools/entry.js": "",
    "shop/till.ts": "import core from '@orchard/core';\nconst t = require(\"@orchard/tools\");\nimport('@orchard/core/seeds/apple');\n",
}
MILL_HASHES = {
    "package.json": '{"imports": {"#store": "./lib/store.ts", "#parts/*": "./lib/parts/*.ts"}}',
    "lib/store.ts": "", "lib/parts/gear.ts": "", "bin/start.ts": "import '#store';\nimport { g } from '#parts/gear';\nimport '#nothing';\n",
}
LOOM_FILES = {
    "one/start.js": "import './left.js';\nimport '../two';\nimport './gone.css';\n", "one/left.ts": "", "two/index.js": "", "two/unused.js": "",
}
FERRY_PYTHON = {
    "service/pyproject.toml": '[project]\nname = "ferry"\n', "service/ferry/__init__.py": "", "service/ferry/route.py": "",
    "service/ferry/timetable.py": "from ferry import route\nimport json\n", "tools/dump.py": "import layout\n", "tools/layout.py": "",
}
_LEVELS = ["deep", "deep/a", "deep/a/b", "deep/a/b/c", "deep/a/b/c/d", "deep/a/b/c/d/e"]
_GATE = "deep/a/b/c/d/e/gate.py"
DEEP_PYTHON = {
    "pyproject.toml": '[project]\nname = "deep"\n', "use.py": "from deep import Gate\n", _GATE: "class Gate: ...\n",
    **{f"{at}/__init__.py": f"from .{(below.rsplit('/', 1)[1] if below else 'gate')} import Gate\n" for at, below in zip(_LEVELS, [*_LEVELS[1:], None])},
}
LANTERN_RUST = {
    "Cargo.toml": '[package]\nname = "lantern"\n', "src/lib.rs": "pub mod wick;\nmod glass;\n", "src/wick.rs": "use crate::glass::Pane;\n",
    "src/glass/mod.rs": "mod tint;\npub struct Pane;\n", "src/glass/tint.rs": "use super::Pane;\npub(crate) fn shade(of: u8) -> u8 { of }\nfn own() {}\n",
}
TIDE_JVM = {
    "src/main/java/org/tide/Pier.java": "package org.tide;\nimport org.tide.boats.Tug;\nimport java.util.List;\npublic class Pier {}\n",
    "src/main/java/org/tide/boats/Tug.java": "package org.tide.boats;\npublic record Tug() {}\n",
    "kotlin/org/tide/Dock.kt": "package org.tide\nimport org.tide.boats.Tug\nfun dock() {}\n",
}
HARBOR_GO = {
    "go.mod": "module tide.test/harbor\n", "chart/plot.go": "package chart\nfunc Plot() {}\n", "chart/scale.go": "package chart\ntype Scale int\n",
    "north.go": 'package harbor\nimport "tide.test/harbor/chart"\nfunc n() { chart.Plot() }\n',
    "alias.go": 'package harbor\nimport c "tide.test/harbor/chart"\nvar size c.Scale\n',
    "side.go": 'package harbor\nimport _ "tide.test/harbor/chart"\n',
    "every.go": 'package harbor\nimport . "tide.test/harbor/chart"\nfunc e() { Plot() }\n',
    "made.go": 'package harbor\nimport "tide.test/harbor/chart"\nfunc m() { chart.Built() }\n',
}
_CHART = ["chart/plot.go", "chart/scale.go"]
SEA_MODULES = {
    "go.mod": "module sea.test/app\n", "main.go": 'package main\nimport ("sea.test/app/tools/k"; "sea.test/plug/wave")\nfunc main() { k.Run(); wave.Roll() }\n',
    "tools/k/k.go": "package k\nfunc Run() {}\n", "third_party/t/go.mod": "module sea.test/app/tools\n", "third_party/t/k/k.go": "package k\nfunc Run() {}\n",
    "plugins/go.mod": "module sea.test/plug\n", "plugins/wave/w.go": "package wave\nfunc Roll() {}\n", "plugins/wave/x.go": "package wave\nfunc Rest() {}\n",
}
BOAT_METHODS = {
    "go.mod": "module boat.test/b\n", "boat.go": "package b\ntype Boat struct{}\n", "steer.go": "package b\nfunc (x *Boat) Steer() {}\n",
    "use.go": "package b\nfunc Sail(x *Boat) { x.Steer() }\n", "shadow.go": "package b\nfunc idle(Steer int) int { return Steer }\n",
}
RELAY = {
    "go.mod": "module re.test/lay\n",
    "spark/spark.go": "package spark\n\nfunc Light() int { return 1 }\n\ntype Idle struct{}\n",
    "wire/wire.go": 'package wire\n\nimport "re.test/lay/spark"\n\nfunc Carry(n int) int { return n * spark.Light() }\n',
    "wire/wire_test.go": 'package wire\n\nimport "testing"\n\nfunc TestCarry(t *testing.T) { Carry(2) }\n',
    "bulb/bulb.go": 'package bulb\n\nimport "re.test/lay/wire"\n\nfunc Glow() int { return wire.Carry(3) }\n',
    "ui/a.ts": "export const a = 2;\n", "ui/b.ts": "import { a } from './a.js';\nexport const b = a;\n",
}

EXPECTED = {
    "ferry_aliases": (FERRY_ALIASES, {"pages/home.ts": ["sources/charts/plot.ts", "sources/metrics/main.ts"]}),
    "orchard": (ORCHARD_PACKAGES, {"shop/till.ts": ["modules/core/main.ts", "modules/core/seeds/apple.ts", "modules/tools/entry.js"]}),
    "mill": (MILL_HASHES, {"bin/start.ts": ["lib/parts/gear.ts", "lib/store.ts"]}),
    "loom": (LOOM_FILES, {"one/start.js": ["one/left.ts", "two/index.js"]}),
    "ferry": (FERRY_PYTHON, {
        "service/ferry/timetable.py": ["service/ferry/__init__.py", "service/ferry/route.py"], "tools/dump.py": ["tools/layout.py"]}),
    "deep": (DEEP_PYTHON, {
        "use.py": ["deep/__init__.py", _GATE], f"{_LEVELS[-1]}/__init__.py": [_GATE],
        **{f"{a}/__init__.py": sorted([f"{b}/__init__.py", _GATE]) for a, b in zip(_LEVELS, _LEVELS[1:])}}),
    "lantern": (LANTERN_RUST, {
        "src/lib.rs": ["src/glass/mod.rs", "src/wick.rs"], "src/wick.rs": ["src/glass/mod.rs"], "src/glass/mod.rs": ["src/glass/tint.rs"],
        "src/glass/tint.rs": ["src/glass/mod.rs"]}),
    "tide": (TIDE_JVM, {p: ["src/main/java/org/tide/boats/Tug.java"] for p in ("src/main/java/org/tide/Pier.java", "kotlin/org/tide/Dock.kt")}),
    "harbor": (HARBOR_GO, {"north.go": _CHART[:1], "alias.go": _CHART[1:], "side.go": _CHART, "every.go": _CHART, "made.go": _CHART}),
    "sea": (SEA_MODULES, {"main.go": ["plugins/wave/w.go", "tools/k/k.go"]}),
    "boat": (BOAT_METHODS, {"steer.go": ["boat.go"], "use.go": ["boat.go", "steer.go"]}),
    "relay": (RELAY, {"wire/wire.go": ["spark/spark.go"], "wire/wire_test.go": ["wire/wire.go"], "bulb/bulb.go": ["wire/wire.go"], "ui/b.ts": ["ui/a.ts"]}),
}


def contents(spark, corpora: dict[str, dict[str, str]]):
    """(repo, rel, size, content) of the given repositories."""
    rows = [(repo, rel, len(text.encode()), text) for repo, files in corpora.items() for rel, text in files.items()]
    return spark.createDataFrame(rows, "repo string, rel string, size bigint, content string")
