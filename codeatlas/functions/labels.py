"""What a path says about a file: language, test, entry point, config, ecosystem."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import paths

# The results depend on exactly these names.
LANGUAGE_BY_EXT = {
    ".go": "Go", ".py": "Python", ".js": "JavaScript", ".jsx": "JavaScript", ".mjs": "JavaScript",
    ".cjs": "JavaScript", ".ts": "TypeScript", ".tsx": "TypeScript", ".mts": "TypeScript",
    ".cts": "TypeScript", ".css": "CSS", ".scss": "SCSS", ".md": "Markdown", ".json": "JSON",
    ".yaml": "YAML", ".yml": "YAML", ".html": "HTML", ".java": "Java", ".c": "C", ".h": "C Header",
    ".cpp": "C++", ".rs": "Rust", ".rb": "Ruby", ".php": "PHP", ".sh": "Shell", ".sql": "SQL",
    ".kt": "Kotlin", ".kts": "Kotlin", ".swift": "Swift", ".cs": "C#", ".toml": "TOML", ".vue": "Vue",
    ".svelte": "Svelte", ".dart": "Dart", ".ex": "Elixir", ".exs": "Elixir", ".scala": "Scala",
    ".lua": "Lua", ".zig": "Zig", ".tf": "Terraform", ".proto": "Protocol Buffers",
}
LANGUAGE_BY_NAME = {
    "Makefile": "Makefile", "Dockerfile": "Dockerfile", "Justfile": "Justfile", "Gemfile": "Ruby",
    "Rakefile": "Ruby", "go.mod": "Go modules", "go.sum": "Go modules",
}
SOURCE_EXTS = {
    "go": [".go"],
    "js": [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts"],
    "py": [".py"], "rs": [".rs"], "java": [".java"], "kt": [".kt"],
}
TEST_DIRS = ["test", "tests", "__tests__"]
SKIPPED_DIRS = ["testdata", "examples", "example", "fixtures", "vendor", "third_party"]
LOW_VALUE_DIRS = [
    "test", "tests", "testdata", "__tests__", "examples", "example", "_examples", "tutorial",
    "tutorials", "samples", "script", "scripts", "docs_src", "fixtures", "vendor", "third_party",
]
ENTRY_NAMES = [
    "main.go", "main.py", "__main__.py", "app.py", "manage.py", "main.rs", "lib.rs", "index.js",
    "index.ts", "index.tsx", "main.js", "main.ts", "main.tsx", "server.js", "server.ts", "app.js",
    "app.ts", "Main.java", "Program.cs", "main.c", "main.cpp", "main.swift", "main.kt",
]
CONFIG_NAMES = [
    "Dockerfile", "Makefile", "Justfile", "Procfile", "docker-compose.yml", "docker-compose.yaml",
    "compose.yml", "compose.yaml", ".env.example", "tsconfig.json", "vercel.json", "netlify.toml",
    "fly.toml", ".goreleaser.yaml", ".goreleaser.yml", "turbo.json", "pnpm-workspace.yaml", "go.work",
]
README_NAMES = ["readme.md", "readme", "readme.rst", "readme.txt"]
ECOSYSTEMS = [  # manifest, language, package manager; in reporting order
    ("go.mod", "Go", "go modules"), ("package.json", "JavaScript/TypeScript", "npm"),
    ("pyproject.toml", "Python", "pip/poetry/uv"), ("requirements.txt", "Python", "pip"),
    ("Cargo.toml", "Rust", "cargo"), ("pom.xml", "Java", "maven"),
    ("build.gradle", "Java/Kotlin", "gradle"), ("build.gradle.kts", "Kotlin", "gradle"),
    ("Gemfile", "Ruby", "bundler"), ("composer.json", "PHP", "composer"),
    ("Package.swift", "Swift", "swiftpm"), ("mix.exs", "Elixir", "mix"),
    ("deno.json", "TypeScript", "deno"),
]
DEFAULT_IGNORES = [
    "node_modules", "dist", "build", ".cache", "__pycache__", ".venv", "venv", ".idea", ".vscode",
    "target", "obj", "coverage", ".next", ".nuxt", ".pytest_cache", ".mypy_cache", ".DS_Store",
    "*.egg-info",
]


def lookup(key: Column, table: dict[str, str]) -> Column:
    """The value of ``key`` in a fixed table, else null."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def language(path: Column) -> Column:
    """Display label of a file's language; null for plain dotfiles and names without extension."""
    name = paths.base(path)
    e = F.lower(paths.ext(path))
    return F.coalesce(
        lookup(name, LANGUAGE_BY_NAME),
        F.when((e == "") | (e == name), F.lit(None)).otherwise(
            F.coalesce(lookup(e, LANGUAGE_BY_EXT), F.upper(F.substring(e, F.lit(2), F.length(e))))
        ),
    )


def is_known_language(label: Column) -> Column:
    return label.isin(*sorted(set(LANGUAGE_BY_EXT.values())))


def source_lang(path: Column) -> Column:
    """The analyzer for a file (go, js, py, rs, java, kt), or null."""
    return lookup(F.lower(paths.ext(path)), {e: k for k, exts in SOURCE_EXTS.items() for e in exts})


def is_test(path: Column) -> Column:
    """Test file by each language's naming convention; Go counts only ``_test.go``."""
    name = paths.base(path)
    return F.when(name.endswith(".go"), name.endswith("_test.go")).otherwise(
        name.contains(".test.") | name.contains(".spec.") | name.startswith("test_")
        | name.endswith("_test.py") | paths.in_folder(path, TEST_DIRS)
    )


def is_runnable_test(path: Column, test: Column | None = None) -> Column:
    """A test one runs, not a helper beside tests: in Python only test_* and *_test.py."""
    name = paths.base(path)
    test = is_test(path) if test is None else test
    return test & F.when(name.endswith(".py"), name.startswith("test_") | name.endswith("_test.py")).otherwise(True)


def is_low_value(path: Column) -> Column:
    """Below tests, samples, scripts, fixtures or vendored code."""
    return paths.in_folder(path, LOW_VALUE_DIRS)


def is_entry_point(path: Column) -> Column:
    return paths.base(path).isin(*ENTRY_NAMES) & (paths.depth(path) <= 3) & ~is_low_value(path)


def is_config(path: Column) -> Column:
    name = paths.base(path)
    named = name.isin(*CONFIG_NAMES, ".gitlab-ci.yml") | path.startswith(".github/workflows/")
    return ~is_entry_point(path) & (named | (name.contains(".config.") & (paths.depth(path) <= 1)))


def readme_rank(path: Column) -> Column:
    """0-3 for a root README by the known names in any case, else null."""
    ranks = F.create_map(*[F.lit(x) for i, n in enumerate(README_NAMES) for x in (n, i)])
    return F.try_element_at(ranks, F.lower(path))


def is_exported_name(name: Column) -> Column:
    return name.rlike(r"^\p{Lu}")
