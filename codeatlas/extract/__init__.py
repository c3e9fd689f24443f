"""Extraction jobs: from ``contents(repo, rel, size, content)`` to imports, declarations and facts.

Patterns run inside the JVM on whole texts. Python is used only for small per-row helpers
where nesting makes a pattern impossible.
"""
