"""Commit touches, new links and changed files as they arrive."""
