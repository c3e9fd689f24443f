"""Table operators over files, edges, commit touches and diffs."""
