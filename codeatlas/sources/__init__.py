"""Where tables come from (folders, version-control exports, rule files) and where reports go."""
