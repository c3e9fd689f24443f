"""Column functions: paths, globs, labels, sizes and text."""
