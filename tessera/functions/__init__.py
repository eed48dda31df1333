"""Column functions: text, paths, scores."""
