"""Column functions: text, statistics, scoring."""
