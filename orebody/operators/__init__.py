"""Relational operators: chunking, search, change detection, graphs, symbols, artifacts."""
