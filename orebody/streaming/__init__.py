"""Structured Streaming: watching a tree, debouncing its changes, incremental indexing."""
