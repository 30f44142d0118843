"""Ignore rules: patterns in the syntax of .gitignore, compiled to ordered regular expressions; the last match decides."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is ignored by default.
DEFAULT = (
    "node_modules", ".git", ".svn", ".hg", "dist", "build", "out", ".next", ".nuxt", "__pycache__", "*.pyc", ".venv", "venv",
    "env", ".tox", "target", "bin/Debug", "bin/Release", "obj", ".gradle", ".idea", ".vscode", ".vs", "*.min.js",
    "*.min.css", "*.map", "*.lock", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock", "Gemfile.lock",
    "poetry.lock", "*.log", "*.tmp", "*.swp", "*.swo", ".DS_Store", "Thumbs.db", "coverage", ".nyc_output", ".cache",
    ".parcel-cache", ".turbo", "vendor",
)


def regex_of(pattern: str) -> tuple[bool, str] | None:
    """(whether it ignores, regular expression over a path; a folder's ends with a slash), or None for blanks and comments."""
    p = pattern.rstrip("\n\r")
    p = p.rstrip() if not p.endswith("\\ ") else p
    if not p or p.startswith("#"):
        return None
    ignores = not p.startswith("!")
    p = p if ignores else p[1:]
    only_dir = p.endswith("/")
    p = p.rstrip("/")
    anchored = "/" in p
    out, i = "", 0
    p = p.lstrip("/")
    while i < len(p):
        c = p[i]
        if p.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and "]" in p[i + 2 :]:
            end = p.index("]", i + 2)
            body = p[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] == "!" else body).replace("\\", "\\\\") + "]", end + 1
        elif c == "\\" and i + 1 < len(p):
            out, i = out + re.escape(p[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return ignores, ("^" if anchored else "^(?:.*/)?") + out + ("/$" if only_dir else "/?$")


def nested(patterns: list[str], folder: str) -> list[str]:
    """A folder's own patterns as seen from the root: prefixed literally with the folder, negation kept."""
    out = []
    for p in patterns:
        if p.strip() and not p.startswith("#"):
            negated, rest = p.startswith("!"), p.lstrip("!")
            out.append(f"{'!' if negated else ''}{folder}/{rest.lstrip('/')}")
    return out


def rules(root: list[str] = (), below: dict[str, list[str]] | None = None, project: list[str] = (), use_gitignore: bool = True) -> list[str]:
    """All patterns in order: defaults, the root's .gitignore, those of folders, the project's own file."""
    git = [*root, *(p for folder, own in sorted((below or {}).items()) for p in nested(own, folder))] if use_gitignore else []
    return [*DEFAULT, *git, *project]


def last_match(path: Column, patterns: list[str]) -> Column:
    """Whether the last pattern that matches ignores. Successive rules of one kind are one expression."""
    groups: list[tuple[bool, list[str]]] = []
    for found in filter(None, map(regex_of, patterns)):
        if groups and groups[-1][0] == found[0]:
            groups[-1][1].append(found[1])
        else:
            groups.append((found[0], [found[1]]))
    result = F.lit(False)
    for ignores, regexes in groups:
        result = F.when(path.rlike("|".join(f"(?:{r})" for r in regexes)), F.lit(ignores)).otherwise(result)
    return result


def is_ignored(path: Column, patterns: list[str]) -> Column:
    """Whether the patterns ignore the path or a folder above it; what lies in an ignored folder cannot be taken back."""
    parts = F.split(path, "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.when(i == F.size(parts), path).otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/"))))
    return F.exists(folders, lambda p: last_match(p, patterns))


def prunable(patterns: list[str]) -> tuple[str, ...]:
    """Patterns that are plain names, so that folders of that name need not be entered, unless a rule takes the folder back."""
    back = [p[1:].rstrip("/").rsplit("/", 1)[-1] for p in patterns if p.startswith("!")]
    taken = [re.compile(regex_of(x)[1]) for x in back if x]
    return tuple(p for p in patterns if not set(p) & set("*?[/\\#!") and not any(t.match(p) for t in taken))
