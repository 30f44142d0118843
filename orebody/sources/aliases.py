"""Path aliases of tsconfig and jsconfig files, as rows for a small broadcast join."""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Callable

STRING_OR_COMMENT = re.compile(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?\*/', re.S)


def without_comments(text: str) -> str:
    """JSON without line and block comments; those inside strings stay. Trailing commas go too."""
    plain = STRING_OR_COMMENT.sub(lambda m: m[0] if m[0][0] == '"' else "", text)
    return re.sub(r",(\s*[}\]])", r"\1", plain)


def aliases(read: Callable[[str], str | None], path: str = "tsconfig.json", most: int = 10) -> list[tuple[str, bool, int, str]]:
    """(prefix, wildcard, order, target) of the config at path; `extends` is followed up to `most` files, never twice.

    read gives a file's text, or None. The nearest config that has paths decides.
    """
    seen: set[str] = set()
    while path not in seen and len(seen) < most:
        seen.add(path)
        text = read(path)
        if text is None:
            return []
        config = json.loads(without_comments(text))
        options = config.get("compilerOptions", {})
        folder = posixpath.dirname(path)
        if options.get("paths"):
            base = posixpath.normpath(posixpath.join(folder, options.get("baseUrl", ".")))
            rows = []
            for pattern, targets in options["paths"].items():
                wild = pattern.endswith("*")
                for target in targets:
                    rows.append((pattern[:-1] if wild else pattern, wild, len(rows), posixpath.normpath(posixpath.join(base, target[:-1] if wild and target.endswith("*") else target))))
            return rows
        parent = config.get("extends")
        if not isinstance(parent, str) or not parent.startswith("."):
            return []
        path = posixpath.normpath(posixpath.join(folder, parent if parent.endswith(".json") else parent + ".json"))
    return []
