"""Configuration files of a tree, read by the driver: artifacts, linked projects, module and alias files."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from typing import NamedTuple

from orebody.sources.aliases import aliases
from orebody.sources.files import go_module, reader

ARTIFACTS_FILE, PROJECT_FILE = ".orebody-artifacts.json", ".orebody.json"


class Artifact(NamedTuple):
    name: str
    path: str
    description: str


def artifact_problems(entries: list) -> list[str]:
    """What is wrong with the entries of an artifact file: every text must be there, and names differ in more than case."""
    found, names = [], {}
    for i, entry in enumerate(entries):
        if not isinstance(entry, dict):
            found.append(f"artifacts[{i}] is no object")
            continue
        found += [f"artifacts[{i}].{k} must be a text that is not empty" for k in Artifact._fields if not isinstance(entry.get(k), str) or not entry[k].strip()]
        key = str(entry.get("name", "")).strip().lower()
        if key in names and key:
            found.append(f"artifacts[{i}].name is that of artifacts[{names[key]}]")
        names.setdefault(key, i)
    return found


def artifacts(root: str, fallback: str | None = None) -> list[Artifact]:
    """The artifacts that a tree's file names, or the one in the fallback folder; none if there is no file. Relative paths
    are taken from the folder of the file."""
    for folder in filter(None, (root, fallback)):
        text = reader(folder)(ARTIFACTS_FILE)
        if text is None:
            continue
        try:
            entries = json.loads(text).get("artifacts", [])
        except (ValueError, AttributeError) as e:
            raise ValueError(f"{ARTIFACTS_FILE} is not readable: {e}") from e
        wrong = artifact_problems(entries) if isinstance(entries, list) else ["artifacts must be a list"]
        if wrong:
            raise ValueError("; ".join(wrong))
        at = lambda p: p if "://" in p or os.path.isabs(p) else f"{folder.rstrip('/')}/{p}"
        return [Artifact(e["name"].strip(), at(e["path"].strip()), e["description"].strip()) for e in entries]
    return []


def linked(root: str, listed: str | None = None, project_of: Callable[[str], str] | None = None) -> list[str]:
    """Folders of linked projects: those of the tree's project file, then those of a comma-separated list. Itself and what does
    not exist are left out, and so are repeats, by folder or by project."""
    from pyarrow.fs import FileType

    from orebody.sources.files import opened

    text = reader(root)(PROJECT_FILE)
    try:
        named = json.loads(text).get("linked", []) if text else []
    except (ValueError, AttributeError):
        named = []
    named = [x for x in named if isinstance(x, str)] if isinstance(named, list) else []
    out, seen = [], {project_of(root)} if project_of else set()
    for path in [*named, *(listed or "").split(",")]:
        if not path.strip():
            continue
        full = path.strip() if "://" in path else os.path.normpath(os.path.join(root, path.strip()))
        files, at = opened(full)
        if full == os.path.normpath(root) or full in out or files.get_file_info(at).type != FileType.Directory:
            continue
        if project_of:
            if (own := project_of(full)) in seen:
                continue
            seen.add(own)
        out.append(full)
    return out


def module_rules(root: str) -> tuple[str | None, list[tuple[str, bool, int, str]]]:
    """The Go module of the tree and the path aliases of its tsconfig (or jsconfig) file; broken files count as absent."""
    read = reader(root)
    mod = read("go.mod")
    for name in ("tsconfig.json", "jsconfig.json"):
        try:
            if found := aliases(read, name):
                return mod and go_module(mod), found
        except (ValueError, AttributeError):
            continue
    return mod and go_module(mod), []
