"""A small tree of several languages through the whole engine: scan, index, search, graph, symbols, artifacts, watching."""

import pytest

from orebody.api import Engine
from orebody.sources import files as sources
from orebody.sources.ignore import is_ignored, rules

TREE = {
    "src/index.ts": 'import { helper } from "./util/helper.js";\nimport type { Kind } from "./kinds";\n\nexport function start(user: string) {\n  return helper(user);\n}\n\nstart("x");\n',
    "src/kinds.ts": "export interface Kind {\n  name: string;\n}\n",
    "src/util/helper.ts": "export function helper(a: string) {\n  return deep(a);\n}\n\nfunction deep(a: string) {\n  return a.trim();\n}\n",
    "lib/work.py": "import os\nfrom .more import thing\n\nclass Job:\n    def __init__(self):\n        self.x = thing()\n\n    def run(self):\n        return self.x\n\ndef main():\n    return Job().run()\n",
    "lib/more.py": "def thing():\n    return 1\n",
    "lib/__init__.py": "\n",
    "go/main.go": "package main\n\nfunc main() {\n\tprintln(1)\n}\n",
    "README.md": "# Words about retries and queues\n",
    "node_modules/x/index.js": "module.exports = 1\n",
    "debug.log": "noise\n",
}


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    for name, text in TREE.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return root


def test_scan_keeps_indexed_files_only(spark, tree):
    rows = {r.relative_path: r for r in sources.indexable_files(spark, str(tree)).collect()}
    assert set(rows) == set(TREE) - {"node_modules/x/index.js", "debug.log"}
    assert rows["lib/work.py"].language == "python" and len(rows["lib/work.py"].content_hash) == 16
    graphed = {r.relative_path for r in sources.graphable_files(spark, str(tree)).collect()}
    assert "README.md" not in graphed and "go/main.go" in graphed


def test_ignore_order(spark):
    own = rules(root=["*.tmp2", "!keep.tmp2", "/only/", "a/**/z.txt"], below={"sub": ["*.gen", "!x.gen"]}, project=["secret?.txt"])
    paths = {"b/q.tmp2": True, "b/keep.tmp2": False, "only/f": True, "b/only/f": False, "a/z.txt": True, "a/b/c/z.txt": True, "sub/y.gen": True, "sub/x.gen": False, "sub/deep/y.gen": False, "secret1.txt": True, "secret12.txt": False, "vendor/a.go": True, "x/bin/Debug/a": False, "bin/Debug/a": True, "only/keep.tmp2": True}
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r.path: r.i for r in df.select("path", is_ignored(df.path, own).alias("i")).collect()}
    assert got == paths


def test_index_search_graph(spark, tree, tmp_path):
    e = Engine(spark, str(tmp_path / "store"), "p1")
    assert e.index(str(tree)) == {"added": 8}
    assert e.index(str(tree)) == {"unchanged": 8}
    first = e.search("retries queues", min_score=0.0).first()
    assert first.path == "README.md"
    assert {r.path for r in e.search("helper", language="typescript", min_score=0.0).collect()} <= {"src/index.ts", "src/kinds.ts", "src/util/helper.ts"}
    (tree / "lib/more.py").write_text("def thing():\n    return 2\n\ndef fresh():\n    return thing()\n")
    (tree / "README.md").unlink()
    assert e.index(str(tree)) == {"changed": 1, "removed": 1, "unchanged": 6}
    assert "README.md" not in {r.path for r in e.rows("chunks").collect()}

    e.graph.build(str(tree))
    edges = {(r.source, r.target) for r in e.graph.edges().collect()}
    assert edges == {("src/index.ts", "src/util/helper.ts"), ("src/index.ts", "src/kinds.ts"), ("lib/work.py", "lib/more.py")}
    assert e.graph.stats().first().edges == 3
    calls = {(r.callee_name, r.confidence) for r in e.rows("call_edges").collect()}
    assert {("helper", "unique"), ("deep", "local"), ("thing", "unique"), ("Job", "local"), ("trim", "unresolved")} <= calls
    kinds = {(r.name, r.kind) for r in e.symbols.list().collect()}
    assert {("Job", "class"), ("__init__", "constructor"), ("run", "method"), ("main", "function"), ("Kind", "interface")} <= kinds
    assert [(r.hop, r.files) for r in e.symbols.impact("lib/more.py").collect()] == [(1, ["lib/work.py"])]
    assert [(r.hop, r.files) for r in e.symbols.impact("helper").collect()] == [(1, ["src/index.ts"])]
    points = {(r.id, r.reason) for r in e.symbols.entry_points().collect()}
    assert ("lib/work.py::main#11", "name:main") in points and ("src/index.ts::<module>#1", "orphan") in points
    context = e.symbols.context("helper").collect()
    assert {r.role for r in context} == {"caller", "callee"}
    assert "graph LR" in e.graph.mermaid()
    tree_rows = e.symbols.flow("src/index.ts::start#4")
    assert [r[1].split("::")[1] for r in tree_rows] == ["start#4", "helper#1", "deep#5"]
    e.remove()
    assert not e.has("chunks")


def test_the_tree_s_own_rules_modules_and_aliases(spark, tree, tmp_path):
    """.gitignore files at all levels, the project's own ignore file, go.mod and tsconfig paths are read from the tree."""
    files = {
        ".gitignore": "gen/\n*.tmp.ts\n", "gen/x.py": "x = 1\n", "src/a.tmp.ts": "let a\n", "lib/.gitignore": "hidden.py\n", "lib/hidden.py": "y = 1\n", "lib/sub/hidden.py": "z = 1\n",
        ".orebodyignore": "private/\n", "private/p.py": "p = 1\n", "go.mod": "module example.org/app\n\ngo 1.22\n", "go/tool/tool.go": "package tool\n\nfunc Use() {\n}\n",
        "go/main.go": 'package main\n\nimport (\n\t"fmt"\n\t"example.org/app/go/tool"\n)\n\nfunc main() {\n\ttool.Use()\n\tfmt.Println(1)\n}\n',
        "tsconfig.json": '{ // comment\n "compilerOptions": {"baseUrl": ".", "paths": {"@util/*": ["src/util/*"]}} }', "src/alias.ts": 'import { helper } from "@util/helper";\nhelper("y");\n',
        "css/a.styl": "@require 'b'\n@import './b'\n", "css/b.styl": ".a\n  color red\n",
        "php/a.php": "<?php\nuse App\\Models\\{User, Post as P};\n", "src/Models/User.php": "<?php\nclass User {\n}\n", "src/Models/Post.php": "<?php\nclass Post {\n}\n",
    }
    for name, text in files.items():
        (tree / name).parent.mkdir(parents=True, exist_ok=True)
        (tree / name).write_text(text)
    found = {r.relative_path for r in sources.indexable_files(spark, str(tree)).collect()}
    assert not found & {"gen/x.py", "src/a.tmp.ts", "lib/hidden.py", "private/p.py"} and "lib/sub/hidden.py" in found
    assert "gen/x.py" in {r.relative_path for r in sources.indexable_files(spark, str(tree), use_gitignore=False).collect()}
    e = Engine(spark, str(tmp_path / "store"), "p1")
    e.graph.build(str(tree))
    edges = {(r.source, r.target) for r in e.graph.edges().collect()}
    assert {("go/main.go", "go/tool/tool.go"), ("src/alias.ts", "src/util/helper.ts"), ("php/a.php", "src/Models/User.php"), ("php/a.php", "src/Models/Post.php"), ("css/a.styl", "css/b.styl")} <= edges
    report = e.graph.report()
    assert report["languages"]["php"] == 3 and report["edges"] == len(edges) and report["cyclic_edges"] == 0
    page = e.graph.page()
    assert open(e.graph.write_page(str(tmp_path)), encoding="utf-8").read() == page
    assert "<\\u002fscript" not in page and page.count("</script>") == 2 and "go/tool/tool.go" in page
    diagram = e.graph.mermaid()
    assert "subgraph Legend" in diagram and "fill:#00ADD8" in diagram and diagram.startswith("graph LR\n    n0[")


def test_nothing_left_is_a_state_too(spark, tmp_path):
    """No import, no file, no artifact: what was stored before goes, and a graph without edges is built."""
    root = tmp_path / "tree"
    root.mkdir()
    (root / "a.py").write_text("import b\n")
    (root / "b.py").write_text("x = 1\n")
    e = Engine(spark, str(tmp_path / "store"), "p1")
    e.graph.build(str(root))
    assert e.graph.edges().count() == 1
    (root / "a.py").write_text("x = 2\n")
    e.graph.build(str(root))
    assert e.graph.edges().count() == 0 and e.graph.stats().first().orphans == 2 and e.graph.status().first().symbols == 0
    e.index(str(root))
    for f in ("a.py", "b.py"):
        (root / f).unlink()
    assert e.index(str(root)) == {"removed": 2}
    assert e.rows("chunks").count() == 0 and e.rows("file_state").count() == 0 and e.index(str(root)) == {}
    e.graph.update(str(root))
    assert e.rows("symbols").count() == 0
    e.artifacts.index({"one": str(tmp_path / "nothing.md")}) if (tmp_path / "nothing.md").exists() else None
    assert e.artifacts.index({}) == {}


def test_incremental_graph_equals_a_full_build(spark, tree, tmp_path):
    e, full = (Engine(spark, str(tmp_path / f"store{i}"), "p1") for i in range(2))
    e.graph.build(str(tree))
    steps = [
        {"lib/more.py": "def thing():\n    return other()\n\ndef other():\n    return 1\n"},
        {"src/util/deep.ts": "export function trim() {\n}\n", "src/util/helper.ts": 'import { trim } from "./deep";\nexport function helper(a: string) {\n  return trim(a);\n}\n'},
        {"src/kinds.ts": None, "lib/extra.py": "from .work import main\nmain()\n"},
        {},
    ]
    for step in steps:
        for name, text in step.items():
            (tree / name).unlink() if text is None else (tree / name).write_text(text)
        counts = e.graph.update(str(tree))
        assert bool(set(counts) - {"unchanged"}) == bool(step)
        full.graph.build(str(tree))
        for name in ("imports", "edges", "symbols", "name_refs", "calls", "call_edges"):
            a, b = (sorted(map(repr, x.rows(name).collect())) for x in (e, full))
            assert a == b, name


def test_index_in_batches_stops_and_goes_on(spark, tree, tmp_path):
    e = Engine(spark, str(tmp_path / "store"), "p1", batch_files=3)
    added = e._add

    def add_and_stop(files):
        added(files)
        e.stop()

    e._add = add_and_stop
    assert e.index(str(tree)) == {"added": 8}
    first = e.rows("file_state").count()
    assert 0 < first < 8 and e.status().first().status == "stopped"
    assert "not complete" in e.search_text("thing", min_score=0.0)
    e._add = added
    assert e.resume(str(tree)) == {"added": 8 - first, "unchanged": first}
    assert e.status().first().status == "completed" and e.rows("chunks").count() == 8
    assert e.rows("chunks").select("id").distinct().count() == 8
    with e.lock():
        other = Engine(spark, str(tmp_path / "store"), "p1")
        with pytest.raises(RuntimeError, match="another process"):
            other.index(str(tree))


def test_projects_search_together_and_one_may_fail(spark, tree, tmp_path):
    store = str(tmp_path / "store")
    for name in ("p1", "007"):
        Engine(spark, store, name).index(str(tree))
    e = Engine(spark, store, "p1")
    with pytest.warns(UserWarning, match="gone"):
        rows = e.search("helper", projects=["007", "gone"]).collect()
    assert {r.label for r in rows} == {"p1", "007"}
    assert {(r.project_id, r.files, r.chunks) for r in e.projects().collect()} == {("p1", 8, 8), ("007", 8, 8)}
    (tree / ".orebody.json").write_text('{"linked": ["../other", "lib", "."]}')
    from orebody.sources.config import linked

    assert linked(str(tree), "go, nowhere,lib") == [str(tree / "lib"), str(tree / "go")]
    text = e.search_text("helper", min_score=1.5)
    assert "Nothing for" in text and "below the threshold" in text


def test_stored_search_equals_search_over_texts(spark, tree, tmp_path):
    from orebody.operators import search

    e = Engine(spark, str(tmp_path / "store"), "p1")
    e.index(str(tree))
    many = {}
    for r in e.search_many(["helper", "thing", "retries queues"], 5).collect():
        many.setdefault(r.query, []).append((r.id, r.score))
    for i, q in enumerate(["helper", "thing", "retries queues"]):
        assert many[i] == [(r.id, r.score) for r in e.search(q, 5, min_score=0.0).collect()]
    assert [r.path for r in e.lookup("chunks", path=["lib/more.py", "lib/none.py"]).collect()] == ["lib/more.py"]
    assert "completed" in e.progress() and "100%" in e.progress()
    terms = ["return", "thing", "helper", "nowhere"]
    chunks = e.rows("chunks").select("id", "text")
    want = {r.id: r.score for r in search.bm25(chunks, "id", chunks.text, terms).collect()}
    got = {r.id: r.score for r in search.bm25_stored(e.rows("postings"), e.rows("search_stats"), terms).collect()}
    assert got == want and got


def test_models_are_asked_in_batches_and_again(spark, tmp_path):
    from orebody.operators.embed import Hashing, Model, Precomputed, context_of, query_vector

    def load():
        asked = []

        def model(texts):
            asked.append(len(texts))
            if len(texts) > 1 and any("bad" in t for t in texts):
                raise ValueError("one of them is bad")
            if "bad" in texts[0]:
                raise ValueError("this one")
            return [[float(len(t)), float(max(asked))] for t in texts]

        return model

    m = Model("nomic-embed-text:v1", load, dims=2, batch=4, first_wait=0.01, context=2)
    rows = spark.createDataFrame([(i, "bad" if i == 5 else "x" * i) for i in range(10)], "i int, text string").coalesce(1)
    got = {r.i: r.embedding for r in m.embed(rows).collect()}
    assert got[5] is None and got[9][0] == 6.0 and got[3] == [3.0, 4.0] and m.embed(rows).columns == ["i", "text", "embedding"]
    assert context_of("nomic-embed-text:latest") == 2048 and m.dims == 2
    assert len(query_vector(spark, Hashing(8), "q")) == 8
    known = Precomputed(spark.createDataFrame([("x", [1.0])], "text string, embedding array<float>"), 1)
    assert [r.embedding for r in known.embed(rows.where("i = 1")).collect()] == [[1.0]]
    with pytest.raises(ValueError):
        Model("unknown", load)


def test_texts_for_people():
    from orebody.operators.render import capped_list, embedded_json, progress_text, tree_text

    assert tree_text([(0, "a", "call"), (1, "b", "cycle")]) == "a\n  └─ b (seen above)"
    assert capped_list("X", ["a", "b", "c"], 2).splitlines() == ["X (3):", "  a", "  b", "  ... and 1 more"]
    assert embedded_json({"a": "</script>"}) == '{"a": "\\u003c/script>"}' and progress_text(1, 4, 1, 2, 3.0).startswith("25%")


def test_artifact_file(spark, tree, tmp_path):
    import json

    e = Engine(spark, str(tmp_path / "store"), "p1")
    config = tree / ".orebody-artifacts.json"
    config.write_text(json.dumps({"artifacts": [{"name": "docs", "path": "lib", "description": "the library"}, {"name": "readme", "path": "README.md", "description": "words"}]}))
    assert e.artifacts.refresh(str(tree)) == {"docs": "new", "readme": "new"}
    assert e.artifacts.search("retries", root=str(tree), min_score=0.0).first().artifact == "readme"
    (tree / "README.md").write_text("# Other words about parsers\n")
    assert e.artifacts.refresh(str(tree)) == {"docs": "fresh", "readme": "stale"}
    assert e.artifacts.search("parsers", min_score=0.0).first().artifact == "readme"
    assert {(r.artifact, r.indexed) for r in e.artifacts.list(str(tree)).collect()} == {("docs", True), ("readme", True)}
    assert e.artifacts.index({"docs": str(tree / "lib")}) == {"docs": "fresh", "readme": "removed"}
    assert {r.artifact for r in e.rows("artifact_chunks").collect()} == {"docs"}
    config.write_text(json.dumps({"artifacts": [{"name": "a", "path": " ", "description": "d"}, {"name": "A", "path": "x", "description": "d"}]}))
    with pytest.raises(ValueError, match="path.*name"):
        e.artifacts.configured(str(tree))


def test_artifacts(spark, tree, tmp_path):
    e = Engine(spark, str(tmp_path / "store"), "p1")
    e.artifacts.index({"docs": str(tree / "lib"), "code": str(tree / "src")})
    assert e.artifacts.search("thing", "docs", min_score=0.0).first().artifact == "docs"
    assert {r.artifact for r in e.rows("artifact_state").collect()} == {"docs", "code"}


def test_watch_finds_changed_and_deleted_files(spark, tree, tmp_path):
    e = Engine(spark, str(tmp_path / "store"), "p1")
    for step in range(3):
        if step == 1:
            (tree / "lib/more.py").write_text("def other():\n    return 3\n")
            (tree / "go/main.go").unlink()
        query = e.watch(str(tree), str(tmp_path / f"cp{step}"), once=True)
        query.awaitTermination(60)
        query.stop()
    files = {r.path for r in e.rows("file_state").collect()}
    assert "go/main.go" not in files and "lib/more.py" in files
    assert "other" in {r.name for r in e.symbols.list().collect()}
