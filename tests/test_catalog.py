"""Every registered query with SQL against DuckDB on the smallest tables, and plain checks of scalar functions and rules."""

import duckdb
import pytest
from pyspark.sql import functions as F

from orebody import catalog
from orebody.functions import scalars as S

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(rows, columns):
    one = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(one(r[c]) for c in columns) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, sf, db, name):
    got = catalog.queries()[name](spark, sf)
    found = db.sql(catalog.oracle_sql()[name])
    assert sorted(got.columns) == sorted(found.columns)
    want = [dict(zip(found.columns, r)) for r in found.fetchall()]
    assert plain([r.asDict() for r in got.collect()], sorted(got.columns)) == plain(want, sorted(got.columns))


def test_scalars(spark):
    one = lambda c, **v: spark.createDataFrame([tuple(v.values())], list(v)).select(c.alias("x")).first().x
    assert one(S.extension(F.col("p")), p="a/.env") == "" and one(S.extension(F.col("p")), p="a/B.R") == ".r"
    assert one(S.language(F.col("p")), p="x/y.KTS") == "kotlin" and one(S.language(F.col("p")), p="n.txt") == "plaintext"
    assert one(S.branch_name(F.col("p")), p="feature/a--b!") == "feature_a_b"
    assert one(S.callee_name(F.col("p")), p="a.b.run(x)") == "run" and one(S.callee_name(F.col("p")), p="(f)(x)") is None
    assert one(S.symbol_file(F.col("p")), p="f.py::a#1") == "f.py" and one(S.symbol_file(F.col("p")), p="::a") is None
    assert one(S.name_shard(F.col("p")), p="Zed") == "z" and one(S.name_shard(F.col("p")), p="_x") == "_"
    assert one(S.html_escaped(F.col("p")), p="<a&'\">") == "&lt;a&amp;&#39;&quot;&gt;"
    assert S.extensions_of(" .TPL, hbs,,") == [".tpl", ".hbs"] and S.merged_extensions("a", ".a,b") == [".a", ".b"]
    assert [S.clamped(v, 1, 50, 10) for v in (None, 0, float("nan"), -3, 99, 7)] == [10, 10, 10, 1, 50, 7]


def test_aliases():
    from orebody.sources.aliases import aliases, without_comments

    files = {"tsconfig.json": '{ // c\n "extends": "./base.json", "x": "http://y", }', "base.json": '{"compilerOptions": {"baseUrl": ".", "paths": {"$lib/*": ["src/lib/*", "alt/*"], "cfg": ["src/cfg.ts"]}}}'}
    assert aliases(files.get) == [("$lib/", True, 0, "src/lib"), ("$lib/", True, 1, "alt"), ("cfg", False, 2, "src/cfg.ts")]
    assert aliases({"tsconfig.json": '{"extends": "./tsconfig.json"}'}.get) == [] and "http://y" in without_comments(files["tsconfig.json"])


def test_resolution_rules(spark):
    from orebody.operators.resolve import resolved_imports

    cases = [
        ("a/m.ts", "typescript", "./x.js", "a/x.ts"), ("a/m.ts", "typescript", "../lib", "lib/index.ts"), ("a/m.ts", "typescript", "$l/u", "src/l/u.ts"), ("a/m.ts", "typescript", "react", None),
        ("s/m.scss", "scss", "./vars", "s/_vars.scss"), ("p/q/m.py", "python", "..w", "p/w.py"), ("p/q/m.py", "python", "pk.sub", "src/pk/sub/__init__.py"), ("p/q/m.py", "python", "os.path", None),
        ("m.go", "go", "ex.org/app/db", "db/a.go"), ("m.go", "go", "fmt", None), ("A.java", "java", "org.b.C", "src/main/java/org/b/C.java"), ("A.java", "java", "org.b.*", None),
        ("c/a.c", "c", "h/x.h", "c/h/x.h"), ("r/a.rb", "ruby", "./b", "r/b.rb"), ("a.php", "php", "App\\\\Kit\\\\T", "app/Kit/T.php"), ("s/l.rs", "rust", "deep", "s/deep/mod.rs"), ("s/l.rs", "rust", "std::io", None),
        ("b/x.sh", "shell", "./y.sh", "b/y.sh"), ("d/m.dart", "dart", "n.dart", "d/n.dart"), ("z.lua", "lua", "k.v", "k/v.lua"),
    ]
    cases = [(a, b, c.replace("\\\\", "\\"), d) for a, b, c, d in cases]
    rows = [(p, lang, i, spec, False, False) for i, (p, lang, spec, _) in enumerate(cases)]
    imports = spark.createDataFrame(rows, "path string, language string, ord int, specifier string, dynamic boolean, style boolean")
    files = spark.createDataFrame([(t,) for t in sorted({c[3] for c in cases if c[3]})], "path string")
    go = spark.createDataFrame([("db", "db/a.go")], "folder string, path string")
    got = {r.import_ord: r.target for r in resolved_imports(imports, files, "ex.org/app", go, aliases=[("$l/", True, 0, "src/l")]).collect()}
    assert {i: got.get(i) for i in range(len(cases))} == {i: c[3] for i, c in enumerate(cases)}


def test_stored_imports_are_not_sent_to_the_driver(spark):
    """Spark takes them for as small as their compressed file; their probes are many times that."""
    from orebody.operators.resolve import resolved_imports
    from orebody.sources.store import cut

    rows = [("a/m.ts", "typescript", "./x", "a/x.ts"), ("m.go", "go", "ex.org/app/db", "db/a.go"), ("a.cs", "csharp", "App.B", "cs/b.cs"), ("A.java", "java", "org.b.C", "k/src/main/java/org/b/C.java")]
    imports = cut(spark.createDataFrame([(p, lang, 0, spec, False, False) for p, lang, spec, _ in rows], "path string, language string, ord int, specifier string, dynamic boolean, style boolean"))
    stored = lambda data, schema: cut(spark.createDataFrame(data, schema))
    go, spaces, classes = stored([("db", "db/a.go")], "folder string, path string"), stored([("App.B", "cs/b.cs")], "namespace string, path string"), stored([("org/b/C.java", rows[3][3])], "suffix string, path string")
    found = resolved_imports(imports, stored([("a/x.ts",)], "path string"), "ex.org/app", go, spaces, classes)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.source, r.target) for r in found.collect()} == {(r[0], r[3]) for r in rows}
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_extraction_by_language():
    from orebody.operators.extract import python_imports, symbols_of

    def names(text, language):
        return {(s.name, s.kind, s.line, s.end) for s in symbols_of(text, language)[0][1:]}

    assert names("func (s *T) Run() {\n}\nfunc main() {\n\tgo()\n}\n", "go") == {("Run", "method", 1, 2), ("main", "function", 3, 5)}
    assert names("class A {\n  A() {\n  }\n  int f(int x) {\n    return g(x);\n  }\n}\n", "java") >= {("A", "class", 1, 7), ("f", "method", 4, 6)}
    assert names("@Entity(name = \"x\") public class A {\n  @Override public int f(int x) {\n    return 1;\n  }\n}\n", "java") == {("A", "class", 1, 5), ("f", "method", 2, 4)}
    assert names("[Serializable] public class B\n{\n  [Test(1)] public int G(int x)\n  {\n    return 1;\n  }\n}\n", "csharp") == {("B", "class", 1, 7), ("G", "method", 3, 6)}
    assert names("module M\n  class K\n    def go!\n    end\n  end\nend\n", "ruby") == {("M", "class", 1, 6), ("K", "class", 2, 5), ("go!", "method", 3, 4)}
    assert names("local function a()\nend\nfunction T:b()\n  a()\nend\n", "lua") == {("a", "function", 1, 2), ("b", "method", 3, 5)}
    assert names("fn a() {\n  b!(\"}\");\n}\n", "rust") == {("a", "function", 1, 3)}
    calls = symbols_of("// no()\nconst s = 'x()';\na.b(c());\nif (d) {}\n", "typescript")[1]
    assert [(c.name, c.line) for c in calls] == [("b", 3), ("c", 3)]
    assert symbols_of("def broken(:\n", "python")[0][0].name == "<module>" and python_imports("import a, b.c as d\nfrom . import e\n") == ["a", "b.c", "."]


def test_regions():
    from orebody.operators.chunking import region_ranges, windows_of

    assert region_ranges([], 10) == [(0, 10)] and windows_of(0, 250) == [(0, 100), (90, 190), (180, 250)]
    assert region_ranges([(2, 20), (30, 33), (40, 80)], 90) == [(0, 2), (2, 33), (33, 80), (80, 90)]


def test_flow_tree_marks_what_was_seen(spark):
    from orebody.operators.symbols import flow_tree

    rows = [("a", 1, "1", ["b"]), ("a", 2, "2", ["c"]), ("b", 1, "3", ["d"]), ("c", 1, "4", ["d"])]
    calls = spark.createDataFrame(rows, "caller_id string, line int, call_id string, candidates array<string>")
    assert flow_tree(calls, "a") == [(0, "a", "call"), (1, "b", "call"), (2, "d", "call"), (1, "c", "call"), (2, "d", "cycle")]


def test_table_functions_give_what_the_operators_give(spark):
    from pyspark.sql import functions as F

    from orebody.functions.registry import register
    from orebody.operators.extract import extracted, imports_of, symbol_rows
    from orebody.plans.code_queries import TEMPLATES

    rows = [(path.replace("{i}", "1"), lang, text.replace("{i}", "1").replace("{a}", "2")) for lang, path, text in TEMPLATES]
    files = spark.createDataFrame(rows, "path string, language string, content string")
    files.createOrReplaceTempView("sources")
    assert {"imports_in", "symbols_in", "chunk_lines", "content_hash"} <= set(register(spark))
    got = spark.sql("SELECT path, i.* FROM sources, LATERAL imports_in(language, content) i").collect()
    want = imports_of(files).select("path", "ord", "specifier", "dynamic").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    got = spark.sql("SELECT path, s.name, s.kind, s.line, s.end_line FROM sources, LATERAL symbols_in(language, content) s").collect()
    want = symbol_rows(extracted(files)).select(F.col("file"), "name", "kind", "line", "end_line").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert imports_of(files, {"go"}).where("language <> 'go'").isEmpty() and imports_of(files.where("language = 'go'"), {"go"}).count() == 2


def test_files_are_read_and_parsed_once_to_be_chunked(spark, sf):
    from orebody import catalog

    plan = catalog.queries()["chunk_regions"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and "Join" not in plan


def test_chunks_of_every_strategy(spark):
    from pyspark.sql import functions as F

    from orebody.operators.chunking import chunks, region_ranges
    from orebody.operators.extract import python_regions, regions_of, symbols_of, top_regions

    nested = "import a\nif a:\n    def f():\n        def g(): pass\n    class C:\n        def m(self): pass\nelse:\n    try:\n        @a\n        def h(): pass\n    finally:\n        async def i(): pass\nmatch a:\n    case 1:\n        def j(): pass\n"
    assert python_regions(nested) == top_regions(symbols_of(nested, "python")[0]) != []
    code = nested + "x = 1\n" * 120 + "def last():\n    pass\n" + "\f\n" * 3
    rows = [("r.py", "python", code), ("b.py", "python", "def broken(:\n" * 120), ("s", "text", "a\nb"), ("m", "text", "word " * 900), ("l", "text", "y\n" * 250), ("e", "text", ""), ("n", "text", None)]
    files = spark.createDataFrame(rows, "path string, language string, content string")
    got = {}
    for r in chunks(files.withColumn("regions", regions_of(F.col("language"), F.col("content")))).orderBy("path", "start_line").collect():
        got.setdefault(r.path, []).append((r.start_line, r.end_line, r.chunk, r.language))
    lines = code.split("\n")
    want = [(s + 1, e, "\n".join(lines[s:e])) for s, e in region_ranges(python_regions(code), len(lines))]
    assert [x[:3] for x in got["r.py"]] == [x for x in want if x[2].strip()] != want
    assert [x[:2] for x in got["l"]] == [x[:2] for x in got["b.py"]][:1] + [(91, 190), (181, 251)] and [x[:2] for x in got["b.py"]] == [(1, 100), (91, 121)]
    assert got["s"] == [(1, 2, "a\nb", "text")] and "".join(x[2] for x in got["m"]) == "word " * 900 and got["e"] == [(1, 1, "", "text")]
