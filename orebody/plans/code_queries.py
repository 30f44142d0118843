"""Extraction and resolution over source files made from documents: document i becomes a file of language i mod 18 that names
document a, the next of its language. What each template must give is written down by hand in tables that the SQL expands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orebody.operators import chunking, extract, resolve, symbols as sym
from orebody.plans.relations import table
from orebody.sources import files as sources

Q: dict = {}
SQL: dict[str, str] = {}

#: language, path, text; {i} is the document's number, {a} that of the file it names.
TEMPLATES = (
    ("python", "py/m{i}.py", "import os, pkg.m{a}\nfrom .m{a} import x\n# import nothing\n\nclass C{i}:\n    def run(self):\n        return f{i}(1)\n\ndef f{i}(x):\n    return C{a}(x)\n"),
    ("javascript", "js/m{i}.js", "import x from './m{a}.js';\nconst y = require('./m{a}');\nexport * from './m{a}';\nimport('./m{a}.js');\n// import z from './no'\nfunction f{i}(x) {\n  return g{a}(x);\n}\nclass C{i} {\n  run() {\n    return f{i}(2);\n  }\n}\n"),
    ("typescript", "ts/m{i}.ts", "import type { T } from './m{a}';\nimport { u } from '@app/m{a}';\nexport interface I{i} {\n  n: number;\n}\nexport const f{i} = async (x: number) => {\n  return g{a}(x);\n};\n"),
    ("go", "go/p{i}/m.go", "package p{i}\n\nimport (\n\t\"fmt\"\n\t\"example.org/app/go/p{a}\"\n)\n\nfunc F{i}(x int) int {\n\treturn p{a}.F{a}(x)\n}\n\nfunc (t *T) Run() {\n\tfmt.Println(1)\n}\n"),
    ("rust", "rs/m{i}.rs", "use std::fs;\nmod m{a};\n\npub fn f{i}(x: u8) -> u8 {\n    println!(\"{}\", x);\n    m{a}::f{a}(x)\n}\n"),
    ("java", "src/main/java/org/a/C{i}.java", "package org.a;\n\nimport java.util.List;\nimport org.a.C{a};\nimport static org.a.C{a}.go;\n\npublic class C{i} {\n  public C{i}(int x) {\n  }\n  public int run(int x) {\n    return go(x);\n  }\n}\n"),
    ("kotlin", "src/main/kotlin/org/b/K{i}.kt", "package org.b\n\nimport org.b.K{a}\n\nclass K{i} {\n  fun run(x: Int): Int {\n    return make(x)\n  }\n}\n\nfun top{i}() {\n  run(1)\n}\n"),
    ("scala", "src/main/scala/org/c/S{i}.scala", "package org.c\n\nimport org.c.S{a}\n\nobject S{i} {\n  def run(x: Int): Int = {\n    make(x)\n  }\n}\n"),
    ("csharp", "cs/N{i}.cs", "using System;\nusing App.N{a};\nusing Alias = App.Other;\nnamespace App.N{i}\n{\n  public class C{i}\n  {\n    public int Run(int x)\n    {\n      return Make(x);\n    }\n  }\n}\n"),
    ("ruby", "rb/m{i}.rb", "require 'json'\nrequire_relative './m{a}'\n\nclass R{i}\n  def run(x)\n    make(x)\n  end\nend\n"),
    ("cpp", "cc/m{i}.cpp", "#include <vector>\n#include \"m{a}.cpp\"\n\nint f{i}(int x) {\n  return g{a}(x);\n}\n\nvoid C{i}::run() {\n  f{i}(1);\n}\n"),
    ("php", "src/Models/P{i}.php", "<?php\nuse App\\Models\\{P{a}, Other as O};\nuse App\\Models\\P{a} as Q;\nrequire_once './P{a}.php';\n\nclass P{i} {\n  public function run($x) {\n    return make($x);\n  }\n}\n"),
    ("shell", "sh/m{i}.sh", "#!/bin/sh\nsource ./m{a}.sh\n\nrun{i}() {\n  make \"$1\"\n}\n\nrun{i} x\n"),
    ("dart", "dart/m{i}.dart", "import 'dart:io';\nimport 'm{a}.dart';\n\nclass D{i} {\n  int get size => 1;\n  void run() {\n    make(1);\n  }\n}\n"),
    ("lua", "lua/m{i}.lua", "local s = require(\"string\")\nlocal m = require(\"lua.m{a}\")\n\nfunction m.run(x)\n  return make(x)\nend\n\nlocal top{i} = function(x)\n  return m.run(x)\nend\n"),
    ("scss", "css/m{i}.scss", "@import 'm{a}';\n@import url('./m{a}.scss');\n@import 'https://example.org/x.css';\n.a { color: red; }\n"),
    ("vue", "vue/m{i}.vue", "<template><b/></template>\n<script>\nimport M from './m{a}.vue';\nfunction f{i}(x) {\n  return g{a}(x);\n}\n</script>\n<style>\n@import './m{a}.css';\n</style>\n"),
    ("swift", "sw/m{i}.swift", "import Foundation\nimport App\n\nclass W{i} {\n  init(x: Int) {\n  }\n  func run() {\n    make(1)\n  }\n}\n"),
)
K = len(TEMPLATES)

#: language: the specifiers in order; * marks a dynamic import, # one of a style sheet.
IMPORTS = {
    "python": "os pkg.m{a} .m{a}", "javascript": "./m{a}.js ./m{a} ./m{a} *./m{a}.js", "typescript": "./m{a} @app/m{a}", "go": "fmt example.org/app/go/p{a}", "rust": "std::fs m{a}",
    "java": "java.util.List org.a.C{a} org.a.C{a}.go", "kotlin": "org.b.K{a}", "scala": "org.c.S{a}", "csharp": "System App.N{a}", "ruby": "json ./m{a}", "cpp": "m{a}.cpp",
    "php": "App\\Models\\P{a} App\\Models\\Other App\\Models\\P{a} ./P{a}.php", "shell": "./m{a}.sh", "dart": "dart:io m{a}.dart", "lua": "string lua.m{a}", "scss": "#m{a} #./m{a}.scss", "vue": "./m{a}.vue #./m{a}.css", "swift": "Foundation App",
}
#: language: places of the imports that are found among the files, and the file's path.
TARGETS = {
    "python": (("2", "py/m{a}.py"),), "javascript": (("0 1 2 3", "js/m{a}.js"),), "typescript": (("0 1", "ts/m{a}.ts"),), "go": (("1", "go/p{a}/m.go"),), "rust": (("1", "rs/m{a}.rs"),),
    "java": (("1", "src/main/java/org/a/C{a}.java"),), "kotlin": (("0", "src/main/kotlin/org/b/K{a}.kt"),), "scala": (("0", "src/main/scala/org/c/S{a}.scala"),), "csharp": (("1", "cs/N{a}.cs"),), "ruby": (("1", "rb/m{a}.rb"),),
    "cpp": (("0", "cc/m{a}.cpp"),), "php": (("0 2 3", "src/Models/P{a}.php"),), "shell": (("0", "sh/m{a}.sh"),), "dart": (("1", "dart/m{a}.dart"),), "lua": (("1", "lua/m{a}.lua"),), "scss": (("1", "css/m{a}.scss"),), "vue": (("0", "vue/m{a}.vue"),), "swift": (),
}
#: language: name, qualified name, kind, first and last line of each symbol but the module.
SYMBOLS = {
    "python": "C{i} C{i} class 5 7|run C{i}.run method 6 7|f{i} f{i} function 9 10",
    "javascript": "f{i} f{i} function 6 8|C{i} C{i} class 9 13|run C{i}.run method 10 12",
    "typescript": "I{i} I{i} interface 3 5|f{i} f{i} function 6 8",
    "go": "F{i} F{i} function 8 10|Run Run method 12 14",
    "rust": "f{i} f{i} function 4 7",
    "java": "C{i} C{i} class 7 13|C{i} C{i}.C{i} constructor 8 9|run C{i}.run method 10 12",
    "kotlin": "K{i} K{i} class 5 9|run K{i}.run method 6 8|top{i} top{i} function 11 13",
    "scala": "S{i} S{i} class 5 9|run S{i}.run method 6 8",
    "csharp": "C{i} C{i} class 6 12|Run C{i}.Run method 8 11",
    "ruby": "R{i} R{i} class 4 8|run R{i}.run method 5 7",
    "cpp": "f{i} f{i} function 4 6|run C{i}::run method 8 10",
    "php": "P{i} P{i} class 6 10|run P{i}.run method 7 9",
    "shell": "run{i} run{i} function 4 6",
    "dart": "D{i} D{i} class 4 9|size D{i}.size method 5 5|run D{i}.run method 6 8",
    "lua": "run m.run method 4 6|top{i} top{i} function 8 10",
    "scss": "",
    "vue": "f{i} f{i} function 4 6",
    "swift": "W{i} W{i} class 4 10|init W{i}.init constructor 5 6|run W{i}.run method 7 9",
}
#: language: name called, line and the caller's qualified name (- for the module).
CALLS = {
    "python": "f{i} 7 C{i}.run|C{a} 10 f{i}", "javascript": "require 2 -|import 4 -|g{a} 7 f{i}|f{i} 11 C{i}.run", "typescript": "g{a} 7 f{i}", "go": "F{a} 9 F{i}|Println 13 Run", "rust": "println 5 f{i}|f{a} 6 f{i}",
    "java": "go 11 C{i}.run", "kotlin": "make 7 K{i}.run|run 12 top{i}", "scala": "make 7 S{i}.run", "csharp": "Make 10 C{i}.Run", "ruby": "make 6 R{i}.run", "cpp": "g{a} 5 f{i}|f{i} 9 C{i}::run",
    "php": "make 8 P{i}.run", "shell": "source 2 -|make 5 run{i}|run{i} 8 -", "dart": "make 7 D{i}.run", "lua": "require 1 -|require 2 -|make 5 m.run|run 9 top{i}", "scss": "url 2 -", "vue": "g{a} 5 f{i}", "swift": "make 8 W{i}.run",
}


def query(sql: str | None):
    def put(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def numbered(spark: SparkSession, sf: str) -> DataFrame:
    """i, k, a of every document: its number, the place of its language and the next document of that language."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("i"))
    n = docs.count()
    return docs.select("i", (F.col("i") % K).cast("int").alias("k"), F.when(F.col("i") + K < n, F.col("i") + K).otherwise(F.col("i") % K).alias("a"))


def filled(template, i="i", a="a"):
    return F.replace(F.replace(template, F.lit("{i}"), F.col(i).cast("string")), F.lit("{a}"), F.col(a).cast("string"))


def code_files(spark: SparkSession, sf: str) -> DataFrame:
    """path, language, content."""
    pick = lambda j: F.get(F.array(*(F.lit(t[j]) for t in TEMPLATES)), F.col("k"))
    return numbered(spark, sf).select(filled(pick(1)).alias("path"), pick(0).alias("language"), filled(pick(2)).alias("content"))


def quoted(x) -> str:
    return str(x) if isinstance(x, (int, bool)) else "'" + str(x).replace("'", "''") + "'"


def values(name: str, columns: str, rows: list[tuple]) -> str:
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows) + ")"


PLACE = {t[0]: k for k, t in enumerate(TEMPLATES)}
BASE = f"d AS (SELECT doc_id AS i, doc_id % {K} AS k, CASE WHEN doc_id + {K} < (SELECT count(*) FROM documents) THEN doc_id + {K} ELSE doc_id % {K} END AS a FROM documents), " + values("p", "k, language, path", [(k, t[0], t[1]) for k, t in enumerate(TEMPLATES)]) + ", f AS (SELECT i, k, a, language, replace(replace(path, '{i}', CAST(i AS VARCHAR)), '{a}', CAST(a AS VARCHAR)) AS path FROM d JOIN p USING (k))"


def put_in(column: str) -> str:
    return f"replace(replace({column}, '{{i}}', CAST(i AS VARCHAR)), '{{a}}', CAST(a AS VARCHAR))"


def import_table() -> str:
    rows = [(PLACE[lang], n, s.lstrip("*#"), s.startswith("*"), s.startswith("#")) for lang, specs in IMPORTS.items() for n, s in enumerate(specs.split())]
    return values("m", "k, ord, spec, dynamic, style", rows)


@query(f"WITH {BASE}, {import_table()} SELECT path, language, CAST(ord AS INTEGER) AS ord, {put_in('spec')} AS specifier, dynamic, style FROM f JOIN m USING (k)")
def extract_imports(spark: SparkSession, sf: str) -> DataFrame:
    return extract.imports_of(code_files(spark, sf))


def target_table() -> str:
    return values("t", "k, ord, target", [(PLACE[lang], int(n), path) for lang, found in TARGETS.items() for places, path in found for n in places.split()])


@query(f"WITH {BASE}, {import_table()}, {target_table()} SELECT path AS source, {put_in('target')} AS target, CASE WHEN dynamic THEN 'dynamic-import' ELSE 'import' END AS type, CAST(ord AS INTEGER) AS import_ord FROM f JOIN m USING (k) JOIN t USING (k, ord)")
def resolve_imports(spark: SparkSession, sf: str) -> DataFrame:
    from orebody.sources.store import cut

    files = code_files(spark, sf)
    paths = files.select("path")
    found = cut(extract.imports_of(files))
    return resolve.resolved_imports(found, paths, "example.org/app", sources.go_packages(paths), sources.namespaces(files), sources.class_suffixes(paths), [("@app/", True, 0, "ts")])


def symbol_table() -> str:
    return values("s", "k, name, qualified, kind, line, end_line", [(PLACE[lang], *(int(x) if x.isdigit() else x for x in row.split())) for lang, rows in SYMBOLS.items() for row in rows.split("|") if row])


@query(f"WITH {BASE}, {symbol_table()} SELECT path AS file, language, path || '::' || {put_in('qualified')} || '#' || line AS id, {put_in('name')} AS name, kind, CAST(line AS INTEGER) AS line, CAST(end_line AS INTEGER) AS end_line FROM f JOIN s USING (k)")
def extract_symbols(spark: SparkSession, sf: str) -> DataFrame:
    rows = extract.symbol_rows(extract.extracted(code_files(spark, sf)))
    return rows.where(F.col("name") != sym.MODULE).select("file", "language", "id", "name", "kind", "line", "end_line")


def call_table() -> str:
    return values("c", "k, callee, line, caller", [(PLACE[lang], x.split()[0], int(x.split()[1]), x.split()[2]) for lang, rows in CALLS.items() for x in rows.split("|") if x])


CALL_SQL = f"{BASE}, {symbol_table()}, {call_table()}, g AS (SELECT path, language, i, a, c.callee, c.line, CASE WHEN caller = '-' THEN path || '::<module>#1' ELSE path || '::' || {put_in('caller')} || '#' || s.line END AS caller_id FROM f JOIN c USING (k) LEFT JOIN s ON s.k = f.k AND s.qualified = c.caller)"


@query(f"WITH {CALL_SQL} SELECT path AS caller_file, {put_in('callee')} AS callee_name, CAST(line AS INTEGER) AS line, caller_id FROM g")
def extract_calls(spark: SparkSession, sf: str) -> DataFrame:
    return extract.call_rows(extract.extracted(code_files(spark, sf))).select("caller_file", "callee_name", "line", "caller_id")


@query(f"WITH {BASE}, {symbol_table()} SELECT path AS file, language FROM f")
def file_languages(spark: SparkSession, sf: str) -> DataFrame:
    return sym.file_languages(extract.symbol_rows(extract.extracted(code_files(spark, sf))))


@query("""WITH n AS (SELECT doc_id, 'class A:' || chr(10) || string_agg('    def m' || j || '(self):' || chr(10) || repeat('        x = 1' || chr(10), 6), '' ORDER BY j) || chr(10) || 'def last():' || chr(10) || '    pass' || chr(10) AS content, doc_id % 40 AS m FROM (SELECT doc_id, unnest(range(0, doc_id % 40 + 1)) AS j FROM documents) GROUP BY doc_id),
r AS (SELECT doc_id, 7 * (m + 1) + 1 AS c, string_split(content, chr(10)) AS l FROM n), g AS (SELECT doc_id, l, c, len(l) AS n, CASE WHEN c + 3 <= 100 THEN true ELSE false END AS one FROM r),
w AS (SELECT doc_id, l, n, 0 AS s, c + 3 AS e FROM g WHERE one AND n > 100 UNION ALL
SELECT doc_id, l, n, unnest(range(0, CAST(ceil((c - 100) / 90.0) AS BIGINT) * 90 + 1, 90)) AS s, c FROM g WHERE NOT one AND n > 100 AND c > 150 UNION ALL SELECT doc_id, l, n, 0, c FROM g WHERE NOT one AND n > 100 AND c <= 150 UNION ALL SELECT doc_id, l, n, c, c + 3 FROM g WHERE NOT one AND n > 100
UNION ALL SELECT doc_id, l, n, 0, n FROM g WHERE n <= 100),
x AS (SELECT doc_id, s, CASE WHEN n <= 100 THEN n WHEN e - s > 100 AND e > 150 THEN s + 100 ELSE e END AS e, l FROM w)
SELECT 'm' || doc_id || '.py' AS path, CAST(s + 1 AS INTEGER) AS start_line, CAST(e AS INTEGER) AS end_line, md5(substr(array_to_string(l[s + 1 : e], chr(10)), 1, 2000)) AS chunk_md5 FROM x""")
def chunk_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Classes of 1 to 40 methods and a function behind them, chunked by their declarations."""
    method = lambda j: F.concat(F.lit("    def m"), j.cast("string"), F.lit("(self):\n"), F.repeat(F.lit("        x = 1\n"), 6))
    body = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("doc_id") % 40), method), "")
    content = F.concat(F.lit("class A:\n"), body, F.lit("\ndef last():\n    pass\n"))
    files = table(spark, sf, "documents").select(F.concat(F.lit("m"), "doc_id", F.lit(".py")).alias("path"), F.lit("python").alias("language"), content.alias("content"))
    parts = files.select("path", "content", extract.regions_of(F.col("language"), F.col("content")).alias("regions"))
    return chunking.chunks(parts).select("path", "start_line", "end_line", F.md5("chunk").alias("chunk_md5"))
