"""Queries over scanned trees, here over paths derived from documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orebody.functions import scalars as S
from orebody.plans.relations import table
from orebody.sources import files as sources
from orebody.sources.ignore import is_ignored, rules

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def put(f):
        Q[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return put


def tree(spark: SparkSession, sf: str) -> DataFrame:
    """path, length, content: documents spread over folders and kinds of files."""
    d = table(spark, sf, "documents").select("doc_id", "source", "text", "n_chars")
    kinds = F.array(*(F.lit(x) for x in ("src/a", "lib/node_modules/x", "pkg/build", "src/main/java/org", ".git", "docs", "env")))
    ext = F.array(*(F.lit(x) for x in (".py", ".go", "_test.go", ".java", ".min.js", ".log", ".bin", ".CS", "/Makefile", ".tar.xz")))
    path = F.concat("source", F.lit("/"), F.get(kinds, (F.col("doc_id") % 7).cast("int")), F.lit("/f"), "doc_id", F.get(ext, (F.col("doc_id") % 10).cast("int")))
    return d.select("doc_id", path.alias("path"), F.col("n_chars").alias("length"), F.col("text").alias("content"))


TREE = """tree AS (SELECT doc_id, source || '/' || ['src/a', 'lib/node_modules/x', 'pkg/build', 'src/main/java/org', '.git', 'docs', 'env'][doc_id % 7 + 1] || '/f' || doc_id
|| ['.py', '.go', '_test.go', '.java', '.min.js', '.log', '.bin', '.CS', '/Makefile', '.tar.xz'][doc_id % 10 + 1] AS path, n_chars AS length, text AS content FROM documents)"""


@query(f"WITH {TREE} SELECT path, length FROM tree WHERE length <= 20000 AND doc_id % 10 IN (0, 1, 2, 3, 4, 7, 8) AND doc_id % 7 NOT IN (1, 2, 4, 6) AND doc_id % 10 <> 4")
def scan_files(spark: SparkSession, sf: str) -> DataFrame:
    t = tree(spark, sf)
    p = F.col("path")
    return t.where((F.col("length") <= 20000) & S.is_indexable(p) & ~is_ignored(p, rules()) & ~sources.has_dot_part(p)).select("path", "length")


@query(f"WITH {TREE} SELECT path, CASE doc_id % 10 WHEN 0 THEN 'python' WHEN 3 THEN 'java' WHEN 7 THEN 'csharp' ELSE 'go' END AS language FROM tree WHERE length <= 5000 AND doc_id % 10 IN (0, 1, 2, 3, 7) AND doc_id % 7 NOT IN (1, 2, 4, 6)")
def graph_files(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("path")
    return tree(spark, sf).where((F.col("length") <= 5000) & S.is_graphable(p) & ~is_ignored(p, rules())).select("path", S.language(p).alias("language"))


@query(f"WITH {TREE} SELECT path, doc_id % 7 IN (1, 2, 4, 6) OR doc_id % 10 = 4 OR doc_id % 10 = 5 AND path NOT LIKE '%f5%' OR doc_id % 10 = 6 AND path LIKE 'src1/%' AS ignored FROM tree")
def ignore_filter(spark: SparkSession, sf: str) -> DataFrame:
    own = rules(root=["/src1/**/*.bin", "!f5*.log"])
    return tree(spark, sf).select("path", is_ignored(F.col("path"), own).alias("ignored"))


@query(f"WITH {TREE} SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, min(path) AS path FROM tree WHERE doc_id % 10 = 1 GROUP BY 1")
def go_packages(spark: SparkSession, sf: str) -> DataFrame:
    return sources.go_packages(tree(spark, sf))


@query(f"WITH {TREE} SELECT 'N' || doc_id % 9 || '.Core' AS namespace, min(replace(path, '.CS', '.cs')) AS path FROM tree WHERE doc_id % 10 = 7 GROUP BY 1")
def cs_namespaces(spark: SparkSession, sf: str) -> DataFrame:
    content = F.concat(F.lit("using System;\n namespace N"), F.col("doc_id") % 9, F.lit(".Core\n{\n"), "content", F.lit("}\n"))
    return sources.namespaces(tree(spark, sf).select(F.replace("path", F.lit(".CS"), F.lit(".cs")).alias("path"), content.alias("content")))


@query(f"WITH {TREE} SELECT regexp_extract(path, 'src/main/java/(.*)$', 1) AS suffix, min(path) AS path FROM tree WHERE doc_id % 7 = 3 GROUP BY 1")
def jvm_suffix(spark: SparkSession, sf: str) -> DataFrame:
    return sources.class_suffixes(tree(spark, sf))
