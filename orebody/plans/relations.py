"""Code-shaped relations derived from the test tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TERMS = ("the", "for", "les", "token")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def files(spark: SparkSession, sf: str) -> DataFrame:
    ext = F.when(F.col("lang") == "en", ".py").when(F.col("lang") == "fr", ".ts").when(F.col("lang") == "de", ".java").otherwise(".txt")
    return table(spark, sf, "documents").select("doc_id", F.concat("source", F.lit("/doc_"), "doc_id", ext).alias("path"), F.col("source").alias("artifact"), "lang", F.col("text").alias("content"))


FILES = """files AS (SELECT doc_id, source || '/doc_' || doc_id || CASE lang WHEN 'en' THEN '.py' WHEN 'fr' THEN '.ts' WHEN 'de' THEN '.java' ELSE '.txt' END AS path,
  source AS artifact, lang, text AS content FROM documents)"""


def snapshots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """New and old file state: path, content_hash."""
    f = files(spark, sf)
    h = lambda c: F.substring(F.sha2(c, 256), 1, 16).alias("content_hash")
    new = f.where("doc_id % 13 <> 0").select("path", h(F.col("content")))
    old = f.where("doc_id % 10 <> 0").select("path", h(F.when(F.col("doc_id") % 7 == 0, F.concat("content", F.lit("x"))).otherwise(F.col("content"))))
    return new, old


SNAPSHOTS = (
    FILES
    + """, new AS (SELECT path, substr(sha256(content), 1, 16) AS content_hash FROM files WHERE doc_id % 13 <> 0),
old AS (SELECT path, substr(sha256(CASE WHEN doc_id % 7 = 0 THEN content || 'x' ELSE content END), 1, 16) AS content_hash FROM files WHERE doc_id % 10 <> 0)"""
)


def part_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Successive parts inside an order, as a bag of edges."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").withColumn("target", F.lead("l_partkey").over(w))
    return rows.where(F.col("target").isNotNull()).select(F.col("l_partkey").alias("source"), "target")


def edges_sql() -> str:
    return """bag AS (SELECT l_partkey AS source, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS target FROM lineitem),
edges AS (SELECT source, target FROM bag WHERE target IS NOT NULL)"""


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """file, line (from 1), first and last word in lower-case ASCII letters."""
    plain = lambda w: F.lower(F.regexp_replace(w, "[^a-zA-Z]", ""))
    rows = table(spark, sf, "documents").select("doc_id", "lang", F.posexplode(F.split("text", "\n", -1)).alias("p", "t"))
    words = F.split("t", " ", -1)
    return rows.select(F.concat(F.lit("d"), "doc_id").alias("file"), "lang", (F.col("p") + 1).alias("line"), plain(F.get(words, F.lit(0))).alias("first"), plain(F.element_at(words, -1)).alias("last"))


LINES = """split AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
lines AS (SELECT 'd' || doc_id AS file, lang, line, lower(regexp_replace(string_split(t, ' ')[1], '[^a-zA-Z]', '', 'g')) AS first, lower(regexp_replace(string_split(t, ' ')[-1], '[^a-zA-Z]', '', 'g')) AS last FROM split)"""


def symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Every third line defines a symbol of three lines, named by its first word."""
    rows = lines(spark, sf).where("(line - 1) % 3 = 0 AND first <> ''")
    lang = F.when(F.col("lang") == "en", "python").when(F.col("lang") == "fr", "typescript").when(F.col("lang") == "de", "java").otherwise("plaintext")
    return rows.select(F.concat("file", F.lit("::"), "first", F.lit("#"), "line").alias("id"), F.col("first").alias("name"), F.lit("function").alias("kind"), "file", "line", (F.col("line") + 2).alias("end_line"), lang.alias("language"))


def sites(spark: SparkSession, sf: str) -> DataFrame:
    rows = lines(spark, sf).where("last <> ''")
    return rows.select("file", "line", F.concat("file", F.lit(":"), "line").alias("site"), F.col("last").alias("callee_name"))


def calls(spark: SparkSession, sf: str) -> DataFrame:
    from orebody.operators.symbols import caller_attribution

    at = sites(spark, sf)
    owner = caller_attribution(at.select("file", "line", "site"), symbols(spark, sf))
    return at.join(owner.select("site", "caller_id"), "site").select(F.col("site").alias("call_id"), "caller_id", F.col("file").alias("caller_file"), "callee_name", "line")


def dependencies(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id")
    n = docs.count()
    name = lambda c: F.concat(F.lit("d"), c)
    rows = docs.select("doc_id", (F.col("doc_id") + 1).alias("to")).where(F.col("to") < n).unionAll(docs.select("doc_id", (F.col("doc_id") * 7 % n).alias("to")))
    return rows.where("doc_id <> to").select(name("doc_id").alias("source"), name("to").alias("target"))


def call_edges(spark: SparkSession, sf: str) -> DataFrame:
    from orebody.operators.symbols import resolved

    return resolved(calls(spark, sf), symbols(spark, sf), dependencies(spark, sf))


DEPENDENCIES = "deps AS (SELECT DISTINCT 'd' || a AS source, 'd' || b AS target FROM (SELECT doc_id AS a, doc_id + 1 AS b FROM documents WHERE doc_id + 1 < (SELECT count(*) FROM documents) UNION ALL SELECT doc_id, doc_id * 7 % (SELECT count(*) FROM documents) FROM documents) WHERE a <> b)"

SYMBOLS = (
    LINES
    + """, symbols AS (SELECT file || '::' || first || '#' || line AS id, first AS name, file, line, line + 2 AS end_line, CASE lang WHEN 'en' THEN 'python' WHEN 'fr' THEN 'typescript' WHEN 'de' THEN 'java' ELSE 'plaintext' END AS language FROM lines WHERE (line - 1) % 3 = 0 AND first <> ''),
sites AS (SELECT file, line, file || ':' || line AS site, last AS callee_name FROM lines WHERE last <> ''),
owned AS (SELECT s.site, s.file, s.line, coalesce(arg_max(y.id, y.line), s.file || '::<module>#1') AS caller_id FROM sites s LEFT JOIN symbols y ON y.file = s.file AND s.line BETWEEN y.line AND y.end_line GROUP BY s.site, s.file, s.line),
calls AS (SELECT s.site AS call_id, o.caller_id, s.file AS caller_file, s.callee_name, s.line FROM sites s JOIN owned o USING (site)),
"""
    + DEPENDENCIES
)
RESOLVED = (
    SYMBOLS
    + """, far AS (SELECT DISTINCT a.source, b.target FROM deps a JOIN deps b ON a.target = b.source WHERE a.source <> b.target),
reach AS (SELECT DISTINCT file AS source, file AS target, 1 AS tier FROM sites UNION ALL SELECT source, target, 2 FROM deps UNION ALL SELECT source, target, 3 FROM far),
wanted AS (SELECT DISTINCT caller_file, callee_name FROM calls),
hits AS (SELECT w.caller_file, w.callee_name, r.tier, y.id FROM wanted w JOIN reach r ON r.source = w.caller_file JOIN symbols y ON y.file = r.target AND y.name = w.callee_name),
least AS (SELECT caller_file, callee_name, min(tier) AS tier FROM hits GROUP BY ALL),
best AS (SELECT caller_file, callee_name, tier, count(DISTINCT id) AS n FROM hits JOIN least USING (caller_file, callee_name, tier) GROUP BY ALL),
targets AS (SELECT DISTINCT caller_file, callee_name, id FROM hits JOIN least USING (caller_file, callee_name, tier)),
resolved AS (SELECT c.*, coalesce(b.n, 0) AS n, CASE WHEN b.n IS NULL THEN 'unresolved' WHEN b.tier = 1 THEN 'local' WHEN b.n = 1 THEN 'unique' ELSE 'multiple-candidates' END AS confidence FROM calls c LEFT JOIN best b USING (caller_file, callee_name)),
links AS (SELECT r.call_id, r.caller_id, r.caller_file, r.callee_name, r.line, r.confidence, r.n, t.id FROM resolved r JOIN targets t USING (caller_file, callee_name))"""
)
