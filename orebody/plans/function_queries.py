"""Scalar functions, registered SQL functions, stored search and stored tables over the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orebody.functions import registry
from orebody.functions import scalars as S
from orebody.operators import changes, chunking, search
from orebody.plans.relations import FILES, TERMS, files, table
from orebody.plans.text_queries import COSINE, FUSE, LINE_SQL, UUID, bm25_sql, dense

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def put(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


NIBBLE = "(instr('0123456789abcdef', substr(sha256(path), {0}, 1)) - 1)"


@query(rf"""WITH {FILES}, n AS (SELECT *, lang || '/Feature--' || doc_id || '!' AS branch, replace(path, '/', '\') || '::f' || doc_id || '#' || doc_id % 7 AS id, substr(content, 1, 40) AS head FROM files)
SELECT doc_id, replace(id, '\', '/') AS slashed, regexp_replace(regexp_replace(regexp_replace(branch, '[^A-Za-z0-9_]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS branch,
substr(sha256(path), 1, 12) || '__' || regexp_replace(regexp_replace(regexp_replace(branch, '[^A-Za-z0-9_]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS project_id,
CASE WHEN regexp_matches(lower(substr(content, 1, 1)), '^[a-z]$') THEN lower(substr(content, 1, 1)) ELSE '_' END AS name_shard, CAST({NIBBLE.format(1)} * 16 + {NIBBLE.format(2)} AS INTEGER) AS reverse_shard,
replace(path, '/', '\') AS symbol_file, true AS is_path, regexp_matches(head, '[/\\]|\.[A-Za-z]{{1,5}}$') AS head_is_path, 'f' || doc_id AS callee,
replace(replace(replace(replace(replace('<' || head || '&">', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped, replace('<' || head, '<', chr(92) || 'u003c') AS json,
md5('search_document: ' || path || chr(10) || content) AS told, 'search_query: ' || head AS asked, substr(content, 1, 24) AS cut, md5(substr(content, 1, 2000)) AS capped, printf('%.4f', doc_id / 8.0) AS score FROM n""")
def scalar_functions(spark: SparkSession, sf: str) -> DataFrame:
    f = files(spark, sf)
    path, content, head = F.col("path"), F.col("content"), F.substring("content", 1, 40)
    branch = F.concat("lang", F.lit("/Feature--"), "doc_id", F.lit("!"))
    symbol = F.concat(F.translate(path, "/", "\\"), F.lit("::f"), "doc_id", F.lit("#"), (F.col("doc_id") % 7).cast("string"))
    call = F.concat(F.lit("a.b::c->f"), "doc_id", F.lit("(x, (y))"))
    return f.select(
        "doc_id", S.forward_slashes(symbol).alias("slashed"), S.branch_name(branch).alias("branch"), S.project_id(path, branch).alias("project_id"), S.name_shard(content).alias("name_shard"), S.reverse_shard(path).alias("reverse_shard"),
        S.symbol_file(symbol).alias("symbol_file"), S.looks_like_path(path).alias("is_path"), S.looks_like_path(head).alias("head_is_path"), S.callee_name(call).alias("callee"), S.html_escaped(F.concat(F.lit("<"), head, F.lit('&">'))).alias("escaped"), S.json_in_html(F.concat(F.lit("<"), head)).alias("json"),
        F.md5(S.document_text(path, content)).alias("told"), S.query_text(head).alias("asked"), S.truncated(content, 8, 3.0).alias("cut"), F.md5(S.capped(content)).alias("capped"), S.score_text(F.col("doc_id") / 8).alias("score"),
    )


@query(f"""WITH {FILES} SELECT path, substr(sha256(content), 1, 16) AS hash, {UUID.format("path || ':' || doc_id")} AS chunk, CASE regexp_extract(path, '[.][a-z]+$') WHEN '.py' THEN 'python' WHEN '.ts' THEN 'typescript' WHEN '.java' THEN 'java' ELSE 'plaintext' END AS language,
round(ln(1 + (100 - 7 + 0.5) / 7.5) * 3 * 2.2 / (3 + 1.2 * (0.25 + 0.75 * doc_id / 50.0)), 9) AS score, round(1 / CAST(2 + doc_id AS DOUBLE), 9) AS rrf, path AS file FROM files""")
def sql_functions(spark: SparkSession, sf: str) -> DataFrame:
    registry.register(spark)
    files(spark, sf).createOrReplaceTempView("orebody_files")
    return spark.sql("SELECT path, content_hash(content) AS hash, chunk_id(path, CAST(doc_id AS INT)) AS chunk, language_of(path) AS language, round(bm25_score(3, doc_id, 7, 100, 50), 9) AS score, round(reciprocal_rank(CAST(doc_id AS INT), 2), 9) AS rrf, symbol_file(path || '::x#1') AS file FROM orebody_files")


@query(f"WITH {FILES} " + LINE_SQL.format(keys="path", more=""))
def sql_chunk_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The registered table function gives the chunks that the operator gives."""
    registry.register(spark)
    files(spark, sf).createOrReplaceTempView("orebody_files")
    return spark.sql("SELECT path, start_line, end_line, md5(chunk) AS chunk_md5 FROM orebody_files, LATERAL chunk_lines(content, 20, 2)")


@query(r"""SELECT term, count(*) AS docs, CAST(sum(tf) AS BIGINT) AS tokens, CAST(max(dl) AS INTEGER) AS longest FROM (SELECT doc_id, term, count(*) AS tf, any_value(len(t)) AS dl FROM (SELECT doc_id, t, unnest(t) AS term FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents)) GROUP BY doc_id, term) GROUP BY term""")
def postings(spark: SparkSession, sf: str) -> DataFrame:
    """Of each term of the inverted index: texts, occurrences and the longest text."""
    index = search.postings(table(spark, sf, "documents"), "doc_id", F.col("text"))
    return index.groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.sum("tf").alias("tokens"), F.max("dl").alias("longest"))


def index_of(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    from orebody.sources.store import cut

    index = cut(search.postings(table(spark, sf, "documents"), "doc_id", F.col("text")))
    return index, search.statistics(index)


STORED = r"WITH t AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents), w AS (SELECT * FROM t WHERE len(t) > 0), s AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(t)) AS average FROM w), h AS (SELECT doc_id, lang, len(t) AS dl, term, count(*) AS tf FROM (SELECT doc_id, lang, t, unnest(t) AS term FROM w) WHERE term IN ('the', 'for', 'les', 'token') GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM h GROUP BY term), b AS (SELECT doc_id, lang, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / average))), 6) AS score FROM h JOIN f USING (term), s GROUP BY doc_id, lang)"


@query(f"{STORED} SELECT doc_id, score FROM b")
def bm25_stored(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of all texts with one of the terms, from the inverted index."""
    index, stats = index_of(spark, sf)
    return search.bm25_stored(index, stats, list(TERMS)).withColumnRenamed("id", "doc_id")


@query(f"{STORED.replace('b AS (', 'b0 AS (')}, b AS (SELECT doc_id, score FROM b0 WHERE lang = 'fr'), {COSINE.replace('FROM embeddings, q)', 'FROM embeddings, q WHERE vec_id IN (SELECT doc_id FROM documents WHERE lang = $$fr$$))')}, {FUSE}")
def hybrid_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """Hybrid search in one language; the sparse part keeps the statistics of all texts."""
    index, stats = index_of(spark, sf)
    only = table(spark, sf, "documents").where("lang = 'fr'").select(F.col("doc_id").alias("id"))
    sparse = search.bm25_stored(index, stats, list(TERMS), only).withColumnRenamed("id", "doc_id")
    return search.hybrid(dense(spark, sf).join(only.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi"), sparse, "doc_id", 10)


@query(f"""WITH {FILES}, n AS (SELECT path, content, string_split(content, chr(10)) AS l FROM files), h AS (SELECT *, CASE WHEN length(content) / len(l) > 500 THEN 'chars' WHEN len(l) <= 20 THEN 'single' ELSE 'lines' END AS how FROM n),
c AS (SELECT path, CAST(1 AS BIGINT) AS s, CAST(len(l) AS BIGINT) AS e, content AS chunk, 1 AS pos FROM h WHERE how = 'single'
UNION ALL SELECT path, s + 1, least(s + 20, len(l)), array_to_string(l[s + 1 : s + 20], chr(10)), s + 1 FROM (SELECT *, unnest(generate_series(0, CAST(greatest(0, ceil((len(l) - 20) / 18.0)) AS BIGINT) * 18, 18)) AS s FROM h WHERE how = 'lines')
UNION ALL SELECT path, 1, 1, p[i], coalesce(list_sum(list_transform(p[1 : i - 1], lambda x: length(x))), 0) FROM (SELECT path, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT path, regexp_extract_all(content, '(?s).{{1,900}}\\z|.{{1,899}}[\\n \\t;,]|.{{1,900}}') AS p FROM h WHERE how = 'chars')))
SELECT path, CAST(s AS INTEGER) AS start_line, CAST(e AS INTEGER) AS end_line, md5(substr(chunk, 1, 900)) AS chunk_md5, {UUID.format("path || ':' || CAST(pos AS BIGINT)")} AS id FROM c""")
def chunk_files(spark: SparkSession, sf: str) -> DataFrame:
    """Every text by the strategy that its shape asks for, capped, with ids."""
    return chunking.chunks(files(spark, sf).select("path", "content"), 20, 2, 900).select("path", "start_line", "end_line", F.md5("chunk").alias("chunk_md5"), "id")


@query("SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS path, CASE WHEN doc_id % 3 = 0 THEN n_chars + 1 ELSE n_chars END AS n FROM documents WHERE (doc_id % 2 = 0 OR doc_id % 3 = 0) AND doc_id % 5 <> 0")
def store_upsert_delete(spark: SparkSession, sf: str) -> DataFrame:
    """A stored table after a write, an upsert by key and a delete by condition; another project's rows stay out of it."""
    from orebody.sources.store import Table, shared_folder

    t = Table(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", "id string, path string, n long")
    rows = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.lit("old").alias("path"), F.col("n_chars").alias("n"), "doc_id")
    t.replace("p", rows.where("doc_id % 2 = 0"))
    t.replace("other", rows)
    t.upsert("p", rows.where("doc_id % 3 = 0").withColumn("path", F.lit("new")).withColumn("n", F.col("n") + 1))
    t.delete("p", F.col("id").cast("long") % 5 == 0)
    return t.read("p")


@query("SELECT 'src/' || source || '/f' || doc_id AS path, doc_id FROM documents")
def relative_keys(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select(F.concat(F.lit("/home/u/tree/src/"), "source", F.lit("/f"), "doc_id").alias("path"), "doc_id")
    return changes.relative_keys(rows, "/home/u/tree")
