"""Queries over files, chunks, changes, artifacts and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orebody.functions import scalars as S
from orebody.operators import artifacts, changes, chunking, search
from orebody.plans.relations import FILES, SNAPSHOTS, TERMS, files, snapshots, table

UUID = "regexp_replace(substr(sha256({0}), 1, 32), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')"
Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def put(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


@query(f"""WITH {FILES} SELECT path, substr(sha256(content), 1, 16) AS content_hash, sha256(content) AS full_hash, {UUID.format("path || ':1'")} AS chunk_id,
CAST(length(content) AS INTEGER) AS n_chars, CAST(len(string_split(content, chr(10))) AS INTEGER) AS n_lines FROM files""")
def content_hash(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("content")
    return files(spark, sf).select("path", S.content_hash(c).alias("content_hash"), S.full_hash(c).alias("full_hash"), S.chunk_id(F.col("path"), F.lit(1)).alias("chunk_id"), F.length(c).alias("n_chars"), F.size(chunking.lines_of(c)).alias("n_lines"))


@query(f"""WITH {FILES} SELECT CASE regexp_extract(path, '[.][a-z]+$') WHEN '.py' THEN 'python' WHEN '.ts' THEN 'typescript' WHEN '.java' THEN 'java' ELSE 'plaintext' END AS language, count(*) AS files FROM files GROUP BY 1""")
def language_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return files(spark, sf).groupBy(S.language(F.col("path")).alias("language")).agg(F.count(F.lit(1)).alias("files"))


LINE_SQL = """SELECT {keys}, CAST(s + 1 AS INTEGER) AS start_line, CAST(least(s + 20, n) AS INTEGER) AS end_line, md5(array_to_string(l[s + 1 : s + 20], chr(10))) AS chunk_md5{more}
FROM (SELECT *, len(l) AS n, unnest(generate_series(0, CAST(greatest(0, ceil((len(l) - 20) / 18.0)) AS BIGINT) * 18, 18)) AS s FROM (SELECT *, string_split(content, chr(10)) AS l FROM files))"""


@query(f"WITH {FILES} " + LINE_SQL.format(keys="path", more=""))
def chunk_lines(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.line_chunks(files(spark, sf).select("path", "content"), 20, 2).select("path", "start_line", "end_line", F.md5("chunk").alias("chunk_md5"))


@query(f"WITH {FILES} " + LINE_SQL.format(keys="path, artifact", more=", " + UUID.format("'context:' || path || ':' || artifact || ':' || s") + " AS id") + " WHERE length(content) > 0")
def chunk_artifact(spark: SparkSession, sf: str) -> DataFrame:
    rows = chunking.line_chunks(files(spark, sf).where(F.length("content") > 0).select("path", "artifact", "content"), 20, 2)
    return rows.select("path", "artifact", "start_line", "end_line", F.md5("chunk").alias("chunk_md5"), S.artifact_chunk_id(F.col("path"), F.col("artifact"), F.col("start_line") - 1).alias("id"))


@query(f"""WITH {FILES} SELECT CASE WHEN length(content) / len(string_split(content, chr(10))) > 500 THEN 'chars' WHEN len(string_split(content, chr(10))) <= 20 THEN 'single' WHEN lang = 'en' THEN 'regions' ELSE 'lines' END AS strategy, count(*) AS files FROM files GROUP BY 1""")
def chunk_strategy(spark: SparkSession, sf: str) -> DataFrame:
    how = chunking.strategy(F.col("content"), F.col("lang") == "en", 20)
    return files(spark, sf).groupBy(how.alias("strategy")).agg(F.count(F.lit(1)).alias("files"))


@query(f"""WITH {FILES}, cut AS (SELECT path, regexp_extract_all(content, '(?s).{{1,1000}}\\z|.{{1,999}}[\\n \\t;,]|.{{1,1000}}') AS p FROM files)
SELECT path, CAST(i - 1 AS INTEGER) AS ord, CAST(coalesce(list_sum(list_transform(p[1 : i - 1], lambda x: length(x))), 0) AS INTEGER) AS "offset", md5(p[i]) AS chunk_md5 FROM (SELECT path, p, unnest(range(1, len(p) + 1)) AS i FROM cut)""")
def chunk_chars(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.char_chunks(files(spark, sf).select("path", "content"), 1000).select("path", "ord", "offset", F.md5("chunk").alias("chunk_md5"))


@query("""WITH i AS (SELECT user_id, epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 1000000 + 1800 AS e FROM events),
m AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM i),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT user_id, min(s) AS s, max(e) AS e, count(*) AS n FROM g GROUP BY user_id, g""")
def merge_intervals(spark: SparkSession, sf: str) -> DataFrame:
    s = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("long")
    rows = table(spark, sf, "events").select("user_id", s.alias("s"), (s + 1800).alias("e"))
    return chunking.merged_intervals(rows, ["user_id"], "s", "e")


@query(f"""WITH {SNAPSHOTS} SELECT path, o.content_hash AS old_hash, n.content_hash AS new_hash, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN o.content_hash = n.content_hash THEN 'unchanged' ELSE 'changed' END AS status FROM new n FULL JOIN old o USING (path)""")
def incremental_diff(spark: SparkSession, sf: str) -> DataFrame:
    return changes.file_changes(*snapshots(spark, sf))


@query(f"WITH {SNAPSHOTS} SELECT * FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.path = n.path AND o.content_hash = n.content_hash)")
def changed_files(spark: SparkSession, sf: str) -> DataFrame:
    return changes.changed_files(*snapshots(spark, sf))


@query(f"WITH {SNAPSHOTS} SELECT * FROM old o WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.path = o.path)")
def removed_files(spark: SparkSession, sf: str) -> DataFrame:
    return changes.removed_files(*snapshots(spark, sf))


@query(f"WITH {SNAPSHOTS} SELECT CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN o.content_hash = n.content_hash THEN 'unchanged' ELSE 'changed' END AS status, count(*) AS files FROM new n FULL JOIN old o USING (path) GROUP BY 1")
def incremental_counts(spark: SparkSession, sf: str) -> DataFrame:
    return changes.change_counts(*snapshots(spark, sf))


def bm25_sql(source: str, name: str, text: str) -> str:
    tf = ", ".join(f"CAST(len(list_filter(t, lambda x: x = '{w}')) AS DOUBLE) AS tf{i}" for i, w in enumerate(TERMS))
    df = ", ".join(f"CAST(count(*) FILTER (WHERE tf{i} > 0) AS DOUBLE) AS df{i}" for i in range(len(TERMS)))
    score = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(TERMS)))
    any_ = " + ".join(f"tf{i}" for i in range(len(TERMS)))
    return f"""{name}_t AS (SELECT *, regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+') AS t FROM {source}), {name}_c AS (SELECT *, CAST(len(t) AS DOUBLE) AS dl, {tf} FROM {name}_t),
{name}_s AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS avgdl, {df} FROM {name}_c), {name} AS (SELECT *, round({score}, 6) AS score FROM {name}_c, {name}_s WHERE {any_} > 0)"""


@query(f"WITH {bm25_sql('documents', 'b', 'text')} SELECT doc_id, score FROM b ORDER BY score DESC, doc_id LIMIT 30")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return search.top(search.bm25(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", F.col("text"), list(TERMS)), 30, ties=("doc_id",)).select("doc_id", "score")


COSINE = """q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 0), d AS (SELECT vec_id AS doc_id, round(list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * CAST(qv[i] AS DOUBLE))) / (sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * sqrt(list_sum(list_transform(qv, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))), 6) AS score FROM embeddings, q)"""


def query_vector(spark: SparkSession, sf: str) -> list[float]:
    return table(spark, sf, "embeddings").where("vec_id = 0").first().embedding


def dense(spark: SparkSession, sf: str) -> DataFrame:
    return search.cosine(table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "embedding", query_vector(spark, sf))


@query(f"WITH {COSINE} SELECT doc_id, score FROM d ORDER BY score DESC, doc_id LIMIT 30")
def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    return search.top(dense(spark, sf), 30, ties=("doc_id",)).select("doc_id", "score")


FUSE = """rd AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS r FROM (SELECT * FROM d ORDER BY score DESC, doc_id LIMIT 30)), rb AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS r FROM (SELECT * FROM b ORDER BY score DESC, doc_id LIMIT 30))
SELECT doc_id, round(sum(CAST(1 AS DOUBLE) / (2 + r)), 6) AS score FROM (SELECT * FROM rd UNION ALL SELECT * FROM rb) GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 10"""


@query(f"WITH {COSINE}, {bm25_sql('documents', 'b', 'text')}, {FUSE}")
def hybrid_rrf(spark: SparkSession, sf: str) -> DataFrame:
    sparse = search.bm25(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", F.col("text"), list(TERMS))
    return search.hybrid(dense(spark, sf), sparse, "doc_id", 10)


@query(f"WITH {COSINE.replace('FROM embeddings, q)', 'FROM embeddings, q WHERE vec_id IN (SELECT doc_id FROM documents WHERE source = $$src3$$))')}, s3 AS (SELECT * FROM documents WHERE source = 'src3'), {bm25_sql('s3', 'b', 'text')}, {FUSE}")
def artifact_search(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "documents").where("source = 'src3'").select("doc_id", "text")
    return search.hybrid(dense(spark, sf).join(own.select("doc_id"), "doc_id", "left_semi"), search.bm25(own, "doc_id", F.col("text"), list(TERMS)), "doc_id", 10)


@query(f"""WITH {bm25_sql('documents', 'b', 'text')}, r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) - 1 AS r FROM b), h AS (SELECT * FROM r WHERE r < 20)
SELECT lang AS label, source AS path, round(sum(CAST(1 AS DOUBLE) / (61 + r)), 6) AS score, arg_min(doc_id, r) AS doc_id FROM h GROUP BY lang, source ORDER BY score DESC, label, min(r) LIMIT 10""")
def multi_rrf(spark: SparkSession, sf: str) -> DataFrame:
    rows = search.bm25(table(spark, sf, "documents").select("doc_id", "lang", "source", "text"), "doc_id", F.col("text"), list(TERMS))
    hits = search.ranked(rows.select("doc_id", "lang", "source", "score"), 20, ("doc_id",), ("lang",)).select(F.col("lang").alias("label"), F.col("source").alias("path"), "rank", F.struct("doc_id").alias("payload"))
    return search.multi_collection(hits, 10).select("label", "path", "score", F.col("payload.doc_id").alias("doc_id"))


CONCAT = FILES + """, a AS (SELECT artifact, string_agg('# ── ' || path || ' ──' || chr(10) || content, chr(10) || chr(10) ORDER BY path) AS content FROM files GROUP BY artifact)"""


@query(f"WITH {CONCAT} SELECT artifact, CAST(length(content) AS INTEGER) AS n_chars, sha256(content) AS hash FROM a")
def artifact_concat(spark: SparkSession, sf: str) -> DataFrame:
    return artifacts.concatenated(files(spark, sf)).select("artifact", F.length("content").alias("n_chars"), S.full_hash(F.col("content")).alias("hash"))


@query(f"""WITH {CONCAT}, now AS (SELECT artifact, substr(sha256(content), 1, 16) AS h FROM a WHERE artifact <> 'src1'),
past AS (SELECT artifact, substr(sha256(CASE WHEN artifact IN ('src2', 'src5') THEN content || 'x' ELSE content END), 1, 16) AS h FROM a WHERE artifact <> 'src4')
SELECT artifact, CASE WHEN p.h IS NULL THEN 'new' WHEN n.h IS NULL THEN 'removed' WHEN n.h = p.h THEN 'fresh' ELSE 'stale' END AS status FROM now n FULL JOIN past p USING (artifact)""")
def artifact_staleness(spark: SparkSession, sf: str) -> DataFrame:
    f = files(spark, sf)
    now = artifacts.fingerprints(f)
    changed = F.when(F.col("artifact").isin("src2", "src5"), F.concat("content", F.lit("x"))).otherwise(F.col("content"))
    then = artifacts.fingerprints(f.where("artifact <> 'src4'").withColumn("content", changed))
    return artifacts.staleness(now.where("artifact <> 'src1'"), then)


@query(f"WITH {FILES}, c AS (" + LINE_SQL.format(keys="artifact", more="") + " WHERE artifact <> 'src4'), p AS (SELECT artifact, count(*) AS n FROM c GROUP BY artifact) SELECT count(*) AS configured, count(n) AS indexed, CAST(coalesce(sum(n), 0) AS BIGINT) AS chunks FROM (SELECT DISTINCT artifact FROM files) LEFT JOIN p USING (artifact)")
def artifact_summary(spark: SparkSession, sf: str) -> DataFrame:
    f = files(spark, sf)
    return artifacts.summary(f, chunking.line_chunks(f.where("artifact <> 'src4'").select("artifact", "content"), 20, 2))


@query("""WITH m AS (SELECT source, max(doc_id) AS last_doc, count(*) AS files_total FROM documents GROUP BY source), g AS (SELECT source, count(*) AS graph_files FROM documents WHERE lang IN ('en', 'fr', 'de') GROUP BY source)
SELECT source AS project, last_doc, files_total, coalesce(graph_files, 0) AS graph_files FROM m LEFT JOIN g USING (source)""")
def list_projects(spark: SparkSession, sf: str) -> DataFrame:
    f = files(spark, sf)
    m = f.groupBy("artifact").agg(F.max("doc_id").alias("last_doc"), F.count(F.lit(1)).alias("files_total"))
    g = f.where(S.is_graphable(F.col("path"))).groupBy("artifact").agg(F.count(F.lit(1)).alias("graph_files"))
    return m.join(g, "artifact", "left").select(F.col("artifact").alias("project"), "last_doc", "files_total", F.coalesce("graph_files", F.lit(0)).alias("graph_files"))


@query("""WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM m) SELECT user_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS events FROM g GROUP BY user_id, g""")
def debounce_sessions(spark: SparkSession, sf: str) -> DataFrame:
    from orebody.streaming.watch import debounced

    e = table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return debounced(e, "ts", ["user_id"], "30 minutes").select("user_id", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"), "events")
