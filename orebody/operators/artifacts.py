"""Context artifacts: named files or folders of non-code text that are chunked and searched beside the code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orebody.functions.scalars import artifact_chunk_id, capped
from orebody.operators.chunking import line_chunks


def concatenated(files: DataFrame) -> DataFrame:
    """files: artifact, path, content. artifact and its content: files in order of path, each under a header line."""
    part = F.concat(F.lit("# ── "), F.col("path"), F.lit(" ──\n"), F.col("content"))
    return files.groupBy("artifact").agg(F.array_sort(F.collect_list(F.struct("path", part.alias("part")))).alias("parts")).select("artifact", F.array_join(F.transform("parts", lambda p: p["part"]), "\n\n").alias("content"))


def artifact_chunks(artifacts: DataFrame, window: int = 100, overlap: int = 10) -> DataFrame:
    """artifacts: artifact, path, content. Empty content gives none; ids count lines from 0."""
    rows = line_chunks(artifacts.where(F.length("content") > 0), window, overlap)
    return rows.withColumn("id", artifact_chunk_id(F.col("path"), F.col("artifact"), F.col("start_line") - 1)).withColumn("chunk", capped(F.col("chunk")))


def fingerprints(files: DataFrame) -> DataFrame:
    """files: artifact, path, content. artifact and a hash of its files' paths and hashes in order: no whole artifact meets in a row."""
    own = F.struct("path", F.sha2("content", 256).alias("h"))
    per = files.groupBy("artifact").agg(F.array_sort(F.collect_list(own)).alias("f"))
    return per.select("artifact", F.substring(F.sha2(F.array_join(F.transform("f", lambda x: F.concat_ws(":", x.path, x.h)), "\n"), 256), 1, 16).alias("content_hash"))


def staleness(configured: DataFrame, stored: DataFrame) -> DataFrame:
    """configured and stored: artifact, content_hash. status: new, stale, fresh or removed."""
    now = configured.select("artifact", F.col("content_hash").alias("now"))
    then = stored.select("artifact", F.col("content_hash").alias("then"))
    status = F.when(F.col("then").isNull(), "new").when(F.col("now").isNull(), "removed").when(F.col("now") == F.col("then"), "fresh").otherwise("stale")
    return now.join(then, "artifact", "full_outer").select("artifact", status.alias("status"))


def summary(configured: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: configured and indexed artifacts and their chunks."""
    per = chunks.groupBy("artifact").agg(F.count(F.lit(1)).alias("n"))
    return configured.select("artifact").distinct().join(per, "artifact", "left").agg(F.count(F.lit(1)).alias("configured"), F.count("n").alias("indexed"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"))
