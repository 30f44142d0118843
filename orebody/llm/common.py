"""Helpers that several operators share: shared scratch tables, free names, text access."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it. A local one is set only where it names none and
    all runs in one process; a cluster without such a folder is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file:///tmp/checkpoints/orebody"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def saved(df: DataFrame, name: str, **options: int) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").options(**options).parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release_path(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(keep: int = 0) -> None:
    """Deletes the scratch tables made so far, but for the last `keep`. Call it when their results are written."""
    while len(_made) > keep:
        spark, path = _made.pop(0)
        try:
            release_path(spark, path)
        except Exception:  # the session may have ended
            return


def discard(df: DataFrame) -> None:
    """Deletes one table that saved() made, when nothing reads it any more."""
    for at, (spark, path) in enumerate(_made):
        if any(path.split(":", 1)[-1].rsplit("/", 1)[-1] in f for f in df.inputFiles()[:1]):
            release_path(spark, path)
            del _made[at]
            return


atexit.register(release)


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with underscores if df has such a column (in any case of letters)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def pieces(batches: Iterable, rows: int = 512) -> Iterator:
    """Arrow batches cut to at most so many rows: what a worker holds of texts, and makes of them, stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def first_by_hash(rows: DataFrame, by: str, id_col: str, most: int) -> DataFrame:
    """Of each value of `by` the `most` rows with the smallest hash of their id (ties by id).

    Counts of 4,096 ranges of hashes tell which ranges are needed, so that the ranking sees hardly more than `most` rows of a
    value, though one may hold most of the table.
    """
    h, part, r, n = (fresh(rows, x) for x in ("_h", "_part", "_r", "_n"))
    hashed = rows.withColumn(h, F.xxhash64(id_col)).withColumn(part, F.shiftright(h, 52))
    counts = hashed.groupBy(by, part).agg(F.count(F.lit(1)).alias(n))
    before = F.sum(n).over(Window.partitionBy(by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    wanted = counts.withColumn(r, F.coalesce(before, F.lit(0))).where(F.col(r) < most).select(by, part)
    rank = F.row_number().over(Window.partitionBy(by).orderBy(h, id_col))
    return hashed.join(wanted, [by, part], "left_semi").withColumn(r, rank).where(F.col(r) <= most).drop(h, part, r)


def whole_text(col: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def free_memory(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of plans that nobody holds any more."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
