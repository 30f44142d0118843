"""Change detection between a stored file state and a new scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def file_changes(new: DataFrame, old: DataFrame, path: str = "path", hash_col: str = "content_hash") -> DataFrame:
    """path, old_hash, new_hash, status (added, changed, unchanged, removed)."""
    n = new.select(F.col(path), F.col(hash_col).alias("new_hash"))
    o = old.select(F.col(path), F.col(hash_col).alias("old_hash"))
    status = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").when(F.col("old_hash") == F.col("new_hash"), "unchanged").otherwise("changed")
    return n.join(o, path, "full_outer").select(path, "old_hash", "new_hash", status.alias("status"))


def restamped(listed: DataFrame, state: DataFrame) -> DataFrame:
    """listed: path, length, modified; state: those and content_hash as stored. path, length, modified, old_hash and listed of
    files whose length or time differs from the stored one, new ones and those that went: the only ones to look into."""
    old = state.select("path", F.col("content_hash").alias("old_hash"), F.col("length").alias("_length"), F.col("modified").alias("_modified"))
    both = listed.select("path", "length", "modified", F.lit(True).alias("listed")).join(old, "path", "full_outer")
    same = F.col("listed") & F.col("length").eqNullSafe(F.col("_length")) & F.col("modified").eqNullSafe(F.col("_modified")) & F.col("old_hash").isNotNull()
    return both.where(~F.coalesce(same, F.lit(False))).select("path", "length", "modified", "old_hash", F.coalesce("listed", F.lit(False)).alias("listed"))


def changed_files(new: DataFrame, old: DataFrame, path: str = "path", hash_col: str = "content_hash") -> DataFrame:
    """Rows of new that must be indexed: no stored row has their path and hash."""
    return new.join(old.select(path, hash_col), [path, hash_col], "left_anti")


def removed_files(new: DataFrame, old: DataFrame, path: str = "path") -> DataFrame:
    return old.join(new.select(path), path, "left_anti")


def change_counts(new: DataFrame, old: DataFrame) -> DataFrame:
    return file_changes(new, old).groupBy("status").agg(F.count(F.lit(1)).alias("files"))


def relative_keys(state: DataFrame, root: str | None = None, path: str = "path") -> DataFrame:
    """state with absolute paths made relative: to root, or to the longest folder that all share. Relative ones stay.

    The longest common prefix of all texts is that of the smallest and the largest.
    """
    if root is None:
        ends = state.agg(F.min(path).alias("a"), F.max(path).alias("b")).first()
        if ends.a is None or not ends.a.startswith("/") or not ends.b.startswith("/"):
            return state
        n = next((i for i, (x, y) in enumerate(zip(ends.a, ends.b)) if x != y), min(len(ends.a), len(ends.b)))
        prefix = ends.a[: ends.a.rfind("/", 0, n) + 1]
    else:
        prefix = root.rstrip("/") + "/"
    return state.withColumn(path, F.when(F.startswith(F.col(path), F.lit(prefix)), F.substring(F.col(path), F.lit(len(prefix) + 1), F.length(path))).otherwise(F.col(path)))
