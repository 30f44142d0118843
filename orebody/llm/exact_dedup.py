"""Operator 5: exact dedup by two passes over a Bloom filter.

The texts are read once for their SHA-256; a thin table of id, hash and a row number is written, and all passes run over it.
Pass one sends every hash to one of `cells_per_row` x rows cells and keeps the cells that two or more rows hit. A task's
share of such a filter is sparse, so tasks send set cells, counted map-side, and only the repeated ones are packed into
4 KB bitmaps. Pass two probes the bitmaps: rows in a cell hit once pass straight through; the others, and no more, shuffle by
their hash, are counted and get the row that stays. A filter too large to broadcast is joined with the thin rows by bitmap;
texts do not shuffle at any size.

Of equal texts the row with the largest doc_id stays; null ids count as smallest, and among rows that repeat an id and text
one stays. A null text equals the empty text. Empty tables give empty results. A very long text is hashed inside its row.
Other columns are not read, or pass through without_copies(); work columns take names that none of them has. Group sizes and
winners come from partial aggregation and a join that AQE may split, so one text may hold a third of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orebody.llm.common import documents, fresh, saved, whole_text

#: Bits of one bitmap_construct_agg bitmap.
BITMAP = 32768


def sha(text_col: str) -> Column:
    return F.unhex(F.sha2(whole_text(text_col), 256))


def verdicts(docs: DataFrame, id_col: str, text_col: str, cells_per_row: int, max_filter_bytes: int) -> DataFrame:
    """id, sha, keep_id, group_size and kept, one row for each row of docs."""
    thin = saved(docs.select(F.col(id_col).alias("id"), sha(text_col).alias("sha"), F.monotonically_increasing_id().alias("rid")), "exact-hashes")
    cells = 1 << max(15, (max(thin.count(), 1) * cells_per_row - 1).bit_length())
    hashed = thin.withColumn("cell", F.xxhash64("sha").bitwiseAND(F.lit(cells - 1)))

    seen_twice = hashed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    within = F.col("cell").bitwiseAND(F.lit(BITMAP - 1))
    filters = seen_twice.groupBy(F.shiftright("cell", 15).alias("no")).agg(F.bitmap_construct_agg(within).alias("bits"))
    if cells // 8 <= max_filter_bytes:
        filters = F.broadcast(filters)
    at = within.cast("int")
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    maybe = F.coalesce(F.getbit(byte, at.bitwiseAND(F.lit(7))) == 1, F.lit(False))
    probed = hashed.withColumn("no", F.shiftright("cell", 15)).join(filters, "no", "left").select("id", "sha", "rid", maybe.alias("maybe"))

    alone = probed.where("NOT maybe").select("id", "sha", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    shuffled = probed.where("maybe")
    groups = shuffled.groupBy("sha").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("id", "rid")).alias("last"))
    return alone.unionByName(shuffled.join(groups, "sha").select("id", "sha", F.col("last.id").alias("keep_id"), "group_size", (F.col("rid") == F.col("last.rid")).alias("kept")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cells_per_row: int = 16, max_filter_bytes: int = 64 << 20) -> DataFrame:
    """One row for each row of docs: its id, keep_id, group_size, kept and text_sha256.

    max_filter_bytes: the filter has cells_per_row / 8 bytes a row; up to this size it is broadcast.
    """
    found = verdicts(docs, id_col, text_col, cells_per_row, max_filter_bytes)
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cells_per_row: int = 16, max_filter_bytes: int = 64 << 20, max_broadcast_rows: int = 500_000) -> DataFrame:
    """docs with one row of each text. The rows that go are told to all by broadcast up to a checked number (about 50 bytes
    each), by a shuffled join beyond."""
    found = verdicts(docs, id_col, text_col, cells_per_row, max_filter_bytes).where("NOT kept")
    rid, key = fresh(docs, "_ob_id"), fresh(docs, "_ob_sha")
    # repeats of the row that stays cannot be told from it by id and text
    gone = saved(found.select(F.col("id").alias(rid), F.col("sha").alias(key), F.col("id").eqNullSafe(F.col("keep_id")).alias("repeat")).distinct(), "exact-gone")
    counts = {r.repeat: r.n for r in gone.groupBy("repeat").agg(F.count(F.lit(1)).alias("n")).collect()}

    def of(repeat: bool) -> DataFrame:
        rows = gone.where(F.col("repeat") == repeat).drop("repeat")
        return F.broadcast(rows) if counts.get(repeat, 0) <= max_broadcast_rows else rows

    same = (sha(text_col) == F.col(key)) & F.col(id_col).eqNullSafe(F.col(rid))
    left = docs.join(of(False), same, "left_anti") if counts.get(False) else docs
    if not counts.get(True):
        return left
    again = left.join(of(True), same, "left_semi").withColumn(key, sha(text_col)).dropDuplicates([id_col, key]).select(*docs.columns)
    return left.join(of(True), same, "left_anti").unionByName(again)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
