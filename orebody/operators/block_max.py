"""BM25 top-k over block-max postings: blocks that cannot reach the best k are never opened.

Texts are dealt by a hash of their id to segments of about `segment` texts. A block holds one term's postings in one segment,
beside the largest impact among them (the score without the term's rarity); a folder keeps the blocks, sorted by term and segment,
and apart from them a thin table without the lists.

A question reads the thin table's rows of its terms first. They give the terms' rarities and, summed over the terms, the most that
a text of each segment can score. The k-th largest impact of one term's blocks, times its rarity, is a score that
k texts reach for sure: the first threshold. Segments above it are opened in waves, the most promising first; each wave
scores its texts in full and raises the threshold for the next. The answer is that of scoring every posting.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orebody.operators.search import B, K1, counted, top
from orebody.sources.store import cut

DIGITS = 6
#: Rounded scores of equal sums may differ by so much.
SLACK = 2e-6


class Read(NamedTuple):
    """Blocks of the question's terms, and how many of them were opened."""

    opened: int
    blocks: int


def impact(tf: Column, dl: Column, average: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / average))


def rarity(df: Column, n: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


class BlockMax:
    """Postings in blocks, in a folder; build() writes them, best() asks them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.read = Read(0, 0)

    def build(self, docs: DataFrame, id_col: str, text: Column, segment: int = 64) -> BlockMax:
        """docs: one row a text. Texts without a token count for the statistics only."""
        rows = cut(counted(docs, id_col, text))
        size = docs.agg(F.count(F.lit(1)).alias("docs"))
        return self.from_postings(rows, size.join(F.broadcast(rows.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("tokens")))), segment)

    def from_postings(self, postings: DataFrame, stats: DataFrame, segment: int = 64) -> BlockMax:
        """postings: id, term, tf, dl; stats: one row, docs and tokens."""
        s = stats.first()
        average, segments = F.lit(float(s.tokens) / max(1, s.docs)), max(1, -(-s.docs // segment))
        rows = postings.select("term", "id", F.col("tf").cast("double").alias("tf"), F.col("dl").cast("double").alias("dl"), F.pmod(F.xxhash64("id"), F.lit(segments)).alias("segment"))
        # a block has at most the texts of a segment, so a term in every text spreads over all of them
        # dealt by ranges once: the blocks form and are written where their postings arrive
        blocks = rows.repartitionByRange("term", "segment").groupBy("term", "segment").agg(F.count(F.lit(1)).cast("int").alias("n"), F.max(impact(F.col("tf"), F.col("dl"), average)).alias("peak"), F.sort_array(F.collect_list(F.struct("id", "tf", "dl"))).alias("list"))
        blocks.sortWithinPartitions("term", "segment").write.mode("overwrite").option("parquet.bloom.filter.enabled#term", "true").parquet(f"{self.path}/blocks")
        thin = self.spark.read.parquet(f"{self.path}/blocks").select("term", "segment", "n", "peak")
        thin.sortWithinPartitions("term", "segment").write.mode("overwrite").option("parquet.bloom.filter.enabled#term", "true").parquet(f"{self.path}/peaks")
        self.spark.createDataFrame([(s.docs, float(s.tokens))], "docs long, tokens double").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/stats")
        return self

    def best(self, terms: list[str], k: int = 30, wave: int = 64, only: DataFrame | None = None) -> DataFrame:
        """id and score of the best k texts with one of the terms, by score and id. only (id) narrows the texts, not the
        statistics. `read` tells afterwards how many blocks were opened."""
        terms = list(dict.fromkeys(t.lower() for t in terms))
        blocks = self.spark.read.parquet(f"{self.path}/blocks")
        nothing = blocks.select(F.explode("list").alias("x")).select("x.id", F.lit(0.0).alias("score")).limit(0)
        if not terms:
            return nothing
        s = self.spark.read.parquet(f"{self.path}/stats").first()
        own = F.col("term").isin(*terms)
        peaks = cut(self.spark.read.parquet(f"{self.path}/peaks").where(own))
        df = {r.term: r.df for r in peaks.groupBy("term").agg(F.sum("n").alias("df")).collect()}  # a row a term
        if not df:
            return nothing
        weights = self.spark.createDataFrame([(t, n) for t, n in df.items()], "term string, df long").select("term", rarity(F.col("df").cast("double"), F.lit(float(s.docs))).alias("rarity"))
        most = cut(peaks.join(F.broadcast(weights), "term").groupBy("segment").agg(F.sum(F.col("rarity") * F.col("peak")).alias("most"), F.count(F.lit(1)).alias("blocks"), F.max(F.col("rarity") * F.col("peak")).alias("sure")))
        # one text a segment reaches `sure`; with a narrower set nothing is sure before texts are scored
        floor = 0.0
        if only is None:
            sure = [r.sure for r in most.orderBy(F.desc("sure")).limit(k).select("sure").collect()]
            floor = sure[-1] if len(sure) == k else 0.0
        average = F.lit(s.tokens / max(1, s.docs))
        found, opened, at = [], 0, None
        for width in (wave, 8 * wave, None):
            left = most.where(F.col("most") >= floor - SLACK)
            if at is not None:
                left = left.where((F.col("most") < at[0]) | ((F.col("most") == at[0]) & (F.col("segment") > at[1])))
            if width:  # two waves of so many segments; what their threshold leaves is opened at once
                chosen = left.orderBy(F.desc("most"), "segment").limit(width).collect()
                if not chosen:
                    break
                at = chosen[-1].most, chosen[-1].segment
                opened += sum(r.blocks for r in chosen)
                inside = blocks.where(own & F.col("segment").isin(*(r.segment for r in chosen)))
            else:
                opened += left.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
                inside = blocks.where(own).join(left.select("segment"), "segment", "left_semi")
            hits = inside.join(F.broadcast(weights), "term").select("rarity", F.explode("list").alias("x")).select("rarity", "x.*")
            if only is not None:
                hits = hits.join(only.select("id"), "id", "left_semi")
            scored = hits.groupBy("id").agg(F.round(F.sum(F.col("rarity") * impact(F.col("tf"), F.col("dl"), average)), DIGITS).alias("score"))
            found = sorted(found + [tuple(r) for r in top(scored, k, ties=("id",)).collect()], key=lambda r: (-r[1], r[0]))[:k]
            if len(found) == k:
                floor = max(floor, found[-1][1])
        self.read = Read(opened, peaks.count())
        return self.spark.createDataFrame(found, nothing.schema)
