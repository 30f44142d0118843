"""A corpus from raw documents to packed training sequences: five stages, each by one operator of orebody.llm.

Each stage takes all rows that its predecessor kept and returns the columns of documents; the last returns the packing's
pieces. Stages do not depend on ids being unique or present, and extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orebody.llm.common import documents, saved
from orebody.llm.exact_dedup import without_copies
from orebody.llm.minhash_dedup import without_near_duplicates
from orebody.llm.mixing import mix
from orebody.llm.packing import packed_documents
from orebody.llm.quality_rules import quality
from orebody.llm.tokens import vocabulary_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines that fail go from the others, whose n_chars follows."""
    judged, out = quality(docs)
    # a plain filter would be pushed below the verdict and work it out a second time
    kept = judged.select(*docs.columns, F.explode(F.filter(F.array(out), lambda v: v.kept)).alias(out))
    lost = F.col(f"{out}.lost_chars") > 0
    text = F.when(lost, F.col(f"{out}.cleaned_text")).otherwise(F.col("text"))
    n_chars = {"n_chars": F.when(lost, F.length(f"{out}.cleaned_text").cast("long")).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {}
    return kept.withColumns({"text": text, **n_chars}).select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row of the largest id stays."""
    return without_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return without_near_duplicates(docs)


def target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose rate gives them no copy go. Rates are bound by 1 here: after two stages of dedup none is repeated."""
    mixed, out = mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), max_rate=1.0)
    return mixed.where(F.col(out).copies > 0).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens."""
    return packed_documents(docs, vocabulary_path())


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("MinHash near-dedup", near_copies),
    ("mixing sources to target weights", target_weights),
    ("packing", packing),
]

#: Tokenisation, sketches and least squares are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-').lower()}")
    return STAGES[-1][1](spark, docs, sf_dir)
