"""Operator 12: toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's n-grams (`ORDERS`) are those of its lower-case letters, any run of other characters being one gap, hashed to 2^bits
cells. Each cell that occurs is a feature, and so is each density that it reaches (`LEVELS`: so many times, and once in so
many letters), for a fragment that clean texts hold by chance tells by its frequency alone. In the labelled rows each
feature gets the log ratio of its smoothed shares of toxic and of clean texts; those within `sure` standard errors of 0, as
of fragments seen in few texts, count for nothing. A logistic regression (Spark's, by L-BFGS, with an L2 penalty) is
fitted on presence times ratio, and a text's score is its sigmoid.

Labels are learned only from rows whose crc32(id as text) modulo 5 is not 0, at most `sample` of each class, those with the
smallest hash of their id; the text is all that a prediction reads. Label rows may repeat (toxic wins); null labels and null
ids are not used. With labels of one class only, or none, every score is the smoothed share of toxic labels, 0 without labels.

Null and empty texts have no features and get the score of the intercept. Rows may repeat, each gives one row; an empty table
gives none. A very long text is held in its row with some 50 bytes for each of its letters. Columns other than id and text are
not read. What tasks get by broadcast are features seen in the sample, of 2^bits cells at most, whatever the corpus' size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orebody.llm.common import documents, first_by_hash, pieces, saved
from orebody.llm.language_id import letters

ORDERS = (3, 4, 5, 6, 7)
#: Least count of an n-gram, and letters for each time it occurs at most (0: any number).
LEVELS = ((1, 0), (2, 1000), (3, 500))
MIX = np.uint64(0x9E3779B97F4A7C15)
STEP = 1 << 20


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def features(text: str | None, bits: int, known: np.ndarray | None = None) -> np.ndarray:
    """Distinct features of the text: cell x levels + level for each level that the cell reaches. known: a table of the cells
    wanted; others are left out."""
    code = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[code]
    if not letter.any():
        return np.empty(0, np.int64)
    code = np.where(letter, code, 0).astype(np.uint64)
    code = np.trim_zeros(code[letter | np.concatenate([[False], letter[:-1]])])
    code = np.concatenate([code[:1] * 0, code, code[:1] * 0]) + np.uint64(1)
    found = []
    for at in range(0, len(code), STEP):
        for n in ORDERS:
            # runs that begin in this step
            run = part = code[at : at + STEP + n - 1]
            for _ in range(n - 1):
                part = part[1:]
                run = run[: len(part)] * MIX + part
            cell = ((run ^ (run >> np.uint64(31))) * MIX >> np.uint64(64 - bits)).astype(np.int64)
            found.append(cell if known is None else cell[known[cell]])
    cell, times = np.unique(np.concatenate(found), return_counts=True)
    out = [cell * len(LEVELS)]
    for i, (least, every) in enumerate(LEVELS[1:], 1):
        out.append(cell[(times >= least) & (times * every >= len(code))] * len(LEVELS) + i)
    return np.concatenate(out)


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample: int) -> DataFrame:
    """id, toxic and text of the rows to learn from."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg((F.max("toxic") > 0).cast("int").alias("toxic")).where(~held_out("id"))
    here = known.join(docs.select(F.col(id_col).alias("id")), "id", "left_semi")
    chosen = first_by_hash(here, "toxic", "id", sample).select("id", "toxic")
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")


def with_features(rows: DataFrame, bits: int) -> DataFrame:
    """toxic and the text's features, as found."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            found = [features(t, bits).astype(np.int32) for t in b.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*found, np.empty(0, np.int32)])))], ["toxic", "found"])

    return rows.select("toxic", "text").mapInArrow(run, "toxic int, found array<int>")


class Classifier:
    """Sorted features with their weights (naive Bayes ratio times coefficient), and an intercept."""

    def __init__(self, bits: int, telling: np.ndarray, weights: np.ndarray, intercept: float):
        self.bits, self.telling, self.weights, self.intercept = bits, telling, weights, intercept

    @cached_property
    def known(self) -> np.ndarray:
        known = np.zeros(1 << self.bits, bool)
        known[self.telling // len(LEVELS)] = True
        return known

    def score(self, text: str | None) -> float:
        found = features(text, self.bits, self.known)
        at = np.minimum(np.searchsorted(self.telling, found), max(0, len(self.telling) - 1))
        z = self.intercept + (float(self.weights[at[self.telling[at] == found]].sum()) if len(found) else 0.0)
        return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


def ratios(seen: DataFrame, sizes: dict[int, int], sure: float) -> DataFrame:
    """feature and its log-count ratio, where that is more than `sure` standard errors from 0."""
    counts = seen.select("toxic", F.explode("found").alias("feature")).groupBy("feature").agg(*(F.count(F.when(F.col("toxic") == c, 1)).alias(f"c{c}") for c in (0, 1)))
    a, b = F.col("c1") + 0.5, F.col("c0") + 0.5
    one, none = float(sizes[1] + 1), float(sizes[0] + 1)
    ratio = F.log(a / one) - F.log(b / none)
    error = F.sqrt(F.greatest(F.lit(0.0), 1 / a - 1 / one) + F.greatest(F.lit(0.0), 1 / b - 1 / none))
    return counts.where(F.abs(ratio) > sure * error).select("feature", ratio.alias("ratio"))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 2_500, bits: int = 22, sure: float = 3.0, penalty: float = 1e-3, steps: int = 100) -> Classifier:
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import SparseVector, VectorUDT

    seen = saved(with_features(labelled(docs, labels, id_col, text_col, sample), bits), "toxicity-labelled")
    sizes = {r.toxic: r.n for r in seen.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    nothing = np.empty(0, np.int64), np.empty(0)
    if len(sizes) < 2:
        share = (sizes.get(1, 0) + 0.5) / (sum(sizes.values()) + 1) if sizes else 0.0
        return Classifier(bits, *nothing, math.log(share / (1 - share)) if share else -math.inf)
    # of 2^bits cells at most
    rows = ratios(seen, sizes, sure).orderBy("feature").toPandas()
    telling, scale = rows.feature.to_numpy().astype(np.int64), rows.ratio.to_numpy()
    if not len(telling):
        return Classifier(bits, *nothing, math.log(sizes[1] / sizes[0]))
    shared = seen.sparkSession.sparkContext.broadcast((telling, scale))

    @F.udf(VectorUDT())
    def scaled(found: list[int]) -> SparseVector:
        telling, scale = shared.value
        found = np.sort(np.array(found, np.int64))
        at = np.minimum(np.searchsorted(telling, found), len(telling) - 1)
        at = at[telling[at] == found]
        return SparseVector(len(scale), at, scale[at])

    fitted = LogisticRegression(featuresCol="features", labelCol="toxic", regParam=penalty, standardization=False, maxIter=steps, tol=1e-5).fit(saved(seen.select("toxic", scaled("found").alias("features")), "toxicity-features"))
    return Classifier(bits, telling, fitted.coefficients.toArray() * scale, float(fitted.intercept))


def toxicity(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: its id and score."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shared.value.score(t) for t in b.column(1).to_pylist()], pa.float64())], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = toxicity(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
