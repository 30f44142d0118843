"""Embedding providers: each adds a vector of a text column. What a provider can do natively stays in the plan; a model is
called in Arrow batches, with texts cut to its context and failed batches tried again, then text by text."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructType

from orebody.functions.scalars import query_text, truncated
from orebody.operators.search import hashed_vector

#: Tokens of context of public models (by name without its tag), and lengths of their vectors.
CONTEXTS = {"nomic-embed-text": 2048, "mxbai-embed-large": 512, "snowflake-arctic-embed": 512, "all-minilm": 256, "text-embedding-3-small": 8191, "text-embedding-3-large": 8191, "text-embedding-ada-002": 8191, "gemini-embedding-001": 2048}
DIMENSIONS = {"nomic-embed-text": 768, "text-embedding-3-small": 1536, "gemini-embedding-001": 3072}


def context_of(model: str) -> int:
    """Tokens that a model takes; 0 if it is not known."""
    return CONTEXTS.get(model.split(":", 1)[0], 0)


class RateLimited(Exception):
    """Raised by a model's function when it must not be asked for a while."""


class Provider(Protocol):
    name: str
    dims: int

    def embed(self, rows: DataFrame, text: str = "text") -> DataFrame:
        """rows and `embedding`, null where a text could not be embedded."""


class Hashing:
    """A deterministic stand-in for a model, native, with no semantic quality."""

    def __init__(self, dims: int = 64):
        self.name, self.dims = "hashing", dims

    def embed(self, rows: DataFrame, text: str = "text") -> DataFrame:
        return rows.withColumn("embedding", hashed_vector(F.col(text), self.dims))


class Precomputed:
    """Vectors from a table: text, embedding."""

    def __init__(self, vectors: DataFrame, dims: int):
        self.name, self.dims, self.vectors = "precomputed", dims, vectors

    def embed(self, rows: DataFrame, text: str = "text") -> DataFrame:
        known = self.vectors.select(F.col("text").alias(text), F.col("embedding").cast("array<float>").alias("embedding")).dropDuplicates([text])
        return rows.join(known, text, "left")


class Model:
    """load() is called once in each worker and gives a function from texts to vectors."""

    def __init__(self, name: str, load: Callable[[], Callable[[list[str]], list[list[float]]]], dims: int | None = None, context: int | None = None, chars_per_token: float = 3.0, batch: int = 32, attempts: int = 3, first_wait: float = 0.5, rate_wait: float = 15.0):
        self.name, self.load, self.batch, self.attempts, self.first_wait, self.rate_wait = name, load, batch, attempts, first_wait, rate_wait
        self.dims = dims or DIMENSIONS.get(name.split(":", 1)[0], 0)
        self.context, self.chars_per_token = context_of(name) if context is None else context, chars_per_token
        if not self.dims:
            raise ValueError(f"the length of the vectors of {name} is not known: give dims")

    def ask(self, model: Callable, texts: list[str]) -> list[list[float]]:
        for i in range(self.attempts):
            try:
                found = model(texts)
                if len(found) != len(texts) or any(len(v) != self.dims for v in found):
                    raise ValueError(f"{self.name} gave other vectors than asked for")
                return found
            except Exception as e:
                if i == self.attempts - 1:
                    raise
                wait = self.first_wait * 2**i
                time.sleep(max(wait, self.rate_wait) if isinstance(e, RateLimited) else wait)
        return []

    def embed(self, rows: DataFrame, text: str = "text") -> DataFrame:
        import pyarrow as pa

        cut = rows.withColumn("_cut", truncated(F.col(text), self.context, self.chars_per_token) if self.context else F.col(text))
        columns = cut.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = self.load()
            for whole in batches:
                for at in range(0, whole.num_rows, self.batch):
                    b = whole.slice(at, self.batch)
                    texts = [t or "" for t in b.column(columns.index("_cut")).to_pylist()]
                    try:
                        found = self.ask(model, texts)
                    except Exception:  # one bad text must not take its neighbours along
                        found = []
                        for t in texts:
                            try:
                                found += self.ask(model, [t])
                            except Exception:
                                found.append(None)
                    kept = [c for n, c in zip(columns, b.columns) if n != "_cut"]
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.list_(pa.float32()))], [*(n for n in columns if n != "_cut"), "embedding"])

        schema = StructType([*(f for f in rows.schema if f.name != "embedding")]).add("embedding", ArrayType(FloatType()))
        return cut.mapInArrow(run, schema)


def query_vector(spark: SparkSession, provider: Provider, query: str) -> list[float] | None:
    """The vector of a question, which gets the prefix of questions."""
    return provider.embed(spark.createDataFrame([(query,)], "text string").withColumn("text", query_text(F.col("text")))).first().embedding
