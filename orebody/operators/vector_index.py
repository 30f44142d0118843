"""Dense neighbours by an inverted-file index: cells around centres, read nearest first, with bounds that prove what is left out.

Vectors are taken at unit length, so that nearer means a larger cosine. Centres come from distributed k-means rounds over a
bounded sample; every vector is then put into the cell of its nearest centre with its distance to it. A stored index is a
folder a cell, each sorted by that distance, and one row a cell (centre, size, least and largest distance).

A question reads the `probe` cells nearest to it. The triangle inequality then bounds what the others can hold: a vector x
of the cell around c is at least |d(q, c) - d(x, c)| away from q. Cells whose whole range of distances is too far are not
read at all; of the others only the vectors within reach are, which the sort by distance turns into skipped row groups.
With exact=True that second read makes the answer the same as a scan of all vectors; without it the answer is that of the
probed cells. What grows with the data is read by tasks; the driver holds centres (cells x length) and k rows a question.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orebody.operators.search import ranked
from orebody.sources.store import cut

#: Scores are told apart to so many places; bounds leave that much room.
DIGITS = 6
SLACK = 1e-5


def unit(rows: list) -> np.ndarray:
    x = np.array(rows, float)
    with np.errstate(invalid="ignore", divide="ignore"):
        return x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else x


def fit_centres(vectors: DataFrame, cells: int, id_col: str = "id", vector_col: str = "embedding", per_cell: int = 64, rounds: int = 8) -> np.ndarray:
    """Centres of at most `cells` cells, by k-means rounds over the cells x per_cell vectors with the smallest hash of their id."""
    import pyarrow as pa

    usable = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.exists("v", lambda x: x != 0))
    sample = cut(usable.orderBy(F.xxhash64("id"), "id").limit(cells * per_cell).repartition(max(1, cells * per_cell // 50_000)))
    centres = unit([r.v for r in sample.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(cells).collect()])
    for _ in range(rounds if len(centres) > 1 else 0):
        shared = sample.sparkSession.sparkContext.broadcast(centres)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros(shared.value.shape), np.zeros(len(shared.value), np.int64)
            for b in batches:
                x = unit(b.column(0).to_pylist())
                own = np.argmax(x @ shared.value.T, axis=1) if len(x) else np.empty(0, int)
                np.add.at(total, own, x)
                count += np.bincount(own, minlength=len(count))
            seen = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(list(total[seen]), pa.list_(pa.float64()))], ["cell", "total"])

        # one sum a cell and task meets the others by cell
        parts = sample.select("v").mapInArrow(sums, "cell int, total array<double>")
        whole = parts.groupBy("cell").agg(F.reduce(F.collect_list("total"), F.array_repeat(F.lit(0.0), centres.shape[1]), lambda a, x: F.zip_with(a, x, lambda p, q: p + q)).alias("total")).collect()
        moved = centres.copy()
        for r in whole:
            n = np.linalg.norm(r.total)
            if n:
                moved[r.cell] = np.array(r.total) / n
        shared.unpersist()
        done = np.allclose(moved, centres, atol=1e-4)
        centres = moved
        if done:
            break
    return centres


def assigned(vectors: DataFrame, centres: np.ndarray, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """id, embedding, cell and far (its distance to the cell's centre); vectors that are null or have no length have no cell."""
    import pyarrow as pa

    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = unit(b.column(1).to_pylist())
            if len(x) and len(shared.value):
                near = x @ shared.value.T
                cell = np.argmax(near, axis=1)
                far = np.sqrt(np.maximum(0, 2 - 2 * near[np.arange(len(x)), cell]))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell.astype(np.int32)), pa.array(far)], ["id", "embedding", "cell", "far"])

    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("embedding")).where(F.exists("embedding", lambda x: x != 0))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, embedding array<float>, cell int, far double")


class Read(NamedTuple):
    """What a search has read: cells and vectors, of how many."""

    cells: int
    of_cells: int
    vectors: int
    of_vectors: int


class VectorIndex:
    """An index in a folder; build() writes it, nearest() asks it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.read = Read(0, 0, 0, 0)

    def build(self, vectors: DataFrame, cells: int, id_col: str = "id", vector_col: str = "embedding", **fit) -> VectorIndex:
        centres = fit_centres(vectors, cells, id_col, vector_col, **fit)
        rows = assigned(vectors, centres, id_col, vector_col)
        # a very full cell is written by several tasks, each of them a range of distances
        kind = rows.schema["id"].dataType.simpleString()
        rows.repartitionByRange("cell", "far").sortWithinPartitions("cell", "far").write.partitionBy("cell").mode("overwrite").parquet(f"{self.path}/cells")
        per = self._rows(kind).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("far").alias("least"), F.max("far").alias("most"))
        table = self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
        # id tells the type of ids, also where there is no vector
        table.join(per, "cell").withColumn("id", F.lit(None).cast(rows.schema["id"].dataType)).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/centres")
        return self

    def _rows(self, kind: str | None = None) -> DataFrame:
        return self.spark.read.schema(f"id {kind or self._kind()}, embedding array<float>, far double, cell int").parquet(f"{self.path}/cells")

    def nearest(self, questions: list[list[float]], k: int = 10, probe: int = 1, exact: bool = True, only: DataFrame | None = None) -> DataFrame:
        """query (its place), id, score (cosine) and rank of the best k vectors of each question. Questions without length
        have none. only (id) narrows the vectors. `read` tells afterwards what was read."""
        q = unit(questions)
        cells = self.spark.read.parquet(f"{self.path}/centres").orderBy("cell").collect()
        live = np.flatnonzero(~np.isnan(q).any(axis=1)) if len(q) else []
        schema = f"query int, id {self._kind()}, score double, rank int"
        if not cells or not len(live):
            return self.spark.createDataFrame([], schema)
        number = np.array([c.cell for c in cells])
        away = np.sqrt(np.maximum(0, 2 - 2 * q @ np.array([c.centre for c in cells]).T))
        order = np.argsort(away, axis=1, kind="stable")
        first = {int(i): set(order[i, : max(1, probe)].tolist()) for i in live}
        wanted = {i: {int(number[c]): (0.0, 3.0) for c in own} for i, own in first.items()}
        found = self._search(q, k, wanted, only)
        best = found.collect()
        if exact:
            worst = {i: 3.0 for i in first}
            for r in best:
                if r["rank"] == k - 1:
                    worst[r["query"]] = float(np.sqrt(max(0.0, 2 - 2 * (r.score - SLACK))))
            more = {}
            for i in first:
                for c, row in enumerate(cells):
                    lo, hi = away[i, c] - worst[i] - SLACK, away[i, c] + worst[i] + SLACK
                    if c not in first[i] and lo <= row.most and hi >= row.least:
                        more.setdefault(i, {})[row.cell] = (lo, hi)
            if more:
                best += self._search(q, k, more, only).collect()
                for i, own in more.items():
                    wanted[i] |= own
        self.read = Read(len({c for own in wanted.values() for c in own}), len(cells), sum(r.n for r in cells if any(r.cell in own for own in wanted.values())), sum(r.n for r in cells))
        return ranked(self.spark.createDataFrame([(r["query"], r["id"], r["score"]) for r in best], schema.rsplit(",", 1)[0]), k, ("id",), ("query",))

    def _kind(self) -> str:
        return self.spark.read.parquet(f"{self.path}/centres").schema["id"].dataType.simpleString()

    def _search(self, q: np.ndarray, k: int, wanted: dict[int, dict[int, tuple[float, float]]], only: DataFrame | None) -> DataFrame:
        """The best k of each question among the vectors of its cells within its ranges of distance."""
        import pyarrow as pa

        by_cell: dict[int, list[int]] = {}
        for i, own in wanted.items():
            for c in own:
                by_cell.setdefault(c, []).append(i)
        rows = self._rows().where(F.col("cell").isin(*by_cell)).where(F.col("far").between(min(r[0] for own in wanted.values() for r in own.values()), max(r[1] for own in wanted.values() for r in own.values())))
        if only is not None:
            rows = rows.join(only.select("id"), "id", "left_semi")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cell, far, ids = b.column(2).to_numpy(), b.column(3).to_numpy(), b.column(0)
                place = np.unique(ids.to_pylist(), return_inverse=True)[1]  # ties go by id
                x = unit(b.column(1).to_pylist())
                for c in np.unique(cell).tolist():
                    at = np.flatnonzero(cell == c)
                    asked = by_cell[c]
                    scores = np.round(q[asked] @ x[at].T, DIGITS)
                    for i, own in zip(asked, scores):
                        lo, hi = wanted[i][c]
                        inside = np.flatnonzero((far[at] >= lo) & (far[at] <= hi) & ~np.isnan(own))
                        top = inside[np.lexsort((place[at[inside]], -own[inside]))[:k]]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top), i, np.int32)), ids.take(pa.array(at[top])), pa.array(own[top])], ["query", "id", "score"])

        found = rows.select("id", "embedding", "cell", "far").mapInArrow(run, f"query int, id {self._kind()}, score double")
        return ranked(found, k, ("id",), ("query",))
