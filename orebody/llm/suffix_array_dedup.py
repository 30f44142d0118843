"""Operator 7: removal of every long byte string that occurs again, by a logarithmic family of suffix arrays.

Candidates come as in repeats.py. Their contexts are routed by anchor and arrive in batches of about `batch` bytes. A batch
gets its suffix array: the places of all strings of `window` bytes in lexicographic order, by prefix doubling over ranks
of 8 bytes upwards. Long matches inside the batch are neighbours of one rank. What is left, one place a string, is
merge-scanned against the arrays of the levels before it, by fingerprints of the strings, and becomes a level; two levels of
about equal size merge into one array, so there are logarithmically many.

Text is taken as UTF-8 bytes, null as empty; a byte is removed if a string of `window` bytes over it starts anywhere
else in the table, the same document included. Shorter texts lose nothing. Rows that repeat an id and text are copies and
lose what is long enough; each input row gives one row, an empty table none; other columns are not read. A very long text is
one row of a worker, with 8 bytes for each of its bytes while its anchors are found, in steps. A group of more than `max_group`
contexts of one anchor is settled by counted windows instead, so that no worker holds an unbounded group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orebody.llm.common import documents, free_memory, saved
from orebody.llm.hashing import Hashes, bytes_of_texts
from orebody.llm.repeats import anchor_table, contexts, grouped, groups_in_order, keyed, merged, of_windows, repeated_anchors, runs_of, with_texts

WINDOW, K = 400, 200


def dense(keys: np.ndarray) -> np.ndarray:
    """The rank of each key among the distinct ones."""
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def window_ranks(data: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """Lexicographic ranks of the strings of `window` bytes at the starts; equal strings have equal ranks."""
    n, width = len(data), 8 if window >= 8 else 1
    padded = np.concatenate([data, np.zeros(width, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(width):
        key = key << np.uint64(8) | padded[j : j + n]
    rank = dense(key)
    while 2 * width <= window:  # ranks of twice as many bytes from pairs of ranks
        after = np.zeros(n, np.int64)
        after[: max(0, n - width)] = rank[width:] + 1
        rank = dense(rank * (n + 2) + after)
        width *= 2
    # two strings of that width, which may overlap, make up the window
    return dense(rank[starts] * (n + 2) + rank[starts + window - width])


class Level(NamedTuple):
    data: np.ndarray  #: bytes of its contexts
    starts: np.ndarray  #: the suffix array: places of distinct strings, in lexicographic order
    numbers: np.ndarray  #: what its owner calls each of them
    prints: np.ndarray  #: their fingerprints


class Levels:
    """Suffix arrays of geometrically growing size over the batches added so far."""

    def __init__(self, window: int, hashes: Hashes):
        self.window, self.hashes, self.levels, self.again = window, hashes, [], []

    def add(self, data: np.ndarray, starts: np.ndarray, numbers: np.ndarray) -> None:
        rank = window_ranks(data, starts, self.window)
        order = np.argsort(rank, kind="stable")
        rank, starts, numbers = rank[order], starts[order], numbers[order]
        same = rank[1:] == rank[:-1]
        if same.any():
            self.again.append(numbers[np.concatenate([[False], same]) | np.concatenate([same, [False]])])
        first = np.concatenate([[True], ~same])[: len(rank)]
        starts, numbers = starts[first], numbers[first]
        prints = of_windows(self.hashes.values[data], starts, self.window)
        for level in self.levels:
            by_print = np.argsort(level.prints)
            at = np.minimum(np.searchsorted(level.prints, prints, sorter=by_print), len(by_print) - 1)
            owner = by_print[at]
            hit = level.prints[owner] == prints
            if hit.any():
                self.again += [numbers[hit], level.numbers[owner[hit]]]
                starts, numbers, prints = starts[~hit], numbers[~hit], prints[~hit]
        if len(starts):
            self.levels.append(Level(data, starts, numbers, prints))
        while len(self.levels) > 1 and 2 * len(self.levels[-1].starts) >= len(self.levels[-2].starts):
            self.levels.append(self.merged(self.levels.pop(), self.levels.pop()))

    def merged(self, a: Level, b: Level) -> Level:
        """One array of two without common strings."""
        data, starts = np.concatenate([a.data, b.data]), np.concatenate([a.starts, b.starts + len(a.data)])
        order = np.argsort(window_ranks(data, starts, self.window))
        return Level(data, starts[order], np.concatenate([a.numbers, b.numbers])[order], np.concatenate([a.prints, b.prints])[order])

    def repeated(self) -> np.ndarray:
        return np.unique(np.concatenate(self.again)) if self.again else np.empty(0, np.int64)


def matches(routed: DataFrame, window: int, hashes: Hashes, batch: int = 1 << 20) -> DataFrame:
    """Spans of the contexts' windows that occur in another context."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, held, size, last = Levels(window, hashes), [], 0, None
        waiting: list[np.ndarray] = []
        first = 0

        def index() -> None:
            """The waiting contexts become a batch of the levels."""
            nonlocal first
            if waiting:
                lengths = np.array([len(x) for x in waiting])
                counts = lengths - window + 1
                begins = np.repeat(np.cumsum(lengths) - lengths, counts)
                within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                levels.add(np.concatenate(waiting), begins + within, np.arange(first, size))
                waiting.clear()
                first = size

        def finish() -> Iterator[pa.RecordBatch]:
            index()
            found = levels.repeated()
            base = np.array([h[0] for h in held] + [size])
            at = np.searchsorted(base, found, "right") - 1
            for i in np.unique(at):
                _, id_, key, lo = held[i]
                starts, ends = runs_of(found[slice(*np.searchsorted(at, [i, i + 1]))] - base[i] + lo, window)
                n = len(starts)
                yield pa.RecordBatch.from_arrays([pa.array([id_.as_py()] * n, id_.type), pa.array([key] * n, pa.int64()), pa.array(starts.astype(np.int32)), pa.array(ends.astype(np.int32))], ["id", "key", "s", "e"])

        waits = 0
        for fp, b in groups_in_order(batches):
            # windows of different anchors cannot match: start anew between groups when there is much
            if fp != last and size > batch // 2:
                yield from finish()
                levels, held, size, first, waits = Levels(window, hashes), [], 0, 0, 0
            last = fp
            for id_, key, lo, data in zip(b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4)):
                context = np.frombuffer(data.as_buffer(), np.uint8)
                waiting.append(context)
                held.append((size, id_, key, lo))
                size += len(context) - window + 1
                waits += len(context)
                if waits >= batch:
                    index()
                    waits = 0
        yield from finish()

    kind = routed.schema["id"].dataType.simpleString()
    return routed.repartition("fp").sortWithinPartitions("fp").mapInArrow(run, f"id {kind}, key long, s int, e int")


def repeated_spans(rows: DataFrame, window: int, k: int, max_group: int, max_broadcast_rows: int) -> DataFrame:
    hashes = Hashes()
    found = saved(repeated_anchors(saved(anchor_table(rows, hashes.of_texts_bytes, window, k, arrays=True), "anchors"), max_group), "anchors")
    free_memory(rows.sparkSession)
    whole = found.where("m > 1").select("id", "key", F.col("lo").alias("s"), (F.col("hi") + window).alias("e"))
    routed, single = contexts(rows, found.where("first AND mixed"), bytes_of_texts, window, max_broadcast_rows)
    parts = whole.unionByName(matches(routed, window, hashes))
    if not found.where("big").isEmpty():
        single = saved(single, "windows")
        twice = single.groupBy("win").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("win")
        parts = parts.unionByName(single.join(twice, "win").select("id", "key", F.col("lo").alias("s"), (F.col("lo") + window).alias("e")))
    return saved(parts, "spans")


def suffix_array_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, k: int = K, max_group: int = 4_000, max_broadcast_rows: int = 2_000_000) -> DataFrame:
    """One row for each row of docs: its id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes that stay)."""
    import pyarrow as pa

    rows = keyed(docs, id_col, text_col)
    spans = repeated_spans(rows, window, k, max_group, max_broadcast_rows)
    free_memory(docs.sparkSession)  # the shuffle files behind the spans
    joined = with_texts(rows, grouped(spans), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for text, items in zip(b.column(1).to_pylist(), b.column(3).to_pylist()):
                raw = text.encode("utf-8", "surrogatepass")
                cut = merged([x["s"] for x in items or ()], [x["e"] for x in items or ()])
                kept, at = [], 0
                for s, e in cut:
                    kept.append(raw[at:s])
                    at = e
                left = b"".join([*kept, raw[at:]])
                for column, value in zip(out, (len(raw), len(raw) - len(left), len(cut), hashlib.sha256(left).hexdigest(), left)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string()), pa.array(out[4], pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    kind = rows.schema["id"].dataType.simpleString()
    return joined.mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary").withColumnRenamed("id", id_col)


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array_dedup(documents(spark, sf_dir)).drop("kept")
