"""Operator 10: packing documents into windows by Karmarkar-Karp multiway differencing.

A document is its ids and an end id. Whole windows are cut from its front; the rest is cut into pieces of at most
`piece` ids, so that a window takes several. Pieces gather in batches of about `windows` windows, in input order and
within one task, so nothing shuffles and memory is bounded by the batch. Differencing keeps partial partitions ordered
by imbalance (largest minus smallest window) and merges the two most imbalanced, largest window against smallest,
until one partition is left. Its windows are nearly equal; if the largest exceeds the capacity, the number of windows
rises by one and the batch is packed anew.

Null text: empty, so the document is the end id alone. Rows may repeat; each row is packed by itself. Every row gives at
least one piece, an empty table none. A very long text is encoded whole in its row, some 4 bytes for each of its ids held, and
cut into as many windows as it fills. Columns other than id and text are not read, whatever their names. A sequence's id is the task's number times 2^33 plus a counter, the same in every attempt of a task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from orebody.llm.common import documents
from orebody.llm.tokens import bpe, vocabulary_path


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Indices of sizes in `windows` nearly equal windows (some may be empty), by multiway differencing."""
    # nodes: each is a set of pieces that lie together; left and right are its parts
    n = len(sizes)
    left, right = list(range(n)), [-1] * n
    heap = [(-s, i, np.array([s]), np.array([i])) for i, s in enumerate(sizes)]  # sums, largest first, and their nodes
    heapify(heap)
    ticket = n
    while len(heap) > 1:
        _, _, sa, na = heappop(heap)
        _, _, sb, nb = heappop(heap)
        over = len(sa) + len(sb) - windows
        if over <= 0:
            sums, nodes = np.concatenate([sa, sb]), np.concatenate([na, nb])
        else:  # the smallest of one join the largest of the other
            sb, nb = sb[::-1], nb[::-1]
            k, m = len(sa), len(sb)
            joined_s = sa[windows - m :] + sb[:over]
            joined_n = np.arange(len(left), len(left) + over)
            left.extend(na[windows - m :].tolist())
            right.extend(nb[:over].tolist())
            sums = np.concatenate([sa[: windows - m], joined_s, sb[over:]])
            nodes = np.concatenate([na[: windows - m], joined_n, nb[over:]])
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        ticket += 1
        heappush(heap, (-int(sums[0] - (sums[-1] if len(sums) == windows else 0)), ticket, sums, nodes))
    out = []
    for node in heap[0][3].tolist() if heap else []:
        pieces, stack = [], [node]
        while stack:
            x = stack.pop()
            if right[x] < 0:
                pieces.append(x)
            else:
                stack += [right[x], left[x]]
        out.append(pieces)
    return out


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of indices, none over capacity; sizes are at most capacity."""
    windows = -(-sum(sizes) // capacity)
    while True:
        found = difference(sizes, windows)
        if all(sum(sizes[i] for i in w) <= capacity for w in found):
            return found
        windows += 1


def packed_documents(docs: DataFrame, path: str, capacity: int = 1024, piece: int = 256, windows: int = 192, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece, as in the module's text; no sequence holds more than capacity ids."""
    import pyarrow as pa

    kind = docs.schema[id_col].dataType
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, end, sequence = bpe(path), end_id.to_bytes(4, "little"), TaskContext.get().partitionId() << 33
        ids = None
        out: list[list] = [[] for _ in names]
        loose: list[tuple] = []
        held = 0

        def put(piece_row: tuple, offset: int) -> None:
            for column, value in zip(out, (*piece_row, sequence, offset)):
                column.append(value)

        def flush() -> None:
            nonlocal sequence, held
            for window in pack([x[2] for x in loose], capacity):
                at = 0
                for i in window:
                    put(loose[i], at)
                    at += loose[i][2]
                sequence += bool(window)
            loose.clear()
            held = 0

        for b in batches:
            ids = b.column(0)
            for i, t in enumerate(b.column(1).to_pylist()):
                data = encoder.ids(t or "").astype("<u4").tobytes() + end
                n, at = len(data) // 4, 0
                while at < n:
                    whole = n - at >= capacity
                    size = capacity if whole else min(piece, n - at)
                    row = (ids[i], at, size, zlib.crc32(data[4 * at : 4 * (at + size)]), n)
                    at += size
                    if whole:
                        put(row, 0)
                        sequence += 1
                    else:
                        loose.append(row)
                        held += size
                if held >= windows * capacity:
                    flush()
                if len(out[0]) > 20_000:
                    yield batch(out, ids.type)
                    out = [[] for _ in names]
        if loose:
            flush()
        if out[0]:
            yield batch(out, ids.type)

    def batch(out: list[list], id_type: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x.as_py() for x in out[0]], id_type), *(pa.array(c, pa.int64()) for c in out[1:])], names)

    schema = f"id {kind.simpleString()}, " + ", ".join(f"{x} long" for x in names[1:])
    return docs.select(id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(documents(spark, sf_dir), vocabulary_path())
