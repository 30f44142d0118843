"""Windows of a fixed number of tokens that occur again: candidates, contexts and spans for operators 7 and 8.

Anchors make the candidates few. Of the k-token runs inside each window the one with the smallest hash (leftmost on a
tie) is its anchor; equal windows have equal anchors at the same offset, so a window can only occur again if its anchor's
hash does. A document has about 2 / (window - k + 2) anchors a token; each stands for the range of windows that chose it.
Anchors of equal hash and equal context (all their windows) are settled by counting; only one of each context, where an
anchor's hash has several contexts, goes on to the operator's own index, routed by the anchor's hash.

Documents are told apart by id and a hash of id and text, so rows that repeat an id and text have the same spans.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orebody.llm.common import free_memory, saved, whole_text
from orebody.llm.hashing import at_places, doubled, joined, power_below

STEP = 1 << 21
#: Bytes of texts that are hashed at once; no more than STEP, for a byte may be a token.
SLICE = 1 << 19
#: What gives the tokens of an array of texts, one after another, and how many each text has.
Tokens = Callable[..., tuple[np.ndarray, np.ndarray]]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values."""
    n, have = len(x) - width + 1, 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:n], x[width - have :][:n])


def anchors(tokens: np.ndarray, counts: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """Document, hash, context hash, first and last window of each anchor. The documents' tokens lie one after another, counts
    says how many each has. More than STEP tokens are taken in steps of windows; only a document alone may have so many, so
    that its cuts, and with them its anchors, do not depend on its neighbours."""
    out = [[], [], [], [], []]
    base = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(counts)), counts)
    for at in range(0, max(0, len(tokens) - window + 1), STEP):
        part = tokens[at : at + STEP + window - 1]
        halves, n = doubled(part, k), len(part) - k + 1
        runs = joined(halves[:n], halves[k - power_below(k) :][:n], k)
        wide = doubled(halves, window, power_below(k))
        place = np.arange(n, dtype=np.uint64)
        least = sliding_min((runs >> np.uint64(32) << np.uint64(32)) | place, window - k + 1) & np.uint64(0xFFFFFFFF)
        # windows that lie in one document; anchors of different documents differ
        whole = np.flatnonzero(owner[at : at + len(least)] == owner[at + window - 1 :][: len(least)])
        if not len(whole):
            continue
        least = least[whole]
        cut = np.flatnonzero(least[1:] != least[:-1]) + 1
        lo, hi = whole[np.concatenate([[0], cut])], whole[np.concatenate([cut - 1, [len(least) - 1]])]
        anchor = least[np.concatenate([[0], cut])].astype(np.int64)
        # first and last window cover all between, for they overlap
        ends = joined(at_places(wide, window, lo), at_places(wide, window, hi), window)
        context = joined(ends, ((anchor - lo) << 32 | (hi - lo)).astype(np.uint64), k)
        doc = owner[lo + at]
        for column, values in zip(out, (doc, runs[anchor], context, lo + at - base[doc], hi + at - base[doc])):
            column.append(values)
    # hashes stay unsigned in an empty result too: joined with signed ones they would become floats
    return tuple(np.concatenate(c) if c else np.empty(0, kind) for c, kind in zip(out, (np.int64, np.uint64, np.uint64, np.int64, np.int64)))


def in_slices(batches: Iterator) -> Iterator:
    """Batches cut so that their texts (column 1) have at most SLICE bytes; a longer text is alone."""
    import pyarrow.compute as pc

    for b in batches:
        ends = np.cumsum(pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
            yield b.slice(at, to - at)
            at = to


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text")).withColumn("key", F.xxhash64("id", "text"))


def of_each(tokens: Callable[[str], np.ndarray]) -> Tokens:
    """The tokens of an array of texts, from what gives those of one."""

    def go(texts) -> tuple[np.ndarray, np.ndarray]:
        found = [tokens(t) for t in texts.to_pylist()]
        return np.concatenate(found), np.array([len(x) for x in found])

    return go


def anchor_table(rows: DataFrame, tokens: Callable, window: int, k: int, arrays: bool = False) -> DataFrame:
    """tokens: what gives the tokens of a text, or with `arrays` those of an array of texts."""
    import pyarrow as pa

    tokens = tokens if arrays else of_each(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            doc, fp, ctx, lo, hi = anchors(*tokens(b.column(1)), window, k)
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(ctx.view(np.int64)), b.column(0).take(take), b.column(2).take(take), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], ["fp", "ctx", "id", "key", "lo", "hi"])

    return rows.mapInArrow(run, f"fp long, ctx long, id {rows.schema['id'].dataType.simpleString()}, key long, lo int, hi int")


def repeated_anchors(table: DataFrame, max_group: int) -> DataFrame:
    """Anchors whose hash occurs again: id, key, fp, lo, hi; m: anchors of this context; first: whether it is the first of
    them by id, key and place; mixed: whether the hash has other contexts; big: whether it has more than max_group."""
    # written first, so that a join's sides are plain exchanges: AQE then splits the rows of a hot anchor
    repeated = saved(table.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fp"), "repeated-fp")
    rows = saved(table.join(repeated, "fp"), "repeated")
    free_memory(table.sparkSession)
    here = F.struct("id", "key", "lo")
    context = rows.groupBy("fp", "ctx").agg(F.count(F.lit(1)).alias("m"), F.min(here).alias("least"))
    kinds = context.groupBy("fp").agg(F.count(F.lit(1)).alias("kinds"))
    known = saved(context.join(kinds, "fp"), "contexts")
    return rows.join(known, ["fp", "ctx"]).select("id", "key", "fp", "lo", "hi", "m", here.eqNullSafe(F.col("least")).alias("first"), (F.col("kinds") > 1).alias("mixed"), (F.col("kinds") > max_group).alias("big"))


def with_texts(rows: DataFrame, by_doc: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined with one row a document."""
    right = by_doc.select(F.col("id").alias("_id"), F.col("key").alias("_key"), "items")
    return rows.join(right, (F.col("key") == F.col("_key")) & F.col("id").eqNullSafe(F.col("_id")), how).select("id", "text", "key", "items")


def contexts(rows: DataFrame, chosen: DataFrame, tokens: Tokens, window: int, max_broadcast_rows: int) -> tuple[DataFrame, DataFrame]:
    """Of the chosen anchors: their contexts (fp, id, key, lo, payload: the tokens of all their windows), and for those of
    big groups their single windows (win: hash, id, key, lo)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    kind = rows.schema["id"].dataType.simpleString()
    items = chosen.groupBy("id", "key").agg(F.collect_set(F.struct("lo", "hi", "fp", "big")).alias("items"))
    # broadcast up to a checked number of anchors, a shuffled join beyond
    joined = with_texts(rows, F.broadcast(items) if chosen.count() <= max_broadcast_rows else items)

    def run(big: bool):
        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in in_slices(batches):
                items = b.column(3).flatten()
                doc = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column(3)).to_numpy(zero_copy_only=False))
                lo, hi, fp, own = (items.field(i).to_numpy(zero_copy_only=False) for i in range(4))
                wanted = np.flatnonzero(own == big)
                if not len(wanted):
                    continue
                t, counts = tokens(b.column(1))
                doc, lo, hi, fp = doc[wanted], lo[wanted].astype(np.int64), hi[wanted].astype(np.int64), fp[wanted]
                begin = (np.cumsum(counts) - counts)[doc] + lo
                lengths = hi - lo + (1 if big else window)
                halves = doubled(t, window) if big else None
                # some anchors at a time, for their contexts overlap
                steps = np.flatnonzero(np.diff(np.cumsum(lengths) // STEP, prepend=0)).tolist()
                for x, y in zip([0, *steps], [*steps, len(doc)]):
                    if x == y:
                        continue
                    n = lengths[x:y]
                    ends = np.cumsum(n)
                    places = np.repeat(begin[x:y] - (ends - n), n) + np.arange(ends[-1])
                    if big:
                        take = np.repeat(doc[x:y], n)
                        first = at_places(halves, window, places).view(np.int64)
                        starts, data = np.repeat(lo[x:y] - (ends - n), n) + np.arange(ends[-1]), []
                    else:
                        take, first, starts, taken = doc[x:y], fp[x:y], lo[x:y], t[places]
                        offsets = np.concatenate([[0], ends * taken.itemsize]).astype(np.int32)
                        data = [pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(taken)])]
                    take = pa.array(take)
                    columns = [pa.array(first), b.column(0).take(take), b.column(2).take(take), pa.array(starts.astype(np.int32)), *data]
                    yield pa.RecordBatch.from_arrays(columns, (["win"] if big else ["fp"]) + ["id", "key", "lo"] + ([] if big else ["payload"]))

        return go

    routed = joined.mapInArrow(run(False), f"fp long, id {kind}, key long, lo int, payload binary")
    single = joined.where(F.exists("items", lambda x: x.big)).mapInArrow(run(True), f"win long, id {kind}, key long, lo int")
    return routed, single


def of_windows(tokens: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    return at_places(doubled(tokens, window), window, at)


def runs_of(at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Merged ranges covered by windows that begin at the sorted places."""
    if not len(at):
        return at, at
    cut = np.flatnonzero(np.diff(at) > window) + 1
    return at[np.concatenate([[0], cut])], at[np.concatenate([cut - 1, [len(at) - 1]])] + window


def merged(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """Maximal ranges of the union; ranges that touch are one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(zip(starts, ends)):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def grouped(spans: DataFrame) -> DataFrame:
    return spans.groupBy("id", "key").agg(F.collect_list(F.struct("s", "e")).alias("items"))


def groups_in_order(batches: Iterator) -> Iterator[tuple[int, list[dict]]]:
    """Rows of sorted batches by fp, group after group, in pieces of a batch at most."""
    for b in batches:
        fps = b.column(0).to_numpy(zero_copy_only=False)
        cuts = np.concatenate([[0], np.flatnonzero(fps[1:] != fps[:-1]) + 1, [len(fps)]]) if len(fps) else []
        for s, e in zip(cuts[:-1], cuts[1:]):
            yield int(fps[s]), b.slice(s, e - s)
