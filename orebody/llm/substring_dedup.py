"""Operator 8: removal of word sequences that occur earlier, by suffix automata of reference shards.

The reference is the corpus itself, which has no proven size bound, so its automata are not broadcast: candidates come as
in repeats.py, and both the reference and the documents' contexts are routed to shards by anchor. In a shard the
contexts stream in order of document and place: each is first run through the automaton of all contexts before it, which
gives the length of the longest match ending at every word (matching statistics); where it reaches the threshold, the
window that ends there occurs earlier. Then the context itself is added. Shards of a very common anchor (more than
max_group different contexts) are split by window, which leaves a count of equal windows.

Words are runs of characters other than space and tab to carriage return, unchanged; null texts have none. Of equal windows
the one of the smallest doc_id, and in it of the smallest start, stays (a null id is smallest; documents that share an id
are ordered by a hash of their text; rows that repeat id and text count as one document). Each input row gives one row, an
empty table none; other columns are not read. A very long text is hashed in steps, with 8 bytes held for each of its words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orebody.llm.common import documents, free_memory, saved
from orebody.llm.hashing import Hashes
from orebody.llm.repeats import anchor_table, contexts, grouped, keyed, merged, repeated_anchors, runs_of, with_texts

WINDOW, K = 20, 8


class Automaton:
    """Generalised suffix automaton of the sequences added so far."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, tokens: list[int]) -> None:
        step, link, length = self.next, self.link, self.length
        last = 0
        for c in tokens:
            q = step[last].get(c)
            if q is not None and length[q] == length[last] + 1:
                last = q
                continue
            if q is None:
                new = len(step)
                step.append({})
                length.append(length[last] + 1)
                link.append(0)
                p = last
                while p >= 0 and c not in step[p]:
                    step[p][c] = new
                    p = link[p]
                q = step[p][c] if p >= 0 else None
            else:
                new, p = None, last
            if q is None:
                target = 0
            elif length[q] == length[p] + 1:
                target = q
            else:  # q stands for longer strings too: split it
                target = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = target
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = target
                    p = link[p]
            if new is None:
                last = target
            else:
                link[new] = target
                last = new

    def matching(self, tokens: list[int]) -> list[int]:
        """For each place, the length of the longest sequence ending there that was added before."""
        step, link, length = self.next, self.link, self.length
        state, n, out = 0, 0, []
        for c in tokens:
            while state and c not in step[state]:
                state = link[state]
                n = length[state]
            if c in step[state]:
                state = step[state][c]
                n += 1
            out.append(n)
        return out


def matches(routed: DataFrame, window: int) -> DataFrame:
    """Spans of the contexts' windows that occur in an earlier context."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = before = automaton = latest = None
        for b in batches:
            take, starts, ends = [], [], []
            for i, (fp, id_, key, lo, data) in enumerate(zip(*(b.column(c).to_pylist() for c in range(5)))):
                if fp != last:
                    automaton, last, before, latest = Automaton(), fp, None, None
                if (id_, key, lo) == before:  # a row that repeats id and text: the same document
                    continue
                before = id_, key, lo
                tokens = np.frombuffer(data, np.uint64).tolist()
                if latest is not None:  # a context is added when another comes, so the last of a shard never is
                    automaton.add(latest)
                    found = np.array(automaton.matching(tokens))
                    s, e = runs_of(np.flatnonzero(found >= window) - window + 1 + lo, window)
                    take += [i] * len(s)
                    starts += s.tolist()
                    ends += e.tolist()
                latest = tokens
            if take:
                at = pa.array(take)
                yield pa.RecordBatch.from_arrays([b.column(1).take(at), b.column(2).take(at), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["id", "key", "s", "e"])

    kind = routed.schema["id"].dataType.simpleString()
    return routed.repartition("fp").sortWithinPartitions("fp", "id", "key", "lo").mapInArrow(run, f"id {kind}, key long, s int, e int")


def earlier_spans(rows: DataFrame, window: int, k: int, max_group: int, max_broadcast_rows: int) -> DataFrame:
    words = Hashes().of_texts_words
    found = saved(repeated_anchors(saved(anchor_table(rows, words, window, k, arrays=True), "anchors"), max_group), "anchors")
    free_memory(rows.sparkSession)
    copies = found.where("NOT first").select("id", "key", F.col("lo").alias("s"), (F.col("hi") + window).alias("e"))
    routed, single = contexts(rows, found.where("first AND mixed"), words, window, max_broadcast_rows)
    parts = copies.unionByName(matches(routed, window))
    if not found.where("big").isEmpty():
        single = saved(single, "windows")
        here = F.struct("id", "key", "lo")
        earliest = single.groupBy("win").agg(F.min(here).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
        parts = parts.unionByName(single.join(earliest, "win").where(~here.eqNullSafe(F.col("least"))).select("id", "key", F.col("lo").alias("s"), (F.col("lo") + window).alias("e")))
    return saved(parts, "spans")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, k: int = K, max_group: int = 2_500, max_broadcast_rows: int = 2_000_000) -> DataFrame:
    """One row for each row of docs: its id, n_words, n_removed, kept_sha256 and kept (the words that stay, one space between)."""
    import pyarrow as pa

    rows = keyed(docs, id_col, text_col)
    spans = earlier_spans(rows, window, k, max_group, max_broadcast_rows)
    free_memory(docs.sparkSession)  # the shuffle files behind the spans
    joined = with_texts(rows, grouped(spans), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for text, items in zip(b.column(1).to_pylist(), b.column(3).to_pylist()):
                words = text.encode("utf-8", "surrogatepass").split()  # of bytes: at space and tab to carriage return only
                kept, at = [], 0
                for s, e in merged([x["s"] for x in items or ()], [x["e"] for x in items or ()]):
                    kept += words[at:s]
                    at = e
                kept += words[at:]
                left = b" ".join(kept)
                for column, value in zip(out, (len(words), len(words) - len(kept), hashlib.sha256(left).hexdigest(), left)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in out[:2]), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())], ["id", "n_words", "n_removed", "kept_sha256", "kept"])

    kind = rows.schema["id"].dataType.simpleString()
    return joined.mapInArrow(run, f"id {kind}, n_words long, n_removed long, kept_sha256 string, kept string").withColumnRenamed("id", id_col)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir)).drop("kept")


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20)),
r AS (SELECT doc_id, i FROM g QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
c AS (SELECT DISTINCT doc_id, i + k AS p FROM r, range(20) t(k)),
x AS (SELECT doc_id, list(p) AS ps FROM c GROUP BY doc_id),
k AS (SELECT w.doc_id, w.w, coalesce(x.ps, []) AS ps FROM w LEFT JOIN x USING (doc_id)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM w) e WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = e.doc_id AND c.p = e.p) GROUP BY doc_id)
SELECT k.doc_id, CAST(len(k.w) AS BIGINT) AS n_words, CAST(len(k.ps) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256 FROM k LEFT JOIN kept USING (doc_id)
"""
