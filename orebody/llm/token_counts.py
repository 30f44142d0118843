"""Operator 4: token counts of whole texts, huge ones by overlap resynchronisation.

A document of more than `chunk` characters is encoded in chunks that overlap. Each chunk keeps the offsets at which its
pre-tokens end. Splitting runs from left to right and looks ahead one character, so once two chunks start a pre-token at
the same offset they agree on all that follows, until shortly before the end of the left chunk (`MARGIN`, the longest
special string and the looked-at character). The splice goes to the last such common boundary; where the overlap holds
none, it is widened (doubled) until one is found or the text ends. Memory is bounded by the chunk, but for a text that
has no boundary at all.

Null and empty texts have 0 bytes and 0 tokens; rows may repeat, each gives one row, an empty table none; other columns are not
read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession

from orebody.llm.common import documents
from orebody.llm.tokens import Bpe, bpe, vocabulary_path


def ends(encoder: Bpe, text: str, start: int, stop: int) -> list[int]:
    """Offsets where the pre-tokens of text[start:stop] end, after start itself."""
    return list(accumulate(map(len, encoder.split(text[start:stop])), initial=start))


def count_tokens(encoder: Bpe, text: str, chunk: int = 1 << 13, overlap: int = 512) -> int:
    """Tokens of the whole text; the same for any chunk and overlap over 0."""
    if len(text) <= chunk:
        return len(encoder.ids(text))
    margin = max([2, *(len(s) + 1 for s in encoder.special)])
    total, begin, stop = 0, 0, chunk  # begin is a true boundary, as shown by the splice before
    at = ends(encoder, text, begin, stop)
    while stop < len(text):
        width = overlap + margin
        while (left := stop - width) > begin:
            right = min(len(text), stop + chunk)
            at2 = ends(encoder, text, left, right)
            known = {p: i for i, p in enumerate(at2[: bisect_right(at2, stop)]) if i}  # the chunk's own start proves nothing
            # after a space the text left of the splice would split otherwise when it is encoded by itself
            common = next((p for p in reversed(at[1 : bisect_right(at, stop - margin)]) if p in known and not text[p - 1].isspace()), None)
            if common is not None:
                total += len(encoder.ids(text[begin:common]))
                begin, stop, at = common, right, at2[known[common] :]
                break
            width *= 2  # alignment failed: widen the overlap
        else:  # the overlap would reach the last splice: take more at once
            stop = min(len(text), stop + max(chunk, width))
            at = ends(encoder, text, begin, stop)
    return total + len(encoder.ids(text[begin:]))


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", chunk: int = 1 << 13, overlap: int = 512) -> DataFrame:
    """One row for each row of docs: its id, n_bytes, n_tokens, over_limit (more than `limit` tokens)."""
    import pyarrow as pa

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe(path)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = [count_tokens(encoder, t, chunk, overlap) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), vocabulary_path())
