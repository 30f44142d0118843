"""Operator 3: language by n-gram filters whose cells hold a bit for every language.

A Bloom filter is kept bit-sliced: each of its cells is a mask of languages, so the AND of an n-gram's cells gives all
languages whose filter holds it. A text's n-grams are looked up once and counted for every language; each count is
corrected for that filter's false positives (its share of set cells to the power of the number of hashes), and the
largest corrected share decides; ties go to the language that sorts first.

The filters are learned from a bounded sample: per language the `sample` labelled rows with the smallest hash of their
id, out of those not held out (crc32 of the id as text, modulo 4, is 2). Of their n-grams a language keeps the `kept` most frequent that
are at least `share` as frequent as in the language that uses them most. Predictions read the text alone.

Null texts and texts without a letter are `und` with score 0, as are all if nothing can be learned; a text with letters of
which no n-gram is known gets the language that sorts first, with score 0. Rows with a null id
are never learned from and not held out. Rows may repeat, each gives one row; an empty table gives none. A very long text is
held once, with 8 bytes for each of its n-grams. Columns other than id, text and (for learning) language are not read. At most `kept` x languages n-grams reach the driver, and the
broadcast filter has cells x 8 bytes for each 64 languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orebody.llm.common import documents, first_by_hash

ORDERS = (2, 3, 4)
HASHES = 2
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD))


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


@lru_cache(1)
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str | None) -> np.ndarray:
    """Hashes of the text's n-grams over lower-case letters; any run of other characters counts as one gap."""
    code = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[code]
    if not letter.any():
        return np.empty(0, np.uint64)
    code = np.where(letter, code, 0).astype(np.uint64)
    # the first of a run of other characters stays; runs at the ends are the gaps that every text begins and ends with
    code = np.trim_zeros(code[letter | np.concatenate([[False], letter[:-1]])])
    code = np.concatenate([code[:1] * 0, code, code[:1] * 0])
    out, run = [], code + np.uint64(1)
    for n in range(2, max(ORDERS) + 1):
        if len(code) < n:
            break
        run = run[:-1] * MIX[0] + code[n - 1 :] + np.uint64(1)
        if n in ORDERS:
            out.append(run ^ (run >> np.uint64(29)))
    return np.concatenate(out) * MIX[2]


def cells_of(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    return [((hashes * m) >> np.uint64(64 - bits)).astype(np.int64) for m in MIX[:HASHES]]


class Filters:
    def __init__(self, languages: list[str], held: dict[str, np.ndarray], bits: int):
        self.languages, self.bits = languages, bits
        self.masks = np.zeros((-(-max(1, len(languages)) // 64), 1 << bits), np.uint64)
        for i, lang in enumerate(languages):
            for c in cells_of(held[lang], bits):
                self.masks[i // 64][c] |= np.uint64(1 << (i % 64))
        self.false = np.array([np.mean(self.masks[i // 64] >> np.uint64(i % 64) & np.uint64(1)) ** HASHES for i in range(len(languages))])

    def predict(self, text: str | None) -> tuple[str, float]:
        hashes = grams(text)
        if not len(hashes) or not self.languages:
            return "und", 0.0
        at = cells_of(hashes, self.bits)
        hit = []
        for row in self.masks:
            mask = row[at[0]]
            for c in at[1:]:
                mask &= row[c]
            hit.append(mask)
        n = np.array([np.count_nonzero(hit[i // 64] & np.uint64(1 << (i % 64))) for i in range(len(self.languages))])
        true = np.maximum(0, (n - len(hashes) * self.false) / (1 - self.false + 1e-12))
        best = int(np.argmax(true))  # languages are sorted
        return self.languages[best], float(true[best] / true.sum()) if true.sum() else 0.0


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 1500, kept: int = 30_000, share: float = 0.4, bits: int = 20) -> Filters:
    import pyarrow as pa

    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    ids = first_by_hash(labelled.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id")), "lang", "id", sample).select("id").distinct()
    chosen = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).join(F.broadcast(ids), "id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[str, list] = {}
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by.setdefault(lang, []).append(grams(text))
            for lang, found in by.items():
                g, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g.view(np.int64)), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    counted = chosen.select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rate = F.col("n") / F.sum("n").over(Window.partitionBy("lang"))
    most = counted.withColumn("rate", rate).withColumn("top", F.max("rate").over(Window.partitionBy("gram")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    rows = most.where(F.col("rate") >= share * F.col("top")).withColumn("rank", rank).where(F.col("rank") <= kept).select("lang", "gram").toPandas()
    held = {str(k): v.gram.to_numpy().astype(np.int64).view(np.uint64) for k, v in rows.groupby("lang")}
    return Filters(sorted(held), held, bits)


def identify(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: its id, lang_pred and score."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shared.value.predict(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(docs, learn(docs)).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
