"""Operator 11: source divergence audit by two-dimensional tiles of group blocks.

A group is a language and a source. Terms are runs of letters (A-Z lower-cased, every character beyond ASCII counts as a
letter); a language keeps the terms of at least `min_docs` of its documents. A group's smoothed probability of a term is
p = 1 + floor(10^9 (count + 5) / (N + 5 V)), a language's the same over its own counts. Part `pair` gives, for each ordered
pair of a language's groups, the sum of |p - q| over all kept terms; part `term` the `top` kept terms of each group that
stand out most against the language.

Counts are aggregated inside tasks before they shuffle. A language's terms are hashed to chunks of about `chunk` terms and
numbered within them, so a group's counts are one packed vector (places and counts) a chunk. Each vector is replicated to
the tiles (own block, other block) of groups, `block` groups to a side; a task takes one tile over a strip of
`strip` chunks and walks through them, holding the two sides of one chunk as dense arrays and the tile's matrix of sums. A
chunk adds what it differs from the sum of terms that neither group has, so that strips and chunks without rows just add
up; the rest is added in one product at the end. So no task holds more than 2 x block x chunk numbers, and a large language
or a large vocabulary spreads over tiles and strips.

Null text, language and source count as ''. Documents without terms still make their group occur; a language that keeps no
terms has pairs of value 0 and no `term` rows; a language with one source has no pairs. Rows may repeat and each counts. An
empty table gives no rows. Very long texts are counted in steps. Columns other than the three are not read. Arithmetic is in
whole numbers: products that pass 64 bits are taken in steps of 10^3 or as decimals. Ties go by the bytes of the item.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orebody.llm.common import documents, pieces, saved
from orebody.llm.hashing import in_steps

SCALE, PRIOR = 1_000_000_000, 5
#: Bytes that are letters stay, A-Z in lower case; all others part terms.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Terms that a task holds before it sends its counts on.
HELD = 400_000


def term_counts(rows: DataFrame) -> DataFrame:
    """rows: lang, source, text. lang, source, term, n (occurrences), docs; term '' stands for the group itself."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in held.items():
                terms, size = pa.array(list(docs), pa.binary()).cast(pa.string()), len(docs)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), terms, pa.array([n[t] for t in docs], pa.int64()), pa.array(list(docs.values()), pa.int64())], ["lang", "source", "term", "n", "docs"])
            held.clear()

        for b in pieces(batches):
            for lang, source, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist()):
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                seen: set[bytes] = {b""}
                for words in in_steps(raw, LETTERS):
                    n.update(words)
                    seen.update(words)
                docs.update(seen)
            if sum(len(docs) for _, docs in held.values()) > HELD:
                yield from flush()
        yield from flush()

    return rows.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")


def probability(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE (count + PRIOR) / (total + PRIOR terms)), exactly."""
    above = ((count + PRIOR).cast("decimal(20,0)") * F.lit(SCALE)).cast("decimal(38,0)")
    below = (total + PRIOR * terms).cast("decimal(20,0)")
    # of a quotient rounded to 18 places only the whole part of an exact division is wanted: take the remainder off first
    return F.when(below > 0, ((above - above % below) / below).cast("long") + 1)


def probabilities(counts: np.ndarray, below: int) -> np.ndarray:
    """The same over an array; SCALE is taken as three steps of 1,000, so nothing passes 64 bits."""
    whole, rest = np.divmod(counts + PRIOR, below)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, below)
        whole = whole * 1000 + digit
    return whole + 1


class Tile:
    """Sums of |p - q| over the chunks seen so far, for groups `x` against groups `y` (each: number -> N + PRIOR V)."""

    def __init__(self, x: dict[int, int], y: dict[int, int]):
        self.x, self.y = x, y
        self.bare = [np.array([probabilities(np.zeros(1, np.int64), below)[0] if below else 0 for below in side.values()], np.int64) for side in (x, y)]
        self.sums = np.zeros((len(x), len(y)), np.int64)

    def add(self, width: int, vectors: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        dense = []
        for side, bare in zip((self.x, self.y), self.bare):
            p = np.repeat(bare[:, None], width, axis=1)
            for i, (number, below) in enumerate(side.items()):
                if number in vectors:
                    at, counts = vectors[number]
                    p[i, at] = probabilities(counts, below)
            dense.append(p)
        for i, p in enumerate(dense[0]):
            self.sums[i] += np.abs(dense[1] - p).sum(axis=1) - width * np.abs(self.bare[1] - self.bare[0][i])


def tile_sums(tiled: DataFrame, block: int) -> DataFrame:
    """tiled: lang, i, j, strip, chunk, no, below, width and counts (places and counts); chunk -1 announces a group. lang, a,
    b and the strip's share of their sum, for both orders of a pair."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, groups, tile = None, {}, None
        chunk, width, vectors = -1, 0, {}

        def end_chunk() -> None:
            nonlocal tile, vectors
            if vectors:
                tile = tile or made()
                tile.add(width, vectors)
                vectors = {}

        def made() -> Tile:
            side = lambda s: {no: below for no, below in groups.items() if no // block == s}
            return Tile(side(key[1]), side(key[2]))

        def end_tile() -> Iterator[pa.RecordBatch]:
            end_chunk()
            t = tile or made()
            a, b = (g.ravel() for g in np.meshgrid(np.array(list(t.x), np.int32), np.array(list(t.y), np.int32), indexing="ij"))
            value = t.sums.ravel()
            if key[1] == key[2]:
                a, b, value = a[a != b], b[a != b], value[a != b]
            else:
                a, b, value = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([value, value])
            yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(a), pa.string()), pa.array(a), pa.array(b), pa.array(value)], ["lang", "a", "b", "value"])

        for batch in batches:
            lists = batch.column(8)
            for r, (*now, c, no, below, w) in enumerate(zip(*(batch.column(x).to_pylist() for x in range(8)))):
                if now != key:
                    if key is not None:
                        yield from end_tile()
                    key, groups, tile, chunk, vectors = now, {}, None, -1, {}
                if c != chunk:
                    end_chunk()
                    chunk = c
                if c < 0:
                    groups[no] = below
                else:
                    packed = lists[r].values
                    width, vectors[no] = w, (packed.field(0).to_numpy(), packed.field(1).to_numpy())
        if key is not None:
            yield from end_tile()

    ordered = tiled.repartition("lang", "i", "j", "strip").sortWithinPartitions("lang", "i", "j", "strip", "chunk", "no")
    return ordered.select("lang", "i", "j", "strip", "chunk", "no", "below", "width", "counts").mapInArrow(run, "lang string, a int, b int, value long")


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 30, top: int = 50, chunk: int = 2048, block: int = 8, strip: int = 64) -> DataFrame:
    """lang, source, part, item, value and rank, as the module's text says."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    counts = saved(term_counts(rows).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "divergence-counts")
    of_term = Window.partitionBy("lang", "term")
    known = counts.where("term <> ''").withColumns({"lang_docs": F.sum("docs").over(of_term), "lang_n": F.sum("n").over(of_term), "least": F.min("source").over(of_term)})
    kept = saved(known.where(F.col("lang_docs") >= min_docs).select("lang", "source", "term", "n", "lang_n", (F.col("source") == F.col("least")).alias("first")), "divergence-kept")

    # one row a group and a language: sizes, numbers, how many blocks, chunks and strips there are
    by_lang = kept.where("first").groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    by_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    groups = counts.where("term = ''").select("lang", "source").join(by_group, ["lang", "source"], "left").join(by_lang, "lang", "left").select("lang", "source", zero("total"), zero("v"), zero("lang_total"))
    groups = groups.withColumns({"no": (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("int"), "blocks": F.ceil(F.count(F.lit(1)).over(Window.partitionBy("lang")) / block).cast("int")})
    groups = groups.withColumns({"below": F.col("total") + PRIOR * F.col("v"), "chunks": F.greatest(F.lit(1), F.ceil(F.col("v") / chunk)).cast("int")})
    groups = saved(groups.withColumn("strips", F.ceil(F.col("chunks") / strip).cast("int")), "divergence-groups")

    numbered = kept.join(groups.select("lang", "source", "no", "blocks", "chunks"), ["lang", "source"]).withColumn("chunk", F.pmod(F.xxhash64("term"), "chunks").cast("int"))
    of_chunk = Window.partitionBy("lang", "chunk")
    placed = numbered.withColumn("at", (F.dense_rank().over(of_chunk.orderBy("term")) - 1).cast("int")).withColumn("width", F.max("at").over(of_chunk) + 1)
    vectors = placed.groupBy("lang", "chunk", "no", "blocks", "width").agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("counts")).withColumn("below", F.lit(0).cast("long")).withColumn("strip", F.floor(F.col("chunk") / strip).cast("int"))
    announced = groups.select("lang", F.lit(-1).alias("chunk"), "no", "blocks", F.lit(0).alias("width"), F.array().cast("array<struct<at:int,n:bigint>>").alias("counts"), "below", F.explode(F.sequence(F.lit(0), F.col("strips") - 1)).alias("strip"))
    own, other = F.floor(F.col("no") / block).cast("int"), F.col("other")
    tiled = vectors.unionByName(announced).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least(own, other), "j": F.greatest(own, other)})
    sums = tile_sums(tiled, block).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))

    side = lambda s: groups.select("lang", F.col("no").alias(s), F.col("source").alias(f"source_{s}"), "v", probability(F.lit(0).cast("long"), F.col("total"), F.col("v")).alias(f"bare_{s}"))
    value = F.when(F.col("v") > 0, F.col("value") + F.col("v") * F.abs(F.col("bare_a") - F.col("bare_b"))).otherwise(F.lit(0).cast("long"))
    pairs = sums.join(side("a"), ["lang", "a"]).join(side("b").drop("v"), ["lang", "b"]).select("lang", F.col("source_a").alias("source"), F.lit("pair").alias("part"), F.col("source_b").alias("item"), value.alias("value"))

    scored = kept.where("n > 0").join(groups.select("lang", "source", "total", "v", "lang_total"), ["lang", "source"])
    excess = probability(F.col("n"), F.col("total"), F.col("v")) - probability(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    terms = scored.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), excess.alias("value")).where("value > 0")

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = lambda part: part.withColumn("rank", rank)
    return ranked(pairs).unionByName(ranked(terms).where(F.col("rank") <= top))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(documents(spark, sf_dir))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
t AS (SELECT lang, source, i, term, count(*) AS n FROM (SELECT lang, source, i, unnest(w) AS term FROM d) GROUP BY ALL),
v AS (SELECT lang, term, sum(n) AS n FROM t GROUP BY ALL HAVING count(*) >= 30),
l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM v GROUP BY lang),
c AS (SELECT t.lang, source, term, sum(t.n) AS n FROM t JOIN v USING (lang, term) GROUP BY ALL),
g AS (SELECT x.lang, x.source, coalesce(sum(c.n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n,
        1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.n + 5 * l.v) AS p,
        1 + (1000000000::HUGEINT * (v.n + 5)) // (l.n + 5 * l.v) AS q
      FROM g JOIN l USING (lang) JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
s AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
a AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(s.value, 0) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source
      UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM a QUALIFY part = 'pair' OR rank <= 50
"""
