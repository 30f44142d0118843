"""Operator 13: phrase collocation mining over vertical positional inverted lists.

Texts (A-Z lower-cased) are cut into pieces at `.,;:!?` and line ends, pieces into words at spaces and tabs. Every task numbers the
words of its documents, a place apart between pieces, and turns them into blocks: per word the sorted list of its places.
The length of a word's lists over all blocks is its exact frequency. A level extends the frequent phrases of each
block: the places of all lists are merge-joined with the places one further on of the adjacent lists (the words at first,
then the adjacent word's places already narrowed to the frequent phrases that share the words between), which gives the
longer phrase's list. Only lengths of lists leave a block; they are summed over blocks, and the phrases of at least
`least` occurrences get numbers, by which a block tells its frequent lists. Lists of the others end there.

Everything is per language (null: `und`); phrases have up to `longest` words. A phrase is cut after its k-th word into two
parts of frequency l and r and scored floor(scale x a / (l + r)); its lowest-scoring cut counts, the first of equals. A
candidate goes if a longer candidate holds it and occurs at least `inside` percent as often. Of the rest each language's
first `top` come out, by score, frequency and the bytes of the phrase.

Null and empty texts have no words. Rows may repeat and count each. A language without candidates gives no rows, an empty
table none. A document is never parted between blocks, so a very long one makes a block of its own size (4 bytes a word in the
table, some 50 at work). Blocks hold some `block` words of a task. Numbers of frequent phrases go to all tasks by broadcast
up to `max_broadcast_rows` (24 bytes a pair), by a shuffled join with the blocks' keys beyond. Products are decimals. Columns
other than text and language are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orebody.llm.common import discard, documents, free_memory, pieces, saved

#: Bytes: A-Z in lower case, ends of pieces as a full stop, tab as a space.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else 46 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
STEP = 1 << 22
#: Blocks are rows of megabytes: row groups of one or two, so that neither the writer nor a reader holds a file's blocks at once.
FEW_ROWS = {"parquet.block.size": 1 << 24, "parquet.page.size.row.check.min": 1}
#: Rows of numbers that a task packs at once.
PACKED = 1 << 20
#: Salts of the first of two rankings.
SALTS = 64


def tokens(raw: bytes) -> Iterator[list[bytes]]:
    """Words and full stops (one ends the text), some megabytes at a time."""
    plain = raw.translate(PLAIN) + b"."
    at = 0
    while at < len(plain):
        to = plain.find(b" ", at + STEP)
        to = len(plain) if to < 0 else to
        yield plain[at:to].replace(b".", b" . ").split(b" ")
        at = to


def blocks(rows: DataFrame, block: int) -> DataFrame:
    """rows: lang, text. block, lang, size (words), words, counts (lengths of their lists), places (the lists, joined)."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: dict[str, tuple[defaultdict, list[np.ndarray]]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, size
            for lang, (index, parts) in held.items():
                seq = np.concatenate(parts)
                counts = np.bincount(seq, minlength=len(index))
                counts[0] = 0  # full stops
                places = np.argsort(seq, kind="stable").astype(np.int32)[len(seq) - counts.sum() :]
                words = pa.array(list(index)[1:], pa.binary()).cast(pa.string())
                whole = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([lang], pa.string()), pa.array([len(places)]), whole(words), whole(pa.array(counts[1:].astype(np.int32))), pa.array([places.tobytes()], pa.binary())], ["block", "lang", "size", "words", "counts", "places"])
                number += 1
            held.clear()
            size = 0

        for b in pieces(batches):
            for lang, raw in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                if lang not in held:
                    index: defaultdict = defaultdict()
                    index.default_factory = index.__len__
                    index[b"."]
                    held[lang] = index, []
                index, parts = held[lang]
                for words in tokens(raw):
                    parts.append(np.fromiter(map(index.__getitem__, filter(None, words)), np.int32))
                    size += len(parts[-1])
                if size >= block:
                    yield from flush()
        yield from flush()

    return rows.select("lang", "text").mapInArrow(run, "block long, lang string, size long, words array<string>, counts array<int>, places binary")


def lists_of(counts: np.ndarray, places: np.ndarray, live: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the live lists in order, and for each the number of its list among ids."""
    start = np.cumsum(counts) - counts
    sizes = counts[live]
    take = np.repeat(start[live] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    at, of = places[take], np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
    order = np.argsort(at, kind="stable")
    return at[order], of[order]


class Numbers:
    """Ids of frequent phrases by their keys: words of a language, or pairs of ids."""

    def __init__(self, rows, names: list[str]):
        if len(names) == 1:
            self.words: dict[str, dict[str, int]] = {}
            for lang, word, i in zip(rows.lang, rows[names[0]], rows.id):
                self.words.setdefault(lang, {})[word] = i
        else:
            self.words = {}
            head, tail = (rows[n].to_numpy(np.int64) for n in names)
            self.heads, self.tails = np.unique(head), np.unique(tail)
            code = np.searchsorted(self.heads, head) * len(self.tails) + np.searchsorted(self.tails, tail)
            order = np.argsort(code)
            self.codes, self.ids = code[order], rows.id.to_numpy(np.int64)[order]

    def of(self, lang: str, keys: list) -> tuple[np.ndarray, np.ndarray]:
        """Which of the block's keys (an Arrow list, or one of heads and one of tails) are frequent, and their ids."""
        if len(keys) == 1:
            own = self.words.get(lang, {})
            ids = np.fromiter((own.get(w, -1) for w in keys[0].to_pylist()), np.int64, len(keys[0]))
            which = np.flatnonzero(ids >= 0)
            return which, ids[which]
        if not len(self.codes):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = []
        for known, own in zip((self.heads, self.tails), keys):
            own = own.to_numpy()
            place = np.minimum(np.searchsorted(known, own), len(known) - 1)
            at.append(np.where(known[place] == own, place, -1))
        code = np.where((at[0] >= 0) & (at[1] >= 0), at[0] * len(self.tails) + at[1], -1)
        place = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        which = np.flatnonzero(self.codes[place] == code)
        return which, self.ids[place[which]]


def merge_joined(block: int, lang: str, counts, places, which: np.ndarray, ids: np.ndarray):
    """The record of a block's lists one word longer, from the lists `which` with their ids."""
    import pyarrow as pa

    at, of = lists_of(counts.values.to_numpy().astype(np.int64), np.frombuffer(places.as_buffer(), np.int32), which, ids)
    # merge-join of the places with the places one further on
    after = np.searchsorted(at, at + 1)
    meets = np.flatnonzero((after < len(at)) & (at[np.minimum(after, len(at) - 1)] == at + 1)) if len(at) else np.empty(0, np.int64)
    key = of[meets].astype(np.int64) * len(ids) + of[after[meets]]
    order = np.argsort(key, kind="stable")
    key, found = key[order], at[meets][order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    lengths = np.diff(np.concatenate([first, [len(key)]])).astype(np.int32)
    heads, tails = np.divmod(key[first], max(1, len(ids)))
    whole = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), pa.array(a))
    return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([lang], pa.string()), whole(ids[heads]), whole(ids[tails]), whole(lengths), pa.array([found.tobytes()], pa.binary())], ["block", "lang", "heads", "tails", "counts", "places"])


LONGER = "block long, lang string, heads array<long>, tails array<long>, counts array<int>, places binary"


def extended(lists: DataFrame, keys: list[str], numbers) -> DataFrame:
    """lists: block, lang, keys (arrays), counts and places. The lists one word longer: block, lang, heads, tails (ids of the
    phrase without its last and without its first word), counts, places. numbers: a broadcast of Numbers."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1):
            lang = b.column(1)[0].as_py()
            yield merge_joined(b.column(0)[0].as_py(), lang, b.column(2)[0], b.column(3)[0], *numbers.value.of(lang, [c[0].values for c in b.columns[4:]]))

    return lists.select("block", "lang", "counts", "places", *keys).mapInArrow(run, LONGER)


def packed(live: DataFrame) -> DataFrame:
    """live: block, at, id. The same as few rows: block, at and ids (the numbers, joined), of some `PACKED` rows of a task each."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            block, at, ids = (np.concatenate(c) for c in zip(*held))
            order = np.argsort(block, kind="stable")
            cuts = np.flatnonzero(np.diff(block[order])) + 1
            rows = np.split(order, cuts)
            yield pa.RecordBatch.from_arrays([pa.array([block[r[0]] for r in rows]), pa.array([at[r].tobytes() for r in rows], pa.binary()), pa.array([ids[r].tobytes() for r in rows], pa.binary())], ["block", "at", "ids"])

        for b in batches:
            if b.num_rows:
                held.append(tuple(c.to_numpy() for c in b.columns))
                size += b.num_rows
            if size >= PACKED:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return live.mapInArrow(run, "block long, at binary, ids binary")


def extended_by_join(lists: DataFrame, found: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """The same, with numbers by a join of the blocks' keys. The numbers come to their block packed and before its lists, so no
    task gathers them as objects. Blocks without any go."""
    import pyarrow as pa

    held = lists.select("block", "lang", F.posexplode(F.arrays_zip(*keys)).alias("at", "x")).select("block", "lang", "at", *(F.col(f"x.{k}").alias(n) for k, n in zip(keys, names)))
    live = packed(held.join(found.select("lang", *names, "id"), ["lang", *names]).select("block", "at", "id"))
    rows = lists.select("block", "lang", "counts", "places").unionByName(live, allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, parts = None, []
        for b in pieces(batches, 1):
            block = b.column(0)[0].as_py()
            if block != of:
                of, parts = block, []
            if b.column(3)[0].is_valid:  # the lists end their block
                if parts:
                    at, ids = (np.concatenate(p) for p in zip(*parts))
                    order = np.argsort(at)
                    yield merge_joined(block, b.column(1)[0].as_py(), b.column(2)[0], b.column(3)[0], at[order].astype(np.int64), ids[order])
                parts = []
            else:
                parts.append((np.frombuffer(b.column(4)[0].as_buffer(), np.int32), np.frombuffer(b.column(5)[0].as_buffer(), np.int64)))

    return rows.repartition("block").sortWithinPartitions("block", F.col("places").isNotNull()).mapInArrow(run, LONGER)


def frequent(lists: DataFrame, keys: list[str], names: list[str], least: int, level: int) -> DataFrame:
    """Phrases whose lists are long enough over all blocks: lang, names (one of each array of keys), f, id."""
    lengths = lists.select("lang", F.explode(F.arrays_zip(*keys, "counts")).alias("x")).select("lang", *(F.col(f"x.{k}").alias(n) for k, n in zip(keys, names)), F.col("x.counts").alias("c"))
    found = lengths.groupBy("lang", *names).agg(F.sum("c").alias("f")).where(F.col("f") >= least)
    return found.withColumn("id", F.monotonically_increasing_id() + F.lit(level << 56))


def longer_lists(lists: DataFrame, found: DataFrame, keys: list[str], names: list[str], max_broadcast_rows: int) -> DataFrame:
    """extended(): the frequent phrases' numbers go to all tasks if they are few and short (16 bytes a word on average), by a
    shuffled join with the blocks' keys beyond."""
    size = found.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(names[0])) if len(names) == 1 else F.lit(0), F.lit(0)).alias("b")).first()
    if size.n <= max_broadcast_rows and size.b <= 16 * max_broadcast_rows:
        rows = found.select("lang", *names, "id").toPandas()
        return extended(lists, keys, lists.sparkSession.sparkContext.broadcast(Numbers(rows, names)))
    return extended_by_join(lists, found, keys, names)


def described(found: DataFrame, before: DataFrame) -> DataFrame:
    """id, lang, phrase, last (its last word), f, left and right (frequencies of its first and last 1, 2, ... words), subs (ids
    of the phrases of two words or more that it holds), of frequent phrases from those one word shorter."""
    side = lambda s, *columns: before.select(F.col("id").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in columns))
    both = found.join(side("head", "phrase", "left", "subs"), "head").join(side("tail", "last", "right", "subs"), "tail")
    phrase = F.concat_ws(" ", "head_phrase", "tail_last")
    one = F.size("head_left") == 1
    subs = F.when(one, F.array().cast("array<bigint>")).otherwise(F.array_distinct(F.concat(F.array("head", "tail"), "head_subs", "tail_subs")))
    return both.select("id", "lang", phrase.alias("phrase"), F.col("tail_last").alias("last"), "f", F.concat("head_left", F.array("f")).alias("left"), F.concat("tail_right", F.array("f")).alias("right"), subs.alias("subs"))


def cut(scale: int) -> Column:
    """The lowest score of all cuts, with its place and parts; the first of equals."""
    at = lambda parts, i: F.element_at(parts, i)
    product = (F.col("f").cast("decimal(20,0)") * F.lit(scale)).cast("decimal(38,0)")

    def of(k: Column) -> Column:
        left, right = at("left", k), at("right", F.size("left") - k)
        total = (left + right).cast("decimal(20,0)")
        return F.struct(((product - product % total) / total).cast("long").alias("score"), k.alias("k"), left.alias("l"), right.alias("r"))

    return F.array_min(F.transform(F.sequence(F.lit(1), F.size("left") - 1), of))


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, longest: int = 4, scale: int = 2_000_000, inside: int = 80, block: int = 2_000_000, max_broadcast_rows: int = 1_000_000) -> DataFrame:
    """All candidates that stay: lang, phrase, a, l, r, n, score."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    lists = saved(blocks(rows, block), "phrases-lists-1", **FEW_ROWS)
    sizes = saved(lists.groupBy("lang").agg(F.sum("size").alias("n")), "phrases-sizes")
    keys, names = ["words"], ["word"]
    found = saved(frequent(lists, keys, names, least, 1), "phrases-frequent-1")
    held = found.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", F.array("f").alias("left"), F.array("f").alias("right"), F.array().cast("array<bigint>").alias("subs"))
    candidates = None
    for level in range(2, longest + 1):
        free_memory(docs.sparkSession)
        longer = saved(longer_lists(lists, found, keys, names, max_broadcast_rows), f"phrases-lists-{level}", **FEW_ROWS)
        discard(lists)
        free_memory(docs.sparkSession)
        lists, keys, names = longer, ["heads", "tails"], ["head", "tail"]
        found = saved(frequent(lists, keys, names, least, level), f"phrases-frequent-{level}")
        free_memory(docs.sparkSession)
        held = saved(described(found, held), f"phrases-{level}")
        candidates = held if candidates is None else candidates.unionByName(held)
    discard(lists)

    longer = candidates.select(F.explode("subs").alias("id"), "f").groupBy("id").agg(F.max("f").alias("around"))
    stays = candidates.join(longer, "id", "left").where(F.coalesce(100 * F.col("around") < inside * F.col("f"), F.lit(True)))
    scored = stays.withColumn("cut", cut(scale)).join(sizes, "lang")
    return scored.select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score")


def best(phrases: DataFrame, top: int = 2000) -> DataFrame:
    """Each language's first `top` with their rank; ranked by salts first, so no task sorts all of a language."""
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    salted = phrases.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top).drop("salt")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best(mine(documents(spark, sf_dir))).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, row_number() OVER () AS no, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
e AS (SELECT lang, no, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM w),
x AS (SELECT lang, w AS w1, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4 FROM e WINDOW o AS (PARTITION BY no ORDER BY i)),
f AS (SELECT lang, concat_ws(' ', w1, w2, w3, w4) AS g, grouping_id(w2, w3, w4) AS z, count(*) AS f FROM x
      GROUP BY GROUPING SETS ((lang, w1), (lang, w1, w2), (lang, w1, w2, w3), (lang, w1, w2, w3, w4))
      HAVING count(*) >= 30 AND (z = 7 OR z = 3 AND w2 IS NOT NULL OR z = 1 AND w3 IS NOT NULL OR z = 0 AND w4 IS NOT NULL)),
s AS (SELECT lang, g, f, string_split(g, ' ') AS w FROM f),
b AS (SELECT lang, g, w, f AS a, unnest(range(1, len(w))) AS j FROM s WHERE len(w) > 1),
c AS (SELECT b.lang, b.g, b.w, b.a, b.j, x.f AS l, y.f AS r, (2000000::HUGEINT * b.a) // (x.f + y.f) AS score
      FROM b JOIN f x ON x.lang = b.lang AND x.g = array_to_string(b.w[1 : b.j], ' ') JOIN f y ON y.lang = b.lang AND y.g = array_to_string(b.w[b.j + 1 :], ' ')),
t AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
u AS (SELECT s.lang, array_to_string(s.w[i : i + m - 1], ' ') AS g, s.f FROM s, range(2, 4) t(m), range(1, 4) u(i) WHERE m < len(s.w) AND i + m - 1 <= len(s.w)),
o AS (SELECT lang, g, max(f) AS f FROM u GROUP BY ALL)
SELECT t.lang, row_number() OVER (PARTITION BY t.lang ORDER BY score DESC, a DESC, t.g) AS rank, t.g AS phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM t JOIN n USING (lang) LEFT JOIN o ON o.lang = t.lang AND o.g = t.g WHERE o.f IS NULL OR 100 * o.f < 80 * a QUALIFY rank <= 2000
"""
