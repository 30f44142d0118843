"""Operator 9: near-duplicates by bottom-k sketches of one hash function.

A document's set is its distinct shingles of five words; its sketch the `k` smallest hashes of them. Documents with
equal sets form a class, and only classes go on. Two sets of the wanted similarity share so many retained values
(`needed`; at k = 48 and 75 %, 20 of them but for one pair in some millions; with sets that their partners' sketches hold
whole, always) that they share one of the rarest size - needed + 1 of each. So only those are kept in the inverted lists,
which leaves out values that a common passage gives to many documents.

Each list's classes are held against its pivot, the class that shares most values: pairs pass if the sketch of their union
has enough values of both, and those are confirmed on full sets. Pairs of one component need no further test, so a group
of copies costs its size, not its square. Lists that still hold several components give their classes to a second
inverted index, this time of full sets (k without bound), ordered the same way, rarest shingle first. Its counts show
each list's true centre, against which those outside the main component are held once more. What then lies apart meets at
a shingle only if the shingles from there on suffice, on either side, for the overlap that the two sizes ask for. That is
exact, and settles most texts that are far from everything without a single pair. All pairs are confirmed on full sets.

One row comes for each input row. Null and empty texts have no shingles and are linked with nothing. Rows that repeat an
id and text share their class; component_id is the smallest id of all classes connected (null ids count only if there is
no other). Very long texts are hashed in steps and held as 8 bytes a shingle. An empty table gives no rows; other columns
are not read. Joins and counts pre-aggregate; hot keys are split by AQE; nothing but counts reaches the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orebody.llm.common import documents, fresh, pieces, saved
from orebody.llm.components import components
from orebody.llm.hashing import Hashes

K = 48


def node_of(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int, k: int, hashes: Hashes) -> DataFrame:
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            nodes, sizes, values = [], [], []
            for t in b.column(1).to_pylist():
                s = hashes.shingle_set(t, width)
                nodes.append(node_of(s))
                sizes.append(len(s))
                values.append(s[:k])
            offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
            flat = np.concatenate(values) if values else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["id", "key", "node", "n", "sketch"])

    return docs.select(id_col, text_col, F.xxhash64(id_col, text_col)).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, key long, node long, n long, sketch array<long>")


def least_shared(percent: int) -> int:
    """Of K values of a union's sketch, those that two sets of this similarity share: the mean less 16/3 standard errors."""
    share = percent / 100
    return max(1, math.floor(K * share - 16 / 3 * math.sqrt(K * share * (1 - share))))


def needed(n: Column, percent: int) -> Column:
    """Retained values that a set of n shingles shares with any set similar to it."""
    whole = F.ceil(percent * n / 100)  # every set similar to so small a one is its own sketch
    return F.greatest(F.lit(1), F.when(100 * n <= percent * K, whole).otherwise(F.floor(F.least(n, F.lit(K)) * least_shared(percent) / K))).cast("int")


def similar_sizes(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def similar(common: Column, a: Column, b: Column, percent: int) -> Column:
    return 100 * common >= percent * (a + b - common)


def sides(pairs: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    """Pairs (x, y) with the columns of both. y is joined last: if it meets many x, its columns do not travel with each."""
    for s in ("x", "y"):
        pairs = pairs.join(table.select(F.col("node").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in columns)), s)
    return pairs


def estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose union's sketch holds enough common values; exact where both sketches are whole sets."""
    both = sides(pairs, classes, "n", "sketch").withColumn("common", F.array_intersect("sketch_x", "sketch_y"))
    union = F.slice(F.array_sort(F.array_union("sketch_x", "sketch_y")), 1, K)
    whole = (F.col("n_x") <= K) & (F.col("n_y") <= K)
    enough = F.size(F.array_intersect("common", union)) * K >= least_shared(percent) * F.size(union)
    return both.where(F.size("common") >= F.greatest(needed(F.col("n_x"), percent), needed(F.col("n_y"), percent))).where(F.when(whole, similar(F.size("common"), F.col("n_x"), F.col("n_y"), percent)).otherwise(enough)).select("x", "y")


def full_sets(nodes: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int, max_broadcast_rows: int, hashes: Hashes) -> DataFrame:
    """node and shingles (array of hashes) of each of the nodes, from the text of a document of that class."""
    import pyarrow as pa

    wanted = saved(nodes.join(classes.select("node", "rep"), "node").select("rep", F.col("node").alias("wanted")), "near-nodes")
    # 16 bytes a row: small enough to broadcast up to a checked number, a shuffled join beyond
    few = F.broadcast(wanted) if wanted.count() <= max_broadcast_rows else wanted
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(few, F.col("id").eqNullSafe(F.col("rep"))).select("wanted", "text")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            sets = [hashes.shingle_set(t, width) for t in b.column(1).to_pylist()]
            # an id may repeat with another text
            found = [(w, s) for w, s in zip(b.column(0).to_pylist(), sets) if node_of(s) == w]
            offsets = np.concatenate([[0], np.cumsum([len(s) for _, s in found])]).astype(np.int32)
            flat = np.concatenate([s for _, s in found]) if found else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["node", "shingles"])

    return saved(rows.mapInArrow(own, "node long, shingles array<long>").dropDuplicates(["node"]), "near-sets")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) of which the full sets are similar enough, as a, b."""
    both = sides(pairs, sets, "shingles").withColumn("common", F.size(F.array_intersect("shingles_x", "shingles_y")))
    return both.where(similar(F.col("common"), F.size("shingles_x"), F.size("shingles_y"), percent)).select(F.col("x").alias("a"), F.col("y").alias("b"))


def several_labels(lists: DataFrame) -> DataFrame:
    """lists: value, label and more. The rows of values with more than one label, with main: the label most frequent there."""
    by_label = lists.groupBy("value", "label").agg(F.count(F.lit(1)).alias("c"))
    main = by_label.groupBy("value").agg(F.max(F.struct("c", "label")).alias("m"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    return lists.join(main.select("value", F.col("m.label").alias("main")), "value")


def rarest_first(sets: DataFrame, percent: int) -> DataFrame:
    """node, n, central (how common its shingles are, summed), left and value: the second index, of full sets. A value stands
    for a node only if the shingles from there on that any other set holds (left) are enough for some set."""
    shingles = sets.select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("value"))
    frequent = shingles.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ranked = shingles.join(frequent, "value").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("v"), F.sum("df").alias("central"))
    placed = ranked.select("node", "n", "central", F.size("v").alias("shared"), F.posexplode("v").alias("at", "v"))
    return placed.select("node", "n", "central", (F.col("shared") - F.col("at")).alias("left"), "v.value").where(F.col("left") * 100 >= percent * F.col("n"))


def pairs_with_centres(apart: DataFrame, index: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) of each class outside its list's main component with that component's most central class, now by full sets."""
    known = apart.join(index.select("node", "n", "central").distinct(), "node")
    centres = known.where("label = main").groupBy("value").agg(F.max(F.struct("central", "node", "n")).alias("p"))
    return known.where("label <> main").join(centres, "value").where(similar_sizes(F.col("n"), F.col("p.n"), percent)).select(F.col("node").alias("x"), F.col("p.node").alias("y")).distinct()


def pairs_apart(index: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) of different labels that may be similar. index: as rarest_first gives it, and label."""
    apart = saved(several_labels(index), "near-apart")
    side = lambda s: apart.select("value", F.col("node").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("n", "left", "label")), (F.col("label") == F.col("main")).alias(f"main_{s}"))
    overlap = (100 + percent) * F.least("left_x", "left_y") >= percent * (F.col("n_x") + F.col("n_y"))
    met = side("x").where("NOT main_x").join(side("y"), "value").where((F.col("label_x") != F.col("label_y")) & (F.col("main_y") | (F.col("x") < F.col("y"))) & overlap)
    return met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75, max_broadcast_rows: int = 2_000_000) -> DataFrame:
    """One row for each row of docs: its id, key (xxhash64 of id and text), n_shingles, node (its class), component (a
    number of its component; that of rows without shingles is null) and component_id."""
    hashes = Hashes()
    members = saved(sketches(docs, id_col, text_col, width, K, hashes), "near-members")
    classes = saved(members.groupBy("node").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "near-classes")
    live = classes.where("n > 0")
    sets_of = lambda nodes: full_sets(nodes, classes, docs, id_col, text_col, width, max_broadcast_rows, hashes)

    values = live.select("node", "n", F.size("sketch").alias("size"), F.explode("sketch").alias("value"))
    frequent = values.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = values.join(frequent, "value")
    ranked = shared.groupBy("node", "n", "size").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("v"), F.sum("df").alias("central"))
    # values that only this class retains come first and take places of the prefix
    places = F.col("size") - needed(F.col("n"), percent) + 1 - (F.col("size") - F.size("v"))
    lists = saved(ranked.where(places > 0).select("node", "n", "central", F.explode(F.slice("v", F.lit(1), places)).alias("v")).select("node", "n", "central", "v.value"), "near-lists")

    # each list's pivot is the class that shares most of its values: the text that the others are copies of
    pivots = lists.groupBy("value").agg(F.count(F.lit(1)).alias("length"), F.max(F.struct("central", "node", "n")).alias("p")).where("length > 1")
    stars = lists.join(pivots, "value").where((F.col("node") != F.col("p.node")) & similar_sizes(F.col("n"), F.col("p.n"), percent)).select(F.col("node").alias("x"), F.col("p.node").alias("y")).distinct()
    candidates = saved(estimated(stars, live, percent), "near-pairs")
    links = saved(confirmed(candidates, sets_of(candidates.select(F.col("x").alias("node")).unionByName(candidates.select(F.col("y").alias("node"))).distinct()), percent), "near-links")
    label = components(links)

    # then whatever still lies between components of one list: first against better centres, then all that is left
    labelled = lambda rows: rows.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    apart = saved(several_labels(labelled(lists.select("value", "node"))), "near-apart")
    if not apart.isEmpty():
        sets = sets_of(apart.select("node").distinct())
        index = saved(rarest_first(sets, percent), "near-index")
        for found in (lambda: pairs_with_centres(apart, index, percent), lambda: pairs_apart(labelled(index), percent)):
            links = saved(links.unionByName(confirmed(saved(found(), "near-pairs"), sets, percent)), "near-links")
            label = components(links)

    joined = classes.select("node", "rep").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = joined.where(F.col("label") != F.col("node")).select("label", "rep").unionByName(joined.where(F.col("label") == F.col("node")).select("label", "rep")).groupBy("label").agg(F.min("rep").alias("component_id"))
    of_class = joined.join(smallest, "label").select("node", F.col("label").alias("component"), "component_id")
    columns = lambda df: df.select(F.col("id").alias(id_col), "key", F.col("n").alias("n_shingles"), "node", "component", "component_id")
    empty = members.where("n = 0").withColumn("component", F.lit(None).cast("long")).withColumn("component_id", F.col("id"))
    return columns(members.where("n > 0").join(of_class, "node")).unionByName(columns(empty))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_broadcast_rows: int = 2_000_000, **how) -> DataFrame:
    """docs with one document of each component: that of the smallest id (of equal ids, of the smallest key)."""
    rid, rkey = fresh(docs, "_ob_id"), fresh(docs, "_ob_key")
    found = saved(near_duplicates(docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")), "doc", "text", **how), "near-found").where("component IS NOT NULL")
    stays = found.groupBy("component").agg(F.min(F.struct("doc", "key")).alias("w"), F.count(F.lit(1)).alias("c")).where("c > 1")
    goes = found.join(stays, "component").where(~F.struct("doc", "key").eqNullSafe(F.col("w"))).select(F.col("doc").alias(rid), F.col("key").alias(rkey)).distinct()
    goes = saved(goes, "near-goes")
    goes = F.broadcast(goes) if goes.count() <= max_broadcast_rows else goes
    return docs.join(goes, F.xxhash64(id_col, text_col).eqNullSafe(F.col(rkey)) & F.col(id_col).eqNullSafe(F.col(rid)), "left_anti")


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a AS doc_id, least(a, min(b)) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id, doc_id = coalesce(component_id, doc_id) AS kept FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
