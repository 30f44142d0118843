"""File graph operators over an edge bag (source, target, type): statistics, reach, cycles, rendering.

Traversals are joins of a frontier with the edges, a fixed number of rounds at most; visited nodes leave by anti join, and
each round's frontier is cut from its lineage by a checkpoint where a shared folder is set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orebody.sources.store import cut

MAX_DEPTH = 10


def ends(edges: DataFrame) -> DataFrame:
    """Both ends of each edge, with multiplicity."""
    return edges.select(F.col("source").alias("node")).unionAll(edges.select(F.col("target").alias("node")))


def degrees(edges: DataFrame) -> DataFrame:
    return ends(edges).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def most_connected(edges: DataFrame, limit: int = 10) -> DataFrame:
    return degrees(edges).orderBy(F.desc("degree"), "node").limit(limit)


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes: node. Those without an edge either way."""
    return nodes.join(ends(edges).distinct(), "node", "left_anti")


def graph_stats(nodes: DataFrame, edges: DataFrame, cyclic: bool = False) -> DataFrame:
    """One row: files, edges, edges_per_file (0 if there are no files), orphans; if asked, the distinct edges on cycles."""
    n = nodes.agg(F.count(F.lit(1)).alias("files"))
    e = edges.agg(F.count(F.lit(1)).alias("edges"))
    o = orphans(nodes, edges).agg(F.count(F.lit(1)).alias("orphans"))
    per = F.when(F.col("files") == 0, F.lit(0.0)).otherwise(F.round(F.col("edges") / F.col("files"), 6))
    out = n.join(F.broadcast(e)).join(F.broadcast(o)).select("files", "edges", per.alias("edges_per_file"), "orphans")
    return out.join(F.broadcast(cyclic_edges(edges).agg(F.count(F.lit(1)).alias("cyclic_edges")))) if cyclic else out


def file_dependencies(edges: DataFrame, node) -> DataFrame:
    """direction (imports, imported_by) and node, one row for each edge."""
    out = edges.where(F.col("source") == node).select(F.lit("imports").alias("direction"), F.col("target").alias("node"))
    return out.unionAll(edges.where(F.col("target") == node).select(F.lit("imported_by").alias("direction"), F.col("source").alias("node")))


def reach(edges: DataFrame, seeds: DataFrame, depth: int = 3, direction: str = "reverse") -> DataFrame:
    """node and hop (1 to depth) of what the seeds (node) reach: along edges (forward), against them (reverse) or both."""
    depth = max(1, min(MAX_DEPTH, depth))
    forward = edges.select(F.col("source").alias("at"), F.col("target").alias("to"))
    back = edges.select(F.col("target").alias("at"), F.col("source").alias("to"))
    steps = {"forward": forward, "reverse": back, "both": forward.unionAll(back)}[direction].distinct()
    steps = cut(steps)  # every hop reads them: edges that are themselves a long plan are worked out once
    seen = seeds.select("node").distinct().withColumn("hop", F.lit(0))
    frontier = seen
    for hop in range(1, depth + 1):
        found = steps.join(frontier.select(F.col("node").alias("at")), "at").select(F.col("to").alias("node")).distinct()
        frontier = cut(found.join(seen, "node", "left_anti").withColumn("hop", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = seen.unionAll(frontier)
    return seen.where("hop > 0")


def is_truncated(edges: DataFrame, reached: DataFrame, seeds: DataFrame, depth: int, direction: str = "reverse") -> bool:
    """Whether one hop more would find another node."""
    return not reach(edges, seeds, depth + 1, direction).where(F.col("hop") == depth + 1).isEmpty()


def impact(edges: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """hop and the sorted files that depend on the seeds at that distance."""
    return reach(edges, seeds, depth).groupBy("hop").agg(F.array_sort(F.collect_list("node")).alias("files"))


def trimmed(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """Distinct edges without those that cannot lie on a cycle, as far as `rounds` rounds of trimming find them."""
    left = cut(edges.select("source", "target").distinct())
    count = left.count()
    for _ in range(rounds):
        left = cut(left.join(left.select(F.col("target").alias("source")).distinct(), "source", "left_semi").join(left.select(F.col("source").alias("target")).distinct(), "target", "left_semi").select("source", "target"))
        now = left.count()
        if now == count:
            break
        count = now
    return left


def cycles(edges: DataFrame, max_length: int = 6) -> DataFrame:
    """Simple cycles of up to max_length edges, each once: nodes begins at its smallest node; length.

    Edges are trimmed to those that may lie on a cycle before paths are grown; a path only takes nodes larger than its first.
    """
    e = cut(trimmed(edges))
    loops = e.where("source = target").select(F.array("source").alias("nodes"))
    paths = e.where("source < target").select(F.col("source").alias("first"), F.col("target").alias("last"), F.array("source", "target").alias("nodes"))
    found = loops
    for _ in range(max_length - 1):
        closed = paths.join(e, (F.col("last") == F.col("source")) & (F.col("first") == F.col("target"))).select("nodes")
        found = found.unionAll(closed)
        grown = paths.join(e, F.col("last") == F.col("source")).where((F.col("target") > F.col("first")) & ~F.array_contains("nodes", F.col("target")))
        paths = cut(grown.select("first", F.col("target").alias("last"), F.array_append("nodes", F.col("target")).alias("nodes")))
    return found.select("nodes", F.size("nodes").alias("length"))


def coloured(edges: DataFrame) -> DataFrame:
    """node and colour: the largest node that reaches it."""
    now = ends(edges).distinct().withColumn("colour", F.col("node"))
    while True:
        sent = edges.join(now, F.col("source") == F.col("node")).select(F.col("target").alias("node"), "colour", F.lit(None).cast(now.schema["colour"].dataType).alias("was"))
        then = cut(now.withColumn("was", F.col("colour")).unionAll(sent).groupBy("node").agg(F.max("colour").alias("colour"), F.max("was").alias("was")))
        now = then.select("node", "colour")
        if then.where("colour <> was").isEmpty():
            return now


def around(edges: DataFrame) -> DataFrame:
    """The component of the node with most edges: node, part (that node).

    Both ways go in the same rounds, and only what a round finds goes into the next. Joins are by shuffle: no round sends its
    nodes to the driver.
    """
    pivot = cut(ends(edges).groupBy("node").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "node").limit(1).select("node"))
    forward = edges.select(F.lit(False).alias("back"), F.col("source").alias("at"), F.col("target").alias("node"))
    steps = forward.unionAll(edges.select(F.lit(True), F.col("target"), F.col("source")))
    frontier = seen = cut(pivot.crossJoin(edges.sparkSession.createDataFrame([(False,), (True,)], "back boolean")).select("back", "node"))
    rounds = 0
    while not frontier.isEmpty():
        rounds += 1
        found = steps.hint("merge").join(frontier.select("back", F.col("node").alias("at")), ["back", "at"]).select("back", "node").distinct()
        frontier = cut(found.hint("merge").join(seen, ["back", "node"], "left_anti"))
        seen = seen.unionAll(frontier) if rounds % 10 else cut(seen.unionAll(frontier))
    both = seen.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("node")
    return cut(both.crossJoin(F.broadcast(pivot.withColumnRenamed("node", "part"))))


def strong_parts(edges: DataFrame) -> DataFrame:
    """Distinct edges with both ends in one strongly connected component (part: one of its nodes, null for an edge from a node to
    itself): those on a cycle of any length.

    Edges at the rim go first. The component of the node with most edges, mostly the one that is large, is found from that
    node alone. In what is left each round colours the nodes forward and takes, of each colour, the nodes that reach its own
    node: a whole component.
    """
    plain = cut(edges.select("source", "target").distinct())
    own = F.lit(None).cast(plain.schema["source"].dataType).alias("part")
    found, left = plain.where("source = target").select("source", "target", own), trimmed(plain.where("source <> target"))
    if left.isEmpty():
        return found
    part = around(left)
    end = lambda rows, name: rows.select(F.col("node").alias(name)).hint("merge")
    found = cut(found.unionByName(left.join(part.withColumnRenamed("node", "source"), "source").join(end(part, "target"), "target", "left_semi").select("source", "target", "part")))
    left = left.join(end(part, "source"), "source", "left_anti").join(end(part, "target"), "target", "left_anti")
    left = trimmed(left)
    while not left.isEmpty():
        colours = coloured(left)
        inside = left.join(colours.select(F.col("node").alias("source"), "colour"), "source").join(colours.select(F.col("node").alias("target"), F.col("colour").alias("other")), "target").where("colour = other")
        one = cut(inside.select("source", "target", "colour"))
        frontier = marked = cut(colours.where("node = colour").select("node"))
        while not frontier.isEmpty():
            back = one.join(frontier.select(F.col("node").alias("target")), "target").select(F.col("source").alias("node")).distinct()
            frontier = cut(back.join(marked, "node", "left_anti"))
            marked = cut(marked.unionAll(frontier))
        a, b = marked.select(F.col("node").alias("source")), marked.select(F.col("node").alias("target"))
        found = cut(found.unionAll(one.join(a, "source", "left_semi").join(b, "target", "left_semi").select("source", "target", F.col("colour").alias("part"))))
        left = trimmed(one.join(a, "source", "left_anti").join(b, "target", "left_anti"))
    return found


def strong_edges(edges: DataFrame) -> DataFrame:
    """Distinct edges on a cycle of any length."""
    return strong_parts(edges).select("source", "target")


def cyclic_edges(edges: DataFrame, max_length: int | None = None) -> DataFrame:
    """Distinct edges on a cycle; with max_length only those on a simple cycle of up to so many edges."""
    if max_length is None:
        return strong_edges(edges)
    at = F.posexplode("nodes").alias("i", "source")
    steps = cycles(edges, max_length).select("nodes", "length", at)
    return steps.select("source", F.element_at("nodes", (F.col("i") + 1) % F.col("length") + 1).alias("target")).distinct()


def numbered(names: DataFrame, parts: int = 64) -> DataFrame:
    """names (node) and n: its place in the order of nodes, from 0. Sorted ranges are numbered by themselves and moved up by the
    sizes of those before them, so no task holds all nodes; the driver sees one number a range."""
    # written once: ranges are drawn from a sample, so a second run of the plan could cut them elsewhere
    ranges = cut(names.select("node").repartitionByRange(parts, "node").withColumn("_part", F.spark_partition_id()))
    before, sizes = 0, []
    for r in ranges.groupBy("_part").agg(F.count(F.lit(1)).alias("c")).orderBy("_part").collect():
        sizes.append((r["_part"], before))
        before += r.c
    offsets = names.sparkSession.createDataFrame(sizes, "_part int, _before long")
    own = F.row_number().over(Window.partitionBy("_part").orderBy("node")) - 1
    return ranges.withColumn("_own", own).join(F.broadcast(offsets), "_part").select("node", (F.col("_own") + F.col("_before")).alias("n"))


def mermaid_edges(edges: DataFrame, max_length: int | None = None) -> DataFrame:
    """Distinct edges with node numbers (n0 on, in order of the node) and whether they lie on a cycle, as a diagram's lines."""
    plain = edges.select("source", "target").distinct()
    numbers = numbered(ends(plain).distinct())
    cyclic = cyclic_edges(plain, max_length).withColumn("cyclic", F.lit(True))
    a = numbers.select(F.col("node").alias("source"), F.col("n").alias("sn"))
    b = numbers.select(F.col("node").alias("target"), F.col("n").alias("tn"))
    rows = plain.join(a, "source").join(b, "target").join(cyclic, ["source", "target"], "left").withColumn("cyclic", F.coalesce("cyclic", F.lit(False)))
    line = F.when(F.col("cyclic"), F.format_string("n%d -.->|cycle| n%d", "sn", "tn")).otherwise(F.format_string("n%d --> n%d", "sn", "tn"))
    return rows.select("source", "target", "cyclic", line.alias("line"))
