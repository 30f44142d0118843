"""Graph operators on cycles longer than the listing of cycles takes."""

from pyspark.sql import functions as F

from orebody.operators import graph


def test_long_cycles_are_cyclic(spark):
    ring = [(i, (i + 1) % 8) for i in range(8)]
    rest = [(7, 20), (20, 21), (21, 22), (22, 20), (30, 0), (22, 31), (40, 40)]
    edges = spark.createDataFrame(ring + rest, "source long, target long")
    want = {*ring, (20, 21), (21, 22), (22, 20), (40, 40)}
    assert {(r.source, r.target) for r in graph.mermaid_edges(edges).where("cyclic").collect()} == want


def test_queries_over_the_whole_edge_table(spark, sf):
    from orebody import catalog
    from orebody.plans.relations import part_edges, table

    pairs = {(r.source, r.target) for r in part_edges(spark, sf).collect()}
    q = catalog.queries()
    nodes = table(spark, sf, "part").select(F.col("p_partkey").alias("node")).unionByName(spark.range(10**6, 10**6 + 5).select(F.col("id").alias("node")))
    assert {r.node for r in graph.orphans(nodes, part_edges(spark, sf)).collect()} == {r.node for r in nodes.collect()} - {x for e in pairs for x in e}

    def hops(steps, depth):
        seen, out = {1}, set()
        for hop in range(1, depth + 1):
            new = {b for a, b in steps if a in seen} - seen
            out |= {(n, hop) for n in new}
            seen |= new
        return out

    back = {(b, a) for a, b in pairs}
    assert {(r.node, r.hop) for r in q["impact_bfs"](spark, sf).collect()} == hops(back, 3)
    assert {(r.node, r.hop) for r in q["neighbourhood"](spark, sf).collect()} == hops(pairs | back, 2)
    after = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)

    def reached(a):
        seen, todo = set(), [a]
        while todo:
            for b in after.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    to = {a: reached(a) for a in after}
    assert {(r.source, r.target) for r in graph.cyclic_edges(part_edges(spark, sf)).collect()} == {(a, b) for a, b in pairs if a in to.get(b, ())}


def test_numbers_follow_the_order_of_nodes(spark):
    names = [f"n{i * 7919 % 1000:04d}" for i in range(1000)]
    rows = graph.numbered(spark.createDataFrame([(n,) for n in names], "node string"), parts=7).collect()
    assert {(r.node, r.n) for r in rows} == {(n, i) for i, n in enumerate(sorted(names))}
    assert graph.numbered(spark.createDataFrame([], "node string")).count() == 0


def test_an_open_ring_is_drawn_as_one(spark):
    from orebody.operators.render import diagram_lines

    edges = spark.createDataFrame([("a.py", "b.py", "import"), ("b.py", "c.py", "import")], "source string, target string, type string")
    lines = lambda *rings: {r.line for r in diagram_lines(edges, None, *rings).where("part = 'edge'").collect()}
    assert lines() == {"    n0 --> n1", "    n1 --> n2"}
    assert lines(edges.where("source = 'a.py'")) == {"    n0 -.->|cycle| n1", "    n1 --> n2"}


def test_terms_are_counted_without_a_shuffle(spark):
    from pyspark.sql import functions as F

    from orebody.operators.search import counted, statistics

    docs = spark.createDataFrame([(1, "a b a"), (2, None), (3, ""), (4, "B c d"), (5, "x")], "doc_id long, text string")
    rows = counted(docs, "doc_id", F.col("text"))
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.id, r.dl, r.term, r.tf) for r in rows.collect()) == [(1, 3, "a", 2), (1, 3, "b", 1), (4, 3, "b", 1), (4, 3, "c", 1), (4, 3, "d", 1), (5, 1, "x", 1)]
    assert tuple(statistics(rows).first()) == (3, 7)
