"""Stored indexes against scans, tables that survive what may go wrong, and updates that leave the rest alone."""

import math
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from orebody.api import Engine
from orebody.operators import search
from orebody.operators.block_max import BlockMax
from orebody.operators.vector_index import VectorIndex
from orebody.sources.store import Buckets, Files, Lock, Table, cut, escaped


def clusters(n=1500, centres=40, dims=16, seed=3):
    rng = random.Random(seed)
    middle = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(centres)]
    rows = [(i, [x + rng.gauss(0, 0.25) for x in middle[rng.randrange(centres)]]) for i in range(n)]
    rows += [(n, None), (n + 1, [0.0] * dims), (n + 2, rows[5][1]), (n + 3, [2 * x for x in rows[5][1]])]
    return rows


def nearest(rows, q, k, only=None):
    length = lambda v: math.sqrt(sum(x * x for x in v))
    scored = [(-round(sum(a * b for a, b in zip(q, v)) / (length(q) * length(v)), 6), i) for i, v in rows if v and any(v) and (only is None or i in only)]
    return [(i, -s) for s, i in sorted(scored)[:k]]


def test_vector_index(spark, tmp_path):
    rows = clusters()
    df = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(4)
    index = VectorIndex(spark, str(tmp_path / "v")).build(df, 40)
    asked = [rows[i][1] for i in range(0, 1500, 50)]
    want = [nearest(rows, q, 10) for q in asked]

    def answer(**how):
        out = [[] for _ in asked]
        for r in index.nearest(asked, 10, **how).orderBy("query", "rank").collect():
            out[r["query"]].append((r.id, round(r.score, 6)))
        return out

    assert answer(probe=1) == want and answer(probe=3) == want  # proved by the bounds, whatever is probed first
    one = index.nearest([asked[0]], 10, probe=2)
    assert [(r.id, r.score) for r in one.orderBy("rank").collect()] == want[0] and 2 <= index.read.cells < index.read.of_cells and index.read.vectors < 0.5 * index.read.of_vectors
    # a twentieth of the cells, without the second read
    found = answer(probe=2, exact=False)
    recall = sum(len({i for i, _ in a} & {i for i, _ in b}) for a, b in zip(found, want)) / sum(map(len, want))
    assert recall >= 0.9, recall
    few = spark.createDataFrame([(i,) for i in range(0, 1500, 7)], "id long")
    got = index.nearest([asked[1], [0.0] * 16], 10, only=few).orderBy("rank").collect()
    assert [(r.id, r.score) for r in got] == nearest(rows, asked[1], 10, set(range(0, 1500, 7))) and {r["query"] for r in got} == {0}
    assert index.nearest([], 5).count() == 0 and index.nearest([asked[0]], 5000).count() == 1502
    empty = VectorIndex(spark, str(tmp_path / "e")).build(df.limit(0), 4)
    assert empty.nearest([asked[0]], 5).count() == 0


def test_vector_index_recall_over_texts(spark, sf, tmp_path):
    """Vectors of the documents' own texts; queries are the rows whose id is divisible by 50, recall against a scan."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("doc_id").alias("id"), search.hashed_vector(F.col("text")).alias("embedding"))
    index = VectorIndex(spark, str(tmp_path / "v")).build(docs, 40)
    rows = [(r.id, r.embedding) for r in docs.collect()]
    asked = [v for i, v in rows if i % 50 == 0]
    want = [{i for i, _ in nearest(rows, q, 10)} for q in asked]
    exact = index.nearest(asked, 10).collect()
    assert all({r.id for r in exact if r["query"] == n} == w for n, w in enumerate(want))
    part = index.nearest(asked, 10, probe=16, exact=False).collect()
    recall = sum(len({r.id for r in part if r["query"] == n} & w) for n, w in enumerate(want)) / sum(map(len, want))
    assert recall >= 0.9, recall


def test_block_max(spark, tmp_path):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(["the"] * rng.randint(0, 4) + [words[min(59, int(rng.expovariate(0.12)))] for _ in range(rng.randint(0, 30))])) for i in range(900)]
    rows += [(900, None), (901, ""), (902, "rare rare the"), (903, "rare w1"), (904, "THE Rare é")]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(3)
    index = BlockMax(spark, str(tmp_path / "b")).build(docs, "id", F.col("text"), segment=8)
    full = docs.withColumn("text", F.coalesce("text", F.lit("")))
    for terms, k, wave in ((["the"], 10, 2), (["rare", "the", "w3"], 5, 1), (["w0", "w1", "w40", "the"], 30, 64), (["RARE"], 10, 4), (["nowhere"], 3, 4), ([], 3, 4)):
        want = search.top(search.bm25(full, "id", F.col("text"), terms), k, ties=("id",)).collect() if terms else []
        got = index.best(terms, k, wave)
        assert [(r.id, r.score) for r in got.orderBy(F.desc("score"), "id").collect()] == [(r.id, r.score) for r in want], terms
        if terms and terms[0] == "rare":
            assert 0 < index.read.opened < 0.5 * index.read.blocks
    few = spark.createDataFrame([(i,) for i in range(0, 900, 5)], "id long")
    want = search.top(search.bm25(full, "id", F.col("text"), ["the", "w2"]).join(few, "id", "left_semi"), 10, ties=("id",)).collect()
    assert [(r.id, r.score) for r in index.best(["the", "w2"], 10, 2, few).orderBy(F.desc("score"), "id").collect()] == [(r.id, r.score) for r in want]
    assert BlockMax(spark, str(tmp_path / "n")).build(docs.limit(0), "id", F.col("text")).best(["the"]).count() == 0


def rows_of(spark, n, start=0):
    return spark.createDataFrame([(f"f{i}", i) for i in range(start, start + n)], "path string, n long")


@pytest.mark.parametrize("make", [lambda s, p: Table(s, p, "path string, n long"), lambda s, p: Buckets(s, p, "path string, n long", "path", 4)])
def test_a_failed_rename_loses_nothing(spark, tmp_path, monkeypatch, make):
    t = make(spark, str(tmp_path / "store" / "t"))
    t.replace("p", rows_of(spark, 10))
    real = Files.rename
    for failing in range(3):
        seen = []

        def rename(self, name, to):
            seen.append(name)
            if len(seen) == failing + 1:
                raise OSError("no")
            real(self, name, to)

        monkeypatch.setattr(Files, "rename", rename)
        with pytest.raises(OSError):
            t.replace("p", rows_of(spark, 20, 100))
        monkeypatch.setattr(Files, "rename", real)
        again = make(spark, str(tmp_path / "store" / "t"))
        assert again.read("p").count() in (10, 20) and again.read().count() in (10, 20)
        again.replace("p", rows_of(spark, 10))
        assert again.read("p").count() == 10
    assert not [n for n in t.files.names() if n.startswith("_staged")]


def test_a_patch_that_broke_off_is_finished(spark, tmp_path, monkeypatch):
    t = Buckets(spark, str(tmp_path / "store" / "t"), "path string, n long", "path", 4)
    t.replace("p", rows_of(spark, 40))
    both = [0, 2, 3]
    kept = cut(t.read("p", both).where("n >= 5").withColumn("n", F.col("n") + 1000).where(t.number() != 3))
    want = sorted((r.path, r.n) for r in t.read("p", [1]).collect()) + sorted((r.path, r.n) for r in kept.collect())
    real, seen = Files.rename, []

    def rename(self, name, to):
        seen.append(name)
        if len(seen) == 3:  # after the patch is complete and one bucket has moved
            raise OSError("no")
        real(self, name, to)

    monkeypatch.setattr(Files, "rename", rename)
    with pytest.raises(OSError):
        t.patch("p", both, kept)
    monkeypatch.setattr(Files, "rename", real)
    again = Buckets(spark, str(tmp_path / "store" / "t"), "path string, n long", "path", 99)
    assert again.count == 4 and sorted((r.path, r.n) for r in again.read("p").collect()) == sorted(want)
    again.patch("p", [0, 1, 2, 3], rows_of(spark, 0))
    assert again.read("p").count() == 0 and again.exists("p")


def test_project_ids_of_any_characters(spark, tmp_path):
    odd = ["a/b", "a%20b", "a b", "x=1", "é:漢", "007", "a"]
    for make in (lambda p: Table(spark, p, "path string, n long"), lambda p: Buckets(spark, p, "path string, n long", "path", 4)):
        t = make(str(tmp_path / f"store{make.__code__.co_firstlineno}{len(make('x').__dict__)}" / "t"))
        for i, name in enumerate(odd):
            t.replace(name, rows_of(spark, i + 1))
        assert t.projects() == sorted(odd) and [t.read(n).count() for n in odd] == [1, 2, 3, 4, 5, 6, 7]
        assert {r.project_id: r["count"] for r in t.read().groupBy("project_id").count().collect()} == {n: i + 1 for i, n in enumerate(odd)}
    assert escaped("a/b%") == "a%2Fb%25"
    e = Engine(spark, str(tmp_path / "s"), "team/one%20")
    with e.lock():
        assert not Lock(spark, str(tmp_path / "s" / "locks"), "team/one%20").acquire()


def test_a_living_lock_is_not_taken_over(spark, tmp_path):
    mine, other = (Lock(spark, str(tmp_path), "p", stale=0.5) for _ in range(2))
    assert mine.acquire() and not other.acquire()
    import time

    for _ in range(4):
        time.sleep(0.2)
        mine.refresh()
        assert not other.acquire()  # there is no moment without a lock
    time.sleep(0.7)
    assert other.acquire()
    with pytest.raises(RuntimeError):
        mine.refresh()
    mine.release()
    assert other.owner()[0] == other.holder
    other.release()
    assert mine.acquire()


def parquet_files(folder):
    return {str(p.relative_to(folder)) for p in Path(folder).rglob("*.parquet")}


def test_a_change_rewrites_its_buckets_only(spark, tmp_path):
    root, store = tmp_path / "tree", tmp_path / "store"
    root.mkdir()
    for i in range(60):
        (root / f"m{i}.py").write_text((f"from .m{i - 1} import f{i - 1}\n" if i else "") + f"def f{i}():\n    return {f'f{i - 1}()' if i else 0}\n")
    (root / "__init__.py").write_text("")
    e, full = Engine(spark, str(store), "p"), Engine(spark, str(tmp_path / "other"), "p")
    e.graph.build(str(root))
    e.index(str(root))
    before = {t: parquet_files(store / t) for t in ("symbols", "calls", "call_edges", "imports", "edges", "chunks", "postings", "file_state", "graph_files", "name_refs")}
    (root / "m30.py").write_text("from .m29 import f29\ndef f30():\n    return other()\n\ndef other():\n    return f29()\n")
    assert e.graph.update(str(root)) == {"changed": 1, "unchanged": 60} and e.index(str(root)) == {"changed": 1, "unchanged": 60}
    for name, old in before.items():
        new = parquet_files(store / name)
        assert old - new and len(old & new) >= 0.5 * len(old), name
    # a new time alone is no change, and is not looked at again
    (root / "m7.py").touch()
    assert e.graph.update(str(root)) == {"unchanged": 61} and e.index(str(root)) == {"unchanged": 61}
    full.graph.build(str(root))
    full.index(str(root))
    for name in ("imports", "edges", "symbols", "name_refs", "calls", "call_edges", "search_stats", "file_state", "graph_files"):
        assert sorted(map(repr, e.rows(name).collect())) == sorted(map(repr, full.rows(name).collect())), name
    for name in ("chunks", "postings"):
        assert sorted(r.id for r in e.rows(name).select("id").collect()) == sorted(r.id for r in full.rows(name).select("id").collect())


def test_an_update_that_broke_off_is_built_anew(spark, tmp_path, monkeypatch):
    root = tmp_path / "tree"
    root.mkdir()
    (root / "a.py").write_text("from .b import g\ndef f():\n    return g()\n")
    (root / "b.py").write_text("def g():\n    return 1\n")
    e, full = Engine(spark, str(tmp_path / "s1"), "p"), Engine(spark, str(tmp_path / "s2"), "p")
    e.graph.build(str(root))
    (root / "b.py").write_text("def h():\n    return 1\n")
    from orebody.operators import symbols as sym

    def fail(*_):
        raise ValueError("no")

    monkeypatch.setattr(sym, "reached_callers", fail)
    with pytest.raises(ValueError):
        e.graph.update(str(root))
    monkeypatch.undo()
    e.graph.update(str(root))
    full.graph.build(str(root))
    assert sorted(map(repr, e.rows("call_edges").collect())) == sorted(map(repr, full.rows("call_edges").collect()))
    assert e.graph.update(str(root)) == {"unchanged": 2}


def test_reachability(spark, tmp_path):
    from orebody.operators.reachability import Reachability, strong_components

    rng = random.Random(6)
    pairs = {(a, a + rng.randint(1, 9)) for a in range(150) for _ in range(2)} | {(i, i + 1) for i in range(200, 260)}
    pairs |= {(40, 31), (33, 33), (300, 301), (301, 302), (302, 300), (302, 200), (90, 82)}
    after: dict = {}
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

    nodes = sorted({x for p in pairs for x in p})
    to = {a: reached(a) for a in nodes}
    edges = spark.createDataFrame([*pairs, *pairs], "source long, target long").repartition(3)
    parts = {r.node: (r.component, r.cyclic) for r in strong_components(edges).collect()}
    assert parts == {a: (min([b for b in to[a] if a in to[b]], default=a), a in to[a]) for a in nodes}
    index = Reachability(spark, str(tmp_path)).build(edges, growth=8)
    every = spark.createDataFrame([(n,) for n in [*nodes, 999]], "node long")
    assert {(r.seed, r.node) for r in index.closure(every).collect()} == {(a, b) for a in nodes for b in to[a]}
    assert {(r.seed, r.node) for r in index.closure(every, reverse=True).collect()} == {(b, a) for a in nodes for b in to[a]}
    asked = {(rng.choice(nodes), rng.choice(nodes)) for _ in range(400)} | {(33, 33), (34, 999), (999, 999), (200, 260), (260, 200), (300, 300)}
    got = {(r.source, r.target): r.reaches for r in index.reaches(spark.createDataFrame([*asked], "source long, target long")).collect()}
    assert got == {(a, b): b in to.get(a, ()) for a, b in asked}
    # far fewer labels than pairs, and one index of a graph without edges
    assert index.labels().count() < 0.5 * sum(map(len, to.values()))
    empty = Reachability(spark, str(tmp_path)).build(edges.limit(0))
    assert empty.closure(every).count() == 0 and not empty.reaches(spark.createDataFrame([(1, 2)], "source long, target long")).first().reaches


def test_a_closure_of_a_large_component_takes_little_disk(spark, tmp_path, monkeypatch):
    """Its rows are seeds times nodes; those of a tile repeat at short distances."""
    from pyspark.sql import functions as F

    from orebody.operators import reachability

    monkeypatch.setattr(reachability, "LARGE", 5_000)
    monkeypatch.setattr(reachability, "SALTS", 2)
    name, n = F.concat(F.lit("d"), F.col("id")), 30_000
    rows = spark.range(n).select(name.alias("node"), F.lit("d0").alias("component"), F.lit(True).alias("cyclic"))
    rows.unionByName(spark.createDataFrame([("x", "x", False), ("y", "y", False)], rows.schema)).write.parquet(str(tmp_path / "nodes"))
    spark.createDataFrame([(True, "d0", "x"), (False, "d0", "d0"), (True, "d0", "d0")], "back boolean, hub string, node string").write.parquet(str(tmp_path / "labels"))
    seeds = spark.range(0, n, 200).select(name.alias("node")).unionByName(spark.createDataFrame([("x",), ("y",)], "node string"))
    reachability.Reachability(spark, str(tmp_path)).closure(seeds).write.option("compression", "snappy").parquet(str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == got.distinct().count() == 151 * n
    assert got.where("node IN ('x', 'y') OR seed = 'y'").isEmpty() and got.where("seed = 'x'").count() == n
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 0.5 * 151 * n


def test_name_index(spark, tmp_path):
    from orebody.operators import symbols as sym
    from orebody.operators.name_index import NameIndex

    rng = random.Random(2)
    rows = []
    for i in range(400):
        name = "".join(rng.choice("abAB_é") for _ in range(rng.randint(1, 7)))
        rows.append((f"f{i % 7}::{name}#{i}", name, f"Cls{rng.choice('xyz')}.{name}", f"f{i % 7}", i))
    rows += [("f0::<module>#1", "<module>", "<module>", "f0", 1), ("f1::n#9", "n", None, "f1", 9)]
    symbols = spark.createDataFrame(rows, "id string, name string, qualified_name string, file string, line int").repartition(3)
    index = NameIndex(spark, str(tmp_path)).build(symbols)
    for needle in ("a", "AB", "aba", "abab", "É_b", "zz", "clsx", "s.a", "a" * 9, "%", "module"):
        assert [tuple(r) for r in index.list(needle).collect()] == [tuple(r) for r in sym.list_symbols(symbols, needle).collect()], needle
        assert [tuple(r) for r in index.find(needle).collect()] == [tuple(r) for r in sym.symbol_lookup(symbols, needle).collect()], needle
    assert [tuple(r) for r in index.list("b", "f3", 9).collect()] == [tuple(r) for r in sym.list_symbols(symbols, "b", "f3", 9).collect()]
    assert [tuple(r) for r in index.list().collect()] == [tuple(r) for r in sym.list_symbols(symbols).collect()]


def test_answers_by_indexes_are_those_of_the_tables(spark, tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    for i in range(24):
        (root / f"m{i}.py").write_text((f"from .m{i - 1} import fn_{i - 1}\n" if i else "") + f"def fn_{i}(x):\n    return {f'fn_{i - 1}(x)' if i else 'x'}\n")
    (root / "__init__.py").write_text("")
    e = Engine(spark, str(tmp_path / "store"), "p/1")
    e.index(str(root))
    e.graph.build(str(root))
    asks = ("return fn_3", "fn_7 import", "nothing")
    plain = [e.search(q, 5, min_score=0.0).collect() for q in asks] + [e.search(asks[0], 5, file="m4.py", min_score=0.0).collect()]
    listed, found = e.symbols.list("n_1").collect(), e.symbols.find("FN_1").collect()
    with pytest.raises(ValueError, match="optimize"):
        e.graph.closure(["m20.py"])
    e.optimize(4)
    e.graph.optimize()
    assert [e.search(q, 5, min_score=0.0).collect() for q in asks] + [e.search(asks[0], 5, file="m4.py", min_score=0.0).collect()] == plain
    assert e.symbols.list("n_1").select(listed[0].__fields__).collect() == listed and e.symbols.find("FN_1").select(found[0].__fields__).collect() == found
    # further than ten steps
    assert {r.node for r in e.graph.closure(["m20.py"]).collect()} == {f"m{i}.py" for i in range(20)}
    assert {(r.seed, r.node) for r in e.graph.closure(["m22.py", "m0.py"], reverse=True).collect()} == {("m22.py", "m23.py"), *(("m0.py", f"m{i}.py") for i in range(1, 24))}
    # a change ends them
    (root / "m3.py").write_text("def other():\n    return 1\n")
    e.index(str(root))
    e.graph.update(str(root))
    assert not e._indexed("vectors") and not e._indexed("names") and "other" in {r.name for r in e.symbols.list("othe").collect()}
    assert "Entry points (" in e.symbols.flow_text()


def test_debounce_of_a_stream(spark, tmp_path):
    """Events of a key in any order within a part; late ones are left out; the state of open bursts outlives the query."""
    from orebody.streaming.debounce import debounced_stream, merged

    assert merged([(5, 5, 1), (0, 1, 2), (9, 9, 1), (3, 3, 1)], 3) == [(0, 5, 4), (9, 9, 1)] and merged([], 1) == []

    def stamps(*rows):
        return spark.createDataFrame([(k, s) for k, s in rows], "k string, s double").select("k", F.timestamp_seconds("s").alias("ts")).coalesce(1)

    def run():
        stream = spark.readStream.schema("k string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        rows = debounced_stream(stream, "ts", "k", 2, "3 seconds")
        rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        return {(r.k, r.first / 1e6, r.last / 1e6, r.events) for r in spark.read.schema(rows.schema).parquet(str(tmp_path / "out")).collect()}

    put = lambda *rows: stamps(*rows).write.mode("append").parquet(str(tmp_path / "in"))
    put(("a", 11.0), ("a", 10.0), ("b", 10.5), (None, 10.0))
    assert run() == set()
    put(("a", 12.5), ("a", 20.0), ("b", 20.0))  # the first bursts are over, of the key without events too
    assert run() == {("a", 10.0, 12.5, 3), ("b", 10.5, 10.5, 1), (None, 10.0, 10.0, 1)}
    put(("a", 12.0), ("a", 40.0))  # too late
    assert run() == {("a", 10.0, 12.5, 3), ("b", 10.5, 10.5, 1), (None, 10.0, 10.0, 1), ("a", 20.0, 20.0, 1), ("b", 20.0, 20.0, 1)}
