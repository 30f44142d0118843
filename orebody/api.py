"""The engine: index a tree, search it, ask its graphs. All state is parquet under one folder, a folder a table and project."""

from __future__ import annotations

import time
import warnings
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orebody.functions.scalars import clamped, content_hash, document_text, language, looks_like_path, query_text
from orebody.operators import artifacts as arts
from orebody.operators import changes, chunking, extract, graph, render, resolve, search
from orebody.operators import symbols as sym
from orebody.operators.block_max import BlockMax
from orebody.operators.embed import Hashing, Provider, query_vector
from orebody.operators.name_index import NameIndex
from orebody.operators.reachability import Reachability
from orebody.operators.vector_index import VectorIndex
from orebody.sources import config
from orebody.sources import files as sources
from orebody.sources.store import KEYS, TABLES, Buckets, Files, Lock, Table, cut, escaped, with_retries


class Engine:
    def __init__(self, spark: SparkSession, store: str, project: str, provider: Provider | None = None, batch_files: int = 50_000, buckets: int = 16):
        """batch_files: files indexed between two saved states; an interrupted run goes on from the last of them. buckets: how
        many a new table's rows are dealt to; some thousands suit a tree of many millions of files."""
        self.buckets = buckets
        self.spark, self.store, self.project, self.batch_files = spark, store.rstrip("/"), project, batch_files
        self.provider = provider or Hashing()
        #: Whether a run that broke off may have left rows, and by how much this run has changed the texts and tokens indexed.
        self._leftovers, self._change = True, [0, 0]
        self.graph, self.symbols, self.artifacts = Graph(self), Symbols(self), Artifacts(self)

    def table(self, name: str) -> Table:
        path = f"{self.store}/{name}"
        return Buckets(self.spark, path, TABLES[name], KEYS[name], self.buckets) if name in KEYS else Table(self.spark, path, TABLES[name])

    def rows(self, name: str, project: str | None = None) -> DataFrame:
        return self.table(name).read(project or self.project)

    def put(self, name: str, rows: DataFrame) -> None:
        with_retries(lambda: self.table(name).replace(self.project, rows))

    def has(self, name: str) -> bool:
        return self.table(name).exists(self.project)

    def lookup(self, name: str, **keys) -> DataFrame:
        """Stored rows whose columns have these values (or one of a list of them); the filter reaches the files."""
        rows = self.rows(name)
        for column, value in keys.items():
            rows = rows.where(F.col(column).isin(*value) if isinstance(value, (list, tuple, set)) else F.col(column) == value)
        return rows

    def lock(self) -> Lock:
        return Lock(self.spark, f"{self.store}/locks", self.project)

    def _stops(self) -> Files:
        return Files(self.spark, f"{self.store}/stops")

    def stop(self) -> None:
        """Asks a running index() of this project, in whatever process, to end after its batch."""
        self._stops().create(escaped(self.project), "stop")

    def index(self, root: str, **scan) -> dict[str, int]:
        """Chunks, vectors, postings and file state of the tree; only new and changed files are worked on, in batches.

        Each batch is saved with the state of its files, so a run that was stopped or failed is resumed by the next. Files of
        the stored length and time are not read, and only buckets of changed paths are rewritten.
        """
        with self.lock() as lock:
            self._stops().delete(escaped(self.project))
            paths = cut(sources.indexable_paths(self.spark, root, **scan))
            state = changes.relative_keys(self.rows("file_state"), root)
            odd = cut(changes.restamped(paths.withColumnRenamed("relative_path", "path"), state))
            found = sources.described(sources.contents(root, odd.where("listed").withColumnRenamed("path", "relative_path"))).withColumnRenamed("relative_path", "path")
            read = cut(found.select("path", "content_hash", "language", "length", "modified"))
            diff = cut(changes.file_changes(read, odd.where("old_hash IS NOT NULL").select("path", F.col("old_hash").alias("content_hash"))).withColumn("b", self.table("file_state").number("path")))
            seen = diff.groupBy("status", "b").agg(F.count(F.lit(1)).alias("files")).collect()
            counts: dict[str, int] = {}
            for r in seen:
                counts[r.status] = counts.get(r.status, 0) + r.files
            rest = paths.count() - sum(n for s, n in counts.items() if s != "removed")
            counts |= {"unchanged": counts.get("unchanged", 0) + rest} if rest else {}
            same = diff.where("status = 'unchanged'").select("path")
            if counts.get("unchanged", 0) > rest:  # new stamps of the same contents
                to = sorted({r.b for r in seen if r.status == "unchanged"})
                table = self.table("file_state")
                table.patch(self.project, to, table.shaped(table.read(self.project, to).join(same, "path", "left_anti")).unionByName(table.shaped(read.join(same, "path", "left_semi"))))
            if self.has("file_state") and not set(counts) - {"unchanged"}:
                return counts
            began = time.time()
            self._drop_indexes("vectors", "blocks")
            done = self.rows("progress").where("status = 'completed'").count() > 0
            gone = diff.where("status IN ('changed', 'removed')").select("path")
            to = sorted({r.b for r in seen if r.status in ("changed", "removed")})
            self._leftovers, self._change = not done, [0, 0]
            if to:
                lost = search.statistics(self.table("postings").read(self.project, to).join(gone, "path", "left_semi")).first()
                self._change = [-lost.docs, -lost.tokens]
                for name in ("chunks", "postings", "file_state"):  # state last: until it has gone a file counts as changed
                    table = self.table(name)
                    with_retries(lambda table=table: table.patch(self.project, to, table.read(self.project, to).join(gone, "path", "left_anti")))
            elif not self.has("file_state"):
                for name in ("chunks", "postings", "file_state"):
                    self.put(name, self.rows(name))
            # until all is done the statistics and leftovers of a run that broke off have to be looked for
            self._progress("index", 0, 1, 0, "in-progress")
            todo = diff.where("status IN ('added', 'changed')").select("path")
            total = counts.get("added", 0) + counts.get("changed", 0)
            batches = -(-total // self.batch_files)
            for i in range(batches):
                own = todo.where(F.pmod(F.xxhash64("path"), F.lit(batches)) == i)
                files = sources.described(sources.contents(root, paths.join(own.withColumnRenamed("path", "relative_path"), "relative_path", "left_semi")))
                self._add(files.withColumnRenamed("relative_path", "path"))
                stopped = self._stops().exists(escaped(self.project))
                self._progress("index", i + 1, batches, total * (i + 1) // batches, "stopped" if stopped else "completed" if i + 1 == batches else "in-progress")
                lock.refresh()
                if stopped:
                    break
            old = self.rows("search_stats").first()
            if not done or old is None:
                self.put("search_stats", search.statistics(self.rows("postings")))
            else:  # what went and what came, not all postings
                self.put("search_stats", self.spark.createDataFrame([(old.docs + self._change[0], old.tokens + self._change[1])], "docs long, tokens long"))
            if not batches:
                self._progress("index", 0, 0, 0, "completed")
            self.seconds = time.time() - began
        return counts

    def update(self, root: str, **scan) -> dict[str, int]:
        return self.index(root, **scan)

    def _add(self, files: DataFrame) -> None:
        """Adds the chunks, postings and state of files that have none. State comes last: files without it are done again."""
        files = cut(files)
        parts = cut(self.chunked(files))
        ids = parts.select("id")
        for name in ("chunks", "postings") if self._leftovers else ():  # what a failed run has left of this batch goes
            if not self.rows(name).join(ids, "id", "left_semi").isEmpty():
                self.put(name, self.rows(name).join(ids, "id", "left_anti"))
        index = cut(search.postings(parts, "id", F.substring("text", 1, 32_000), "path"))
        with ThreadPoolExecutor(2) as pool:
            for j in [pool.submit(with_retries, lambda: self.table("chunks").append(self.project, parts)), pool.submit(with_retries, lambda: self.table("postings").append(self.project, index))]:
                j.result()
        self.table("file_state").append(self.project, files)
        new = search.statistics(index).first()
        self._change = [self._change[0] + new.docs, self._change[1] + new.tokens]

    def _beside(self, name: str) -> str:
        return f"{self.store}/indexes/{name}/{escaped(self.project)}"

    def _drop_indexes(self, *names: str) -> None:
        """Indexes of rows that are about to change go; questions then read the tables until optimize() is called again."""
        for name in names:
            Files(self.spark, self._beside(name)).delete()

    def _indexed(self, name: str) -> bool:
        return Files(self.spark, self._beside(name)).exists("_built")

    def optimize(self, cells: int | None = None) -> None:
        """Builds cells of vectors and blocks of postings over the project's chunks. Searches give the same answers by them, but
        read a part of the vectors and postings. cells: about the root of the number of chunks, if not given."""
        with self.lock():
            self._drop_indexes("vectors", "blocks")
            chunks = self.rows("chunks")
            VectorIndex(self.spark, self._beside("vectors")).build(chunks.select("id", "embedding"), cells or max(1, round(chunks.count() ** 0.5)))
            BlockMax(self.spark, self._beside("blocks")).from_postings(self.rows("postings"), self.rows("search_stats"))
            for name in ("vectors", "blocks"):
                Files(self.spark, self._beside(name)).create("_built", "")

    def _progress(self, phase: str, batch: int, batches: int, files: int, status: str) -> None:
        row = self.spark.createDataFrame([(phase, batch, batches, files, status)], "phase string, batch int, batches int, files long, status string")
        self.put("progress", row.withColumn("at", F.current_timestamp()))

    def chunked(self, files: DataFrame) -> DataFrame:
        known = files.select("path", "content", "language", "content_hash", extract.regions_of(F.col("language"), F.col("content")).alias("regions"))
        parts = chunking.chunks(known).select("path", "start_line", "end_line", "chunk", "id", "language", "content_hash")
        told = parts.withColumn("text", document_text(F.col("path"), F.col("chunk")))
        return self.provider.embed(told).where("embedding IS NOT NULL").withColumn("type", F.lit("code"))

    def search(self, query: str, limit: int = 10, file: str | None = None, language: str | None = None, min_score: float = 0.1, projects: list[str] = (), where: dict[str, str] | None = None) -> DataFrame:
        """The best chunks. With other projects each is searched by itself and the hits are merged by file; a project that
        cannot be searched is left out with a warning."""
        limit = int(clamped(limit, 1, 50, 10))
        own = list(dict.fromkeys([self.project, *projects]))
        if len(own) == 1:
            return self._search(query, limit, file, language, min_score, self.project, where)
        wide = max(2 * limit, 20)
        hits = []
        for name in own:
            try:  # at most `wide` rows of each project
                hits += [(name, i, r.path, r.start_line, r.end_line, r.language, r.chunk) for i, r in enumerate(self._search(query, wide, file, language, 0.0, name, where).collect())]
            except Exception as e:
                warnings.warn(f"{name} was not searched: {e}", stacklevel=2)
        rows = self.spark.createDataFrame(hits, "label string, rank int, path string, start_line int, end_line int, language string, chunk string")
        return search.multi_collection(rows.select("label", "rank", "path", F.struct("start_line", "end_line", "language", "chunk").alias("payload")), limit)

    def search_linked(self, query: str, root: str, project_of: Callable[[str], str], listed: str | None = None, **how) -> DataFrame:
        """search() over this project and those that the tree's project file or a comma-separated list links to it."""
        return self.search(query, projects=[project_of(p) for p in config.linked(root, listed, project_of)], **how)

    def _search(self, query: str, limit: int, file: str | None, language: str | None, min_score: float, project: str, where: dict[str, str] | None = None) -> DataFrame:
        return self._hybrid("chunks", "postings", "search_stats", query, limit, min_score, project, {"path": file, "language": language, **(where or {})})

    def _hybrid(self, chunks: str, index: str, stats: str, query: str, limit: int, min_score: float, project: str, wanted: dict[str, str | None]) -> DataFrame:
        """Hybrid search of stored chunks under a conjunction of column = value. The dense part gets the prefixed question, the
        sparse part the bare one and only the postings of its terms."""
        if not self.table(chunks).exists(project):
            raise ValueError(f"{project} has no {chunks}: index it first")
        rows, narrowed = self.rows(chunks, project), False
        for column, value in wanted.items():
            if value is not None:
                rows, narrowed = rows.where(F.col(column) == value), True
        vector = query_vector(self.spark, self.provider, query)
        terms = self.spark.range(1).select(search.tokens(F.lit(query))).first()[0]
        only = rows.select("id") if narrowed else None
        if chunks == "chunks" and project == self.project and self._indexed("vectors") and self._indexed("blocks"):
            wide = search.prefetch(limit)
            sparse = BlockMax(self.spark, self._beside("blocks")).best(terms, wide, only=only)
            dense = VectorIndex(self.spark, self._beside("vectors")).nearest([vector], wide, only=only)
        else:
            sparse = search.bm25_stored(self.rows(index, project), self.rows(stats, project), terms, only)
            dense = search.cosine(rows.select("id", "embedding"), "embedding", vector).where("NOT isnan(score)")
        best = search.hybrid(dense, sparse, "id", limit, min_score=min_score)
        return rows.drop("embedding", "text").join(F.broadcast(best), "id").orderBy(F.desc("score"), "id")

    def search_many(self, questions: list[str], limit: int = 10) -> DataFrame:
        """The best chunks of many questions at once: query (a question's place), rank, score and the chunk's columns. The
        corpus is read once for all of them."""
        limit = int(clamped(limit, 1, 50, 10))
        asked = self.spark.createDataFrame(list(enumerate(questions)), "query int, text string")
        told = self.provider.embed(asked.withColumn("text", query_text(F.col("text")))).orderBy("query").collect()
        wide, rows = search.prefetch(limit), self.rows("chunks")
        dense = search.dense_many(rows, [r.embedding for r in told], wide)
        sparse = search.sparse_many(self.rows("postings"), self.rows("search_stats"), asked, wide)
        best = search.hybrid_many(dense, sparse, limit)
        return rows.drop("embedding", "text").join(F.broadcast(best), "id").orderBy("query", "rank")

    def search_text(self, query: str, limit: int = 10, min_score: float = 0.1, **how) -> str:
        """search() as text, with the number of hits below the threshold and a note if the index is not complete."""
        rows = self.search(query, limit, min_score=0.0, **how)
        rows = (rows.select("label", "path", "score", "payload.*") if "payload" in rows.columns else rows).collect()
        good = [r.asDict() for r in rows if r.score >= min_score]
        last = self.rows("progress").first()
        note = "" if last is None or last.status == "completed" else f"The index is not complete (batch {last.batch} of {last.batches})."
        return render.results_text(query, self.project, good, len(rows) - len(good), min_score, note)

    def progress(self) -> str:
        """How far a run has come, as text."""
        last = self.rows("progress").first()
        if last is None:
            return "nothing has been indexed"
        return f"{last.phase}, {last.status}: " + render.progress_text(last.batch, last.batches, last.batch, last.batches, 0.0)

    def status(self) -> DataFrame:
        """One row: files, chunks and the last run's phase, batch, batches, status and time."""
        files = self.rows("file_state").agg(F.count(F.lit(1)).alias("files"))
        chunks = self.rows("chunks").agg(F.count(F.lit(1)).alias("chunks"))
        return files.join(F.broadcast(chunks)).join(F.broadcast(self.rows("progress").drop("files")), F.lit(True), "left")

    def projects(self) -> DataFrame:
        """project_id, files, chunks, graph_files, symbols, artifacts of all projects of the store."""
        per = lambda name, what: self.table(name).read().groupBy("project_id").agg(F.count(F.lit(1)).alias(what))
        out = per("file_state", "files")
        for name, what in (("chunks", "chunks"), ("graph_files", "graph_files"), ("symbols", "symbols"), ("artifact_state", "artifacts")):
            out = out.join(per(name, what), "project_id", "left").withColumn(what, F.coalesce(what, F.lit(0)))
        return out

    def remove(self) -> None:
        with self.lock():
            for name in TABLES:
                self.table(name).drop(self.project)
            self._drop_indexes("vectors", "blocks", "names", "reach")

    def resume(self, root: str, **scan) -> dict[str, int]:
        """What a service does at its start: goes on with an index that was not completed, and catches up with changes."""
        last = self.rows("progress").first()
        return self.index(root, **scan) if last is not None else {}

    def watch(self, root: str, checkpoint: str, once: bool = False, max_failures: int = 5):
        """A streaming query that updates the index and graph when the tree changes; stop() ends it."""
        from orebody.streaming.watch import watch

        def listing() -> DataFrame:
            found = sources.described(sources.contents(root, sources.indexable_paths(self.spark, root)))
            return found.select(F.col("relative_path").alias("path"), "content_hash")

        def stamps() -> DataFrame:
            return sources.indexable_paths(self.spark, root).select(F.col("relative_path").alias("path"), "length", "modified")

        def changed(_: DataFrame, __: int) -> None:
            self.index(root)
            self.graph.update(root)

        return watch(self.spark, listing, f"{self.store}/watch/{self.project}", changed, checkpoint, once=once, stamps=stamps, max_failures=max_failures)


class Graph:
    STORED = ("graph_files", "imports", "edges", "symbols", "name_refs", "calls", "call_edges")

    def __init__(self, engine: Engine):
        self.engine = engine

    def build(self, root: str, go_module: str | None = None, aliases: list | None = None, **scan) -> None:
        """Import edges, symbols, calls and resolved calls of the tree, in place of the stored ones. The Go module and path
        aliases are read from the tree unless they are given."""
        e = self.engine
        with e.lock() as lock:
            e._drop_indexes("names", "reach")
            # many branches read the files: they are scanned once
            e.put("graph_files", self._scanned(root, **scan))
            files = e.rows("graph_files")
            found = cut(extract.extracted(files))

            def put_edges() -> None:
                # stored, so that the rules of resolution stand once in a plan and not in each language's branch
                e.put("imports", extract.imports_of(files, self._languages()))
                e.put("edges", self._edges(root, go_module, aliases))

            def put_symbols() -> None:
                e.put("symbols", extract.symbol_rows(found))
                e.put("name_refs", e.rows("symbols").where(F.col("name") != sym.MODULE))

            lock.refresh()
            with ThreadPoolExecutor(3) as pool:  # tables do not wait for each other
                for j in [pool.submit(put_edges), pool.submit(put_symbols), pool.submit(lambda: e.put("calls", extract.call_rows(found)))]:
                    j.result()
            lock.refresh()
            e.put("call_edges", sym.resolved(e.rows("calls"), e.rows("symbols"), e.rows("edges")))
            self._save_rules(root, go_module, aliases)

    def _scanned(self, root: str, **scan) -> DataFrame:
        return sources.graphable_files(self.engine.spark, root, **scan).withColumnRenamed("relative_path", "path")

    def _languages(self) -> set[str]:
        return {r.language for r in self.engine.rows("graph_files").select("language").distinct().collect()}

    def _edges(self, root: str, go_module: str | None, aliases: list | None, imports: DataFrame | None = None, languages: set[str] | None = None) -> DataFrame:
        """Edges of all imports, or of some of which the languages are known."""
        own_module, own_aliases = config.module_rules(root)
        files = self.engine.rows("graph_files")
        paths = files.select("path")
        return resolve.resolved_imports(self.engine.rows("imports") if imports is None else imports, paths, go_module or own_module, sources.go_packages(paths), sources.namespaces(files), sources.class_suffixes(paths), own_aliases if aliases is None else aliases, self._languages() if languages is None else languages)

    def update(self, root: str, go_module: str | None = None, aliases: list | None = None, **scan) -> dict[str, int]:
        """Brings the stored graph to the state of the tree; the result is that of build(). Counts of files by status.

        Files of the stored length and time are not read. Only changed ones are parsed, only buckets of their paths and names
        are rewritten, and only calls that a change can reach are resolved again: those of changed files, of files that
        import them, and calls of a changed name in files that import those.
        """
        e = self.engine
        marks = Files(e.spark, f"{e.store}/patching")
        if not e.has("graph_files") or marks.exists(escaped(e.project)):  # none yet, or a patch that was not finished
            self.build(root, go_module, aliases, **scan)
            marks.delete(escaped(e.project))
            return {"added": e.rows("graph_files").count()}
        with e.lock() as lock:
            listed = sources.graphable_paths(e.spark, root, **scan).withColumnRenamed("relative_path", "path")
            odd = cut(changes.restamped(listed, e.rows("graph_files")))
            now = sources.graphed(sources.contents(root, odd.where("listed").withColumnRenamed("path", "relative_path"))).withColumnRenamed("relative_path", "path")
            parsed = extract.extracted(now).select("path", "symbols", "calls")
            anew = cut(now.join(parsed, "path"))
            status = F.when(F.col("content_hash").isNull(), "removed").when(F.col("old_hash").isNull(), "added").when(F.col("old_hash") == F.col("content_hash"), "unchanged").otherwise("changed")
            judged = cut(odd.select("path", "old_hash", "listed").join(anew.select("path", "content_hash", "language"), "path", "left").where("old_hash IS NOT NULL OR content_hash IS NOT NULL").select("path", status.alias("status"), "language", e.table("graph_files").number("path").alias("b")))
            seen = judged.groupBy("status", "b").agg(F.count(F.lit(1)).alias("n"), F.collect_set("language").alias("languages")).collect()
            counts: dict[str, int] = {}
            for r in seen:
                counts[r.status] = counts.get(r.status, 0) + r.n
            same = e.rows("graph_files").count() - counts.get("changed", 0) - counts.get("removed", 0)
            counts |= {"unchanged": same} if same else {}
            buckets = sorted({r.b for r in seen if r.status != "unchanged"})
            odd_buckets = sorted({r.b for r in seen})
            if not buckets:
                if odd_buckets:  # new stamps of the same contents
                    e.table("graph_files").patch(e.project, odd_buckets, self._kept_files(odd_buckets, judged.select("path"), anew))
                return counts
            marks.create(escaped(e.project), "patching")
            e._drop_indexes("names", "reach")
            languages = {x for r in seen if r.status != "unchanged" for x in r.languages}
            moved = judged.where("status <> 'unchanged'").select("path")
            stamped, anew = anew, anew.join(moved, "path", "left_semi")
            symbols, calls = extract.symbol_rows(anew), extract.call_rows(anew)
            gone = moved.withColumnRenamed("path", "file")
            refs = e.table("name_refs")
            names = cut(e.table("symbols").read(e.project, buckets).join(gone, "file", "left_semi").select("name").unionByName(symbols.select("name")).distinct())

            def patch(name: str, rows: DataFrame, to: list[int] = buckets, of: str | None = None) -> None:
                table = e.table(name)
                kept = table.read(e.project, to).join(moved.withColumnRenamed("path", of or table.key), of or table.key, "left_anti")
                with_retries(lambda: table.patch(e.project, to, table.shaped(kept).unionByName(table.shaped(rows))))

            def patch_names() -> None:
                to = [r.b for r in names.select(refs.number("name").alias("b")).distinct().collect()]
                patch("name_refs", symbols.where(F.col("name") != sym.MODULE), to, "file")

            fresh_imports = extract.imports_of(anew, languages)
            # the set of files, or names that sources declare, may move the target of any import
            whole = bool({"added", "removed"} & set(counts)) or "csharp" in languages or self._rules_differ(root, go_module, aliases)
            with ThreadPoolExecutor(5) as pool:  # tables do not wait for each other
                jobs = [pool.submit(patch, "imports", fresh_imports), pool.submit(patch, "symbols", symbols), pool.submit(patch, "calls", calls), pool.submit(patch_names)]
                if not whole:
                    jobs.append(pool.submit(lambda: patch("edges", self._edges(root, go_module, aliases, fresh_imports, languages))))
                for j in jobs:
                    j.result()
            lock.refresh()
            changed = gone
            if whole:
                with_retries(lambda: e.table("graph_files").patch(e.project, odd_buckets, self._kept_files(odd_buckets, judged.select("path"), stamped)))
                old = cut(e.rows("edges").distinct())
                e.put("edges", self._edges(root, go_module, aliases))
                edges = e.rows("edges").distinct()
                # files whose edges differ count as changed: a new file can become the target of an old import
                differ = old.exceptAll(edges).unionByName(edges.exceptAll(old)).select(F.col("source").alias("file"))
                changed = cut(gone.unionByName(differ).distinct())
            affected = cut(sym.reached_callers(e.rows("calls"), e.rows("edges"), changed, names))
            table = e.table("call_edges")
            to = [r.b for r in affected.select(table.number("caller_file").alias("b")).distinct().collect()]
            again = sym.resolved(e.table("calls").read(e.project, to).join(affected, "caller_file", "left_semi"), e.rows("symbols"), e.rows("edges"))
            kept = table.read(e.project, to).join(affected, "caller_file", "left_anti")
            with_retries(lambda: table.patch(e.project, to, table.shaped(kept).unionByName(table.shaped(again))))
            if not whole:
                with_retries(lambda: e.table("graph_files").patch(e.project, odd_buckets, self._kept_files(odd_buckets, judged.select("path"), stamped)))
            self._save_rules(root, go_module, aliases)
            marks.delete(escaped(e.project))
        return counts

    def _kept_files(self, buckets: list[int], moved: DataFrame, anew: DataFrame) -> DataFrame:
        table = self.engine.table("graph_files")
        kept = table.read(self.engine.project, buckets).join(moved, "path", "left_anti")
        return table.shaped(kept).unionByName(table.shaped(anew))

    def _rules(self, root: str, go_module: str | None, aliases: list | None) -> str:
        own_module, own_aliases = config.module_rules(root)
        return repr((go_module or own_module, own_aliases if aliases is None else aliases))

    def _rules_differ(self, root: str, go_module: str | None, aliases: list | None) -> bool:
        return Files(self.engine.spark, f"{self.engine.store}/rules").read(escaped(self.engine.project)) != self._rules(root, go_module, aliases)

    def _save_rules(self, root: str, go_module: str | None, aliases: list | None) -> None:
        Files(self.engine.spark, f"{self.engine.store}/rules").create(escaped(self.engine.project), self._rules(root, go_module, aliases), overwrite=True)

    def optimize(self) -> None:
        """Builds the index of names and the closure of file dependencies (imports and calls)."""
        e = self.engine
        with e.lock():
            e._drop_indexes("names", "reach")
            NameIndex(e.spark, e._beside("names")).build(e.rows("symbols"))
            built = Reachability(e.spark, e._beside("reach")).build(self.links())
            Files(e.spark, e._beside("names")).create("_built", "")
            Files(e.spark, e._beside("reach")).create("_built", built.path)

    def links(self) -> DataFrame:
        """source and target of all imports, and of calls between files."""
        calls = sym.reverse_index(self.engine.rows("call_edges"), self.engine.rows("symbols"))
        return self.edges().select("source", "target").unionByName(calls.select(F.col("caller_file").alias("source"), F.col("callee_file").alias("target"))).distinct()

    def closure(self, files: list[str], reverse: bool = False) -> DataFrame:
        """seed and node: all files that these depend on, or (reverse) that depend on them, however far. Needs optimize()."""
        e = self.engine
        found = Files(e.spark, e._beside("reach")).read("_built")
        if found is None:
            raise ValueError("there is no closure of this graph: call optimize() first")
        seeds = e.spark.createDataFrame([(f.replace("\\", "/"),) for f in files], "node string")
        return Reachability(e.spark, found).closure(seeds, reverse)

    def edges(self) -> DataFrame:
        return self.engine.rows("edges")

    def nodes(self) -> DataFrame:
        return self.engine.rows("graph_files").select(F.col("path").alias("node"))

    def deps(self, file: str) -> DataFrame:
        return graph.file_dependencies(self.edges(), file.replace("\\", "/"))

    def stats(self) -> DataFrame:
        return graph.graph_stats(self.nodes(), self.edges(), cyclic=True)

    def languages(self) -> DataFrame:
        return self.nodes().groupBy(language(F.col("node")).alias("language")).agg(F.count(F.lit(1)).alias("files")).orderBy(F.desc("files"), "language")

    def report(self) -> dict:
        """Totals, the most connected files, files by language and the number of orphans and of edges on cycles, in one answer."""
        totals = self.stats().first().asDict()
        return totals | {"most_connected": [tuple(r) for r in graph.most_connected(self.edges()).collect()], "languages": {r.language: r.files for r in self.languages().collect()}}

    def cycles(self, max_length: int = 6) -> DataFrame:
        return graph.cycles(self.edges(), max_length)

    def cyclic_edges(self) -> DataFrame:
        return graph.cyclic_edges(self.edges())

    def mermaid(self) -> str:
        return render.diagram(self.edges(), self.nodes())

    def page(self) -> str:
        """A viewer of the graph: one page of HTML that needs nothing else."""
        e = self.engine
        return render.viewer_page(render.viewer_data(e.project, self.nodes(), self.edges(), e.rows("symbols"), e.rows("call_edges")))

    def write_page(self, folder: str | None = None, show: bool = False) -> str:
        """Writes the page to a file of the driver's machine, named after the project, and opens it if asked; its path."""
        import tempfile
        import webbrowser
        from pathlib import Path

        name = "".join(c if c.isalnum() else "_" for c in self.engine.project)
        path = Path(folder or tempfile.gettempdir(), f"graph-{name}.html")
        path.write_text(self.page(), encoding="utf-8")
        if show:
            webbrowser.open(path.as_uri())
        return str(path)

    def remove(self) -> None:
        with self.engine.lock():
            for name in self.STORED:
                self.engine.table(name).drop(self.engine.project)

    def status(self) -> DataFrame:
        return sym.symbol_graph_meta(self.engine.rows("symbols"), self.engine.rows("call_edges"))


class Symbols:
    def __init__(self, engine: Engine):
        self.engine = engine

    def _own(self, name: str) -> DataFrame:
        return self.engine.rows(name)

    def impact(self, target: str, depth: int = 3) -> DataFrame:
        """Files that depend on a file, or on the files that define a symbol, by their distance. Calls between files count."""
        spark = self.engine.spark
        if spark.range(1).select(looks_like_path(F.lit(target))).first()[0]:
            seeds = spark.createDataFrame([(target.replace("\\", "/"),)], "node string")
        else:
            seeds = self._own("name_refs").where(F.col("name") == target).select(F.col("file").alias("node")).distinct()
        links = sym.reverse_index(self._own("call_edges"), self._own("symbols")).select(F.col("caller_file").alias("source"), F.col("callee_file").alias("target"))
        return graph.impact(links, seeds, int(clamped(depth, 1, graph.MAX_DEPTH, 3)))

    def ids(self, name: str, file: str | None = None) -> list[str]:
        """Ids of the symbols of a name, at most 51 of them: more than one needs a file to tell them apart."""
        rows = self._own("name_refs").where(F.col("name") == name)
        if file:
            rows = rows.where(F.col("file") == file.replace("\\", "/"))
        return [r.id for r in rows.orderBy("id").limit(51).collect()]

    def flow(self, symbol_id: str, depth: int = 5) -> list[tuple[int, str, str]]:
        return sym.flow_tree(self._own("call_edges"), symbol_id, int(clamped(depth, 1, graph.MAX_DEPTH, 5)))

    def flow_text(self, name: str | None = None, file: str | None = None, depth: int = 5) -> str:
        """The call tree of a symbol as text; without a name, the entry points that one can start from."""
        if not name:
            points = cut(self.entry_points())
            found = [f"{r.id} ({r.reason})" for r in points.orderBy("id", "reason").limit(render.SHOWN).collect()]
            return render.capped_list("Entry points", found, total=points.count()) if found else "No entry points found."
        ids = self.ids(name, file)
        if len(ids) != 1:
            return render.capped_list(f"{name} is not unique; name a file", ids) if ids else f"There is no symbol {name}."
        return render.tree_text(self.flow(ids[0], depth))

    def entry_points(self) -> DataFrame:
        return sym.entry_points(self._own("symbols"), self._own("calls"), self._own("edges"))

    def context(self, name: str, file: str | None = None) -> DataFrame:
        return sym.symbol_context(self._own("call_edges"), self._own("symbols"), name, file and file.replace("\\", "/"))

    def list(self, contains: str | None = None, file: str | None = None, limit: int = 200) -> DataFrame:
        if self.engine._indexed("names"):
            return NameIndex(self.engine.spark, self.engine._beside("names")).list(contains, file and file.replace("\\", "/"), limit)
        return sym.list_symbols(self._own("symbols"), contains, file and file.replace("\\", "/"), limit)

    def find(self, text: str, limit: int = 50) -> DataFrame:
        if self.engine._indexed("names"):
            return NameIndex(self.engine.spark, self.engine._beside("names")).find(text, limit)
        return sym.symbol_lookup(self._own("symbols"), text, limit)


class Artifacts:
    STORED = ("artifact_chunks", "artifact_postings", "artifact_search_stats", "artifact_state")

    def __init__(self, engine: Engine):
        self.engine = engine

    def configured(self, root: str, fallback: str | None = None) -> dict[str, str]:
        return {a.name: a.path for a in config.artifacts(root, fallback)}

    def _files(self, configured: dict[str, str]) -> DataFrame | None:
        rows = None
        for name, path in configured.items():
            one = sources.artifact_files(self.engine.spark, name, path)
            rows = one if rows is None else rows.unionByName(one)
        return rows

    def index(self, configured: dict[str, str], descriptions: dict[str, str] | None = None) -> dict[str, str]:
        """name to path (a file or folder); artifacts whose content changed are chunked and embedded again, those no longer
        configured go. The status that each had: new, stale, fresh or removed."""
        e = self.engine
        with e.lock():
            files = self._files(configured)
            if files is None:
                gone = {r.artifact: "removed" for r in e.rows("artifact_state").collect()}
                for name in self.STORED:
                    e.table(name).drop(e.project)
                return gone
            files = cut(files)
            state = cut(arts.fingerprints(files))
            status = {r.artifact: r.status for r in arts.staleness(state, e.rows("artifact_state")).collect()}
            todo = [a for a, s in status.items() if s in ("new", "stale")]
            stays = [a for a, s in status.items() if s == "fresh"]
            if todo or "removed" in status.values():
                paths = F.create_map(*(F.lit(x) for pair in configured.items() for x in pair))
                whole = arts.concatenated(files.where(F.col("artifact").isin(*todo))).withColumn("path", F.element_at(paths, F.col("artifact")))
                told = arts.artifact_chunks(whole).withColumn("text", document_text(F.col("path"), F.col("chunk")))
                parts = cut(e.provider.embed(told).where("embedding IS NOT NULL"))
                table, own = e.table("artifact_chunks"), F.col("artifact").isin(*stays)
                e.put("artifact_chunks", e.rows("artifact_chunks").where(own).unionByName(table.shaped(parts)))
                fresh = e.table("artifact_postings").shaped(search.postings(parts, "id", F.substring("text", 1, 32_000), "artifact"))
                e.put("artifact_postings", e.rows("artifact_postings").where(own).unionByName(fresh).sortWithinPartitions("term"))
                e.put("artifact_search_stats", search.statistics(e.rows("artifact_postings")))
                told_of = F.create_map(*(F.lit(x) for pair in (descriptions or {"": ""}).items() for x in pair))
                e.put("artifact_state", state.select("artifact", F.element_at(paths, F.col("artifact")).alias("path"), F.try_element_at(told_of, F.col("artifact")).alias("description"), "content_hash"))
        return status

    def list(self, root: str, fallback: str | None = None) -> DataFrame:
        """name, path, description, chunks and whether it is indexed, for each configured artifact."""
        rows = self.engine.spark.createDataFrame(config.artifacts(root, fallback), "artifact string, path string, description string")
        per = self.engine.rows("artifact_chunks").groupBy("artifact").agg(F.count(F.lit(1)).alias("chunks"))
        return rows.join(per, "artifact", "left").withColumn("indexed", F.col("chunks").isNotNull()).withColumn("chunks", F.coalesce("chunks", F.lit(0)))

    def refresh(self, root: str, fallback: str | None = None) -> dict[str, str]:
        found = config.artifacts(root, fallback)
        return self.index({a.name: a.path for a in found}, {a.name: a.description for a in found})

    def search(self, query: str, artifact: str | None = None, limit: int = 10, min_score: float = 0.1, root: str | None = None) -> DataFrame:
        """The best chunks; with root, the artifacts that its file names are brought up to date first."""
        if root is not None:
            self.refresh(root)
        return self.engine._hybrid("artifact_chunks", "artifact_postings", "artifact_search_stats", query, int(clamped(limit, 1, 50, 10)), min_score, self.engine.project, {"artifact": artifact})

    def remove(self) -> None:
        with self.engine.lock():
            for name in self.STORED:
                self.engine.table(name).drop(self.engine.project)
