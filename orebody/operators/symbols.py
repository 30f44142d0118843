"""Symbols and calls: three-tier resolution, contexts, indexes, entry points, flow.

symbols: id, name, kind, file, line, end_line, language (a `<module>` symbol stands for a whole file);
calls: caller_id, caller_file, callee_name, line (one row a call site, told apart by call_id);
edges: source, target (file dependencies).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orebody.operators.graph import reach
from orebody.sources.store import cut

MODULE = "<module>"
#: Names of entry points by language, and calls that register a handler.
ENTRY_NAMES = {lang: "main" for lang in ("javascript", "typescript", "python", "go", "rust", "java", "kotlin", "scala", "c", "cpp", "swift", "ruby", "php", "dart")} | {"csharp": "Main"}
HTTP_VERBS = ("get", "post", "put", "delete", "patch", "head", "options", "all", "use")
TEST_NAME = r"^test[_A-Z]|^Test[A-Z_]|^it$|^describe$"


def resolved(calls: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """call_id, caller_id, caller_file, callee_name, line, candidates (sorted ids) and confidence.

    Tier 1: the caller's file; tier 2: files it depends on; tier 3: files those depend on, but not the caller's own. The first
    tier with a hit counts. File pairs with their tier are one relation, so one join finds all hits, and partial
    aggregation keeps the lowest tier.
    """
    deps = edges.select("source", "target").distinct()
    files = calls.select(F.col("caller_file").alias("source")).distinct()
    first = deps.join(files, "source", "left_semi")
    second = first.join(deps.select(F.col("source").alias("target"), F.col("target").alias("far")), "target").select("source", F.col("far").alias("target")).where("source <> target").distinct()
    reachable = files.select("source", F.col("source").alias("target"), F.lit(1).alias("tier")).unionAll(first.select("source", "target", F.lit(2))).unionAll(second.select("source", "target", F.lit(3)))
    names = symbols.where(F.col("name") != MODULE).select(F.col("file").alias("target"), F.col("name").alias("callee_name"), F.col("id").alias("hit"))
    wanted = calls.select(F.col("caller_file").alias("source"), "callee_name").distinct()
    # files first: a name that thousands of files define meets only the definitions in reach of its caller
    hits = reachable.join(wanted, "source").join(names, ["target", "callee_name"])
    best = hits.groupBy("source", "callee_name", "tier").agg(F.array_sort(F.collect_set("hit")).alias("c")).groupBy("source", "callee_name").agg(F.min(F.struct("tier", "c")).alias("b"))
    found = calls.join(best.withColumnRenamed("source", "caller_file"), ["caller_file", "callee_name"], "left")
    n = F.size("b.c")
    confidence = F.when(F.col("b").isNull(), "unresolved").when(F.col("b.tier") == 1, "local").when(n == 1, "unique").otherwise("multiple-candidates")
    return found.select("call_id", "caller_id", "caller_file", "callee_name", "line", F.coalesce("b.c", F.array().cast("array<string>")).alias("candidates"), confidence.alias("confidence"))


def unresolved_percent(call_edges: DataFrame) -> DataFrame:
    """One row: edges, unresolved_pct (0 without edges)."""
    return call_edges.agg(F.count(F.lit(1)).alias("edges"), F.coalesce(F.round(F.avg(F.when(F.size("candidates") == 0, 100.0).otherwise(0.0)), 6), F.lit(0.0)).alias("unresolved_pct"))


def symbol_graph_meta(symbols: DataFrame, call_edges: DataFrame) -> DataFrame:
    named = symbols.agg(F.count(F.when(F.col("name") != MODULE, 1)).alias("symbols"), F.countDistinct("file").alias("files"))
    return named.join(F.broadcast(unresolved_percent(call_edges)))


def name_index(symbols: DataFrame) -> DataFrame:
    """name and how many symbols bear it in how many files; the refs themselves are name_refs()."""
    return symbols.where(F.col("name") != MODULE).groupBy("name").agg(F.count(F.lit(1)).alias("refs"), F.countDistinct("file").alias("files"))


def name_refs(symbols: DataFrame) -> DataFrame:
    """name, file, id, kind, line of each definition, in files sorted by name: a lookup reads the row groups of its name."""
    return symbols.where(F.col("name") != MODULE).select("name", "file", "id", "kind", "line").repartitionByRange("name", "id").sortWithinPartitions("name", "id")


def file_languages(symbols: DataFrame) -> DataFrame:
    """file and its language: that of its first symbol by line that is not the module; of a file without any, the module's."""
    first = F.struct(F.col("name") == MODULE, "line", "id")
    return symbols.groupBy("file").agg(F.min_by("language", first).alias("language"))


def reverse_index(call_edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Distinct callee_file and caller_file, own calls excluded."""
    owner = symbols.select(F.col("id").alias("hit"), F.col("file").alias("callee_file"))
    return call_edges.select("caller_file", F.explode("candidates").alias("hit")).join(owner, "hit").where("caller_file <> callee_file").select("callee_file", "caller_file").distinct()


def symbol_context(call_edges: DataFrame, symbols: DataFrame, name: str, file: str | None = None, own_file: bool = False) -> DataFrame:
    """role (caller, callee), id of the definition, other (symbol id or called name), line, confidence, candidates."""
    definitions = symbols.where(F.col("name") == name)
    if file is not None:
        definitions = definitions.where(F.col("file") == file)
    d = definitions.select("id", F.col("file").alias("own"))
    callers = call_edges.select("caller_id", "caller_file", "line", "confidence", F.explode("candidates").alias("id"), F.size("candidates").alias("candidates")).join(d, "id")
    callers = callers if own_file else callers.where("caller_file <> own")
    callees = call_edges.join(d, F.col("caller_id") == F.col("id"))
    return callers.select(F.lit("caller").alias("role"), "id", F.col("caller_id").alias("other"), "line", "confidence", "candidates").unionAll(callees.select(F.lit("callee"), "id", "callee_name", "line", "confidence", F.size("candidates")))


def list_symbols(symbols: DataFrame, contains: str | None = None, file: str | None = None, limit: int = 200) -> DataFrame:
    rows = symbols.where(F.col("name") != MODULE)
    if contains:
        rows = rows.where(F.contains(F.lower("name"), F.lit(contains.lower())))
    if file:
        rows = rows.where(F.col("file") == file)
    return rows.orderBy("name", "file", "line", "id").limit(limit)


def symbol_lookup(symbols: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Exact names before names that begin so, those that contain it and qualified names that do; match is 0 to 3."""
    low, q = F.lower("name"), F.lit(query.lower())
    match = F.when(low == q, 0).when(F.startswith(low, q), 1).when(F.contains(low, q), 2)
    if "qualified_name" in symbols.columns:
        match = match.when(F.contains(F.lower("qualified_name"), q), 3)
    return symbols.where(F.col("name") != MODULE).withColumn("match", match).where("match IS NOT NULL").orderBy("match", "name", "file", "line", "id").limit(limit)


def symbols_by_file(symbols: DataFrame, cap: int = 200) -> DataFrame:
    named = symbols.where(F.col("name") != MODULE)
    w = Window.partitionBy("file").orderBy("line", "id")
    counts = named.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    first = named.withColumn("r", F.row_number().over(w)).where(F.col("r") <= cap).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("line", "name"))).alias("s"))
    return counts.join(first, "file").select("file", "n", F.transform("s", lambda x: x["name"]).alias("names"))


def covering(sites: DataFrame, symbols: DataFrame, *keys: str, block: int = 64) -> DataFrame:
    """sites: file, line and keys. keys and b, the symbol (start, id) that covers the line and starts last (of equal starts, the
    last id). Spans are laid out over blocks of lines, so that a line meets the spans of its block and not of its whole file."""
    at = lambda line: F.floor(F.col(line) / block).cast("int")
    spans = symbols.where(F.col("name") != MODULE).select("file", F.col("id"), F.col("line").alias("start"), F.col("end_line").alias("end"))
    laid = spans.where("end >= start").withColumn("_block", F.explode(F.sequence(at("start"), at("end"))))
    inside = sites.withColumn("_block", at("line")).join(laid, ["file", "_block"]).where(F.col("line").between(F.col("start"), F.col("end")))
    return inside.groupBy(*keys).agg(F.max(F.struct("start", "id")).alias("b"))


def caller_attribution(sites: DataFrame, symbols: DataFrame) -> DataFrame:
    """sites: file, line, site. The symbol that covers the line and starts last (of equal starts, the last id)."""
    best = covering(sites, symbols, "file", "site")
    return sites.join(best, ["file", "site"], "left").select("file", "site", "line", F.coalesce("b.id", F.concat("file", F.lit("::<module>#1"))).alias("caller_id"))


def entry_points(symbols: DataFrame, calls: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct id and reason: files nobody depends on that call something, names of entry points, handlers and tests."""
    named = symbols.where(F.col("name") != MODULE)
    roots = named.select("file").distinct().join(calls.select(F.col("caller_file").alias("file")).distinct(), "file", "left_semi").join(edges.select(F.col("target").alias("file")).distinct(), "file", "left_anti")
    orphan = roots.select(F.concat("file", F.lit("::<module>#1")).alias("id"), F.lit("orphan").alias("reason"))
    wanted = F.create_map(*(F.lit(x) for pair in ENTRY_NAMES.items() for x in pair))
    mains = named.where(F.col("name") == F.element_at(wanted, F.col("language"))).select("id", F.concat(F.lit("name:"), F.col("name")).alias("reason"))
    low = F.lower("callee_name")
    reason = F.when(low.isin(*HTTP_VERBS), F.concat(F.lit("framework:http-"), low)).when(low == "route", "framework:route")
    sites = calls.withColumn("reason", reason).where("reason IS NOT NULL").select(F.col("caller_file").alias("file"), "line", F.col("call_id").alias("site"), "reason")
    handlers = covering(sites, symbols, "site", "reason").select("b.id", "reason")
    tests = named.where(F.col("name").rlike(TEST_NAME)).select("id", F.lit("test").alias("reason"))
    return orphan.unionAll(mains).unionAll(handlers).unionAll(tests).distinct()


def call_edges_between(call_edges: DataFrame) -> DataFrame:
    return call_edges.select(F.col("caller_id").alias("source"), F.explode("candidates").alias("target")).distinct()


def flow(call_edges: DataFrame, seeds: DataFrame, depth: int = 5) -> DataFrame:
    """Symbols (node) that the seeds' calls reach, and in how many calls (hop)."""
    return reach(call_edges_between(call_edges), seeds, depth, "forward")


def flow_tree(call_edges: DataFrame, seed: str, depth: int = 5, max_nodes: int = 5000) -> list[tuple[int, str, str]]:
    """Preorder rows (depth, id, reason) of the call tree; reason is call, cycle (seen before, anywhere) or depth.

    The tree is drawn on the driver from the bounded neighbourhood; more than max_nodes of its edges are refused.
    """
    spark = call_edges.sparkSession
    start = spark.createDataFrame([(seed,)], "node string")
    near = start.unionAll(flow(call_edges, start, depth).select("node"))
    rows = call_edges.join(near.withColumnRenamed("node", "caller_id"), "caller_id", "left_semi").select("caller_id", "line", "call_id", F.explode("candidates").alias("to")).limit(max_nodes + 1).collect()
    if len(rows) > max_nodes:
        raise ValueError("the flow is too large to draw")
    calls: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r.caller_id, r.line, str(r.call_id), r.to)):
        calls.setdefault(r.caller_id, []).append(r.to)
    out, seen, stack = [], set(), [(0, seed)]
    while stack:
        level, node = stack.pop()
        if node in seen:
            out.append((level, node, "cycle"))
            continue
        seen.add(node)
        if level >= depth:
            out.append((level, node, "depth"))
            continue
        out.append((level, node, "call"))
        stack += [(level + 1, c) for c in reversed(calls.get(node, []))]
    return out


def reached_callers(calls: DataFrame, edges: DataFrame, changed_files: DataFrame, changed_names: DataFrame) -> DataFrame:
    """caller_file of the files whose calls a change may resolve otherwise: the changed ones (file), those that import them, and
    those that import these and call a changed name (name)."""
    deps = edges.select("source", "target").distinct()
    by = lambda files: deps.join(files.withColumnRenamed("file", "target"), "target", "left_semi").select(F.col("source").alias("file"))
    near = changed_files.select("file").unionByName(by(changed_files)).distinct()
    far = by(near).select(F.col("file").alias("caller_file")).distinct()
    called = calls.join(far, "caller_file", "left_semi").join(changed_names.select(F.col("name").alias("callee_name")), "callee_name", "left_semi")
    return near.select(F.col("file").alias("caller_file")).unionByName(called.select("caller_file")).distinct()


def patched_calls(call_edges: DataFrame, calls: DataFrame, symbols: DataFrame, edges: DataFrame, changed_files: DataFrame, changed_names: DataFrame) -> DataFrame:
    """call_edges after a change: resolved anew where the caller's file changed or the name called was touched; exact.

    changed_files: file (its edges may differ too); changed_names: callee_name (defined before or after in those files).
    """
    importers = edges.join(changed_files.withColumnRenamed("file", "target"), "target", "left_semi").select(F.col("source").alias("caller_file"))
    near = changed_files.select(F.col("file").alias("caller_file")).unionAll(importers).distinct()
    by_file, by_name = (calls.join(rows, key, "left_semi").select("call_id") for rows, key in ((near, "caller_file"), (changed_names, "callee_name")))
    touched = cut(by_file.unionAll(by_name).distinct())
    anew = resolved(calls.join(touched, "call_id", "left_semi"), symbols, edges)
    kept = call_edges.join(calls.select("call_id"), "call_id", "left_semi").join(touched, "call_id", "left_anti")
    return kept.unionByName(anew)
