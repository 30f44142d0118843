"""Text and pages for people: diagrams, a viewer, result lists, call trees, progress. All draw bounded tables on the driver."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orebody.functions.scalars import base_name, language
from orebody.operators.graph import cyclic_edges, ends, numbered
from orebody.operators.symbols import MODULE, symbols_by_file

#: A language's colour in diagrams; others are grey.
COLOURS = {
    "typescript": "#3178C6", "javascript": "#F7DF1E", "python": "#3776AB", "java": "#ED8B00", "kotlin": "#7F52FF", "go": "#00ADD8",
    "rust": "#CE422B", "ruby": "#CC342D", "php": "#777BB4", "swift": "#FA7343", "c": "#A8B9CC", "cpp": "#00599C",
    "csharp": "#239120", "scala": "#DC322F", "dart": "#0175C2", "lua": "#2C2D72", "shell": "#4EAA25",
}
GREY = "#607D8B"
#: What a viewer's page holds at most; beyond it symbols are left out and the page says so.
MOST_SYMBOLS, MOST_CALLS, MOST_OF_FILE = 20_000, 60_000, 200


def diagram_lines(edges: DataFrame, nodes: DataFrame | None = None, rings: DataFrame | None = None) -> DataFrame:
    """part (node, edge, style, legend), a, b (for the order) and line: the lines of a diagram of the files (node) and edges (source,
    target, type). Repeated edges are drawn once; those on cycles and dynamic imports are dotted. rings (source, target): edges
    that are drawn as those of a cycle though the rest of it is not at hand."""
    names = ends(edges).distinct() if nodes is None else nodes.select("node").distinct()
    numbers = numbered(names)
    known = numbers.select("n", "node", language(F.col("node")).alias("language"))
    colour = F.lit(GREY)
    for lang, value in COLOURS.items():
        colour = F.when(F.col("language") == lang, value).otherwise(colour)
    own = known.withColumn("colour", colour)
    node_lines = own.select(F.lit("node").alias("part"), F.col("n").alias("a"), F.lit(0).cast("long").alias("b"), F.format_string('    n%d["%s"]', "n", base_name(F.col("node"))).alias("line"))
    style_lines = own.select(F.lit("style"), F.col("n"), F.lit(0).cast("long"), F.format_string("    style n%d fill:%s,color:#fff,stroke:%s", "n", "colour", "colour"))
    plain = edges.groupBy("source", "target").agg(F.min(F.col("type") == "dynamic-import").alias("dynamic"))
    on_cycle = cyclic_edges(plain)
    on_cycle = (on_cycle if rings is None else on_cycle.unionByName(rings.select("source", "target")).distinct()).withColumn("cyclic", F.lit(True))
    at = lambda end, n: numbers.select(F.col("node").alias(end), F.col("n").alias(n))
    drawn = plain.join(on_cycle, ["source", "target"], "left").join(at("source", "a"), "source").join(at("target", "b"), "target")
    arrow = F.when(F.col("cyclic"), "-.->|cycle|").when(F.col("dynamic"), "-.->").otherwise("-->")
    edge_lines = drawn.select(F.lit("edge"), "a", "b", F.format_string("    n%d %s n%d", F.col("a"), arrow, F.col("b")))
    used = own.where(F.col("colour") != GREY).select("language", "colour").distinct()
    legend = used.select(F.lit("legend"), F.lit(0).cast("long"), F.lit(0).cast("long"), F.format_string('    legend_%s["%s"]\n    style legend_%s fill:%s,color:#fff,stroke:%s', "language", "language", "language", "colour", "colour"))
    return node_lines.unionAll(edge_lines).unionAll(style_lines).unionAll(legend)


def diagram(edges: DataFrame, nodes: DataFrame | None = None, most: int = 10_000) -> str:
    """The diagram's text. A picture of more than `most` lines is of no use, so it is refused."""
    rows = diagram_lines(edges, nodes).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} lines; choose a neighbourhood first")
    of = lambda part: [r.line for r in sorted((r for r in rows if r.part == part), key=lambda r: (r.a, r.b, r.line))]
    if not rows:
        return "graph LR\n  empty[No files found]"
    legend = of("legend")
    box = ["", "    subgraph Legend", "    direction LR", *legend, "    end"] if len(legend) > 1 else []
    return "\n".join(["graph LR", *of("node"), "", *of("edge"), "", *of("style"), *box])


def viewer_data(project: str, nodes: DataFrame, edges: DataFrame, symbols: DataFrame, call_edges: DataFrame) -> dict:
    """What the viewer shows: files with their degrees, distinct edges with their cycles, symbols and the first target of each call.

    Beyond the fixed limits symbols and calls are left out and the mode is `capped`; each file still lists its first symbols.
    """
    plain = edges.groupBy("source", "target").agg(F.min("type").alias("type"))
    on_cycle = cyclic_edges(plain).withColumn("on", F.lit(True))
    deps, dependents = (plain.groupBy(F.col(end).alias("node")).agg(F.count(F.lit(1)).alias(name)) for end, name in (("source", "deps"), ("target", "dependents")))
    lists = symbols_by_file(symbols, MOST_OF_FILE)
    files = nodes.select("node").distinct().join(deps, "node", "left").join(dependents, "node", "left").join(lists.select(F.col("file").alias("node"), "n", "names"), "node", "left")
    drawn = files.select(F.col("node").alias("id"), base_name(F.col("node")).alias("label"), language(F.col("node")).alias("language"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("deps", "dependents")), F.coalesce("n", F.lit(0)).alias("symbol_count"), F.coalesce("names", F.array().cast("array<string>")).alias("symbols")).orderBy("id")
    lines = plain.join(on_cycle, ["source", "target"], "left").select("source", "target", "type", F.coalesce("on", F.lit(False)).alias("cyclic")).orderBy("source", "target")
    named = symbols.where(F.col("name") != MODULE)
    n, calls = named.count(), call_edges.count()
    over = [f"{have:,} {what} > {most:,}" for have, what, most in ((n, "symbols", MOST_SYMBOLS), (calls, "call edges", MOST_CALLS)) if have > most]
    mode = "omitted" if not n and not calls else "capped" if over else "full"
    full = mode == "full"
    of = lambda df: [r.asDict() for r in df.collect()]
    return {
        "project": {"name": project, "symbols": n, "call_edges": calls}, "files": of(drawn), "edges": of(lines), "mode": mode, "reason": ", ".join(over),
        "symbols": of(named.select("id", "file", "name", "qualified_name", "kind", "line").orderBy("file", "line", "id")) if full else [],
        "calls": of(call_edges.where(F.size("candidates") > 0).select(F.col("caller_id").alias("source"), F.col("candidates")[0].alias("target"), "confidence").orderBy("source", "target")) if full else [],
    }


def embedded_json(data) -> str:
    """JSON that cannot end the script element that holds it."""
    return json.dumps(data, ensure_ascii=False).replace("<", "\\u003c")


PAGE = """<!doctype html>
<html lang="en"><head><meta charset="utf-8"><title>%(title)s</title>
<style>body{font:14px sans-serif;margin:0;display:flex;height:100vh}#list{width:320px;overflow:auto;border-right:1px solid #ccc;padding:8px}
#main{flex:1;overflow:auto;padding:8px}a{cursor:pointer;color:#06c;display:block}.cycle{color:#c00}</style></head>
<body><div id="list"><input id="find" placeholder="find a file or symbol"><div id="files"></div></div><div id="main"></div>
<script id="data" type="application/json">%(data)s</script>
<script>
const D = JSON.parse(document.getElementById("data").textContent), by = {};
for (const e of D.edges) { (by[e.source] ??= {out: [], in: []}).out.push(e); (by[e.target] ??= {out: [], in: []}).in.push(e); }
const el = (tag, text, cls) => Object.assign(document.createElement(tag), {textContent: text, className: cls || ""});
function show(f) {
  const m = document.getElementById("main"), b = by[f.id] || {out: [], in: []};
  m.replaceChildren(el("h2", f.id), el("p", f.language + ", " + f.symbol_count + " symbols"));
  for (const [head, rows, end] of [["imports", b.out, "target"], ["imported by", b.in, "source"]]) {
    m.append(el("h3", head));
    for (const e of rows) { const a = el("a", e[end], e.cyclic ? "cycle" : ""); a.onclick = () => show(D.files.find(x => x.id === e[end])); m.append(a); }
  }
  m.append(el("h3", "symbols"));
  for (const s of f.symbols) m.append(el("div", s));
  const own = new Set(D.symbols.filter(s => s.file === f.id).map(s => s.id));
  if (own.size) { m.append(el("h3", "calls")); for (const c of D.calls) if (own.has(c.source)) m.append(el("div", c.source + " → " + c.target + " (" + c.confidence + ")")); }
}
function list(q) {
  const out = document.getElementById("files"); out.replaceChildren();
  for (const f of D.files) if (!q || f.id.toLowerCase().includes(q) || f.symbols.some(s => s.toLowerCase().includes(q))) { const a = el("a", f.id); a.onclick = () => show(f); out.append(a); }
}
document.getElementById("find").oninput = e => list(e.target.value.toLowerCase());
list("");
</script></body></html>
"""


def viewer_page(data: dict) -> str:
    from html import escape

    return PAGE % {"title": escape(data["project"]["name"]), "data": embedded_json(data)}


def results_text(query: str, project: str, rows: list, below: int = 0, min_score: float = 0.0, note: str = "") -> str:
    """Search hits (path, start_line, end_line, language, chunk, score and perhaps label) as text."""
    many = f"{below} result{' was' if below == 1 else 's were'} below the threshold"
    if not rows:
        return f'Nothing for "{query}" in {project} scores {min_score:.2f} or more: {many}.' if below else f'Nothing found for "{query}" in {project}. Has it been indexed?'
    out = [f'{len(rows)} results for "{query}":', *([note] if note else []), ""]
    for r in rows:
        label = f" [{r['label']}]" if "label" in r and r["label"] else ""
        out += [f"--- {r['path']} (lines {r['start_line']}-{r['end_line']}) [{r['language']}]{label} score: {r['score']:.4f} ---", r["chunk"], ""]
    return "\n".join(out + ([f"({many} of {min_score:.2f})"] if below else []))


def tree_text(rows: list[tuple[int, str, str]]) -> str:
    """Preorder rows (depth, id, reason) as an indented tree; repeated and cut nodes say so."""
    more = {"cycle": " (seen above)", "depth": " (deeper calls not shown)", "call": ""}
    return "\n".join(f"{'  ' * depth}{'└─ ' if depth else ''}{node}{more.get(reason, '')}" for depth, node, reason in rows)


#: Lines that a list shows at most.
SHOWN = 50


def capped_list(title: str, lines: list[str], most: int = SHOWN, total: int | None = None) -> str:
    """A list of at most `most` lines that says how many it leaves out (of total, if lines are only the first); the table
    behind it is whole."""
    total = len(lines) if total is None else total
    left = total - min(most, len(lines))
    return "\n".join([f"{title} ({total}):", *(f"  {x}" for x in lines[:most]), *([f"  ... and {left} more"] if left > 0 else [])])


def progress_text(done: int, total: int, batch: int, batches: int, seconds: float) -> str:
    share = f"{round(100 * done / total)}%" if total else "unknown"
    return f"{share} done (batch {batch} of {batches})" + (f", {seconds:.0f} s so far" if seconds else "")
