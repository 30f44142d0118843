"""Chunking: files to rows of text. Line and character chunks are native; for declaration chunks
Python gets the places of regions and gives the lines to cut at."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orebody.functions.scalars import capped, chunk_id, is_minified

LINES, OVERLAP, CAP = 100, 10, 2000
#: A pending group grows while it spans at most LINES and the new region is under SMALL lines; groups over LARGE are cut.
SMALL, LARGE = 5, 150


def lines_of(content: Column) -> Column:
    return F.split(content, "\n", -1)


def line_chunks(files: DataFrame, window: int = LINES, overlap: int = OVERLAP, path: str = "path", content: str = "content") -> DataFrame:
    """All columns but the content, and start_line, end_line (from 1, inclusive), chunk."""
    step = window - overlap
    n = F.size("_lines")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - window) / step)).cast("int") * step, F.lit(step))
    rows = files.withColumn("_lines", lines_of(F.col(content))).withColumn("_start", F.explode(starts))
    return rows.select(*[c for c in files.columns if c != content], (F.col("_start") + 1).alias("start_line"), F.least(F.col("_start") + window, n).alias("end_line"), F.array_join(F.slice("_lines", F.col("_start") + 1, F.lit(window)), "\n").alias("chunk"))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def char_pieces(content: Column, limit: int = CAP) -> Column:
    """Array of chunk, offset: slices of at most `limit` characters that end after a separator where they can."""
    pattern = rf"(?s).{{1,{limit}}}\z|.{{1,{limit - 1}}}[\n \t;,]|.{{1,{limit}}}"
    # offsets: running sums of lengths
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
    offsets = lambda parts: F.aggregate(parts, start, lambda a, p: F.struct((a["at"] + F.length(p)).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")), lambda a: a["all"])
    return bound(F.regexp_extract_all(content, F.lit(pattern), F.lit(0)), lambda parts: F.zip_with(parts, offsets(parts), lambda p, at: F.struct(p.alias("chunk"), at.alias("offset"))))


def char_chunks(files: DataFrame, limit: int = CAP, content: str = "content") -> DataFrame:
    """All columns but the content, and ord from 0, chunk, offset in characters: char_pieces() as rows."""
    rows = files.select(*[c for c in files.columns if c != content], F.posexplode(char_pieces(F.col(content), limit)).alias("ord", "_c"))
    return rows.select("*", F.col("_c.chunk").alias("chunk"), F.col("_c.offset").alias("offset")).drop("_c")


def strategy(content: Column, has_regions: Column | None = None, window: int = LINES) -> Column:
    regions = F.lit(False) if has_regions is None else has_regions
    return F.when(is_minified(content), "chars").when(F.size(lines_of(content)) <= window, "single").when(regions, "regions").otherwise("lines")


def merged_intervals(rows: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Union of closed intervals by key; one that begins at or before the last end joins it. Gaps and islands, one shuffle."""
    before = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    marked = rows.withColumn("_new", F.when(F.col(start) <= F.max(end).over(before), 0).otherwise(1))
    island = marked.withColumn("_island", F.sum("_new").over(Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n")).drop("_island")


def region_ranges(regions: list[tuple[int, int]], total: int) -> list[tuple[int, int]]:
    """Line ranges (from 0, end exclusive) of a file's chunks, from its top-level regions."""
    islands: list[list[int]] = []
    for s, e in sorted(regions):
        if islands and s <= islands[-1][1]:
            islands[-1][1] = max(islands[-1][1], e)
        else:
            islands.append([s, e])
    groups: list[list[int]] = []
    for s, e in islands:
        if groups and e - groups[-1][0] <= LINES and e - s < SMALL:
            groups[-1][1] = e
        else:
            groups.append([s, e])
    out, at = [], 0
    for i, (s, e) in enumerate(groups):
        begin = at if i else s  # a gap goes with the group after it
        if not i and s > 0:
            out.append((0, s))
        out += windows_of(begin, e) if e - begin > LARGE else [(begin, e)]
        at = e
    if at < total:
        out.append((at, total))
    return out


def windows_of(begin: int, end: int, window: int = LINES, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    out = []
    for s in range(begin, end, window - overlap):
        out.append((s, min(s + window, end)))
        if s + window >= end:
            break
    return out


def cuts_of(regions: Column, total: Column) -> Column:
    """region_ranges() of a column of regions (array of struct start, end) and one of numbers of lines."""
    kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))

    @F.arrow_udf("array<struct<s:int,e:int>>")
    def go(regions: pa.Array, total: pa.Array) -> pa.Array:
        found = ([(r["start"], r["end"]) for r in rs or ()] for rs in regions.to_pylist())
        return pa.array([[{"s": s, "e": e} for s, e in region_ranges(rs, n)] if rs else None for rs, n in zip(found, total.to_pylist())], kind)

    return go(regions, total)


def chunks(files: DataFrame, window: int = LINES, overlap: int = OVERLAP, cap: int = CAP) -> DataFrame:
    """path, content and, where files have them, regions (null or empty where the language has none) to capped chunks with ids, by
    strategy: all columns but content and regions, and start_line, end_line, chunk, id. One pass over files."""
    told = "regions" in files.columns
    content, n, step = F.col("content"), F.size(lines_of(F.col("content"))), window - overlap
    marked = files.withColumn("_how", strategy(content, F.size(F.coalesce("regions", F.array())) > 0 if told else None, window))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size("_lines") - window) / step)).cast("int") * step, F.lit(step))
    even = F.transform(starts, lambda s: F.struct(s.alias("s"), F.least(s + window, F.size("_lines")).alias("e")))
    cuts = F.when(F.col("_how") == "lines", even).when(F.col("_how") == "single", F.array(F.struct(F.lit(0).alias("s"), F.size("_lines").alias("e"))))
    if told:
        marked = marked.withColumn("_cuts", cuts_of(F.when(F.col("_how") == "regions", F.col("regions")), n))
        cuts = cuts.when(F.col("_how") == "regions", F.col("_cuts"))
    marked = marked.withColumn("_lines", lines_of(content))

    def piece(start, end, chunk, place):
        return F.struct(start.cast("int").alias("start_line"), end.cast("int").alias("end_line"), chunk.alias("chunk"), place.cast("int").alias("place"))

    by_lines = bound(F.col("_lines"), lambda lines: F.transform(cuts, lambda c: piece(c["s"] + 1, c["e"], F.array_join(F.slice(lines, c["s"] + 1, c["e"] - c["s"]), "\n"), c["s"] + 1)))
    by_chars = F.transform(char_pieces(content, cap), lambda c: piece(F.lit(1), F.lit(1), c["chunk"], c["offset"]))
    # blank chunks of regions are left out
    by_regions = F.filter(by_lines, lambda p: p["chunk"].rlike(r"(?U)[^\s\x1c-\x1f]"))
    pieces = F.when(F.col("_how") == "chars", by_chars).when(F.col("_how") == "regions", by_regions).otherwise(by_lines)
    rows = marked.withColumn("_p", F.explode(pieces))
    kept = [c for c in files.columns if c not in ("content", "regions")]
    return rows.select(*kept, "_p.start_line", "_p.end_line", capped(F.col("_p.chunk"), cap).alias("chunk"), chunk_id(F.col("path"), F.col("_p.place")).alias("id"))
