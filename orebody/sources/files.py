"""Scans of source trees: what is indexed, what goes into the graph, and the relations read from module files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orebody.functions.scalars import content_hash, grammar, is_graphable, is_indexable, language
from orebody.sources.ignore import is_ignored, prunable, rules
from orebody.sources.store import cut

MAX_INDEXED, MAX_GRAPHED = 5_000_000, 1_000_000


def opened(root: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    if "://" in root:
        return fs.FileSystem.from_uri(root)
    import os

    return fs.LocalFileSystem(), os.path.abspath(root)


def reader(root: str) -> Callable[[str], str | None]:
    """Gives the text of a file below root, or None; for small configuration files, read by the driver."""
    from pyarrow.fs import FileType

    files, base = opened(root)

    def read(name: str) -> str | None:
        path = f"{base.rstrip('/')}/{name}"
        if files.get_file_info(path).type != FileType.File:
            return None
        with files.open_input_stream(path) as stream:
            return stream.read().decode("utf-8", "replace")

    return read


def walked(spark: SparkSession, root: str, prune: tuple[str, ...] = (), most_listed: int = 1000) -> DataFrame:
    """relative_path, length and modified of all files below root, or of root itself if it is a file.

    Spark's own file source leaves out names that begin with `_` or `.` and files of no bytes, which source trees have. So
    the driver looks at folder names, level by level, until there are some for every task; tasks list what is in those
    folders and walk all below the last level. Folders named in prune are not entered.
    """
    import pyarrow as pa
    from pyarrow.fs import FileSelector, FileType

    files, base = opened(root)
    base = base.rstrip("/")
    names = ["relative_path", "length", "modified"]
    if files.get_file_info(base).type == FileType.File:
        info = files.get_file_info(base)
        return spark.createDataFrame([(base.rsplit("/", 1)[-1], info.size, info.mtime)], "relative_path string, length long, modified timestamp")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, top = opened(root)
        top = top.rstrip("/")
        for b in batches:
            for folder, deep in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                folders = [folder]
                while folders:
                    found = where.get_file_info(FileSelector(folders.pop()))
                    rows = [(f.path[len(top) + 1 :], f.size, f.mtime) for f in found if f.type == FileType.File]
                    if deep:
                        folders += [f.path for f in found if f.type == FileType.Directory and f.base_name not in prune]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.timestamp("us", "UTC"))], names)

    width = 4 * spark.sparkContext.defaultParallelism
    level, above = [base], []
    while level and len(level) < width and len(above) + len(level) <= most_listed:
        above += level
        level = [f.path for folder in level for f in files.get_file_info(FileSelector(folder)) if f.type == FileType.Directory and f.base_name not in prune]
    tasks = [(p, False) for p in above] + [(p, True) for p in level]
    return spark.createDataFrame(tasks, "path string, deep boolean").repartition(min(len(tasks), width), "path").mapInArrow(walk, "relative_path string, length long, modified timestamp")


def contents(root: str, rows: DataFrame) -> DataFrame:
    """rows (relative_path, length, modified) with the raw bytes of each file; the files are dealt out anew."""
    import pyarrow as pa
    from pyarrow.fs import FileType

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, top = opened(root)
        top = top.rstrip("/")
        if where.get_file_info(top).type == FileType.File:
            top = top.rsplit("/", 1)[0]
        for b in batches:
            for i, path in enumerate(b.column(0).to_pylist()):
                if where.get_file_info(f"{top}/{path}").type != FileType.File:
                    continue  # it went after it was listed
                with where.open_input_stream(f"{top}/{path}") as stream:
                    yield pa.RecordBatch.from_arrays([*(c.slice(i, 1) for c in b.columns), pa.array([stream.read()], pa.binary())], ["relative_path", "length", "modified", "content"])

    return rows.select("relative_path", "length", "modified").repartition("relative_path").mapInArrow(read, "relative_path string, length long, modified timestamp, content binary")


def tree_rules(root: str, listed: DataFrame | None = None, use_gitignore: bool = True, own_file: str = ".orebodyignore") -> list[str]:
    """All ignore patterns of a tree: defaults, its .gitignore, those of its folders (found among listed), its own file."""
    read = reader(root)
    lines = lambda name: (read(name) or "").splitlines()
    below = {}
    if use_gitignore and listed is not None:
        for r in listed.where(F.col("relative_path").endswith("/.gitignore") & ~is_ignored(F.col("relative_path"), rules(lines(".gitignore")))).select("relative_path").collect():
            below[r.relative_path.rsplit("/", 1)[0]] = lines(r.relative_path)
    return rules(lines(".gitignore"), below, lines(own_file), use_gitignore)


def listed_files(spark: SparkSession, root: str, keep: Column, patterns: list[str] | None, max_bytes: int, use_gitignore: bool = True) -> DataFrame:
    """Files that keep wants and no ignore rule hides. Rules are read from the tree unless patterns gives them."""
    if patterns is not None:
        rows = walked(spark, root, prunable(patterns))
    else:
        top = (reader(root)(".gitignore") or "").splitlines() if use_gitignore else []
        rows = cut(walked(spark, root, prunable(rules(top))))
        patterns = tree_rules(root, rows, use_gitignore)
    return rows.where((F.col("length") <= max_bytes) & keep & ~is_ignored(F.col("relative_path"), patterns))


def has_dot_part(path):
    return path.rlike(r"(^|/)\.[^/]")


def indexable_paths(spark: SparkSession, root: str, extra: list[str] = (), patterns: list[str] | None = None, dot_files: bool = False, max_bytes: int = MAX_INDEXED, use_gitignore: bool = True) -> DataFrame:
    """Files to index: relative_path, length, modified."""
    keep = is_indexable(F.col("relative_path"), extra)
    if not dot_files:
        keep &= ~has_dot_part(F.col("relative_path"))
    return listed_files(spark, root, keep, patterns, max_bytes, use_gitignore)


def indexable_files(spark: SparkSession, root: str, **how) -> DataFrame:
    """Files to index: relative_path, length, content (text), content_hash, language."""
    return described(contents(root, indexable_paths(spark, root, **how)))


def graphable_paths(spark: SparkSession, root: str, extra: list[str] = (), patterns: list[str] | None = None, max_bytes: int = MAX_GRAPHED, use_gitignore: bool = True) -> DataFrame:
    """Files of the graph: relative_path, length, modified; files whose name begins with a dot are included."""
    return listed_files(spark, root, is_graphable(F.col("relative_path"), extra), patterns, max_bytes, use_gitignore)


def graphable_files(spark: SparkSession, root: str, **how) -> DataFrame:
    """Files of the graph with their content (text), content_hash and grammar."""
    return graphed(contents(root, graphable_paths(spark, root, **how)))


def graphed(rows: DataFrame) -> DataFrame:
    return described(rows).withColumn("language", grammar(F.col("relative_path")))


def described(rows: DataFrame) -> DataFrame:
    text = F.col("content").cast("string")
    return rows.select("relative_path", "length", "modified", text.alias("content"), content_hash(text).alias("content_hash"), language(F.col("relative_path")).alias("language"))


def folder_of(path):
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def go_packages(files: DataFrame) -> DataFrame:
    """folder and the first of its .go files that is no test."""
    own = files.where(F.col("path").rlike(r"\.go$") & ~F.col("path").rlike(r"_test\.go$"))
    return own.groupBy(folder_of(F.col("path")).alias("folder")).agg(F.min("path").alias("path"))


def go_module(go_mod: str) -> str | None:
    import re

    found = re.search(r"^module[ \t]+(\S+)", go_mod, re.M)
    return found[1] if found else None


def namespaces(files: DataFrame) -> DataFrame:
    """files: path, content. namespace of C# sources and the first file that declares it."""
    own = files.where(F.col("path").endswith(".cs"))
    return own.select("path", F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^\s*namespace\s+([A-Za-z_][\w.]*)"), F.lit(1))).alias("namespace")).groupBy("namespace").agg(F.min("path").alias("path"))


def class_suffixes(files: DataFrame) -> DataFrame:
    """Class path below the first src/main/<language> folder, and the first file that has it."""
    suffix = F.regexp_extract("path", r"^(?:.*?/)?src/main/(?:java|kotlin|scala)/(.+)$", 1)
    return files.withColumn("suffix", suffix).where("suffix <> ''").groupBy("suffix").agg(F.min("path").alias("path"))


def artifact_files(spark: SparkSession, name: str, path: str) -> DataFrame:
    """artifact, path, content of a file or folder, without dot files and package folders."""
    rows = walked(spark, path, ("node_modules", ".git"))
    rows = contents(path, rows.where(~has_dot_part(F.col("relative_path"))))
    return rows.select(F.lit(name).alias("artifact"), F.col("relative_path").alias("path"), F.col("content").cast("string").alias("content"))
