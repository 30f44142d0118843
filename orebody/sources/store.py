"""Stored tables: a parquet folder a project, replaced as a whole or, where rows are dealt to buckets by a key, bucket by bucket."""

from __future__ import annotations

import atexit
import re
import time
import urllib.parse
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Columns of the engine's tables beside project_id.
TABLES = {
    "file_state": "path string, content_hash string, language string, length long, modified timestamp",
    "chunks": "path string, start_line int, end_line int, chunk string, id string, language string, content_hash string, text string, embedding array<float>, type string",
    "postings": "term string, id string, path string, tf int, dl int",
    "search_stats": "docs long, tokens long",
    "name_refs": "name string, file string, id string, kind string, line int",
    "progress": "phase string, batch int, batches int, files long, status string, at timestamp",
    "graph_files": "path string, language string, content string, content_hash string, length long, modified timestamp",
    "imports": "path string, language string, ord int, specifier string, dynamic boolean, style boolean",
    "edges": "source string, target string, type string",
    "symbols": "id string, name string, qualified_name string, kind string, file string, line int, end_line int, language string",
    "calls": "call_id string, caller_id string, caller_file string, callee_name string, line int",
    "call_edges": "call_id string, caller_id string, caller_file string, callee_name string, line int, candidates array<string>, confidence string",
    "artifact_chunks": "artifact string, path string, start_line int, end_line int, chunk string, id string, text string, embedding array<float>",
    "artifact_postings": "term string, id string, artifact string, tf int, dl int",
    "artifact_search_stats": "docs long, tokens long",
    "artifact_state": "artifact string, path string, description string, content_hash string",
}


#: Columns by whose hash a table's rows are dealt to buckets, so that a change rewrites those of its files or names alone.
KEYS = {"file_state": "path", "chunks": "path", "postings": "path", "graph_files": "path", "imports": "path", "edges": "source", "symbols": "file", "name_refs": "name", "calls": "caller_file", "call_edges": "caller_file"}

#: Columns that are looked up by value: their files get Bloom filters beside the minima and maxima.
LOOKED_UP = {"chunks": ("path",), "postings": ("term",), "name_refs": ("name",), "symbols": ("file",), "call_edges": ("caller_file",), "artifact_postings": ("term",)}


def with_retries(action, attempts: int = 3, first_wait: float = 0.5):
    """Runs action; waits twice as long before each further attempt."""
    for i in range(attempts):
        try:
            return action()
        except Exception:
            if i == attempts - 1:
                raise
            time.sleep(first_wait * 2**i)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it. Where it names none, one is set if all runs in one
    process; a cluster without such a folder is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file:///tmp/checkpoints/engine"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


_made: list[tuple[SparkSession, str]] = []


def cut(df: DataFrame) -> DataFrame:
    """df without its lineage: written to the shared folder and read back. (A checkpoint would work it out twice.)"""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def release() -> None:
    """Deletes what cut() has written so far; call it when its results are no longer read."""
    while _made:
        spark, path = _made.pop()
        try:
            Files(spark, path).delete()
        except Exception:  # the session may have ended
            return


#: Characters that Spark escapes in the names of partition folders (fixed values), beside control characters.
ESCAPED = "\"#%'*/:=?\\{[]^\x7f"


def escaped(value: str) -> str:
    """A value as the name of a partition folder holds it."""
    return "".join(f"%{ord(c):02X}" if c in ESCAPED or ord(c) < 32 else c for c in value)


class Files:
    """A folder of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.root = path.rstrip("/")
        self.fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str = ""):
        return self._path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self.at(name))

    def rename(self, name: str, to: str) -> None:
        if not self.fs.rename(self.at(name), self.at(to)):
            raise OSError(f"{self.root}/{name} could not be renamed to {to}")

    def names(self) -> list[str]:
        return sorted(f.getPath().getName() for f in self.fs.listStatus(self.at())) if self.exists() else []

    def delete(self, name: str = "") -> None:
        self.fs.delete(self.at(name), True)

    def create(self, name: str, text: str, overwrite: bool = False) -> bool:
        """Writes a file; False if there is one already and it is not to be overwritten."""
        self.fs.mkdirs(self.at())
        try:
            out = self.fs.create(self.at(name), overwrite)
        except Exception:
            if self.exists(name):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def read(self, name: str) -> str | None:
        if not self.exists(name):
            return None
        stream = self.fs.open(self.at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()


class Table:
    """A table of one folder a project. A write goes to a folder of its own first and then takes the project's place, so it may
    read what it replaces, writers of other projects do not meet, and no rows at all are a state like any other.

    A complete write is named the project's next folder before the old one goes. Whoever finds a project without a folder but
    with a next one puts that in its place, so neither a failed rename nor a driver that dies in between loses rows."""

    def __init__(self, spark: SparkSession, path: str, schema: str, partition: str = "project_id"):
        self.spark, self.path, self.partition = spark, path.rstrip("/"), partition
        self.schema, self.files = StructType.fromDDL(schema), Files(spark, path)
        self.options = {f"parquet.bloom.filter.enabled#{c}": "true" for c in LOOKED_UP.get(self.path.rsplit("/", 1)[-1], ())}

    def folder(self, project: str) -> str:
        return f"{self.partition}={escaped(project)}"

    def aside(self, what: str, folder: str) -> str:
        """The name of a folder beside a project's; Spark passes over names that begin with `_` and have no `=`."""
        return f"_{what}-{folder.replace('=', '~', 1)}"

    def projects(self) -> list[str]:
        for n in self.files.names():
            for what in ("next", "patch"):
                if n.startswith(self.aside(what, f"{self.partition}=")):
                    self._settle(n.removeprefix(f"_{what}-").replace("~", "=", 1))
        return sorted(urllib.parse.unquote(n.split("=", 1)[1]) for n in self.files.names() if n.startswith(f"{self.partition}="))

    def _settle(self, folder: str) -> None:
        """Puts the next folder in its place where a write got no further than that."""
        coming = self.aside("next", folder)
        if not self.files.exists(folder) and self.files.exists(f"{coming}/_SUCCESS"):
            self.files.rename(coming, folder)

    def exists(self, project: str | None = None) -> bool:
        """Whether there is a table, or one of its projects."""
        if project is None:
            return self.files.exists()
        self._settle(self.folder(project))
        return self.files.exists(self.folder(project))

    def read(self, project: str | None = None) -> DataFrame:
        """One project's rows, or all with their project_id. What was never written is empty."""
        if project is not None:
            if not self.exists(project):
                return self.spark.createDataFrame([], self.schema)
            return self.spark.read.schema(self.schema).parquet(f"{self.path}/{self.folder(project)}")
        # a declared type, so that ids of digits are not read as numbers
        whole = StructType([*self.schema.fields]).add(self.partition, "string")
        return self.spark.read.schema(whole).parquet(self.path) if self.projects() else self.spark.createDataFrame([], whole)

    def replace(self, project: str, rows: DataFrame) -> None:
        own, mark = self.folder(project), uuid.uuid4().hex
        staged, old, coming = f"_staged-{mark}", f"_old-{mark}", self.aside("next", own)
        self._settle(own)
        try:
            self._write(rows, staged)
            self.files.delete(coming)  # of a write that got no further, while its project kept the old rows
            self.files.rename(staged, coming)
        finally:
            self.files.delete(staged)
        if self.files.exists(own):
            self.files.rename(own, old)
        self.files.rename(coming, own)
        self.files.delete(old)

    def append(self, project: str, rows: DataFrame) -> None:
        self._write(rows, self.folder(project), "append")

    def _write(self, rows: DataFrame, folder: str, mode: str = "error") -> None:
        self.shaped(rows).write.options(**self.options).mode(mode).parquet(f"{self.path}/{folder}")

    def shaped(self, rows: DataFrame) -> DataFrame:
        """The declared columns; those that rows lack are null."""
        have = set(rows.columns)
        return rows.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema.fields))

    def upsert(self, project: str, rows: DataFrame, key: str = "id") -> None:
        """Rows take the place of the project's stored ones of the same key."""
        rows = self.shaped(rows)
        self.replace(project, self.read(project).join(rows.select(key), key, "left_anti").unionByName(rows))

    def delete(self, project: str, condition: Column) -> None:
        """Stored rows of the project that meet the condition go."""
        if self.exists(project):
            self.replace(project, self.read(project).where(~F.coalesce(condition, F.lit(False))))

    def drop(self, project: str) -> None:
        for what in ("next", "patch"):
            self.files.delete(self.aside(what, self.folder(project)))
        self.files.delete(self.folder(project))


class Buckets(Table):
    """A table whose rows lie in `count` buckets by the hash of a key, a folder each, sorted by what it is looked up by. patch() gives some
    buckets new rows and leaves the files of the others alone."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, count: int = 64, partition: str = "project_id"):
        super().__init__(spark, path, schema, partition)
        self.key, self.sorted_by = key, LOOKED_UP.get(self.path.rsplit("/", 1)[-1], (key,))[0]
        # all tables of a store have the number that it was made with, so a path's bucket is the same in each
        self.store = Files(spark, self.path.rsplit("/", 1)[0])
        self.count = int(self.store.read("_buckets") or count)

    def number(self, column: str | Column | None = None) -> Column:
        return F.pmod(F.xxhash64(self.key if column is None else column), F.lit(self.count)).cast("int")

    def read(self, project: str | None = None, buckets: list[int] | None = None) -> DataFrame:
        if project is not None and not self.exists(project) or project is None and not self.projects():
            return super().read(project)
        whole = StructType([*self.schema.fields])
        if project is None:
            whole = whole.add(self.partition, "string")
        rows = self.spark.read.schema(whole.add("bucket", "integer")).parquet(self.path if project is None else f"{self.path}/{self.folder(project)}")
        return (rows if buckets is None else rows.where(F.col("bucket").isin(*buckets))).drop("bucket")

    def _write(self, rows: DataFrame, folder: str, mode: str = "error") -> None:
        if not self.store.exists("_buckets"):
            self.store.create("_buckets", str(self.count))
        dealt = self.shaped(rows).withColumn("bucket", self.number())
        # balanced by what the shuffle has measured: a full bucket is written by several tasks, small ones by one
        dealt.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", self.sorted_by).write.options(**self.options).partitionBy("bucket").mode(mode).parquet(f"{self.path}/{folder}")

    def _settle(self, folder: str) -> None:
        super()._settle(folder)
        patch = self.aside("patch", folder)
        if self.files.exists(f"{patch}/_SUCCESS"):
            for b in (self.files.read(f"{patch}/_touched") or "").split():
                if self.files.exists(f"{patch}/bucket={b}"):
                    self.files.delete(f"{folder}/bucket={b}")
                    self.files.rename(f"{patch}/bucket={b}", f"{folder}/bucket={b}")
            for b in (self.files.read(f"{patch}/_emptied") or "").split():
                self.files.delete(f"{folder}/bucket={b}")
            self.files.delete(patch)

    def patch(self, project: str, buckets: list[int], rows: DataFrame) -> None:
        """rows become all that the buckets hold. They are complete beside the table before the first bucket moves; who finds
        such a patch moves what is left of it, so a driver that dies meanwhile leaves a whole table."""
        if not buckets:
            return
        own, staged = self.folder(project), f"_staged-{uuid.uuid4().hex}"
        self._settle(own)
        try:
            self._write(rows, staged)
            got = {n.split("=")[1] for n in Files(self.spark, f"{self.path}/{staged}").names() if n.startswith("bucket=")}
            Files(self.spark, f"{self.path}/{staged}").create("_touched", " ".join(sorted(got)))
            Files(self.spark, f"{self.path}/{staged}").create("_emptied", " ".join(str(b) for b in buckets if str(b) not in got))
            self.files.rename(staged, self.aside("patch", own))
        finally:
            self.files.delete(staged)
        self._settle(own)


class StateStore:
    """path and content_hash of what was indexed, in numbered folders; the newest complete one counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.files = spark, Files(spark, path)

    def versions(self) -> list[int]:
        return sorted(int(n[1:]) for n in self.files.names() if n.startswith("v") and self.files.exists(f"{n}/_SUCCESS"))

    def read(self, schema: StructType | str = "path string, content_hash string") -> DataFrame:
        found = self.versions()
        if not found:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.files.root}/v{found[-1]}")

    def write(self, rows: DataFrame) -> None:
        found = self.versions()
        rows.write.mode("overwrite").parquet(f"{self.files.root}/v{found[-1] + 1 if found else 0}")
        for old in found[:-1]:
            self.files.delete(f"v{old}")


class Lock:
    """One writer a project: a file that names its holder, and beside it one that the holder writes anew to say that it is
    alive; a lock not refreshed for `stale` seconds is taken over."""

    def __init__(self, spark: SparkSession, path: str, project: str, stale: float = 3600.0):
        self.files, self.name, self.stale, self.holder = Files(spark, path), f"{escaped(project)}.lock", stale, uuid.uuid4().hex

    def owner(self) -> tuple[str, float] | None:
        """The holder and when it last said that it is alive."""
        text = self.files.read(self.name)
        try:
            holder, at = (text or "").split()
            return holder, max(float(at), float(self.files.read(f"{self.name}.{holder}") or 0))
        except ValueError:
            return None

    def acquire(self) -> bool:
        held = self.owner()
        if held and held[0] != self.holder and time.time() - held[1] > self.stale:
            self.files.delete(self.name)
            self.files.delete(f"{self.name}.{held[0]}")
        return self.files.create(self.name, f"{self.holder} {time.time()}") or (self.owner() or ("",))[0] == self.holder

    def refresh(self) -> None:
        """Says that the holder is alive; fails if another has taken the lock over."""
        if (self.owner() or ("",))[0] != self.holder:
            raise RuntimeError("the lock was taken over")
        self.files.create(f"{self.name}.{self.holder}", str(time.time()), overwrite=True)

    def release(self) -> None:
        if (self.owner() or ("",))[0] == self.holder:
            self.files.delete(self.name)
        self.files.delete(f"{self.name}.{self.holder}")

    def __enter__(self) -> Lock:
        if not self.acquire():
            raise RuntimeError(f"another process writes to this project ({self.name})")
        return self

    def __exit__(self, *_) -> None:
        self.release()
