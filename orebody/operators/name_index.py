"""Substring lookup of names by an index of their n-grams.

Every distinct lower-case name stands in the lists of its runs of one, two and three letters. A needle of up to three letters is
one list; a longer one has several three-letter runs, of which the rarest lists are intersected and the names then checked.
The lists are sorted by run, so a lookup reads the row groups of its runs and not all names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orebody.operators.symbols import MODULE
from orebody.sources.store import cut

#: Lists that are intersected at most; the check on the name does the rest.
LISTS = 3
#: Names that a filter names one by one; more are joined.
NAMED = 1000


def grams_of(text: str) -> list[str]:
    """The runs to look for: the needle itself up to three letters, else its runs of three."""
    return [text] if len(text) <= 3 else sorted({text[i : i + 3] for i in range(len(text) - 2)})


class NameIndex:
    """Names of symbols by their runs of letters, in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, symbols: DataFrame) -> NameIndex:
        rows = symbols.where(F.col("name") != MODULE)
        fields = [f for f in ("name", "qualified_name") if f in rows.columns]
        for f in fields:
            rows = rows.withColumn(f"low_{f}", F.lower(f))
        rows.repartitionByRange("low_name", "id").sortWithinPartitions("low_name", "id").write.mode("overwrite").parquet(f"{self.path}/symbols")
        stored = self.spark.read.parquet(f"{self.path}/symbols")
        values = None
        for f in fields:
            one = stored.select(F.lit(f).alias("field"), F.col(f"low_{f}").alias("value")).where("value IS NOT NULL").distinct()
            values = one if values is None else values.unionByName(one)
        runs = lambda n: F.when(F.length("value") >= n, F.transform(F.sequence(F.lit(1), F.length("value") - (n - 1)), lambda i: F.substring(F.col("value"), i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
        lists = values.select("field", "value", F.explode(F.array_distinct(F.concat(runs(1), runs(2), runs(3)))).alias("gram"))
        lists.repartitionByRange("gram", "value").sortWithinPartitions("gram", "value").write.mode("overwrite").option("parquet.bloom.filter.enabled#gram", "true").parquet(f"{self.path}/lists")
        sizes = self.spark.read.parquet(f"{self.path}/lists").groupBy("field", "gram").agg(F.count(F.lit(1)).alias("n"))
        sizes.repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{self.path}/sizes")
        return self

    def symbols(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/symbols")

    def holding(self, needle: str, field: str = "name") -> DataFrame:
        """value: the distinct lower-case names that contain the needle in any case."""
        low = needle.lower()
        own = F.col("field") == field
        lists = self.spark.read.parquet(f"{self.path}/lists").where(own)
        if not low:
            return lists.select("value").distinct()
        wanted = grams_of(low)
        sizes = {r.gram: r.n for r in self.spark.read.parquet(f"{self.path}/sizes").where(own & F.col("gram").isin(*wanted)).collect()}
        if len(sizes) < len(wanted):  # a run that no name has
            return lists.select("value").limit(0)
        rarest = sorted(wanted, key=lambda g: (sizes[g], g))[:LISTS]
        found = lists.where(F.col("gram") == rarest[0]).select("value")
        for g in rarest[1:]:
            found = found.join(lists.where(F.col("gram") == g).select("value"), "value", "left_semi")
        return found.where(F.contains("value", F.lit(low)))

    def _rows(self, needle: str, field: str) -> DataFrame:
        values = cut(self.holding(needle, field))
        some = [r.value for r in values.limit(NAMED + 1).collect()]
        column = f"low_{field}"
        rows = self.symbols()
        if len(some) <= NAMED:  # the filter reaches the files, which are sorted by name
            return rows.where(F.col(column).isin(*some)) if some else rows.limit(0)
        return rows.join(values.select(F.col("value").alias(column)), column, "left_semi")

    def list(self, contains: str | None = None, file: str | None = None, limit: int = 200) -> DataFrame:
        """What symbols.list_symbols() gives."""
        rows = self._rows(contains, "name") if contains else self.symbols()
        if file:
            rows = rows.where(F.col("file") == file)
        return self._plain(rows).orderBy("name", "file", "line", "id").limit(limit)

    def find(self, query: str, limit: int = 50) -> DataFrame:
        """What symbols.symbol_lookup() gives."""
        low, q = F.lower("name"), F.lit(query.lower())
        rows = self._rows(query, "name")
        if "qualified_name" in rows.columns:
            rows = rows.unionByName(self._rows(query, "qualified_name").where(~F.contains(low, q)))
        match = F.when(low == q, 0).when(F.startswith(low, q), 1).when(F.contains(low, q), 2).otherwise(3)
        return self._plain(rows.withColumn("match", match)).orderBy("match", "name", "file", "line", "id").limit(limit)

    def _plain(self, rows: DataFrame) -> DataFrame:
        return rows.drop("low_name", "low_qualified_name")
