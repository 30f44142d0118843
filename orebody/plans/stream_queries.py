"""Queries over streams of the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orebody.plans import text_queries
from orebody.plans.relations import table
from orebody.sources.store import shared_folder
from orebody.streaming.debounce import debounced_stream

Q: dict = {}
SQL: dict[str, str] = {}


def debounce_stream(spark: SparkSession, sf: str, parts: int = 4) -> DataFrame:
    """The events, streamed in parts by time, as bursts with half an hour of quiet; the last part's time ends all of them."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    events = table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    cuts = events.select(F.percentile_approx(F.unix_micros("ts"), [i / parts for i in range(1, parts)]).alias("q"), F.max("ts").alias("last")).first()
    part = sum((F.when(F.unix_micros("ts") > x, 1).otherwise(0) for x in cuts.q or []), F.lit(0))
    dealt = events.withColumn("part", part)
    for i in range(parts):  # one after the other, as files arrive
        dealt.where(F.col("part") == i).drop("part").coalesce(2).write.mode("append").parquet(f"{base}/in")
    end = events.groupBy().agg((F.coalesce(F.max("ts"), F.current_timestamp()) + F.expr("INTERVAL 1 DAY")).alias("ts")).select(F.lit(None).cast(events.schema["user_id"].dataType).alias("user_id"), "ts")
    end.coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
    found = debounced_stream(stream, "ts", "user_id", 1800, "1 hour").select("user_id", F.col("first").alias("first_us"), F.col("last").alias("last_us"), "events")
    query = found.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{base}/out")


Q["debounce_stream"], SQL["debounce_stream"] = debounce_stream, text_queries.SQL["debounce_sessions"]
