"""Structured Streaming: resumable jobs, growing logs, event time and state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def file_stream(spark: SparkSession, path: str, schema: str, kind: str = "parquet", files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(kind).load(path)


def resumable(source: DataFrame, key: list[str], work: Callable[[DataFrame], DataFrame], target: str, errors: str, checkpoint: str) -> StreamingQuery:
    """Runs `work` on rows whose key is not in the target yet; its rows with an error go to another table and come again.

    A batch that is repeated after a failure finds its rows done and adds nothing.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        fresh = df.dropDuplicates(key)
        try:
            fresh = fresh.join(spark.read.parquet(target).select(*key), key, "left_anti")
        except Exception:  # noqa: BLE001 - nothing is done yet
            pass
        done = work(fresh).persist()
        done.filter("error is null").drop("error").write.mode("append").parquet(target)
        done.filter("error is not null").write.mode("append").parquet(errors)
        done.unpersist()

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def step_means(log: DataFrame, step: str, value: str) -> DataFrame:
    """Means by step of a growing log."""
    return log.groupBy(step).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def windowed(events: DataFrame, time: str, size: str, slide: str | None = None, late: str = "10 minutes", by: tuple[str, ...] = (), value: str = "value") -> DataFrame:
    """Counts and sums by tumbling or sliding window; rows later than the watermark are dropped."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return events.withWatermark(time, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def sessions(events: DataFrame, time: str, gap: str, user: str, late: str = "10 minutes") -> DataFrame:
    """Sessions of each user, apart by a gap."""
    grouped = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), user)
    return grouped.agg(F.count("*").alias("n")).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def least_used_stream(slots: DataFrame, poem: str) -> DataFrame:
    """Streaming choice of the candidate least used so far in a poem (candidates: array of lemma, place, poem)."""
    out = f"`{poem}` bigint, place int, picked string"

    def pick(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, counts = state.get if state.exists else ([], [])
        used = dict(zip(names, counts, strict=True))
        rows = []
        for pdf in parts:
            for place, cs in sorted(zip(pdf["place"], pdf["candidates"], strict=True), key=lambda r: r[0]):
                best = min(((used.get(c, 0), i, c) for i, c in enumerate(cs)), default=None)
                if best:
                    used[best[2]] = used.get(best[2], 0) + 1
                rows.append((key[0], place, best[2] if best else None))
        state.update((list(used), list(used.values())))
        yield pd.DataFrame(rows, columns=[poem, "place", "picked"])

    return slots.groupBy(poem).applyInPandasWithState(pick, out, "names array<string>, counts array<int>", "append", GroupStateTimeout.NoTimeout)


def as_of(left: DataFrame, right: DataFrame, by: str, time: str, value: str) -> DataFrame:
    """Each left row with the last right value at or before it, by one sorted union and one window instead of a range join."""
    from pyspark.sql import Window

    both = left.select("*", F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(1).alias("_side")).unionByName(right.select(by, time, F.col(value).alias("_v"), F.lit(0).alias("_side")), allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).filter("_side = 1").drop("_v", "_side")


def run_to_end(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over what is there into a table in memory, for tests and small reports."""
    w = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    q = (w.option("checkpointLocation", checkpoint) if checkpoint else w).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def run_to_files(df: DataFrame, path: str) -> DataFrame:
    """Runs a stream over what is there into Parquet files, so its rows never stand in the driver's memory."""
    w = df.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state")
    w.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows")
