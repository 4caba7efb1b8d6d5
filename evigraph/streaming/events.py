"""Event-log operators as Structured Streaming plans."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evigraph.sources.scratch import scratch_path

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, glob: str = "events.parquet") -> DataFrame:
    """The log as a stream of files; ``availableNow`` on it is a replay without following."""
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", glob).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def live(stream: DataFrame, kinds: list[str]) -> DataFrame:
    return stream.filter(F.col("event_type").isin(*kinds))


def deduplicated(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Each event id once, as far back as the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def windowed(stream: DataFrame, length: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return stream.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"))


def usage(stream: DataFrame) -> DataFrame:
    """Running sums per user as events arrive."""
    return stream.groupBy("user_id").agg(F.count("*").alias("events"), F.sum("value").alias("value"))


def expiring(stream: DataFrame, deadline_ms: int = 5 * 60_000) -> DataFrame:
    """Signups that no purchase followed within the deadline, by an event-time timer on each user's state."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (since,) = state.get
            state.remove()
            yield pd.DataFrame({"user_id": [key[0]], "status": ["expired"], "since": [since]})
            return
        rows = pd.concat(list(frames)).sort_values("ms")
        out = []
        since = state.get[0] if state.exists else None
        for ms, kind in zip(rows["ms"], rows["event_type"], strict=True):
            if since is not None and ms > since + deadline_ms:
                out.append((key[0], "expired", since))
                since = None
            if kind == "signup" and since is None:
                since = int(ms)
            elif kind == "purchase" and since is not None:
                out.append((key[0], "resolved", since))
                since = None
        if since is None:
            if state.exists:
                state.remove()
        else:
            state.update((since,))
            state.setTimeoutTimestamp(max(since + deadline_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["user_id", "status", "since"])

    rows = stream.withWatermark("ts", "1 hour").select("user_id", "event_type", "ts", F.unix_millis("ts").alias("ms"))
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, status string, since long", "since long", "append", GroupStateTimeout.EventTimeTimeout)


def run_once(stream: DataFrame, name: str, mode: str = "append", base: str | None = None) -> DataFrame:
    """Run a stream over what is there into a table in the shared scratch folder, and read that back.

    base names the folder for output and checkpoint: a run that is started again
    with it goes on where the lost one stopped. Without it a new one is made.
    In complete mode, each epoch replaces the result, and the last one is read.
    """
    spark = stream.sparkSession
    base = base or scratch_path(spark, name)
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    else:
        def keep(df: DataFrame, epoch: int) -> None:
            df.write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}")

        q = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{base}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(f"{base}/out")
    own = _epochs(spark, f"{base}/out")
    return spark.read.schema(stream.schema).parquet(f"{base}/out/epoch={max(own)}") if own else spark.createDataFrame([], stream.schema)


def _epochs(spark: SparkSession, folder: str) -> list[int]:
    """Epochs that were written whole."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    done = [s.getPath() for s in fs.listStatus(path)]
    return [int(p.getName().partition("=")[2]) for p in done if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
