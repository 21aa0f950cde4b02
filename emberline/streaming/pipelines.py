"""Streams of reports: deduplication, windows, sessions, throttles and timers, with bounded state.

State is bounded by watermarks: what is later than the allowed lateness is dropped and its state with it. Functions take
and give streaming DataFrames; `run` drains one into Parquet, so that a batch can be compared with it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from emberline.sources.shared import shared_folder


def events(spark: SparkSession, sf_dir: str, name: str = "events", files_per_trigger: int = 8) -> DataFrame:
    """Stream over the files of a table."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def dedup(stream: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    """First of each key within the lateness; later repeats are new, as in a replay cache that forgets."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def bursts(stream: DataFrame, by: list[str], at: str, size: str = "30 minutes", slide: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Reports per sliding window."""
    w = F.window(at, size, slide)
    return stream.withWatermark(at, late).groupBy(w, *by).agg(F.count("*").alias("n_reports"), F.approx_count_distinct("user_id").alias("callers")).select(F.col("window.start").alias("started"), F.col("window.end").alias("ended"), *by, "n_reports", "callers")


def sessions(stream: DataFrame, key: str, at: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions that end with silence."""
    s = stream.withWatermark(at, late).groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n_events"))
    return s.select(key, F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "n_events")


def throttle(stream: DataFrame, key: str, at: str, window_seconds: int, most: int, late: str = "1 hour") -> DataFrame:
    """Rows of a key that are accepted: at most `most` within the window. A key's state is its accepted times, and goes with silence."""
    kind = dict(stream.dtypes)[key]

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        hits = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["second", "event_id"])
        accepted = []
        for second, event in zip(rows["second"], rows["event_id"], strict=True):
            hits = [t for t in hits if t >= second - window_seconds]
            if len(hits) < most:
                hits.append(float(second))
                accepted.append(event)
        state.update((hits,))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, int((max(hits) + window_seconds) * 1000)))
        yield pd.DataFrame({key: [name[0]] * len(accepted), "event_id": accepted})

    s = stream.withWatermark(at, late).withColumn("second", F.col(at).cast("double"))
    return s.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, event_id bigint", "hits array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def stale(stream: DataFrame, key: str, at: str, silence_minutes: int, late: str = "10 minutes") -> DataFrame:
    """A row for each key whose last packet is older than the silence, once the watermark has passed it."""
    kind = dict(stream.dtypes)[key]

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({key: [name[0]], "last_second": [last], "reason": ["device silent"]})
            return
        last = max([*(state.get if state.exists else ()), *(float(f["second"].max()) for f in frames)])
        state.update((last,))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, int((last + silence_minutes * 60) * 1000)))

    s = stream.withWatermark(at, late).withColumn("second", F.col(at).cast("double"))
    return s.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, last_second double, reason string", "last double", "append", GroupStateTimeout.EventTimeTimeout)


class Health(StreamingQueryListener):
    """Counters of micro-batches, as source health; kept on the driver, a few numbers a query."""

    def __init__(self) -> None:
        self.runs: dict[str, dict[str, float]] = {}

    def onQueryStarted(self, event):  # noqa: N802  names are Spark's
        self.runs[str(event.id)] = {"batches": 0, "rows": 0, "failed": 0}

    def onQueryProgress(self, event):  # noqa: N802
        r = self.runs.setdefault(str(event.progress.id), {"batches": 0, "rows": 0, "failed": 0})
        r["batches"] += 1
        r["rows"] += event.progress.numInputRows

    def onQueryIdle(self, event):  # noqa: N802
        pass

    def onQueryTerminated(self, event):  # noqa: N802
        if event.exception:
            self.runs.setdefault(str(event.id), {"batches": 0, "rows": 0, "failed": 0})["failed"] = 1


def start(stream: DataFrame, path: str, checkpoint: str, every: str = "60 seconds"):
    """ST01: keep writing a stream to Parquet by micro-batches; the checkpoint lets it resume after a failure."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def run(stream: DataFrame, mode: str = "append", sink: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Drain what is there now into Parquet and read it back. In complete mode the last batch is the result."""
    spark = stream.sparkSession
    folder = shared_folder(spark, "stream")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if mode == "append" and sink is None:
        query = writer.format("parquet").option("path", f"{folder}/out").start()
    else:
        query = writer.foreachBatch(sink or (lambda df, _: df.write.mode("overwrite").parquet(f"{folder}/out"))).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
