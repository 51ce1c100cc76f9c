"""The ledgers as streams: the same operators over rows that keep arriving."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def arriving_files(spark: SparkSession, folder: str, glob: str = "*.epub") -> DataFrame:
    """path, content of files as they come in."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).load(folder).select("path", "content")


def daily_counts(events: DataFrame, time: str = "ts", late: str = "1 day") -> DataFrame:
    """day, n: events of each calendar day; what comes later than ``late`` is dropped, as the day is over."""
    return (
        events.withWatermark(time, late).groupBy(F.window(time, "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"))
        .select(F.to_date("w.start").alias("day"), "n")
    )


def running_totals(runs: DataFrame) -> DataFrame:
    """One row of totals over all runs so far (complete mode)."""
    return runs.agg(F.count(F.lit(1)).alias("runs"), F.sum("calls").alias("calls"), F.sum("tokens").alias("tokens"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"))


def occurrences(findings: DataFrame, escalates_at: int = 2) -> DataFrame:
    """signature, first, last, filed, escalated, deduped: for each batch that brings findings of a signature, which occurrences
    they are and what becomes of them. One row for each signature and batch, however many findings it has."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else 0
        now = before + sum(int(frame["n"].sum()) for frame in frames)
        state.update((now,))
        filed, escalated = int(before < 1 <= now), int(before < escalates_at <= now)
        yield pd.DataFrame([(key[0], before + 1, now, filed, escalated, now - before - filed - escalated)], columns=["signature", "first", "last", "filed", "escalated", "deduped"])

    return findings.select("signature", F.lit(1).alias("n")).groupBy("signature").applyInPandasWithState(
        update, "signature string, first long, last long, filed int, escalated int, deduped long", "n long", "append", GroupStateTimeout.NoTimeout
    )


def stop_when(query: StreamingQuery, wanted: Callable[[], bool], every: float = 1.0) -> bool:
    """Wait for a query, and stop it between batches as soon as ``wanted`` says so; whether it was stopped."""
    while not query.awaitTermination(every):
        if wanted():
            query.stop()
            return True
    return False


def upserts(findings: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand each batch to ``merge`` once, with its number, so that a repeated batch can be told."""
    return findings.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Progress(StreamingQueryListener):
    """Collects a line for each batch and for the end of each query; pass ``print`` or a logger."""

    def __init__(self, say: Callable[[str], None]):
        self.say = say

    def onQueryStarted(self, event):
        self.say(f"{event.name or event.id}: started")

    def onQueryProgress(self, event):
        self.say(f"{event.progress.name or event.progress.id}: batch {event.progress.batchId}, {event.progress.numInputRows} rows")

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.say(f"{event.id}: {'failed' if event.exception else 'ended'}")


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there into a table at ``path``, and read it: the last batch of totals (``complete``), else all rows."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}" if mode == "append" else path)

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path).select(stream.columns)
