"""Requests as a stream: validated, extracted and answered batch by batch.

Where a server would refuse requests beyond its queue, a stream takes at most ``files`` new files a batch and
leaves the rest to later ones; nothing is refused. ``query.stop()`` ends after the batch that runs; ``query.status``
says whether it is alive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..sources.readers import validated_requests


def request_stream(spark: SparkSession, path: str, files: int = 16) -> DataFrame:
    """(body, content_type) of JSON-lines files that arrive in a folder, a request a line."""
    lines = spark.readStream.option("maxFilesPerTrigger", files).text(path)
    return lines.where(F.length(F.trim("value")) > 0).select(F.col("value").alias("body"), F.lit("application/json").alias("content_type"))


def serve(requests: DataFrame, answer: Callable[[DataFrame], DataFrame], to: str, checkpoint: str, every: str | None = None, once: bool = False) -> StreamingQuery:
    """Valid requests go through ``answer`` (a DataFrame to a DataFrame); the others are written with their error. ``every`` is a
    processing-time trigger: one batch in flight, ticks that fall into it are skipped."""

    def batch(rows: DataFrame, number: int) -> None:
        checked = validated_requests(rows).persist()
        answer(checked.where("status = 200")).write.mode("overwrite").json(f"{to}/answers/batch={number}")
        checked.where("status != 200").select("body", "status", "error").write.mode("overwrite").json(f"{to}/errors/batch={number}")
        checked.unpersist()

    writer = requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    elif every:
        writer = writer.trigger(processingTime=every)
    return writer.start()


class LastEvents(StatefulProcessor):
    """Of each user the last six event types, counts of each type, and a smoothed value (0.8 old, 0.2 new)."""

    PLACES, KEEP = 6, 0.8

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", "types array<string>, counts map<string,long>, smooth double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.state.get() if self.state.exists() else None
        types, counts, smooth = (list(held[0]), dict(held[1]), held[2]) if held else ([], {}, None)
        for part in rows:
            for r in part.sort_values(["ts", "event_id"]).itertuples():
                types = [*types, r.event_type][-self.PLACES :]
                counts[r.event_type] = counts.get(r.event_type, 0) + 1
                smooth = float(r.value) if smooth is None else self.KEEP * smooth + (1 - self.KEEP) * float(r.value)
        self.state.update((types, counts, smooth))
        yield pd.DataFrame({"user_id": [key[0]], "last": [",".join(types)], "n": [sum(counts.values())], "smooth": [smooth]})

    def close(self) -> None:
        pass


def last_events(events: DataFrame) -> DataFrame:
    """A row for each user a batch touches; needs the RocksDB state store."""
    return events.groupBy("user_id").transformWithStateInPandas(LastEvents(), "user_id long, last string, n long, smooth double", "Update", "None")
