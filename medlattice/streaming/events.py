"""Event streams bundled as they arrive.

Batch over the stored events stays the source of truth: events later than the watermark are in the files and are
counted by the next batch run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.orphans import advance, load_state


def read_shards(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 16) -> DataFrame:
    """New Parquet shards of a folder as a stream; the schema is stated, never guessed."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def deduplicated(events: DataFrame, key: list[str], delay: str = "7 days", time: str = "time") -> DataFrame:
    """Each event once, as long as copies come within the delay; the state forgets older keys."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def day_bundles(events: DataFrame, delay: str | None = "7 days", time: str = "time") -> DataFrame:
    """(subject_id, day, n_events, n_codes, codes) per tumbling day, final when the watermark has passed it.

    A stream that has a watermark already, as a deduplicated one, is given with ``delay`` None.
    """
    return (
        (events.withWatermark(time, delay) if delay else events)
        .groupBy("subject_id", F.window(time, "1 day"))
        .agg(F.count("*").alias("n_events"), F.array_sort(F.collect_set("code")).alias("codes"))
        .select("subject_id", F.to_date("window.start").alias("day"), "n_events", F.size("codes").alias("n_codes"), "codes")
    )


def episodes(events: DataFrame, gap: str = "30 days", delay: str | None = "7 days", time: str = "time") -> DataFrame:
    """(subject_id, start, end, n_events): runs of events without a pause of ``gap``."""
    return (
        (events.withWatermark(time, delay) if delay else events)
        .groupBy("subject_id", F.session_window(time, gap))
        .agg(F.count("*").alias("n_events"))
        .select("subject_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n_events")
    )


class OrphanStream:
    """Micro-batches of references and parents through the orphan tracker: use ``take`` as foreachBatch's function.

    ``split`` turns a batch into (references, parent intervals).  Rows must reach the stream by their time of arrival.
    The state lies in ``folder`` under the number of the batch: a batch that is delivered again changes nothing, and a
    restarted stream goes on from the last complete one.
    """

    def __init__(self, split, folder: str | None = None):
        self.split, self.folder, self.state = split, folder, None

    def take(self, batch: DataFrame, batch_id: int) -> None:
        if self.state is None and self.folder is not None:
            self.state = load_state(batch.sparkSession, self.folder)
        if self.state is not None and batch_id <= self.state.number:
            return
        references, parents = self.split(batch)
        self.state = advance(self.state, references, parents, folder=self.folder, number=batch_id)
