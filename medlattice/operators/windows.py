"""Calendar and look-back windows and the documents assembled over them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import dimension

#: The resolutions in order.
RESOLUTIONS = ("1d", "1mo", "1y")
EMPTY_HISTORY = "No clinical records available in this interval."


def _by_resolution(resolution: Column, day: Column, month: Column, year: Column) -> Column:
    made = F.when(resolution == "1d", day).when(resolution == "1mo", month).when(resolution == "1y", year)
    return F.when(made.isNull() & resolution.isNotNull() & ~resolution.isin(*RESOLUTIONS), F.raise_error(F.concat(F.lit("unknown resolution "), resolution)).cast("date")).otherwise(made)


def calendar_window(day: Column, resolution: Column) -> tuple[Column, Column]:
    """First and last day of the day, month or year; both inclusive."""
    first = _by_resolution(resolution, day, F.trunc(day, "MM"), F.trunc(day, "YEAR"))
    last = _by_resolution(resolution, day, F.last_day(day), F.make_date(F.year(day), F.lit(12), F.lit(31)))
    return first, last


def keyed_window(day: Column, resolution: Column) -> tuple[Column, Column, Column]:
    """(key, start, end] - the window as a half-open interval that starts the day before its first."""
    first, last = calendar_window(day, resolution)
    key = F.when(resolution == "1d", F.date_format(day, "yyyy-MM-dd")).when(resolution == "1mo", F.date_format(day, "yyyy-MM")).otherwise(F.date_format(day, "yyyy"))
    return key, F.date_sub(first, 1), last


def lookback_start(end: Column, resolution: Column) -> Column:
    """Start of (start, end]: a day, month or year earlier, at the month's end where the day does not exist."""
    return _by_resolution(resolution, F.date_sub(end, 1), F.add_months(end, -1), F.add_months(end, -12))


def lookback_tiling(spans: DataFrame, resolution: str) -> DataFrame:
    """(patient_id, window_no, window_start, window_end]: look-back windows from the last event back beyond the first.

    ``spans`` has (patient_id, first_date, last_date).  Each start is taken from the one before, so a clamped month end
    stays clamped; the chain is folded over a sequence and never leaves its row.
    """
    steps = {
        "1d": F.datediff("last_date", "first_date") + 1,
        "1mo": F.ceil(F.months_between("last_date", "first_date")).cast("int") + 1,
        "1y": F.ceil(F.months_between("last_date", "first_date") / 12).cast("int") + 1,
    }[resolution]
    start = F.struct(F.col("last_date").alias("at"), F.array().cast("array<struct<s:date,e:date>>").alias("out"))

    def step(acc: Column, _: Column) -> Column:
        before = lookback_start(acc["at"], F.lit(resolution))
        grown = F.concat(acc["out"], F.array(F.struct(before.alias("s"), acc["at"].alias("e"))))
        more = acc["at"] >= F.col("first_date")
        return F.struct(F.when(more, before).otherwise(acc["at"]).alias("at"), F.when(more, grown).otherwise(acc["out"]).alias("out"))

    tiles = F.aggregate(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), start, step, lambda acc: acc["out"])
    return spans.select("patient_id", F.posexplode(tiles).alias("window_no", "w")).select("patient_id", "window_no", F.col("w.s").alias("window_start"), F.col("w.e").alias("window_end"))


def assign_tiles(events: DataFrame, tiles: DataFrame) -> DataFrame:
    """Events with the tile that holds them: an equi-join on patient and month, the interval as its residual.

    A tile is listed under every month it touches, so an event meets the few tiles of its month only, however long its
    patient's history is.
    """
    months = F.sequence(F.trunc(F.date_add("window_start", 1), "MM"), F.trunc("window_end", "MM"), F.expr("interval 1 month"))
    t = tiles.withColumn("_month", F.explode(months)).alias("t")
    e = events.withColumn("_month", F.trunc("date", "MM")).alias("e")
    held = (F.col("e.patient_id") == F.col("t.patient_id")) & (F.col("e._month") == F.col("t._month")) & (F.col("e.date") > F.col("t.window_start")) & (F.col("e.date") <= F.col("t.window_end"))
    return t.join(e, held).select("t.patient_id", "t.window_no", "t.window_start", "t.window_end", "e.event_id", "e.date")


def windowed(events: DataFrame, cutoffs: DataFrame | None = None) -> DataFrame:
    """Events with each resolution's calendar window; with cutoffs also the windows clipped at a cutoff.

    A clipped window is another one than the whole: events after the cutoff do not belong to it.
    """
    res = events.withColumn("resolution", F.explode(F.array(*[F.lit(r) for r in RESOLUTIONS])))
    first, last = calendar_window(F.col("date"), F.col("resolution"))
    res = res.withColumn("window_start", first).withColumn("window_end", last)
    if cutoffs is None:
        return res
    clipped = res.join(dimension(cutoffs.select("cutoff").distinct()), (F.col("cutoff") >= F.col("date")) & (F.col("cutoff") < F.col("window_end")))
    clipped = clipped.withColumn("window_end", F.least("window_end", "cutoff")).select(*res.columns)
    return res.unionByName(clipped).dropDuplicates(["event_id", "resolution", "window_start", "window_end"])


def window_documents(events: DataFrame, version: str = "explicit", text: str = "text") -> DataFrame:
    """One document per patient, resolution and window: dated lines in order, ids and hashes.

    Built once over the union of natural and clipped windows, so tasks and cutoffs share documents by id.
    """
    line = F.struct("date", "event_id", F.concat(F.date_format("date", "yyyy-MM-dd"), F.lit(": "), F.col(text)).alias("line"))
    made = events.groupBy("patient_id", "resolution", "window_start", "window_end").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    body = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    return made.select(
        F.concat_ws(":", "patient_id", F.lit("history"), "resolution", F.col("window_start").cast("string"), F.col("window_end").cast("string"), F.lit(version)).alias("document_id"),
        "patient_id", "resolution", "window_start", "window_end",
        F.lit(version).alias("explicitness"),
        F.size("lines").alias("n_events"),
        F.transform("lines", lambda x: x["event_id"]).alias("event_ids"),
        body.alias("text"),
        F.sha2(body, 256).alias("text_sha256"),
    )


def _said_together(documents: DataFrame) -> DataFrame:
    """(patient_id, resolution, input_sha256): the digest of the texts of all windows in order, a line feed between them.

    The texts of a history pass one after the other, in the order of their windows, and never stand in one row.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, made = None, None, []
        for batch in batches:
            for patient, resolution, text in zip(*(batch.column(c).to_pylist() for c in ("patient_id", "resolution", "text"))):
                if (patient, resolution) != now:
                    if now is not None:
                        made.append((*now, digest.hexdigest()))
                    now, digest = (patient, resolution), hashlib.sha256((text or "").encode())
                else:
                    digest.update(b"\n" + (text or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*made) if made else ([], [], []))], names=["patient_id", "resolution", "input_sha256"])
            made = []
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.string()) for v in (*now, digest.hexdigest())], names=["patient_id", "resolution", "input_sha256"])

    placed = documents.select("patient_id", "resolution", "window_start", "window_end", "document_id", "text").repartition("patient_id", "resolution")
    return placed.sortWithinPartitions("patient_id", "resolution", "window_start", "window_end", "document_id").mapInArrow(work, "patient_id string, resolution string, input_sha256 string")


def history_documents(people: DataFrame, documents: DataFrame) -> DataFrame:
    """Per patient and resolution the ordered ids of the window documents; patients without events stay, with none.

    The document's text refers to its windows; ``input_sha256`` is the hash of what they say together.
    """
    ref = F.struct("window_start", "window_end", "document_id")
    by = ["patient_id", "resolution"]
    made = documents.groupBy(*by).agg(F.array_sort(F.collect_list(ref)).alias("w"), F.sum("n_events").alias("n_events")).join(_said_together(documents), by, "left")
    everyone = people.select(F.col("Id").alias("patient_id"), F.explode(F.array(*[F.lit(r) for r in RESOLUTIONS])).alias("resolution"))
    return everyone.join(made, by, "left").select(
        F.concat_ws(":", "patient_id", F.lit("multilabel"), F.lit(""), "resolution", F.lit("full-history"), F.lit("explicit")).alias("document_id"),
        "patient_id", "resolution",
        F.coalesce(F.transform("w", lambda x: x["document_id"]), F.array().cast("array<string>")).alias("window_document_ids"),
        F.try_element_at("w", F.lit(1))["window_start"].alias("window_start"),
        F.coalesce("n_events", F.lit(0)).alias("n_events"),
        F.coalesce("input_sha256", F.sha2(F.lit(EMPTY_HISTORY), 256)).alias("input_sha256"),
    )


def coverage(events: DataFrame, windows: DataFrame) -> DataFrame:
    """Per resolution: events, window slots and distinct events in windows; all equal where each is covered once."""
    whole = events.agg(F.count("*").alias("n_events"))
    held = windows.select("resolution", F.explode("event_ids").alias("event_id")).groupBy("resolution").agg(F.count("*").alias("n_slots"), F.countDistinct("event_id").alias("n_covered"))
    return held.join(F.broadcast(whole)).withColumn("exact", (F.col("n_events") == F.col("n_slots")) & (F.col("n_slots") == F.col("n_covered")))


def resolve_references(histories: DataFrame, documents: DataFrame) -> DataFrame:
    """Each reference of a history with the document it names."""
    named = histories.select(F.col("document_id").alias("history_id"), F.posexplode("window_document_ids").alias("position", "document_id"))
    return named.join(documents.select("document_id", "text_sha256", "n_events"), "document_id", "left")


def period_chunks(events: DataFrame, years: int = 5) -> DataFrame:
    """Events by periods of ``years`` from a patient's first year; the last ends in the patient's last year."""
    spans = events.groupBy("patient_id").agg(F.min(F.year("date")).alias("low"), F.max(F.year("date")).alias("high"))
    placed = events.select("patient_id", "date").join(spans, "patient_id").withColumn("chunk_no", F.floor((F.year("date") - F.col("low")) / years).cast("int"))
    first = F.col("low") + F.col("chunk_no") * years
    return placed.groupBy("patient_id", "chunk_no").agg(F.min(first).alias("from_year"), F.min(F.least(first + years - 1, F.col("high"))).alias("to_year"), F.count("*").alias("n_events"))


def auto_chunk_years(tokens: Column, span_years: Column, most: int) -> Column:
    """Years per chunk so that one stays within 70 % of ``most`` tokens; the whole span if that suffices."""
    years = F.greatest(F.lit(1), F.floor(0.7 * most / (tokens / F.greatest(span_years, F.lit(1)))).cast("int"))
    return F.when(tokens <= 0, span_years).otherwise(F.least(years, F.greatest(span_years, F.lit(1))))
