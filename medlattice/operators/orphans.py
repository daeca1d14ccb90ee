"""References to records that do not exist, tracked incrementally.

The tracker's state is a set of keyed tables:

* index - the versions of parent rows as they were delivered, one part a period; of the deliveries of one row (parent,
  id, time of arrival) the latest tells when it ends,
* orphans - the references whose parent was not registered when they arrived, one part a period,
* counts - references per key and month of arrival, one part a period: what a deletion reopens,
* waiting - the pending orphans: counts of the references whose parent is not registered now, per key and month,
* snapshots - references, orphans on arrival and waiting ones per table, field and month, at the end of every period.

Each :func:`advance` takes the rows of one period.  New references probe the index; parents that arrive resolve the keys
that wait for them; deletions, also those of rows delivered earlier, and registrations that have run out put the
references of their keys back.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ids import as_column, canonical_id, not_blank
from ..session import cut, drop_cut, file_system, put, state_folder

FOREVER = "9999-12-31 00:00:00"


@dataclass(frozen=True)
class Reference:
    """A column of a table that names a row of a parent table."""

    table: str
    field: str
    parent: str
    blank_is_missing: bool = True


#: Parts of the index or of the counts from which they are merged into one.
MOST_PARTS = 8
INDEX = "parent string, key binary, start timestamp_ntz, stop timestamp_ntz, number long"
COUNTS = "table_name string, field_name string, parent string, key binary, month date, n_refs long, n_orphans long"
FOUND = "table_name string, field_name string, parent string, row_id {row_id}, key binary, loaded_at timestamp_ntz, month date"
SNAPSHOTS = "number long, until timestamp_ntz, table_name string, field_name string, month date, n_refs long, n_orphans long, n_open long"
SCHEMAS = {"index": INDEX, "orphans": FOUND, "counts": COUNTS, "waiting": COUNTS, "snapshots": SNAPSHOTS}


@dataclass(frozen=True)
class OrphanState:
    """Where the tables of the state lie; ``number`` is that of the last period or micro-batch taken in."""

    spark: SparkSession
    folder: str
    number: int
    until: datetime | None
    parts: dict[str, tuple[str, ...]]
    row_id: str = "bigint"  #: type of the references' row ids

    def table(self, name: str) -> DataFrame:
        paths = [f"{self.folder}/{p}" for p in self.parts.get(name, ())]
        schema = SCHEMAS[name].format(row_id=self.row_id)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    @property
    def orphans(self) -> DataFrame:
        return self.table("orphans")


def _forever() -> Column:
    return F.lit(FOREVER).cast("timestamp_ntz")


def parent_intervals(df: DataFrame, parent: str, key: str = "Id", deleted: str | None = "deleted_at") -> DataFrame:
    """(parent, key, start, stop): when each id was registered; rows without an id or a time say nothing.

    A row that ends as it starts registers nothing, but may replace an earlier delivery of itself.
    """
    stop = F.coalesce(F.col(deleted).cast("timestamp_ntz"), _forever()) if deleted else _forever()
    return df.select(
        F.lit(parent).alias("parent"),
        F.unhex(canonical_id(key)).alias("key"),
        F.col("loaded_at").cast("timestamp_ntz").alias("start"),
        stop.alias("stop"),
    ).where("key is not null and start is not null")


def compact(intervals: DataFrame) -> DataFrame:
    """The same times with fewer rows: open intervals become one per key, overlapping closed ones are joined.

    Closed intervals are joined within a year first and across years after, so that no single task sorts all rows of
    a much repeated id.
    """
    is_open = F.col("stop") >= _forever()
    opened = intervals.where(is_open).groupBy("parent", "key").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))

    def joined(df: DataFrame, *extra: str) -> DataFrame:
        w = Window.partitionBy("parent", "key", *extra).orderBy("start", "stop")
        before = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
        island = F.sum(F.when(F.col("start") <= F.col("before"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
        return (
            df.withColumn("before", before)
            .withColumn("island", island)
            .groupBy("parent", "key", *extra, "island")
            .agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
            .drop("island")
        )

    closed = intervals.where(~is_open).withColumn("year", F.year("start"))
    return joined(joined(closed, "year").drop("year")).unionByName(opened)


def references(df: DataFrame, ref: Reference) -> DataFrame:
    """(table_name, field_name, parent, row_id, key, loaded_at); key is NULL where the value is no id at all."""
    given = not_blank(ref.field) if ref.blank_is_missing else as_column(ref.field).isNotNull()
    return df.where(given).select(
        F.lit(ref.table).alias("table_name"),
        F.lit(ref.field).alias("field_name"),
        F.lit(ref.parent).alias("parent"),
        "row_id",
        F.unhex(canonical_id(ref.field)).alias("key"),
        F.col("loaded_at").cast("timestamp_ntz").alias("loaded_at"),
    )


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, frames)


def _live_at(time: Column) -> Column:
    return (F.col("r.parent") == F.col("i.parent")) & (F.col("r.key") == F.col("i.key")) & (F.col("i.start") <= time) & (F.col("i.stop") > time)


def resolved(versions: DataFrame) -> DataFrame:
    """Compact intervals of the delivered versions: of one row's deliveries the latest holds, within one the longest."""
    rows = versions.groupBy("parent", "key", "start").agg(F.max(F.struct("number", "stop")).alias("v"))
    return compact(rows.select("parent", "key", "start", F.col("v.stop").alias("stop")).where("stop > start"))


def _live(index: DataFrame, at: datetime | None) -> DataFrame:
    """(parent, key) registered at a time; for None now and forever after the last event."""
    when = _forever() - F.expr("interval 1 second") if at is None else F.lit(at).cast("timestamp_ntz")
    return index.where((F.col("start") <= when) & (F.col("stop") > when)).select("parent", "key").distinct()


BY = ["table_name", "field_name", "parent", "key", "month"]


def _added(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    return counts.groupBy(*by).agg(F.sum("n_refs").alias("n_refs"), F.sum("n_orphans").alias("n_orphans"))


def advance(state: OrphanState | None, refs: DataFrame, parents: DataFrame, until: datetime | None = None, folder: str | None = None, number: int | None = None) -> OrphanState:
    """Take in the references and parent intervals of one period, write the new state and return it.

    A reference without a time of arrival was there before any parent, so it is an orphan.  A reference is judged once,
    by what has been delivered with it or before; to be judged as of its own arrival it must not come in an earlier
    period than the parents it needs, so periods are cut by ``loaded_at``.  Later deliveries decide whether it waits.

    ``folder`` (in the shared file system) is where a new tracker keeps its tables.  ``number`` orders the periods; one
    that the state has taken in already changes nothing, and one that failed half-way is written anew.
    """
    spark = refs.sparkSession
    if state is not None and number is not None and number <= state.number:
        return state
    if state is None:
        state = OrphanState(spark, folder or state_folder(spark, "orphans"), -1, None, {}, refs.schema["row_id"].dataType.simpleString())
    number = state.number + 1 if number is None else number
    parts = dict(state.parts)

    def write(name: str, df: DataFrame, fresh: bool = False) -> DataFrame:
        path = f"{name}-{number:08d}"
        df.write.mode("overwrite").parquet(f"{state.folder}/{path}")
        parts[name] = ((path,) if fresh else (*parts.get(name, ()), path))
        return spark.read.schema(SCHEMAS[name].format(row_id=state.row_id)).parquet(f"{state.folder}/{path}")

    refs = cut(refs)
    delivered = write("index", parents.select("parent", "key", "start", "stop", F.lit(number).cast("long").alias("number")))
    versions = state.table("index").unionByName(delivered)
    index = cut(resolved(versions))
    probed = refs.where("key is not null").alias("r")
    month = F.date_trunc("month", "loaded_at").cast("date")
    found = _union([probed.join(index.alias("i"), _live_at(F.col("r.loaded_at")), "left_anti"), refs.where("key is null")])
    found = write("orphans", found.withColumn("month", month))
    zero = F.lit(0).cast("bigint")
    new = _union([
        refs.withColumn("month", month).groupBy(*BY).agg(F.count("*").alias("n_refs")).withColumn("n_orphans", zero),
        found.groupBy(*BY).agg(F.count("*").alias("n_orphans")).withColumn("n_refs", zero),
    ])
    new = write("counts", _added(new, BY))

    live = _live(index, until)
    known = ["parent", "key"]
    waiting = [state.table("waiting").join(live, known, "left_anti"), new.join(live, known, "left_anti")]
    if state.number >= 0:
        ended = F.col("stop") <= (_forever() - F.expr("interval 1 second") if until is None else F.lit(until).cast("timestamp_ntz"))
        if state.until is not None:
            ended &= F.col("stop") > F.lit(state.until).cast("timestamp_ntz")
        touched = delivered.select(*known).unionByName(index.where(ended).select(*known)).distinct()
        lost = touched.join(live, known, "left_anti").join(state.table("waiting").select(*known).distinct(), known, "left_anti")
        waiting.append(state.table("counts").join(lost, known, "left_semi"))
    waiting = write("waiting", _added(_union([w.select(*BY, "n_refs", "n_orphans") for w in waiting]), BY), fresh=True)

    month_of = ["table_name", "field_name", "month"]
    before = state.table("snapshots").where(F.col("number") == state.number)
    sums = _union([
        before.select(*month_of, "n_refs", "n_orphans", zero.alias("n_open")),
        _added(new, month_of).withColumn("n_open", zero),
        waiting.groupBy(*month_of).agg(F.sum("n_refs").alias("n_open")).select(*month_of, zero.alias("n_refs"), zero.alias("n_orphans"), "n_open"),
    ])
    sums = sums.groupBy(*month_of).agg(*[F.sum(c).alias(c) for c in ("n_refs", "n_orphans", "n_open")])
    write("snapshots", sums.select(F.lit(number).cast("long").alias("number"), F.lit(until).cast("timestamp_ntz").alias("until"), "*").coalesce(1))

    merged = OrphanState(spark, state.folder, number, until, dict(parts), state.row_id)
    for name, whole in (
        ("index", lambda t: t.groupBy("parent", "key", "start").agg(F.max(F.struct("number", "stop")).alias("v")).select("parent", "key", "start", "v.stop", "v.number")),
        ("counts", lambda t: _added(t, BY)),
    ):
        if len(parts[name]) > MOST_PARTS:
            path = f"{name}-merged-{number:08d}"
            whole(merged.table(name)).write.mode("overwrite").parquet(f"{state.folder}/{path}")
            parts[name] = (path,)
    drop_cut(index)
    drop_cut(refs)
    after = OrphanState(spark, state.folder, number, until, parts, state.row_id)
    save_state(after)
    return after


def snapshot(state: OrphanState, at: datetime | None = None) -> DataFrame:
    """Per table, field and month of arrival: references, orphans on arrival, and those still open.

    Open are the waiting references of the last period; with ``at`` those whose parent is not registered at that time
    by what is known now.
    """
    month_of = ["table_name", "field_name", "month"]
    if at is None:
        return state.table("snapshots").where(F.col("number") == state.number).select(*month_of, "n_refs", "n_orphans", "n_open")
    live = _live(resolved(state.table("index")), at).withColumn("live", F.lit(True))
    return (
        state.table("counts")
        .join(live, ["parent", "key"], "left")
        .groupBy(*month_of)
        .agg(
            F.sum("n_refs").alias("n_refs"),
            F.sum("n_orphans").alias("n_orphans"),
            F.sum(F.when(F.col("live"), 0).otherwise(F.col("n_refs"))).alias("n_open"),
        )
    )


def snapshots(state: OrphanState) -> DataFrame:
    """The snapshots at the end of every period so far."""
    return state.table("snapshots")


def replay(refs: DataFrame, parents: DataFrame, periods: int = 2, folder: str | None = None) -> OrphanState:
    """Build the state from a whole history in ``periods`` equal spans of time, oldest first.

    Empty tables give an empty state.  Rows whose time is NULL belong to the first period.
    """
    low, high = refs.agg(F.min("loaded_at"), F.max("loaded_at")).first()
    spans = [low + timedelta(microseconds=(high - low) // timedelta(microseconds=1) * k // periods) for k in range(1, periods)] if low is not None and high > low else []
    state = None
    for number, (since, until) in enumerate(zip([None, *spans], [*spans, None])):

        def within(column: str) -> Column:
            kept = F.lit(True)
            if since is not None:
                kept = F.col(column) > F.lit(since).cast("timestamp_ntz")
            if until is not None:
                kept = kept & (F.col(column) <= F.lit(until).cast("timestamp_ntz"))
            return kept if since is not None else F.coalesce(kept, F.lit(True))

        state = advance(state, refs.where(within("loaded_at")), parents.where(within("start")), until, folder, number)
    return state


def clinical_replay(spark: SparkSession, root: str, periods: int = 2) -> OrphanState:
    """The tracker over the conditions, encounters and patients tables of a directory."""
    read = lambda t: spark.read.parquet(f"{root}/{t}.parquet")
    conditions, encounters, patients = read("conditions"), read("encounters"), read("patients")
    refs = _union([
        references(conditions, Reference("conditions", "PATIENT", "patients")),
        references(encounters, Reference("encounters", "PATIENT", "patients")),
        references(conditions, Reference("conditions", "ENCOUNTER", "encounters", blank_is_missing=False)),
    ])
    parents = parent_intervals(patients, "patients").unionByName(parent_intervals(encounters, "encounters", deleted=None))
    return replay(refs, parents, periods)


def save_state(state: OrphanState) -> None:
    """Write where the tables of a state lie, last of all and at one stroke, so that a period without it has not been taken in."""
    told = json.dumps({"number": state.number, "until": None if state.until is None else state.until.isoformat(), "parts": state.parts, "row_id": state.row_id})
    name = f"{state.folder}/state-{state.number:08d}"
    put(state.spark, f"{name}.tmp", [told.encode()])
    fs, done = file_system(state.spark, f"{name}.json")
    fs.delete(done, False)
    fs.rename(file_system(state.spark, f"{name}.tmp")[1], done)


def load_state(spark: SparkSession, folder: str) -> OrphanState | None:
    """The last complete state of a folder; None where there is none."""
    fs, path = file_system(spark, f"{folder}/state-*.json")
    files = fs.globStatus(path)
    names = sorted(f.getPath().getName() for f in files) if files else []
    if not names:
        return None
    told = json.loads(spark.read.text(f"{folder}/{names[-1]}").first()[0])
    return OrphanState(spark, folder, told["number"], None if told["until"] is None else datetime.fromisoformat(told["until"]), {k: tuple(v) for k, v in told["parts"].items()}, told["row_id"])
