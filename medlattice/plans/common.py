"""Shared pieces of the query modules."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean, events

Query = Callable[[SparkSession, str], DataFrame]

CUTOFFS = (date(2016, 1, 1), date(2018, 1, 1), date(2020, 1, 1))
HORIZONS = (90, 365)
SOURCE_END = date(2024, 12, 31)


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


class History:
    """The clinical views of a directory and what is derived from them."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.tables = clean.clinical(spark, root)
        self.people = self.tables["patients"]
        self.events = events.bundle(self.tables)
        self.panel = clean.panel(self.tables["conditions"])
        self.labels = events.labelled(self.events, self.panel.select("concept_id", F.col("concept_id").alias("code")))
        self.first = events.first_dates(self.labels)
        self.texted = self.events.withColumn("text", events.explicit_text(F.col("facts"), F.col("diagnoses")))


class Registry:
    """Collects a module's queries and oracles under their names."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, query: Query, oracle: str | None = None) -> None:
        query.__name__ = name
        self.queries[name] = query
        if oracle is not None:
            self.oracles[name] = oracle

    def on(self, oracle: str | None = None) -> Callable[[Query], Query]:
        def wrap(query: Query) -> Query:
            self.add(query.__name__, query, oracle)
            return query

        return wrap
