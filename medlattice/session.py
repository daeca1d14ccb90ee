"""Session construction, shared-folder checkpoints and broadcast guards."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows a table may have before an operator stops treating it as a broadcast dimension.
MAX_DIMENSION_ROWS = 200_000


def build_session(app: str = "medlattice", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the engine is tested with; a cluster supplies its own."""
    root = str(Path(__file__).resolve().parent.parent)
    paths = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        os.environ["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Give the package to the session's Python workers, wherever they run; once per context."""
    root = Path(__file__).resolve().parent.parent
    context = spark.sparkContext
    if getattr(context, "_medlattice_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="medlattice-ship-")) / "medlattice.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted((root / "medlattice").rglob("*.py")):
            z.write(path, path.relative_to(root))
    context.addPyFile(str(archive))  # the driver serves the file to every executor
    context._medlattice_shipped = True


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path for it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def put(spark: SparkSession, path: str, chunks: Iterable[bytes], replace: bool = True, flush: bool = False) -> None:
    """Write bytes to a file of any file system that the session knows; with ``flush`` each chunk is readable at once."""
    fs, where = file_system(spark, path)
    out = fs.create(where, replace)
    try:
        for chunk in chunks:
            out.write(bytearray(chunk))
            if flush:
                out.hflush()
    finally:
        out.close()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for reliable checkpoints.

    Where the cluster names one in ``spark.checkpoint.dir`` that is used; only a local session without one (tests, a
    laptop) gets a folder of its own.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not set_dir:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        set_dir = tempfile.mkdtemp(prefix="medlattice-checkpoint-")
        spark.sparkContext.setCheckpointDir(set_dir)
        return set_dir
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(set_dir)
    return set_dir


def state_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared file system for the tables of an operator's state."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, *by: str) -> DataFrame:
    """Materialise ``df`` as Parquet in the shared folder, in folders per value of ``by``, and read it back.

    Lineage ends there, so a lost executor costs a re-read and not a recomputation, and columnar files keep their
    statistics and pruning, which an RDD checkpoint would lose.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).option("compression", "snappy").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Delete the files behind a frame made by :func:`cut`, once nothing will read it again."""
    for folder in {re.sub(r"(/cut-[0-9a-f]{32})/.*", r"\1", name) for name in df.inputFiles()}:
        fs, path = file_system(df.sparkSession, folder)
        if path.getName().startswith("cut-"):
            fs.delete(path, True)


def dimension(df: DataFrame, limit: int = MAX_DIMENSION_ROWS) -> DataFrame:
    """Hint a broadcast when ``df`` is counted to be at most ``limit`` rows, else leave the join to shuffle."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def tasks_for(spark: SparkSession) -> int:
    """Partitions for explicit repartitioning: the session's shuffle width."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, each: int = 3) -> DataFrame:
    """Enough partitions to keep every core busy in a Python stage: few and large input splits are dealt out anew.

    Inputs that come in at least ``each`` splits a core are left alone, so at scale nothing is shuffled.
    """
    wanted = each * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)
