"""Session defaults and staged tables."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "rankcut", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; on a cluster, pass your own session to the operators."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of every executor (once per application)."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        package = Path(__file__).parent
        target = Path(tempfile.mkdtemp(prefix="rankcut-zip-")) / "rankcut"
        spark.sparkContext.addPyFile(shutil.make_archive(str(target), "zip", package.parent, package.name))
        _SHIPPED.add(app)


def scratch_dir(spark: SparkSession) -> str:
    """The folder set with ``setCheckpointDir``, else the one ``spark.checkpoint.dir`` names.

    A temporary one is set only for a local master: on a cluster, other machines could not read it.
    """
    configured = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    fallback = tempfile.mkdtemp(prefix="rankcut-")
    spark.sparkContext.setCheckpointDir(fallback)
    return fallback


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/rankcut/{uuid.uuid4().hex}/{name}"


def stage(df: DataFrame, name: str = "stage", partition_by: list[str] | None = None, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder, with the session's compression unless another is named, and read it back.

    Cuts the lineage with files that outlive any executor, and pins the outcome of steps whose
    result depends on how rows are laid out (see ``row_index``).
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", compression) if compression else df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, keys: list[str], buckets: int, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder once, dealt into ``buckets`` by ``keys`` and sorted, and read it back.

    Tables with equal keys and bucket numbers are joined, and grouped by these keys, where they lie: no row is shuffled again,
    however often they are read.
    """
    spark = df.sparkSession
    unique = f"{name}_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").bucketBy(buckets, *keys).sortBy(*keys).option("path", new_path(spark, name)).saveAsTable(unique)
    return spark.table(unique)


@contextmanager
def layouts_kept(spark: SparkSession) -> Iterator[None]:
    """Tables written in here join where they lie if both sides are dealt by some of the join keys; else Spark deals them anew by all keys."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Python functions in jobs run in here get at most ``rows`` rows at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def unstage(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing will read again."""
    spark = df.sparkSession
    own = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/rankcut").toUri().getPath()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if path.toUri().getPath().startswith(f"{own}/"):
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
