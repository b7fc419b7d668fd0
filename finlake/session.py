"""Session, shared-folder and lineage helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark import RDD
from pyspark.sql import Column, DataFrame, Observation, SparkSession

def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("finlake")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, from ``spark.checkpoint.dir``.

    A temporary folder stands in only when the session runs on one machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="finlake-"))
    return spark.sparkContext.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint; survives executor loss."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def checkpointed(rdd: RDD) -> RDD:
    """``rdd`` whose lineage is cut by a reliable checkpoint with the first job that reads it; for what is persisted."""
    if not rdd.ctx.getCheckpointDir():
        rdd.ctx.setCheckpointDir(shared_dir(SparkSession.active()))
    rdd.checkpoint()
    return rdd


def drop_checkpoint(rdd: RDD) -> None:
    """Delete the checkpoint of an ``rdd`` that nothing reads any more."""
    if file := rdd.getCheckpointFile():
        _delete(SparkSession.active(), file)


def watched(df: DataFrame, figure: Column) -> tuple[DataFrame, object]:
    """:func:`written` and an aggregate of the rows, taken while they are written.

    Only for aggregates that repeated rows leave as they are (min, max): a task that runs twice may count twice.
    """
    seen = Observation()
    return written(df.observe(seen, figure.alias("figure"))), seen.get["figure"]


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Unlike a checkpoint the copy is columnar, so every later reader prunes
    columns and pushes filters down. Use it for inputs read many times.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage with a Parquet copy, for rounds of loops that write many small rows.

    A checkpoint serialises row by row as objects, which at millions of rows takes longer than the round itself.
    """
    return stage_table(df, "round")


@contextmanager
def bucketed(df: DataFrame, key: str) -> Iterator[DataFrame]:
    """``df`` as a table bucketed and sorted by ``key``, for loops that join it on ``key`` again and again.

    A checkpoint forgets how its rows are partitioned, so each round would
    shuffle ``df`` anew; buckets are matched by shuffling the other side only.
    The table leaves the catalogue with the block.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"finlake_{uuid.uuid4().hex}"
    (
        df.repartition(n, key).write.format("parquet").bucketBy(n, key).sortBy(key)
        .option("path", new_path(spark, "buckets")).saveAsTable(name)
    )
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


class GrowingTable:
    """Rows added by and by to a table bucketed by ``keys``: joins on them do not shuffle it. ``rows`` is None while it has none."""

    def __init__(self, spark: SparkSession, keys: Sequence[str]) -> None:
        self.rows: DataFrame | None = None
        self.keys, self.name, self.path = list(keys), f"finlake_{uuid.uuid4().hex}", new_path(spark, "growing")

    def add(self, df: DataFrame) -> None:
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        (
            df.repartition(n, *self.keys).write.format("parquet").mode("append").bucketBy(n, *self.keys)
            .option("path", self.path).saveAsTable(self.name)
        )
        self.rows = df.sparkSession.table(self.name)

    def stored(self) -> DataFrame:
        """The rows by their files, which stay when the table leaves the catalogue."""
        return self.rows.sparkSession.read.schema(self.rows.schema).parquet(self.path)


@contextmanager
def growing(spark: SparkSession, keys: Sequence[str]) -> Iterator[GrowingTable]:
    """A :class:`GrowingTable` that leaves the catalogue with the block."""
    table = GrowingTable(spark, keys)
    try:
        yield table
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table.name}")


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/finlake/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh, unused path below the shared folder, in the folder of this application."""
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> bool:
    file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(file, True)


def drop_staged(spark: SparkSession) -> bool:
    """Delete everything this application staged; call it when the results were written."""
    return _delete(spark, _own_folder(spark))
