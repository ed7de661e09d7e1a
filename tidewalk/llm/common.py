"""Tables in the cluster's shared folder, and id/text preparation."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders made where the session names none, by application.
_own: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where the session names none, one of our own, on a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = _own.setdefault(spark.sparkContext.applicationId, f"file://{tempfile.mkdtemp(prefix='tidewalk-')}")
    return found.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # noqa: BLE001 - the session may be gone when the interpreter ends
        pass


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of what is written inside are dropped when it is done: what is written is read from the table."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def table(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidewalk-{name}-{uuid.uuid4().hex}"
    with _shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    atexit.register(_forget, spark, path)
    back = spark.read.schema(df.schema).parquet(path)
    back._tidewalk_path = path
    return back


def bucketed(df: DataFrame, name: str, files: int, column: str, order: str, number: str) -> DataFrame:
    """Like `table`, with equal values of `column` in one of `files` buckets, so that grouping by it needs no shuffle.

    Rows are written in the order of `column` and `order`, each with a `number` of its own that rises with them.
    """
    spark = df.sparkSession
    label = f"tidewalk_{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{label}"
    dealt = df.repartition(files, column).sortWithinPartitions(column, order).withColumn(number, F.monotonically_increasing_id())
    with _shuffles_dropped(spark):
        dealt.write.bucketBy(files, column).option("compression", "zstd").option("path", path).saveAsTable(label)
    atexit.register(_forget, spark, path)
    return spark.table(label)


def drop_table(df: DataFrame) -> None:
    if path := getattr(df, "_tidewalk_path", None):
        _forget(df.sparkSession, path)


def id_and_text(docs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and text alone, whatever other columns the table has."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra)


def in_parts(n_rows: int, each: int, least: int = 1) -> int:
    return max(least, -(-n_rows // each))


def remainder(column: str, divisor: int) -> Column:
    """crc32 of the id written as text, modulo `divisor`."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor
