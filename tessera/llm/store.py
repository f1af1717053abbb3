"""Cutting lineage with tables in the shared folder that the session names."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import ship


def named(column: str) -> Column:
    """The column of that very name, whatever characters are in it."""
    return F.col("`" + column.replace("`", "``") + "`")


def whole_row(df: DataFrame) -> Column:
    """All columns as one structure, so that columns beside it can't clash with theirs."""
    return F.struct(*[named(c) for c in df.columns]).alias("row")


def row_columns(columns: list[str], row: str = "row") -> list[Column]:
    """The columns of such a structure again."""
    return [F.col(row).getField(c).alias(c) for c in columns]


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir or given by setCheckpointDir; only where there is none and all runs on this machine, a new one of this process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and (given := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        found = given.get()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    made = tempfile.mkdtemp(prefix="tessera-shared-")
    atexit.register(shutil.rmtree, made, True)
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    return f"file://{made}"


def _place(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, files = _place(spark, path)
    return files.exists(where)


def _delete(spark: SparkSession, path: str) -> None:
    where, files = _place(spark, path)
    files.delete(where, True)


#: Bytes of an Arrow batch between the JVM and Python, where the session leaves Spark's default of 64 MB: batches are held several times on both sides, off the heap too.
BATCH = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches for this session, unless it has set a size itself."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":
        spark.conf.set(key, str(BATCH))


class Tables:
    """Intermediate tables of one run of an operator.

    ``keep`` writes a DataFrame as Parquet into the shared folder and reads it back: later stages
    survive the loss of any executor, and row numbers given before the write stay fixed. ``drop``
    deletes tables that nothing reads any more.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        ship(spark)
        bound_batches(spark)
        self.spark, self.root, self.count = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tessera_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            _delete(self.spark, table._tessera_path)
