"""What the operators share: input columns, Arrow batches, the shipped package."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staygrid.session import work_path

# A batch handed to Python holds at most this many rows and about this many bytes, so
# that a run of very long texts does not fill a worker's memory.
ROWS_PER_BATCH = 1000
BYTES_PER_BATCH = 16 << 20

PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ready(spark: SparkSession) -> SparkSession:
    """Limit the Arrow batches and give the executors this package, once per context."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES_PER_BATCH))
    context = spark.sparkContext
    if not getattr(context, "_staygrid_shipped", False):
        archive = os.path.join(tempfile.mkdtemp(), "staygrid_package.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for folder, _, names in os.walk(PACKAGE):
                for name in sorted(n for n in names if n.endswith(".py")):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(PACKAGE)))
        context.addPyFile(archive)
        context._staygrid_shipped = True
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text as a string; a missing text counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def id_and_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns most operators read; any others of ``docs`` stay behind."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), text_of(text).alias("text"))


def map_batches(
    df: DataFrame,
    function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: str,
) -> DataFrame:
    ready(df.sparkSession)
    return df.mapInArrow(function, schema)


def batch_of(**columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


class Scratch:
    """Tables of one run in the shared folder, removed when nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, str] = {}

    def stored(self, df: DataFrame, label: str) -> DataFrame:
        """Write ``df`` once and read it back; one table per label at a time."""
        path = self.paths[label] = work_path(self.spark, label)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def discard(self, *labels: str) -> None:
        """Remove tables, through the file system that holds them."""
        for label in labels:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(label))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def least_by(df: DataFrame, turn: str, n: int) -> DataFrame:
    """The ``n`` rows with the least hash in the column ``turn``; all columns break ties.

    The rows are counted by the leading 16 bits of the hash first (at most 65,536 rows
    come to the driver), so that only rows up to the cut are sorted, about ``n`` however
    many there are. Runs a job.
    """
    leading = F.shiftright(F.col(turn), 48)
    counts = df.groupBy(leading.alias("leading")).agg(F.count(F.lit(1)).alias("rows")).collect()
    held = 0
    for leading_bits, rows in sorted(map(tuple, counts)):
        held += rows
        if held >= n:
            df = df.where(leading <= leading_bits)
            break
    return df.orderBy(turn, *[c for c in df.columns if c != turn]).limit(n)
