"""Document and snapshot sinks."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Markers of published versions lie in this folder, one small file per version.
PUBLISHED = "published"


def write_documents(df: DataFrame, path: str) -> None:
    """JSON lines with every key present; NULLs are written, not dropped."""
    df.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def envelope(requests: DataFrame, rows: DataFrame, request: str, data: list[str]) -> DataFrame:
    """One response document per request: {data: [...], meta: {page, size, total}}.

    ``requests`` has request, page, size, total; a request without rows gets an empty
    list. A page holds at most 50 rows, so the array is bounded.
    """
    order = F.array_sort(F.collect_list(F.struct("position", F.struct(*data).alias("row"))))
    filled = rows.groupBy(request).agg(F.transform(order, lambda x: x["row"]).alias("data"))
    empty = F.array().cast(filled.schema["data"].dataType)
    return requests.join(filled, request, "left").select(
        request, F.coalesce("data", empty).alias("data"), F.struct("page", "size", "total").alias("meta")
    )


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    location = jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm


def names_under(spark: SparkSession, pattern: str) -> list[str]:
    """Last parts of the paths that match a pattern of the file system."""
    fs, jvm = _fs(spark, pattern)
    return sorted(s.getPath().getName() for s in fs.globStatus(jvm.org.apache.hadoop.fs.Path(pattern)) or [])


def remove(spark: SparkSession, path: str) -> None:
    fs, jvm = _fs(spark, path)
    fs.delete(jvm.org.apache.hadoop.fs.Path(path), True)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Published versions, oldest first; unfinished ones are not listed."""
    return [int(name.split("=")[1]) for name in names_under(spark, f"{path}/{PUBLISHED}/version=*")]


def write_snapshot(tables: dict[str, DataFrame], path: str) -> int:
    """Publish several tables together as the next version.

    The tables go to a folder of this write's own. Then a marker that names the folder is
    created under the next free number; the file system lets only one writer create it,
    and the other takes the number after it. So a version never mixes two writers'
    files and is never changed once it can be seen.
    """
    spark = next(iter(tables.values())).sparkSession
    folder = f"data-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{path}/{folder}/{name}")
    number = (versions(spark, path) or [0])[-1] + 1
    while True:
        marker = f"{path}/{PUBLISHED}/version={number:012d}"
        fs, jvm = _fs(spark, marker)
        try:
            out = fs.create(jvm.org.apache.hadoop.fs.Path(marker), False)
        except Py4JJavaError as error:
            if "AlreadyExists" not in error.java_exception.getClass().getName():
                raise
            number += 1
            continue
        out.write(bytearray(folder, "ascii"))
        out.close()
        return number


def read_snapshot(spark: SparkSession, path: str, table: str, version: int | None = None) -> DataFrame:
    number = version or versions(spark, path)[-1]
    folder = spark.read.text(f"{path}/{PUBLISHED}/version={number:012d}").first()["value"]
    return spark.read.parquet(f"{path}/{folder}/{table}")
