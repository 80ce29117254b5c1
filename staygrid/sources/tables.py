"""Typed scans of the nine tables, draft ingest and the event-log stream source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staygrid.schema import AMENITIES, DEFAULTS, TABLES

KEY_COLUMNS = ("id", "owner_id", "listing_id", "user_id", "tenant_id")


def conform(df: DataFrame, table: str, keys_as: str | None = None) -> DataFrame:
    """Give ``df`` the declared columns of ``table``.

    Missing columns become NULL or the column default; key columns keep the type
    they arrive in unless ``keys_as`` is given; text keys are lower-cased, the
    canonical print of an id.
    """
    columns: list[Column] = []
    for field in TABLES[table].fields:
        if field.name not in df.columns:
            default = DEFAULTS.get((table, field.name))
            columns.append(F.lit(default).cast(field.dataType).alias(field.name))
            continue
        column = F.col(field.name)
        if field.name in KEY_COLUMNS and field.dataType == T.StringType():
            if keys_as:
                column = column.cast(keys_as)
            if isinstance(df.schema[field.name].dataType, T.StringType):
                column = F.lower(column)
        else:
            column = column.cast(field.dataType)
        columns.append(column.alias(field.name))
    return df.select(*columns)


def load_table(spark: SparkSession, table: str, path: str) -> DataFrame:
    """Parquet scan; column pruning and filters reach the files as usual.

    The file's own types are read (no data is touched for that) and cast once, so
    a timestamp without zone becomes an instant in the session zone.
    """
    return conform(spark.read.parquet(f"{path.rstrip('/')}/{table}"), table)


def load_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {table: load_table(spark, table, path) for table in TABLES}


def jdbc_options(table: str, url: str, key: str = "id", slices: int = 8) -> dict:
    """Reader arguments for one table of the operational database.

    The geography column is split by the database; the scan is cut into ``slices``
    ranges of the id's leading hex digits, so no executor reads the whole table. The
    bounds are uuid literals on the bare column, so the key's index serves each slice;
    a slice takes one connection, and the default leaves most of a small pool free.
    """
    if not 1 <= slices <= 256:
        raise ValueError("slices must lie in 1..256")
    source = table
    if table == "listings":
        plain = [f.name for f in TABLES[table].fields if f.name not in ("lat", "lng", "rules")]
        source = (
            f"(select {', '.join(plain)}, rules::text as rules, "
            "ST_Y(location::geometry) as lat, ST_X(location::geometry) as lng "
            "from listings) as listings"
        )
    edges = [f"{i * 256 // slices:02x}000000-0000-0000-0000-000000000000" for i in range(slices)]
    predicates = [
        " and ".join(
            ([f"{key} >= '{low}'::uuid"] if i else [])
            + ([f"{key} < '{edges[i + 1]}'::uuid"] if i + 1 < slices else [])
        )
        or "true"
        for i, low in enumerate(edges)
    ]
    return {"url": url, "table": source, "predicates": predicates}


def load_tables_jdbc(
    spark: SparkSession, url: str, properties: dict[str, str], slices: int = 8
) -> dict[str, DataFrame]:
    """The nine tables over JDBC, each read in parallel slices of its key."""
    first_key = {"listing_amenities": "listing_id", "favorites": "user_id"}
    frames = {}
    for table in TABLES:
        if table == "amenities":
            frames[table] = conform(
                spark.read.jdbc(url=url, table=table, properties=properties), table
            )
            continue
        options = jdbc_options(table, url, first_key.get(table, "id"), slices)
        frames[table] = conform(spark.read.jdbc(properties=properties, **options), table)
    return frames


def amenities(spark: SparkSession) -> DataFrame:
    """The fixed amenity dimension; small by definition, so joins broadcast it."""
    return spark.createDataFrame(list(AMENITIES), TABLES["amenities"])


def read_events(spark: SparkSession, path: str, schema: T.StructType, **options) -> DataFrame:
    """An append-only folder of parquet event files as a stream."""
    return spark.readStream.schema(schema).options(**options).parquet(path)
