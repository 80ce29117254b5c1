"""Ordering and paging with total orders (a primary key breaks ties)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staygrid.operators.skew import with_group_number

# A request with more candidates than this is ranked by a sort over all tasks.
CANDIDATES_PER_TASK = 1_000_000


def newest_first(column: str, *keys: str) -> list[Column]:
    """Descending time; an unset time comes first, as the source database sorts it."""
    return [F.col(column).desc_nulls_first(), *[F.col(k).asc() for k in keys]]


def ascending(column: str, *keys: str) -> list[Column]:
    return [F.col(column).asc_nulls_last(), *[F.col(k).asc() for k in keys]]


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of one ordered result."""
    return df.orderBy(*order).offset(number * size).limit(size)


def top_per_group(df: DataFrame, groups: list[str], order: list[Column], n: int, name: str) -> DataFrame:
    """The first ``n`` rows of each group; at most n per group and task are shuffled."""
    place = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    return df.withColumn(name, place).where(F.col(name) <= n)


def page_per_request(matches: DataFrame, requests: DataFrame) -> DataFrame:
    """The page of each request by (distance_m, listing_id), with ``position`` and the
    request's ``total`` number of matches; all columns of ``requests`` ride along.

    ``matches`` carries request_id, listing_id, distance_m; ``requests`` request_id, page,
    size. Any page is served by the same plan: three narrow columns are shuffled once by
    request, and both the rank and the count are taken above that one shuffle, so each
    pair is measured once. The matches of one request, at most the number of listings,
    are sorted in one task and spill beyond its memory.
    """
    skip = F.col("page").cast("bigint") * F.col("size")
    mine = Window.partitionBy("request_id")
    ranked = matches.select("request_id", "listing_id", "distance_m").withColumns(
        {
            "position": F.row_number().over(mine.orderBy("distance_m", "listing_id")),
            "total": F.count(F.lit(1)).over(mine).cast("int"),
        }
    )
    placed = ranked.join(requests.withColumn("_skip", skip), "request_id")
    on_page = (F.col("position") > F.col("_skip")) & (F.col("position") <= F.col("_skip") + F.col("size"))
    return placed.where(on_page).drop("_skip")


def page_of_candidates(candidates: DataFrame, per_task: int = CANDIDATES_PER_TASK) -> DataFrame:
    """(request_id, listing_id, distance_m, position): the page of each request.

    ``candidates`` (request_id, listing_id, distance_m, page, size) holds all matches that
    can be on it, and in ``passed`` how many matches come before all of them; it is read
    several times and should be stored. Ranked by (distance_m, listing_id): in one window
    where a request has few candidates, by a distributed sort where it has more than
    ``per_task``. Runs a job.
    """
    order = ["distance_m", "listing_id"]
    many = candidates.groupBy("request_id").agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > per_task)
    mine = Window.partitionBy("request_id").orderBy(*order)
    if many.isEmpty():
        ranked = candidates.withColumn("_rank", F.row_number().over(mine).cast("long"))
    else:
        many = many.select("request_id")
        few = candidates.join(many, "request_id", "left_anti").withColumn("_rank", F.row_number().over(mine).cast("long"))
        ranked = few.unionByName(
            with_group_number(candidates.join(many, "request_id", "left_semi"), ["request_id"], order, "_rank")
        )
    position = F.col("_rank") + F.col("passed")
    skip = F.col("page").cast("long") * F.col("size")
    return ranked.where((position > skip) & (position <= skip + F.col("size"))).select(
        "request_id", "listing_id", "distance_m", position.cast("int").alias("position")
    )
