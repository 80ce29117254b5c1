"""Joins and numbering that hold when one key carries a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from staygrid.session import stored

# A key with more rows than this is split over several tasks.
ROWS_PER_SPLIT = 1_000_000


# Key counts are estimated from one row in n, chosen by hash, with about this many
# counted rows for a key at the limit.
COUNTED_ROWS = 4096


def hot_keys(
    df: DataFrame, keys: list[str], spread_by: str, rows_per_split: int = ROWS_PER_SPLIT
) -> DataFrame:
    """Keys with about ``rows_per_split`` rows or more and the number of splits each gets.

    This only decides over how many tasks a key is spread; every row is still
    joined. So an estimate will do, and counting every nearly unique key exactly
    would shuffle as much as the join itself. The rows counted depend on the value
    of ``spread_by`` alone, hence both sides of a join see the same list. At most
    about rows / rows_per_split keys qualify, which keeps the list small enough to
    broadcast.
    """
    one_in = max(1, rows_per_split // COUNTED_ROWS)
    counted = df.where(F.pmod(F.xxhash64(F.lit("count"), spread_by), F.lit(one_in)) == 0)
    sizes = counted.groupBy(*keys).agg((F.count(F.lit(1)) * one_in).alias("_rows"))
    return sizes.where(F.col("_rows") > rows_per_split).select(
        *keys, F.ceil(F.col("_rows") / rows_per_split).cast("int").alias("_splits")
    )


def split_join(
    many: DataFrame,
    one: DataFrame,
    keys: list[str],
    how: str,
    spread_by: str,
    rows_per_split: int = ROWS_PER_SPLIT,
) -> DataFrame:
    """Join ``many`` (any number of rows per key) to ``one`` (one row per key).

    Rows of a hot key are spread over splits by ``spread_by``; the single matching
    row of ``one`` is repeated once per split. Other keys join as usual.
    """
    hot = hot_keys(many, keys, spread_by, rows_per_split)
    spread = many.join(F.broadcast(hot), keys, "left").withColumn(
        "_split", F.pmod(F.xxhash64(spread_by), F.coalesce("_splits", F.lit(1))).cast("int")
    ).drop("_splits")
    repeated = one.join(F.broadcast(hot), keys, "left").withColumn(
        "_split", F.explode(F.sequence(F.lit(0), F.coalesce("_splits", F.lit(1)) - 1))
    ).drop("_splits")
    return spread.join(repeated, [*keys, "_split"], how).drop("_split")


def with_row_number(df: DataFrame, order: list, name: str) -> DataFrame:
    """Dense 1-based numbering in a total order without a single-task window.

    The sorted rows are stored once in the shared folder (their partition bounds
    come from sampling, so both readers must see the same layout). Each row then
    knows its partition and its place in it; the rows before a partition are a
    prefix sum over one row per partition.
    """
    place = F.monotonically_increasing_id()
    placed = stored(df.orderBy(*order).withColumn("_place", place), "numbered")
    part = F.shiftright(F.col("_place"), 33)
    index = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    # One row per partition: the window below sees at most as many rows as the
    # sort has tasks.
    before = sizes.select(
        "_part",
        (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"),
    )
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(before), "_part")
        .withColumn(name, F.col("_before") + index + 1)
        .drop("_place", "_part", "_before")
    )


def with_group_number(df: DataFrame, groups: list[str], order: list, name: str) -> DataFrame:
    """``row_number() over (partition by groups order by order)`` for huge groups.

    One global sort by (groups, order), then each group's first number is taken off.
    """
    numbered = with_row_number(df, [*groups, *order], "_number")
    first = numbered.groupBy(*groups).agg(F.min("_number").alias("_first"))
    return (
        split_join(numbered, first, groups, "inner", "_number")
        .withColumn(name, F.col("_number") - F.col("_first") + 1)
        .drop("_number", "_first")
    )
