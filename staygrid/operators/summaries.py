"""Cell summaries: how many listings of a cell a request may count without looking at them.

A cell lies inside a request's circle, outside, or on its border. The listings of dense cells
are rolled up once; what lies inside is counted from the roll-up, and only the border is
joined pair by pair, in ever smaller cells. The same counts tell which cells can hold a page
of a request's results, so that the others are never measured. A request that reaches no
dense cell has a bounded number of pairs, which cost less than summaries.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from staygrid.operators.spatial import covering, placed, with_level, with_reach
from staygrid.session import stored

# Different points of active listings that make a cell dense. Below that, measuring pairs costs less than the
# jobs for summaries.
DENSE = 16_384

# Halvings of dense cells. Each halves the share of a circle that lies in border cells and
# doubles their number.
REFINEMENTS = 4

# Rents of a cell are kept in squares of this side (rent against the next lower rent of the
# same listing), so that a range of rents counts most squares as a whole.
RENT_SQUARE = 2048

# A lower rent for listings' lowest rents, and bounds for requests without one.
NO_RENT, NO_LOW, NO_HIGH = -9_000_000_000_000_000_000, -8_000_000_000_000_000_000, 9_000_000_000_000_000_000
CELL = ["_level", "_cy", "_cx"]


def quartered(cells: DataFrame, keep: str = "false") -> DataFrame:
    """Cells replaced by their four quarters, but those where ``keep`` holds."""
    own = "array(struct(_level as l, _cy as y, _cx as x))"
    quarters = ", ".join(
        f"struct(_level - 1 as l, 2 * _cy + {y} as y, 2 * _cx + {x} as x)" for y in (0, 1) for x in (0, 1)
    )
    rest = [c for c in cells.columns if c not in CELL]
    return cells.select(*rest, F.explode(F.expr(f"case when {keep} then {own} else array({quarters}) end")).alias("_q")).select(
        *rest, F.col("_q.l").alias("_level"), F.col("_q.y").alias("_cy"), F.col("_q.x").alias("_cx")
    )


def dense_cells(offers: DataFrame, levels: DataFrame, dense: int = DENSE) -> DataFrame:
    """Cells of the ``levels`` with at least ``dense`` of the ``offers`` (``_dense``) and their
    quarters: at most five per ``dense`` listings and level. These are rolled up."""
    sizes = placed(offers.select("lat", "lng"), levels).groupBy(*CELL).agg(F.count(F.lit(1)).alias("_size"))
    large = sizes.where(F.col("_size") >= dense).select(*CELL, F.lit(True).alias("_dense"))
    quarters = quartered(large.select(*CELL)).withColumn("_dense", F.lit(False))
    return large.unionByName(quarters).groupBy(*CELL).agg(F.max("_dense").alias("_dense"))


def with_density(cells: DataFrame, dense: DataFrame) -> DataFrame:
    """``_dense`` and ``_rolled``: whether a cell is dense, and whether it is rolled up."""
    known = dense.select(*CELL, "_dense", F.lit(True).alias("_rolled"))
    flags = {n: F.coalesce(n, F.lit(False)) for n in ("_dense", "_rolled")}
    return cells.drop(*flags).join(known, CELL, "left").withColumns(flags)


def classified(requests: DataFrame, dense: DataFrame, refinements: int = REFINEMENTS) -> DataFrame:
    """Cells of each request's circle with ``_inside``, ``_dense`` and ``_rolled``. Dense cells
    on its border are halved, up to ``refinements`` times."""
    cells = with_density(with_reach(covering(requests)), dense)
    for _ in range(refinements):
        cells = with_density(with_reach(quartered(cells, "_inside or not _dense")), dense)
    return cells


def levels_of(requests: DataFrame, least: int = REFINEMENTS, most: int = 0) -> DataFrame:
    """Levels from ``least`` to ``most`` halvings below those the requests pick, one row
    each: at most one per halving of the globe."""
    steps = F.sequence(F.col("_level") - least, F.col("_level") - most)
    return with_level(requests).select("_level").distinct().select(F.explode(steps).alias("_level")).distinct()


def roll_up(offers: DataFrame, dense: DataFrame, categories: list[str]) -> DataFrame:
    """Counts of listings per cell in ``dense`` (of ``dense_cells``) and category values.

    ``offers`` has lat, lng, the categories and ``_rents`` (distinct rents). Rows with
    ``_bounded`` false count listings. The others count steps from one rent of a listing to
    its next higher one, by squares of both: a listing has a rent in a range exactly if one
    of its steps starts below the range and ends in it.
    """
    here = placed(offers.select("lat", "lng", *categories, "_rents"), dense).join(dense, CELL, "left_semi")
    key = [*CELL, *categories]
    count = F.count(F.lit(1)).alias("_n")
    whole = here.groupBy(*key).agg(count).withColumn("_bounded", F.lit(False))
    rents = F.array_sort("_rents")
    steps = here.select(*key, F.explode(F.arrays_zip(
        F.concat(F.array(F.lit(NO_RENT)), F.transform(rents, lambda r: r.cast("long"))).alias("low"), rents.alias("high")
    )).alias("_step")).where(F.col("_step.high").isNotNull())
    points = steps.groupBy(*key, F.col("_step.low").alias("low"), F.col("_step.high").cast("long").alias("high")).agg(count)
    square = [F.floor(F.col(c) / RENT_SQUARE).alias(f"_{c}_square") for c in ("low", "high")]
    squares = points.groupBy(*key, *square).agg(
        F.sum("_n").alias("_n"), *[f(c).alias(f"_{c}_{n}") for c in ("low", "high") for n, f in (("min", F.min), ("max", F.max))],
        F.collect_list(F.struct("low", "high", F.col("_n").alias("n"))).alias("_steps"),
    ).drop("_low_square", "_high_square").withColumn("_bounded", F.lit(True))
    return whole.unionByName(squares, allowMissingColumns=True)


def counted(cells: DataFrame, rolled: DataFrame, categories: str, by: list[str]) -> DataFrame:
    """``by`` and ``_n``: listings of the cells that match the requests' categories and
    rents (``_ask_lo`` to ``_ask_hi``), from the roll-up. Groups without any are absent."""
    low, high = (f"coalesce({c}, {none}L)" for c, none in (("_ask_lo", NO_LOW), ("_ask_hi", NO_HIGH)))
    text = f"""
      with asked as (
        select *, _ask_lo is not null or _ask_hi is not null as _bounded, {low} as _lo, {high} as _hi from {{cells}})
      select {", ".join(by)}, sum(
        case when not _bounded or _low_max < _lo and _high_min >= _lo and _high_max <= _hi then _n
        else aggregate(_steps, 0L, (sum, s) -> sum + case when s.low < _lo and s.high >= _lo and s.high <= _hi then s.n else 0L end)
        end) as _n
      from asked join {{rolled}} using ({", ".join([*CELL, "_bounded"])})
      where {categories} and (not _bounded or _low_min < _lo and _high_max >= _lo and _high_min <= _hi)
      group by {", ".join(by)}
    """
    return cells.sparkSession.sql(text, cells=cells, rolled=rolled)


def page_cells(
    requests: DataFrame, dense: DataFrame, rolled: DataFrame, categories: str, refinements: int = REFINEMENTS
) -> DataFrame:
    """Cells that may hold the page of each request, with ``_passed``: how many of its
    matches are nearer than all of them.

    ``requests`` carries page and size. Cells that begin beyond a distance within which the
    page is surely full go; so do rolled-up cells inside the circle that end before the
    first distance the page can begin at, and their matches are counted as passed. Dense cells
    that are left are halved and looked at again. One job a round, and a bounded number of
    cells per request.
    """
    start = {"_skip": F.col("page").cast("long") * F.col("size"), "_passed": F.lit(0).cast("long")}
    cells = with_density(with_reach(covering(requests)), dense).withColumns(start)
    mine = Window.partitionBy("request_id")
    for step in range(refinements + 1):
        if step:
            cells = with_density(with_reach(quartered(cells, "not _dense")), dense)
        cells = stored(cells, "page-cells")
        sure = F.col("_inside") & F.col("_rolled")
        n = counted(cells.where(sure), rolled, categories, ["request_id", *CELL])
        known = cells.join(n, ["request_id", *CELL], "left").withColumn(
            "_n", F.when(sure, F.coalesce("_n", F.lit(0))).otherwise(0)
        )
        known = known.where(~sure | (F.col("_n") > 0)).withColumns({
            "_sum": F.sum("_n").over(mine.orderBy("_to_m", "_cy", "_cx")),
            # Any number of matches may lie in a cell that has not been counted.
            "_may": F.sum(F.when(sure, F.col("_n")).otherwise(F.col("_skip") + 1)).over(mine.orderBy("_from_m", "_cy", "_cx")),
        }).withColumns({
            "_full": F.min(F.when(F.col("_sum") >= F.col("_skip") + F.col("size"), F.col("_to_m"))).over(mine),
            "_first": F.min(F.when(F.col("_may") > F.col("_skip"), F.col("_from_m"))).over(mine),
        })
        before = F.col("_to_m") < F.col("_first")
        known = known.withColumn("_gone", F.sum(F.when(before, F.col("_n")).otherwise(0)).over(mine))
        cells = known.where(~before & (F.col("_full").isNull() | (F.col("_from_m") <= F.col("_full"))))
        cells = cells.withColumns({"_skip": F.col("_skip") - F.col("_gone"), "_passed": F.col("_passed") + F.col("_gone")})
        cells = cells.drop("_n", "_sum", "_may", "_full", "_first", "_gone")
    return cells


def matching(asked: dict[str, str]) -> str:
    """Predicate: each category asked for (key) is that of the listing (value)."""
    return reduce(lambda a, b: f"{a} and {b}", (f"(_ask_{k} is null or _{v} = _ask_{k})" for k, v in asked.items()))
