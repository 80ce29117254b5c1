"""How many listings lie within a request's circle, without measuring each of them.

Requests that ask for the same things share a filter, and what a filter lets through is
counted per point once. A request then meets points of its filter instead of listings. The chord
through the earth tells which points are surely within the circle and which are surely not;
distances are only measured in the thin ring between. The same chords tell a smaller radius
that surely holds as many matches as a page needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staygrid.functions.geo import within_sql
from staygrid.operators.spatial import (
    CHORD,
    PAIRS_PER_CELL_TASK,
    covering,
    place_sql,
    placed,
    with_chords,
    with_level,
    with_reach,
)
from staygrid.session import spread, stored

# More different filters than this are not worth counting one by one.
FILTERS = 1024

# The finest level of the cells used here; cells of 140 m.
FINEST = -3

# Smaller radii looked at, each with half the area of the one before.
STEPS = 12

CELL_KEY = ["_filter", "_level", "_cy", "_cx"]


def filters_of(asked: DataFrame, asks: list[str]) -> DataFrame:
    """The different values of the columns ``asks``, numbered in ``_filter``; stored."""
    return stored(asked.select(*asks).distinct().withColumn("_filter", F.monotonically_increasing_id()), "filters")


def with_filter(asked: DataFrame, filters: DataFrame, asks: list[str]) -> DataFrame:
    same = " and ".join(f"a.{c} <=> f.{c}" for c in asks)
    return asked.sparkSession.sql(
        f"select /*+ broadcast(f) */ a.*, f._filter from {{asked}} a join {{filters}} f on {same}", asked=asked, filters=filters
    )


def sites_of(offers: DataFrame, filters: DataFrame, asks: list[str], lets_through: str) -> DataFrame:
    """``_filter``, lat, lng and ``n``: offers that a filter lets through, per point; stored.

    ``filters`` is short (``FILTERS``), so it travels as one array with each offer.
    """
    text = f"""
      select _filter, lat, lng, count(*) as n from (
        select *, {", ".join(f"_f.{c} as {c}" for c in ["_filter", *asks])} from (
          select *, explode((select collect_list(struct({", ".join(["_filter", *asks])})) from {{filters}})) as _f from {{offers}}))
      where {lets_through} and lat is not null and lng is not null group by _filter, lat, lng
    """
    return stored(offers.sparkSession.sql(text, offers=offers, filters=filters), "sites")


def covered(requests: DataFrame, metric: str) -> DataFrame:
    """Cells of the circles of ``requests`` (request_id, ``_filter``, req_lat, req_lng, radius_m)."""
    return with_reach(covering(with_chords(requests, metric), FINEST))


def levels_in(requests: DataFrame) -> DataFrame:
    return with_level(requests, FINEST).select("_level").distinct()


def placed_sites(sites: DataFrame, levels: DataFrame, metric: str) -> DataFrame:
    text = f"select *, {place_sql('lat', 'lng', metric, ('_px', '_py', '_pz'))} from {{sites}}"
    return placed(sites.sparkSession.sql(text, sites=sites), levels)


class Meeting:
    """``cells`` (rows of ``covered``) and ``sites`` where filter and cell are the same.

    Keys with more pairs than ``pairs`` are cut into rectangles as in ``cell_join``. The join
    is on one hash, so that rows sort by a number, and the key is compared in its condition.
    """

    def __init__(self, cells: DataFrame, sites: DataFrame, levels: DataFrame, metric: str, pairs: int = PAIRS_PER_CELL_TASK):
        self.metric, here = metric, placed_sites(sites, levels, metric)
        sizes = cells.groupBy(*CELL_KEY).agg(F.count(F.lit(1)).alias("_r")).join(
            here.groupBy(*CELL_KEY).agg(F.count(F.lit(1)).alias("_l")), CELL_KEY
        ).where(F.col("_r") * F.col("_l") > pairs)
        side = max(1, int(pairs**0.5))
        # At most as many rows as pairs / limit.
        crowded = stored(sizes.selectExpr(
            *CELL_KEY, f"cast(ceil(_r * least(_l, {side}) / {pairs}) as int) as _request_splits",
            f"cast(ceil(_l * least(_r, {side}) / {pairs}) as int) as _site_splits",
        ), "crowded")
        if crowded.isEmpty():
            crowded = None
        self.asking = self._spread(cells, crowded, "request", "site", "request_id")
        self.offering = self._spread(here, crowded, "site", "request", "lat, lng")

    def _spread(self, rows: DataFrame, crowded: DataFrame | None, own: str, other: str, by: str) -> DataFrame:
        if crowded is None:
            slots = {f"_{own}_slot": F.lit(0), f"_{other}_slot": F.lit(0)}
            rows = rows.withColumns(slots)
        else:
            rows = rows.join(F.broadcast(crowded), CELL_KEY, "left").withColumn(
                f"_{other}_slot", F.explode(F.expr(f"sequence(0, coalesce(_{other}_splits, 1) - 1)"))
            ).withColumn(f"_{own}_slot", F.expr(f"cast(pmod(xxhash64({by}), coalesce(_{own}_splits, 1)) as int)"))
        return rows.withColumn("_key", F.xxhash64(*CELL_KEY, "_request_slot", "_site_slot"))

    def _pairs(self, columns: str, where: str) -> str:
        # Differences, since equal columns would become further sort keys.
        same = " and ".join(
            f"a.{c} - o.{c} = 0" for c in [*CELL_KEY, "_request_slot", "_site_slot"]
        )
        return (
            f"select /*+ merge(a, o) */ {columns} from {{asking}} a "
            f"join {{offering}} o on a._key = o._key and {same} and {where}"
        )

    def sure(self, steps: int = 0) -> DataFrame:
        """Per request, ``_n``: listings surely within the radius; ``_doubt``: those in the ring;
        and ``_n1`` ... those surely within the radius over the square root of 2, 4, 8, ..."""
        near = "".join(f", sum(if(_chord <= _in * {0.5**j!r}D, n, 0L)) as _n{j}" for j in range(1, steps + 1))
        text = self._pairs(f"request_id, n, _in, {CHORD} as _chord", f"{CHORD} <= _out")
        return self.asking.sparkSession.sql(
            f"select request_id, sum(if(_chord <= _in, n, 0L)) as _n, sum(if(_chord > _in, n, 0L)) as _doubt{near} "
            f"from ({text}) group by request_id", asking=self.asking, offering=self.offering,
        )

    def ring(self) -> DataFrame:
        """Per request, ``_n``: listings in the ring that are within the radius."""
        keep = ["request_id", "req_lat", "req_lng", "radius_m", "lat", "lng", "n"]
        near = self._pairs(", ".join(keep), f"{CHORD} > _in and {CHORD} <= _out")
        close = within_sql(f"({near})", keep, "req_lat", "req_lng", "lat", "lng", "radius_m", metric=self.metric)
        return self.asking.sparkSession.sql(
            f"select request_id, sum(n) as _n from {close} group by request_id", asking=self.asking, offering=self.offering
        )


def near_counts(cells: DataFrame, sites: DataFrame, levels: DataFrame, metric: str, steps: int = 0) -> DataFrame:
    """What ``Meeting.sure`` counts, and ``_found``: all within the radius; stored. Only
    requests with points in the ring meet theirs again, to be measured."""
    sure = stored(Meeting(cells, sites, levels, metric).sure(steps), "near-sure")
    doubted = sure.where("_doubt > 0").select("request_id")
    if doubted.isEmpty():
        return sure.withColumn("_found", F.col("_n"))
    ring = Meeting(cells.join(doubted, "request_id", "left_semi"), sites, levels, metric).ring()
    ring = ring.withColumnRenamed("_n", "_ring")
    return stored(sure.join(ring, "request_id", "left").selectExpr("*", "_n + coalesce(_ring, 0L) as _found"), "near-counts")


def radius_holding(counts: DataFrame, need: str, steps: int = STEPS) -> DataFrame:
    """``counts`` (radius_m, ``_n``, ``_n1`` ...) with ``_holds``: the least radius looked at
    that surely holds ``need`` matches, null where none does."""
    tests = " ".join(
        f"when coalesce(_n{j or ''}, 0) >= {need} then least(radius_m, radius_m * {0.5 ** (j / 2) * 1.0001!r}D)" for j in range(steps, -1, -1)
    )
    return counts.withColumn("_holds", F.expr(f"case {tests} end"))


def page_radius(requests: DataFrame, sites: DataFrame, metric: str) -> DataFrame:
    """request_id and ``_near``: a radius that surely holds the ``_need`` nearest matches of a
    request, at most ``radius_m``.

    ``requests`` also has ``_total``. The search starts where even density would put the
    need and quadruples the radius where that is too small. One round of jobs each.
    """
    asked = requests.withColumn(
        "_try", F.expr("least(radius_m, 1.3D * radius_m * sqrt(cast(_need as double) / _total))")
    )
    asked, done = stored(spread(asked, "request_id"), "page-radius"), None
    while True:
        now = asked.selectExpr("request_id", "_filter", "req_lat", "req_lng", "_try as radius_m")
        counts = Meeting(covered(now, metric), sites, levels_in(now), metric).sure(STEPS)
        tried = asked.join(counts, "request_id", "left").withColumnsRenamed({"radius_m": "_most", "_try": "radius_m"})
        tried = stored(spread(radius_holding(tried, "_need"), "request_id"), "page-radius")
        settled = "_holds is not null or radius_m >= _most"
        found = tried.where(settled).selectExpr("request_id", "coalesce(_holds, _most) as _near")
        done = found if done is None else done.unionByName(found)
        asked = tried.where(f"not ({settled})").selectExpr(
            "request_id", "_filter", "req_lat", "req_lng", "_need", "_total", "_most as radius_m",
            "least(_most, 4 * radius_m) as _try",
        )
        if asked.isEmpty():
            return done
