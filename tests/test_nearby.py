"""Counts per point and filter, chords as bounds, and radii that hold a page."""

import random

import pytest
from pyspark.sql import functions as F
from test_properties import points
from test_summaries import CITY, requests_and_listings

from staygrid.functions.geo import haversine_m, with_geodesic_m
from staygrid.operators import nearby, spatial
from staygrid.operators.paging import page_per_request
from staygrid.plans import search


@pytest.mark.parametrize("metric", ["spheroid", "sphere"])
def test_chords_bound_distances(spark, metric):
    rng = random.Random(5)
    asked = points(spark, rng, 60, "request_id", "req_lat", "req_lng", ((-85.0, 85.0), (-175.0, 175.0)))
    listed = points(spark, rng, 60, "listing_id", "lat", "lng", ((-85.0, 85.0), (-175.0, 175.0)))
    near = asked.selectExpr("request_id", "req_lat", "req_lng", "1000 + request_id as listing_id", "req_lat + 0.01 * sin(request_id) as lat", "req_lng + 0.03 * cos(request_id) as lng")
    pairs = asked.join(listed, F.lit(True)).select(near.columns).unionByName(near)
    pairs = with_geodesic_m(pairs, "req_lat", "req_lng", "lat", "lng", "d") if metric == "spheroid" else pairs.withColumn(
        "d", haversine_m("req_lat", "req_lng", "lat", "lng")
    )
    pairs = pairs.where("d < 19000000").selectExpr("*", "explode(array(0.5D, 0.9999999D, 1D, 1.0000001D, 1.1D)) as share")
    pairs = pairs.withColumn("radius_m", F.col("share") * F.col("d"))
    text = f"select *, {nearby.place_sql('lat', 'lng', metric, ('_px', '_py', '_pz'))} from {{p}}"
    met = spark.sql(text, p=nearby.with_chords(pairs, metric)).selectExpr("*", f"{nearby.CHORD} as c")
    assert met.where("c <= _in and d > radius_m or c > _out and d <= radius_m").count() == 0
    # In town, all but a ring of millimetres is settled without a distance.
    assert met.where("d < 10000 and c > _in and c <= _out and abs(d - radius_m) > 0.01").count() == 0


def test_points_are_counted_once_and_only_the_ring_is_measured(spark):
    """Six listings at each of 500 points: a request meets points, and measures hardly any."""
    requests, listings, rooms = requests_and_listings(spark, 4, 500, CITY, [2.0, 6.0])
    listings = listings.selectExpr("explode(sequence(0, 5)) as k", "*").selectExpr("id + k * 500 as id", "* except(id, k)")
    rooms = rooms.selectExpr("explode(sequence(0, 5)) as k", "*").selectExpr("id", "listing_id + k * 500 as listing_id", "monthly_rent")
    parts = search.Summaries(search.asked_of(requests), listings, rooms, "spheroid", 10**6)
    assert parts.sites.groupBy("_filter").count().agg(F.max("count")).first()[0] <= 500
    counts = parts.plain_counts(4)
    want = dict(map(tuple, search.search_totals(requests, search.search_matches(requests, listings, rooms)).collect()))
    got = {r.request_id: r._found for r in counts.collect()}
    assert {k: v for k, v in want.items() if v} == {k: v for k, v in got.items() if v} and sum(got.values()) > 200
    assert counts.agg(F.sum("_doubt")).first()[0] <= 6


def test_more_filters_than_counted_one_by_one(spark):
    """Beyond the limit of filters pairs are measured, with the same totals and pages."""
    requests, listings, rooms = requests_and_listings(spark, 6, 300, CITY, [0.4, 6.0, 60.0])
    found = []
    for filters, dense in ((1, 4), (nearby.FILTERS, 4), (nearby.FILTERS, 10**6)):
        parts = search.Summaries(search.asked_of(requests), listings, rooms, "spheroid", dense, filters)
        assert parts.by_filter == (filters > 1)
        rows, totals = parts.pages()
        columns = ["request_id", "position", "listing_id", "distance_m", "total"]
        found.append((sorted(map(tuple, rows.select(columns).collect())), sorted(map(tuple, totals.where("total > 0").collect()))))
    assert found[0][0] and all(f == found[0] for f in found)


def test_a_pair_of_points_is_measured_once(spark):
    """Rows at one point are gathered; each pair of rows is still there, whatever their number."""
    rng = random.Random(7)
    requests = points(spark, rng, 12, "request_id", "req_lat", "req_lng", CITY).selectExpr(
        "explode(sequence(0, 3)) as k", "*").selectExpr("request_id + 12 * k as request_id", "req_lat", "req_lng", "if(request_id = 3, 5000000D, 20000D) as radius_m")
    listings = points(spark, rng, 15, "listing_id", "lat", "lng", CITY).selectExpr(
        "explode(sequence(0, 9)) as k", "*").selectExpr("listing_id + 15 * k as listing_id", "lat", "lng")
    few = spatial.gathered(listings, ["lat", "lng"], "listing_id", "offers", 4)
    assert few.agg(F.sum(F.size("offers"))).first()[0] == 150 and few.count() > 15
    assert spatial.gathered(listings, ["lat", "lng"], "listing_id", "offers").count() == listings.select("lat", "lng").distinct().count() <= 15
    got = spatial.radius_join(requests, listings)
    assert got.columns == ["request_id", "req_lat", "req_lng", "radius_m", "listing_id", "lat", "lng", "distance_m"]
    want = spatial.radius_join(requests, listings, "true or lat is null")
    rows = sorted((r.request_id, r.listing_id, round(r.distance_m, 5)) for r in got.collect())
    assert rows == sorted((r.request_id, r.listing_id, round(r.distance_m, 5)) for r in want.collect())
    assert len(rows) > 400


def test_the_radius_of_a_page_is_small_and_holds_it(spark):
    """A page of 20 among thousands of matches: few of them are near enough to be measured."""
    rng = random.Random(8)
    requests, listings, rooms = requests_and_listings(spark, 8, 20_000, CITY, [15.0])
    requests = requests.selectExpr("* except(page, size, min_rent, max_rent, food)", "1 as page", "20 as size", "null as food",
                                   "cast(null as int) as min_rent", "cast(null as int) as max_rent")
    parts = search.Summaries(search.asked_of(requests), listings, rooms, "spheroid", 10**6)
    counts = parts.plain.join(parts.plain_counts(nearby.STEPS), "request_id").withColumn("_need", F.lit(40))
    held = nearby.radius_holding(counts, "_need").withColumn("_near", F.expr("coalesce(_holds, radius_m)"))
    found = search.search_matches(requests, listings, rooms).select("request_id", "distance_m").join(held.select("request_id", "_near", "_found"), "request_id")
    sizes = found.where("distance_m <= _near").groupBy("request_id", "_found").count().collect()
    assert len(sizes) == 40 and all(40 <= r["count"] <= 160 and r._found > 400 for r in sizes)
    asked = counts.withColumn("_total", F.col("_found")).select("request_id", "_filter", *search.CIRCLE, "_need", "_total")
    again = nearby.page_radius(asked, parts.sites, "spheroid")
    sizes = found.drop("_near").join(again, "request_id").where("distance_m <= _near").groupBy("request_id").count().collect()
    assert len(sizes) == 40 and all(40 <= r["count"] <= 160 for r in sizes)


@pytest.mark.parametrize("metric", ["spheroid", "sphere"])
def test_the_page_is_that_of_all_matches(spark, metric):
    """The page among the pairs within its radius is that among all matches, by either distance."""
    requests, listings, rooms = requests_and_listings(spark, 9, 4_000, CITY, [20.0])
    requests = requests.selectExpr("* except(page, size)", "0 as page", "5 as size")
    want = page_per_request(search.search_matches(requests, listings, rooms, metric), requests.select("request_id", "user_id", "page", "size"))
    parts = search.Summaries(search.asked_of(requests), listings, rooms, metric, 10**6)
    rows, _ = parts.pages()
    assert sorted(map(tuple, rows.select(search.PAGE_ROW).collect())) == sorted(map(tuple, want.select(search.PAGE_ROW).collect()))


def test_dense_cells_have_many_points(spark):
    """Listings at one point are one row of the counts, so they do not make a cell dense."""
    requests, listings, rooms = requests_and_listings(spark, 10, 300, CITY, [3.0])
    together = listings.withColumns({"lat": F.lit(12.95), "lng": F.lit(77.65)})
    assert search.Summaries(search.asked_of(requests), together, rooms, "spheroid", 64).heavy is None


def test_near_pages_need_no_roll_up_by_rent(spark):
    requests, listings, rooms = requests_and_listings(spark, 11, 300, CITY, [10.0])
    requests = requests.selectExpr("* except(page, size)", "1 as page", "5 as size")
    parts = search.Summaries(search.asked_of(requests), listings, rooms, "spheroid", 8)
    rows, _ = parts.pages()
    assert parts.heavy is not None and parts._rolled is None and rows.count() > 0
