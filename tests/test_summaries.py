"""Cell summaries, selection of pages and rectangles against plain pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F
from test_properties import points

from staygrid.operators import spatial, summaries
from staygrid.operators.paging import page_of_candidates, page_per_request
from staygrid.operators.spatial import cell_join, covering, placed, radius_join, rectangles_sql, with_reach
from staygrid.plans import search

CITY = ((12.8, 13.2), (77.5, 77.9))
LAND = ((8.0, 37.0), (68.0, 98.0))


def requests_and_listings(spark, seed, n, box, radii):
    rng = random.Random(seed)
    asked = [
        (r, r % 3, rng.uniform(*box[0]), rng.uniform(*box[1]), rng.choice(radii), rng.choice([None, 5, 9, 30]),
         rng.choice([None, 7, 12, 2]), rng.choice([0, 0, 1, 7, 400]), rng.choice([1, 5, 50]),
         rng.choice([None, "male"]), rng.choice([None, "veg", "non_veg"]), None)
        for r in range(40)
    ]
    schema = (
        "request_id long, user_id long, lat double, lng double, radius_km double, min_rent int, max_rent int, "
        "page int, size int, gender string, food string, pg_type string"
    )
    places = points(spark, rng, n, "id", "lat", "lng", box)
    pick = lambda *values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.xxhash64("id", F.lit(str(values))), F.lit(len(values))) + 1).cast("int"))
    listings = places.select(
        "*", pick("ACTIVE", "ACTIVE", "PAUSED").alias("status"), pick("MALE", "FEMALE", None).alias("gender_preference"),
        pick("VEG", "NON_VEG").alias("food_type"), pick("PG", None).alias("pg_type"),
    )
    rents = [(k, k % n, rng.choice([4, 5, 6, 8, 10, 13, 20, 40])) for k in range(2 * n) if k % 5]
    return spark.createDataFrame(asked, schema), listings, spark.createDataFrame(rents, "id long, listing_id long, monthly_rent int")


@pytest.mark.parametrize("dense,box,radii", [(1, CITY, [0.0, 0.4, 3.0, 60.0]), (12, LAND, [20.0, 900.0, 5000.0])])
def test_totals_and_candidates_are_brute_force(spark, dense, box, radii):
    requests, listings, rooms = requests_and_listings(spark, 3, 600, box, radii)
    matches = search.search_matches(requests, listings, rooms)
    got = search.match_totals(requests, listings, rooms, dense=dense)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, search.search_totals(requests, matches).collect()))
    parts = search.Summaries(search.asked_of(requests), listings, rooms, "spheroid", dense)
    want = page_per_request(matches, requests.select("request_id", "page", "size"))
    rows = page_per_request(parts.plain_pairs(), requests.select("request_id", "page", "size"))
    columns = ["request_id", "position", "listing_id", "distance_m"]
    found = list(map(tuple, rows.select(columns).collect()))
    if parts.heavy is not None:
        candidates = parts.heavy_candidates()
        pages = [sorted(map(tuple, page_of_candidates(candidates, n).select(columns).collect())) for n in (10**6, 3)]
        assert pages[0] == pages[1]
        found += pages[0]
    assert sorted(found) == sorted(map(tuple, want.select(columns).collect()))


def test_only_the_border_is_measured(spark):
    """A circle over 40,000 listings: totals measure few of them, a page still fewer."""
    rng = random.Random(1)
    rows = [(k, 12.8 + rng.random() * 0.4, 77.5 + rng.random() * 0.4) for k in range(40_000)]
    listings = spark.createDataFrame(rows, "id long, lat double, lng double").select(
        "*", F.lit("ACTIVE").alias("status"), *[F.lit(None).cast("string").alias(c) for c in ("gender_preference", "food_type", "pg_type")]
    )
    asked = spark.createDataFrame(
        [(1, 1, 13.0, 77.7, 15.0, None, None, 300, 20, None, None, None)],
        "request_id long, user_id long, lat double, lng double, radius_km double, min_rent int, max_rent int, "
        "page int, size int, gender string, food string, pg_type string",
    )
    rooms = spark.createDataFrame([], "id long, listing_id long, monthly_rent int")
    total = search.match_totals(asked, listings, rooms, dense=16).first().total
    assert total > 14_000
    parts = search.Summaries(search.asked_of(asked), listings, rooms, "spheroid", 16)
    cells = summaries.classified(parts.heavy, parts.dense)
    border = cells.where("not (_inside and _rolled)")
    here = placed(parts.offers, border.select("_level").distinct()).join(border.select(*summaries.CELL), summaries.CELL)
    assert here.count() < total / 4
    page = parts.heavy_candidates()
    assert 20 <= page.count() < total / 5
    got = [r.position for r in page_of_candidates(page).collect()]
    assert sorted(got) == list(range(6001, 6021))


def test_no_task_ranks_all_candidates_of_a_request(spark):
    rows = [(1, k, float(k % 50), 100, 20, 7) for k in range(4_000)]
    rows += [(r, k, float(k), 0, 5, 0) for r in (2, 3) for k in range(30)]
    made = spark.createDataFrame(rows, "request_id long, listing_id long, distance_m double, page int, size int, passed long")
    small, large = (page_of_candidates(made, n) for n in (100, 10**6))
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))
    # The windows left see the requests with few candidates, and one row per sorted part.
    plan = small._jdf.queryExecution().optimizedPlan().toString()
    by = re.findall(r"\bWindow \[\S+ windowspecdefinition\((\w+)#", plan)
    assert by.count("request_id") == 1 and set(by) == {"request_id", "_part"} and "LeftAnti" in plan


@pytest.mark.parametrize("shape", [(300, 300), (1500, 10), (10, 1500)])
def test_rectangles_bound_the_pairs_of_a_task(spark, shape):
    """All in one cell: every pair once, no slot with many more pairs than asked for."""
    limit, (r, n) = 2_000, shape
    # Rows, not literals: the optimizer would expand constants through the whole chain.
    requests = spark.createDataFrame([(k, 12.901, 77.601, 100.0) for k in range(r)], "request_id long, req_lat double, req_lng double, radius_m double")
    listings = spark.createDataFrame([(k, 12.901, 77.601) for k in range(n)], "listing_id long, lat double, lng double")
    cells = with_reach(covering(requests)).where("_cy = 1290 and _cx = 7760")
    sides = spark.sql(
        f"with {rectangles_sql(limit)} select * from (select {', '.join(spatial.SLOT_KEYS)}, count(*) as a from asking group by all) "
        f"join (select {', '.join(spatial.SLOT_KEYS)}, count(*) as b from offering group by all) using ({', '.join(spatial.SLOT_KEYS)})",
        cells=cells, placed=placed(listings, cells),
    ).selectExpr("a * b as pairs").collect()
    assert sum(x.pairs for x in sides) == r * n
    assert max(x.pairs for x in sides) < 2 * limit
    assert cell_join(cells, listings, pairs_per_cell_task=limit).count() == r * n


def test_reach_bounds_every_point_of_a_cell(spark):
    rng = random.Random(2)
    for radius, box in ((2_000.0, CITY), (3_000_000.0, ((-89.0, 89.0), (-179.0, 179.0)))):
        requests = points(spark, rng, 12, "request_id", "req_lat", "req_lng", box).withColumn("radius_m", F.lit(radius))
        listings = points(spark, rng, 300, "listing_id", "lat", "lng", box)
        near = radius_join(requests, listings)
        cells = with_reach(covering(requests)).select("request_id", *summaries.CELL, "_from_m", "_to_m")
        met = placed(near, cells).join(cells, ["request_id", *summaries.CELL])
        assert met.count() == near.count()  # no cell of a match was left out
        assert met.where("distance_m < _from_m or distance_m > _to_m").count() == 0
