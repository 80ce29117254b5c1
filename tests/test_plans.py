"""The plans are the ones meant: pruned scans, bounded ranking, early aggregation."""

from staygrid.catalog.fixtures import Fixtures
from staygrid.operators.enrich import recent_reviews
from staygrid.plans import reports, search

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_n_is_pruned_before_the_shuffle(spark):
    f = Fixtures(spark, SF_DIR)
    for df in (
        recent_reviews(f.reviews, f.users),
        reports.inquiry_summary(f.inquiries, f.listings),
    ):
        assert "WindowGroupLimit" in plan(df) and "Partial" in plan(df)


def test_batch_search_measures_each_pair_once(spark):
    """Rank and total stand above one shuffle of the matches: one distance chain runs, and
    one expression for pairs beyond a country."""
    f = Fixtures(spark, SF_DIR)
    df = search.geo_search(f.requests, f.listings, f.rooms, f.photos, f.favorites)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # Three arc tangents of two arguments in one chain with two passes, and four for each of
    # the two geodesics (the halving and the result) of the expression.
    assert final.upper().count("ATAN2(") == 3 + 8


def test_point_search_pushes_the_box_down(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    f = Fixtures(spark, SF_DIR)
    f.listings.write.parquet(str(tmp_path / "listings"))
    stored = spark.read.parquet(str(tmp_path / "listings"))
    text = plan(search.point_matches(stored, f.rooms, 12.97, 77.64, 3.0, gender="female").select("id"))
    pushed = text[text.index("PushedFilters"):]
    for want in ("EqualTo(status,ACTIVE)", "GreaterThanOrEqual(lat,", "LessThanOrEqual(lng,", "EqualTo(gender_preference,FEMALE)"):
        assert want in pushed
    schema = pushed[pushed.index("ReadSchema"):].split("\n")[0]
    assert "description" not in schema and "title" not in schema


def test_summary_is_aggregated_before_the_join(spark):
    f = Fixtures(spark, SF_DIR)
    logical = reports.inquiries_on_listings(f.inquiries, f.listings)._jdf.queryExecution().optimizedPlan().toString()
    assert logical.index("Join") < logical.index("Aggregate [listing_id")


def test_portfolio_sorts_without_a_window(spark):
    f = Fixtures(spark, SF_DIR)
    text = plan(reports.owner_portfolio(f.listings, f.rooms))
    assert "rangepartitioning" in text and "Window" not in text
