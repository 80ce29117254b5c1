"""Set-based generators: review backfill and room / amenity inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staygrid.operators.folds import insert_absent
from staygrid.operators.skew import split_join, with_group_number, with_row_number
from staygrid.operators.enrich import listing_ratings


def match_titles(targets: DataFrame, listings: DataFrame) -> DataFrame:
    """Targets (title, ratings) joined to listings by title, with a running offset."""
    named = listings.select(F.col("id").alias("listing_id"), "title")
    matched = targets.join(named, "title")
    numbered = with_row_number(matched, ["title", "listing_id"], "_number")
    return numbered.withColumn("offset", F.col("_number") - 1).drop("_number")


def explode_ratings(matched: DataFrame) -> DataFrame:
    """One row per rating with its 1-based position in the list."""
    spread = matched.select("listing_id", "offset", F.posexplode("ratings").alias("_p", "rating"))
    return spread.withColumn("pos", F.col("_p") + 1).drop("_p")


def attach_comments(ranked: DataFrame, comments: DataFrame) -> DataFrame:
    """The k-th review of a rating takes its k-th comment; ranks without one drop out."""
    return ranked.join(comments.withColumnRenamed("ord", "rating_rank"), ["rating", "rating_rank"])


def backfill_reviews(
    targets: DataFrame,
    listings: DataFrame,
    reviewers: DataFrame,
    comments: DataFrame,
    existing: DataFrame,
    as_of: Column,
) -> DataFrame:
    """Review rows for the target rating lists: (listing_id, user_id, rating, comment,
    created_at). Keys that already have a review are left alone.

    Reviewers rotate: position p of the listing with offset o takes reviewer
    (o + p - 1) mod n + 1. created_at steps back a day (and some hours) per row.
    Ranks over all rows are numbered by a distributed sort, since there are only a
    handful of rating values and one global sequence.
    """
    rows = explode_ratings(match_titles(targets, listings))
    ranked = with_row_number(rows, ["listing_id", "pos"], "sequence")
    ranked = with_group_number(ranked, ["rating"], ["listing_id", "pos"], "rating_rank")

    numbered = with_row_number(
        reviewers.select(F.col("id").alias("user_id"), "firebase_uid"), ["firebase_uid"], "reviewer"
    )
    count = numbered.agg(F.count(F.lit(1)).alias("n")).scalar()
    ranked = ranked.withColumn("reviewer", (F.col("offset") + F.col("pos") - 1) % count + 1)

    seconds = F.col("sequence") * 86400 + (F.col("sequence") * 7 % 24) * 3600
    filled = split_join(
        attach_comments(ranked, comments), numbered.select("reviewer", "user_id"),
        ["reviewer"], "inner", "sequence",
    ).select(
        "listing_id", "user_id", "rating", "comment",
        F.timestamp_seconds(F.unix_timestamp(as_of) - seconds).alias("created_at"), "sequence",
    )
    # A reviewer who comes round to a listing twice keeps the earlier row.
    return insert_absent(filled, existing, ["listing_id", "user_id"], ["sequence"]).drop("sequence")


def backfilled_ratings(existing: DataFrame, added: DataFrame, listings: DataFrame) -> DataFrame:
    """Ratings of the reviewed listings after a backfill."""
    every = existing.select("listing_id", "rating").unionByName(added.select("listing_id", "rating"))
    rated = listing_ratings(every)
    return rated.join(listings.select(F.col("id").alias("listing_id")), "listing_id", "left_semi")


# Amenities every listing gets, those most get, and the share.
ALWAYS_AMENITIES = ("WiFi", "Power Backup")
OFTEN_AMENITIES = ("AC", "Laundry", "CCTV", "Hot Water")
OFTEN_ABOVE = 0.4


def uniform(seed: int, tag: str, *columns: str) -> Column:
    """A number in [0, 1) that depends only on the seed and the row's key.

    Unlike a random generator it survives task retries and repartitioning.
    """
    text = F.concat_ws(":", F.lit(seed), F.lit(tag), *[F.col(c).cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def _between(low: int, span: int, draw: Column) -> Column:
    return (F.lit(low) + F.floor(draw * span + 0.5)).cast("int")


# Rooms of a generated listing (lowest rent and deposit, and the span above).
DOUBLE_RENT, DOUBLE_DEPOSIT, DOUBLE_BEDS, DOUBLE_FREE = (8000, 7000), (15000, 10000), 4, (1, 3)
SINGLE_RENT, SINGLE_DEPOSIT, SINGLE_BEDS = (14000, 8000), (25000, 15000), 1
NOTICE_DAYS = 30


def generate_rooms(listings: DataFrame, seed: int) -> DataFrame:
    """A DOUBLE room for every listing and a SINGLE one for PG and COLIVING."""
    ids = listings.select(F.col("id").alias("listing_id"), "pg_type")
    double = ids.select(
        "listing_id", F.lit("DOUBLE").alias("sharing_type"),
        _between(*DOUBLE_RENT, uniform(seed, "double rent", "listing_id")).alias("monthly_rent"),
        _between(*DOUBLE_DEPOSIT, uniform(seed, "double deposit", "listing_id")).alias("security_deposit"),
        F.lit(DOUBLE_BEDS).alias("total_beds"),
        _between(*DOUBLE_FREE, uniform(seed, "double free", "listing_id")).alias("available_beds"),
        F.lit(NOTICE_DAYS).alias("notice_period_days"),
    )
    single = ids.where(F.col("pg_type").isin("COLIVING", "PG")).select(
        "listing_id", F.lit("SINGLE").alias("sharing_type"),
        _between(*SINGLE_RENT, uniform(seed, "single rent", "listing_id")).alias("monthly_rent"),
        _between(*SINGLE_DEPOSIT, uniform(seed, "single deposit", "listing_id")).alias("security_deposit"),
        F.lit(SINGLE_BEDS).alias("total_beds"), F.lit(SINGLE_BEDS).alias("available_beds"),
        F.lit(NOTICE_DAYS).alias("notice_period_days"),
    )
    return double.unionByName(single)


def pair_amenities(listings: DataFrame, amenities: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Every listing with every named amenity.

    The named ids (a dozen at most) travel as one array value and are exploded per
    listing: a map-side pass without a join.
    """
    chosen = amenities.where(F.col("name").isin(*names)).agg(F.array_sort(F.collect_list("id"))).scalar()
    return listings.select(F.col("id").alias("listing_id"), chosen.alias("_ids")).select(
        "listing_id", F.explode("_ids").alias("amenity_id")
    )


def generate_links(listings: DataFrame, amenities: DataFrame, seed: int) -> DataFrame:
    """Two amenities for every listing and about 60 % of four more."""
    always = pair_amenities(listings, amenities, ALWAYS_AMENITIES)
    often = pair_amenities(listings, amenities, OFTEN_AMENITIES).where(
        uniform(seed, "amenity", "listing_id", "amenity_id") > OFTEN_ABOVE
    )
    return always.unionByName(insert_absent(often, always, ["listing_id", "amenity_id"]))
