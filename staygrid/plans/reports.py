"""Per-owner, per-user and lookup reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staygrid.operators.enrich import min_rent, photo_count, with_room_stats
from staygrid.operators.filters import live, rating_display
from staygrid.operators.paging import newest_first, top_per_group
from staygrid.plans.search import CARD, listing_cards
from staygrid.schema import INQUIRY_SUMMARY_CAP


def owner_portfolio(listings: DataFrame, rooms: DataFrame) -> DataFrame:
    """Every owner's visible listings, newest first, with cheapest rent and room count.

    Category values are shown as stored. Sorting by owner and time splits a large
    owner over several tasks, which a window per owner would not.
    """
    stats = rating_display(with_room_stats(live(listings, "visible"), rooms))
    return stats.orderBy("owner_id", *newest_first("created_at", "id")).select(
        "owner_id", "id", "title", "locality", "gender_preference", "pg_type", "status",
        "avg_rating", "review_count", "min_rent", "room_count", "created_at",
    )


def inquiries_on_listings(inquiries: DataFrame, listings: DataFrame) -> DataFrame:
    """Distinct inquirers and latest attempt per listing that has inquiries.

    Aggregated before the join: a listing with very many inquiries is one row there.
    """
    per_listing = inquiries.groupBy("listing_id").agg(
        F.count_distinct("tenant_id").cast("int").alias("unique_inquirers"),
        F.max("last_attempt_at").alias("last_inquiry_at"),
    )
    titles = live(listings, "any").select(
        F.col("id").alias("listing_id"), "owner_id", F.col("title").alias("listing_title")
    )
    return per_listing.join(titles, "listing_id")


def inquiry_summary(
    inquiries: DataFrame, listings: DataFrame, n: int | None = INQUIRY_SUMMARY_CAP
) -> DataFrame:
    """Each owner's ``n`` most recently asked listings, without identities.

    With ``n`` None all of them, sorted by owner and time and without a position.
    """
    summary = inquiries_on_listings(inquiries, listings)
    if n is None:
        return summary.orderBy("owner_id", *newest_first("last_inquiry_at", "listing_id")).select(
            "owner_id", "listing_id", "listing_title", "unique_inquirers", "last_inquiry_at"
        )
    return top_per_group(
        summary, ["owner_id"], newest_first("last_inquiry_at", "listing_id"),
        n, "position",
    ).select(
        "owner_id", "position", "listing_id", "listing_title", "unique_inquirers", "last_inquiry_at"
    )


def favorites_list(
    favorites: DataFrame, listings: DataFrame, rooms: DataFrame, photos: DataFrame
) -> DataFrame:
    """Every user's favourites on ACTIVE listings, latest first."""
    cards = listing_cards(live(listings, "active"), min_rent(rooms), photos)
    mine = favorites.select("user_id", "listing_id", "created_at").join(cards, "listing_id")
    return mine.orderBy("user_id", *newest_first("created_at", "listing_id")).select(
        "user_id", "listing_id", *CARD, "min_rent", "cover_photo",
        F.lit(None).cast("double").alias("distance_m"), F.lit(True).alias("is_favorite"),
        "created_at",
    )


def user_profiles(users: DataFrame, uids: DataFrame) -> DataFrame:
    """Profiles of the asked account ids."""
    shown = users.select(
        "id", "firebase_uid", "email", "phone", "full_name", "role",
        F.coalesce("is_verified", F.lit(False)).alias("is_verified"), "gender", "dob",
    )
    return shown.join(uids.select("firebase_uid"), "firebase_uid", "left_semi")


def target_lookup(
    targets: DataFrame, listings: DataFrame, photos: DataFrame
) -> DataFrame:
    """State of (listing_id, photo_id) targets as the write gates ask for it: status,
    owner, active test, photo count, and the photo's url and order if it belongs to
    the listing."""
    state = listings.select(
        F.col("id").alias("listing_id"), "owner_id", "status",
        F.coalesce(F.col("status") == "ACTIVE", F.lit(False)).alias("is_active"),
    )
    counted = state.join(photo_count(photos), "listing_id", "left").withColumn(
        "photo_count", F.coalesce("photo_count", F.lit(0))
    )
    owned = photos.select(
        "listing_id", F.col("id").alias("photo_id"), F.col("url").alias("photo_url"),
        F.coalesce("display_order", F.lit(0)).alias("photo_order"),
    )
    return targets.join(counted, "listing_id").join(owned, ["listing_id", "photo_id"], "left")


# Registers of a sketch, as a power of two, and the error its estimates are held to: three
# standard deviations of 1.04 / sqrt(registers).
SKETCH_BITS = 12
SKETCH_ERROR = 3 * 1.04 / 2 ** (SKETCH_BITS / 2)


def inquirer_sketches(inquiries: DataFrame) -> DataFrame:
    """(listing_id, day, sketch, latest): distinct inquirers of each listing and day as a
    mergeable sketch of bounded size, with the day's latest attempt.

    Days can be added as they come and merged over any range, which counts of distinct
    tenants cannot.
    """
    return inquiries.groupBy("listing_id", F.to_date("last_attempt_at").alias("day")).agg(
        F.hll_sketch_agg("tenant_id", SKETCH_BITS).alias("sketch"), F.max("last_attempt_at").alias("latest")
    )


def inquirer_estimates(sketches: DataFrame) -> DataFrame:
    """(listing_id, inquirers, latest): the approximate form of the inquiry summary's counts,
    within ``SKETCH_ERROR`` (relative) with a probability of about 99.7 %."""
    return sketches.groupBy("listing_id").agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("inquirers"), F.max("latest").alias("latest")
    )
