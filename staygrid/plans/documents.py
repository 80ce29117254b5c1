"""Nested listing documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staygrid.operators.enrich import (
    collect_sorted,
    photo_options,
    recent_reviews,
    room_options,
    with_amenities,
    with_favorite_flag,
    with_owner,
)
from staygrid.operators.filters import contact_phone, display_defaults, live, rating_display

TEXT = ["description", "address_line", "locality", "city", "pincode"]
CATEGORY = ["gender_preference", "pg_type", "food_type"]


def listing_core(listings: DataFrame, users: DataFrame) -> DataFrame:
    """Listing and owner in one row; PAUSED listings are visible, DELETED are not."""
    owned = with_owner(live(listings, "visible"), users)
    owned = rating_display(display_defaults(owned))
    return owned.select(
        "id", "title", *TEXT, "lat", "lng", *CATEGORY, "avg_rating", "review_count", "status",
        "owner_id", "owner_name",
        contact_phone("contact_phone", "owner_account_phone").alias("owner_phone"),
        "owner_verified",
    )


def listing_documents(
    listings: DataFrame,
    users: DataFrame,
    rooms: DataFrame,
    photos: DataFrame,
    links: DataFrame,
    amenities: DataFrame,
    reviews: DataFrame,
) -> DataFrame:
    """One document per visible listing: owner plus four arrays.

    Each child table is reduced to one row per listing by itself; joining the
    tables first would multiply their rows. Absent children are empty arrays.
    """
    children = {
        "room_options": collect_sorted(
            room_options(rooms), "listing_id", [F.col("monthly_rent"), F.col("id")],
            ["id", "sharing_type", "monthly_rent", "security_deposit", "total_beds",
             "available_beds", "notice_period_days"],
            "room_options",
        ),
        "photos": collect_sorted(
            photo_options(photos), "listing_id",
            [F.col("sort_order").isNull(), F.col("sort_order"), F.col("id")],
            ["id", "url", "thumbnail_url", "display_order"], "photos",
        ),
        "amenities": collect_sorted(
            with_amenities(links, amenities).withColumnRenamed("amenity_id", "id"),
            "listing_id", [F.col("name")], ["id", "name", "icon_key"], "amenities",
        ),
        "recent_reviews": collect_sorted(
            recent_reviews(reviews, users), "listing_id", [F.col("position")],
            ["id", "user_id", "user_name", "rating", "comment", "stayed_from",
             "stayed_until", "created_at"],
            "recent_reviews",
        ),
    }
    core = listing_core(listings, users)
    document = core
    for name, child in children.items():
        empty = F.array().cast(child.schema[name].dataType)
        document = document.join(
            child.withColumnRenamed("listing_id", "id"), "id", "left"
        ).withColumn(name, F.coalesce(name, empty))
    return document.select(
        "id", "title", *TEXT, "lat", "lng", *CATEGORY, "avg_rating", "review_count", "status",
        F.struct(
            F.col("owner_id").alias("id"), F.col("owner_name").alias("full_name"),
            F.col("owner_phone").alias("phone"), F.col("owner_verified").alias("is_verified"),
        ).alias("owner"),
        *children,
    )


def documents_for(
    asked: DataFrame, listings: DataFrame, users: DataFrame, rooms: DataFrame, photos: DataFrame,
    links: DataFrame, amenities: DataFrame, reviews: DataFrame, favorites: DataFrame,
) -> DataFrame:
    """Documents for (user_id, listing_id) rows, with the user's favourite flag.

    The asked listings meet every table before anything is built from it, so documents
    are made for these listings only. Asked listings that cannot be shown drop out.
    """
    wanted = asked.select("listing_id").distinct()

    def of(table: DataFrame, key: str = "listing_id") -> DataFrame:
        return table.join(wanted.withColumnRenamed("listing_id", key), key, "left_semi")

    documents = listing_documents(
        of(listings, "id"), users, of(rooms), of(photos), of(links), amenities, of(reviews)
    ).withColumnRenamed("id", "listing_id")
    return with_favorite_flag(asked, favorites).join(documents, "listing_id")
