"""Per-listing roll-ups and child collections, each aggregated before any join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from staygrid.functions.ratings import rating_of
from staygrid.operators.filters import is_member, shown_reviews, zero_if_null
from staygrid.schema import DEFAULT_SHARING, RECENT_REVIEWS


def min_rent(rooms: DataFrame) -> DataFrame:
    """Cheapest room per listing, over all its rooms."""
    return rooms.groupBy("listing_id").agg(F.min("monthly_rent").alias("min_rent"))


def room_stats(rooms: DataFrame) -> DataFrame:
    """Cheapest room and number of rooms per listing."""
    return rooms.groupBy("listing_id").agg(
        F.min("monthly_rent").alias("min_rent"), F.count("id").cast("int").alias("room_count")
    )


def with_room_stats(listings: DataFrame, rooms: DataFrame) -> DataFrame:
    """Listings without rooms keep a NULL rent and a count of 0."""
    stats = room_stats(rooms).withColumnRenamed("listing_id", "id")
    return listings.join(stats, "id", "left").withColumn(
        "room_count", F.coalesce("room_count", F.lit(0))
    )


def rent_levels(rooms: DataFrame) -> DataFrame:
    """Distinct rents per listing with their range.

    Lets a rent test run on the listing row itself: no join of matches to rooms.
    The array holds distinct integer rents only, however many rooms there are.
    """
    distinct = rooms.where(F.col("monthly_rent").isNotNull()).select("listing_id", "monthly_rent").distinct()
    return distinct.groupBy("listing_id").agg(
        F.min("monthly_rent").alias("rent_lo"),
        F.max("monthly_rent").alias("rent_hi"),
        F.collect_list("monthly_rent").alias("rents"),
    )


def cover_photo(photos: DataFrame) -> DataFrame:
    """Thumbnail of the photo with the lowest display order (NULL order last)."""
    rank = F.struct(F.col("display_order").isNull(), F.col("display_order"), F.col("id"))
    return photos.groupBy("listing_id").agg(F.min_by("thumbnail_url", rank).alias("cover_photo"))


def photo_count(photos: DataFrame) -> DataFrame:
    return photos.groupBy("listing_id").agg(F.count(F.lit(1)).cast("int").alias("photo_count"))


def listing_ratings(reviews: DataFrame) -> DataFrame:
    """Mean rating and review count per reviewed listing; flagged reviews count."""
    sums = reviews.groupBy("listing_id").agg(
        F.sum("rating").alias("_sum"), F.count(F.lit(1)).alias("_n")
    )
    return sums.select(
        "listing_id",
        rating_of(F.col("_sum"), F.col("_n")).alias("avg_rating"),
        F.col("_n").cast("int").alias("review_count"),
    )


def with_owner(listings: DataFrame, users: DataFrame) -> DataFrame:
    """Inner N:1 join to the owner; a listing without owner row drops out."""
    owners = users.select(
        F.col("id").alias("owner_id"),
        F.col("full_name").alias("owner_name"),
        F.col("phone").alias("owner_account_phone"),
        zero_if_null("is_verified", "boolean").alias("owner_verified"),
    )
    return listings.join(owners, "owner_id")


def with_favorite_flag(df: DataFrame, favorites: DataFrame) -> DataFrame:
    """``is_favorite`` for the (user_id, listing_id) of each row."""
    marks = favorites.select("user_id", "listing_id", F.lit(True).alias("_mark"))
    flagged = df.join(marks, ["user_id", "listing_id"], "left")
    return flagged.withColumn("is_favorite", is_member("_mark")).drop("_mark")


def with_amenities(links: DataFrame, amenities: DataFrame) -> DataFrame:
    """Amenity names of each listing; the dimension has a dozen rows."""
    named = amenities.select(F.col("id").alias("amenity_id"), "name", "icon_key")
    return links.join(F.broadcast(named), "amenity_id")


def with_reviewer(reviews: DataFrame, users: DataFrame) -> DataFrame:
    """Reviewer name; a review whose user row is gone is not shown."""
    names = users.select(F.col("id").alias("user_id"), F.col("full_name").alias("user_name"))
    return reviews.join(names, "user_id")


def recent_reviews(reviews: DataFrame, users: DataFrame, n: int = RECENT_REVIEWS) -> DataFrame:
    """The latest moderated reviews of each listing with ``position`` 1..n.

    The literal bound lets Spark keep n rows per listing before the shuffle.
    """
    latest = Window.partitionBy("listing_id").orderBy(
        F.col("created_at").desc_nulls_first(), F.col("id")
    )
    # Only ids meet the reviews before they are cut; names join what is shown.
    known = users.select(F.col("id").alias("user_id"))
    shown = shown_reviews(reviews).join(known, "user_id", "left_semi")
    top = shown.withColumn("position", F.row_number().over(latest)).where(F.col("position") <= n)
    return with_reviewer(top, users)


def room_options(rooms: DataFrame) -> DataFrame:
    """Rooms as shown in a document: NULL sharing and notice get display values."""
    return rooms.withColumns(
        {
            "sharing_type": F.coalesce("sharing_type", F.lit(DEFAULT_SHARING)),
            "notice_period_days": zero_if_null("notice_period_days", "int"),
        }
    )


def photo_options(photos: DataFrame) -> DataFrame:
    """Photos as shown: a NULL display order sorts last but reads as 0."""
    return photos.withColumns(
        {
            "sort_order": F.col("display_order"),
            "display_order": zero_if_null("display_order", "int"),
        }
    )


def photos_ordered(photos: DataFrame) -> DataFrame:
    """All photos in listing order; the sort key spreads a large listing over tasks."""
    return (
        photo_options(photos)
        .orderBy("listing_id", F.col("sort_order").asc_nulls_last(), "id")
        .select("listing_id", "id", "url", "thumbnail_url", "display_order")
    )


def collect_sorted(df: DataFrame, key: str, order: list, fields: list[str], name: str) -> DataFrame:
    """One sorted array of structs per key.

    The array is the document field itself, so its size is the document's; sort
    keys travel along and are dropped at the end.
    """
    sort = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    item = F.struct(sort.alias("sort"), F.struct(*fields).alias("item"))
    return df.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(item)), lambda x: x["item"]).alias(name)
    )
