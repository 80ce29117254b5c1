"""Row filters and display rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staygrid.functions.text import double_or_null, int_or_null, sanitize
from staygrid.schema import (
    DEFAULT_PAGE_SIZE,
    DEFAULT_RADIUS_KM,
    DEFAULT_SHARING,
    DISPLAY_DEFAULTS,
    INDIA_LAT,
    INDIA_LNG,
    MAX_PAGE_SIZE,
)

CATEGORIES = {"gender": "gender_preference", "food": "food_type", "pg_type": "pg_type"}


def live(listings: DataFrame, policy: str) -> DataFrame:
    """Status gate: 'active' (search, favourites), 'visible' (detail, owner list:
    PAUSED stays), 'any' (inquiry summary). A NULL status passes only 'any'."""
    if policy == "active":
        return listings.where(F.col("status") == "ACTIVE")
    if policy == "visible":
        return listings.where(F.col("status") != "DELETED")
    if policy == "any":
        return listings
    raise ValueError(f"unknown policy {policy!r}")


def category_filter(
    listings: DataFrame, gender: str | None = None, food: str | None = None,
    pg_type: str | None = None,
) -> DataFrame:
    """Exact category equality for the given filters, after sanitising the asked value.

    MALE does not include COED, and a NULL category never matches although it is
    displayed as a default. Only the given filters become predicates.
    """
    for value, column in ((gender, "gender_preference"), (food, "food_type"), (pg_type, "pg_type")):
        if value is not None:
            listings = listings.where(F.col(column) == sanitize(F.lit(value)))
    return listings


def rent_filter(
    listings: DataFrame, rooms: DataFrame, low: int | None = None, high: int | None = None
) -> DataFrame:
    """Listings with one room whose rent satisfies both bounds.

    Distinct inner join and semi join give the same rows; without bounds no join
    is needed at all. Matching rooms are reduced to their listing ids first, so a
    listing with very many rooms does not weigh on one task.
    """
    if low is None and high is None:
        return listings
    if low is not None:
        rooms = rooms.where(F.col("monthly_rent") >= low)
    if high is not None:
        rooms = rooms.where(F.col("monthly_rent") <= high)
    matching = rooms.select(F.col("listing_id").alias("id")).distinct()
    return listings.join(matching, "id", "left_semi")


def display_defaults(df: DataFrame, room_sharing: str | None = None) -> DataFrame:
    """Values shown for NULL categories."""
    shown = {
        name: F.coalesce(F.col(name), F.lit(value))
        for name, value in DISPLAY_DEFAULTS.items()
        if name in df.columns
    }
    if room_sharing:
        shown[room_sharing] = F.coalesce(F.col(room_sharing), F.lit(DEFAULT_SHARING))
    return df.withColumns(shown)


def zero_if_null(name: str, kind: str) -> Column:
    """A NULL number reads as 0 and a NULL flag as false in the output documents."""
    return F.coalesce(F.col(name).cast(kind), F.lit(False if kind == "boolean" else 0).cast(kind)).alias(name)


def rating_display(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "avg_rating": zero_if_null("avg_rating", "double"),
            "review_count": zero_if_null("review_count", "int"),
        }
    )


def contact_phone(listing_phone: str, owner_phone: str) -> Column:
    """The listing's phone, else the owner's; an empty text is a value."""
    return F.coalesce(F.col(listing_phone), F.col(owner_phone))


def is_member(column: str) -> Column:
    """Membership flag after an outer join."""
    return F.col(column).isNotNull()


def shown_reviews(reviews: DataFrame) -> DataFrame:
    """Reviews that pass moderation; an unset flag does not."""
    return reviews.where(F.col("is_flagged") == F.lit(False))


def in_query_box(lat: Column, lng: Column) -> Column:
    """The query point must lie in the supported box (NaN does not)."""
    return lat.between(*INDIA_LAT) & lng.between(*INDIA_LNG)


def normalise_requests(raw: DataFrame) -> DataFrame:
    """Typed search parameters from text: unparsable means absent, then defaults
    and the page-size clamp apply."""
    size = F.coalesce(int_or_null("size"), F.lit(DEFAULT_PAGE_SIZE))
    return raw.withColumns(
        {
            "lat": double_or_null("lat"),
            "lng": double_or_null("lng"),
            "radius_km": F.coalesce(double_or_null("radius_km"), F.lit(DEFAULT_RADIUS_KM)),
            "min_rent": int_or_null("min_rent"),
            "max_rent": int_or_null("max_rent"),
            "page": F.coalesce(int_or_null("page"), F.lit(0)),
            "size": clamp_size(size),
        }
    )


def clamp_size(size: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(MAX_PAGE_SIZE), size))
