"""Batch validation and integrity audits.

Every ``validate_*`` keeps all rows and adds ``reason``: the first rule a row
breaks, NULL when it is accepted. ``accepted`` and ``rejected`` split the result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staygrid.functions.dates import age_years
from staygrid.functions.ratings import rating_of
from staygrid.functions.text import (
    ISO_DATE_SHAPE,
    file_ext,
    full_match,
    is_blank,
    trim_ws,
    utf16_length,
    valid_id_shape,
)
from staygrid.operators.filters import clamp_size, in_query_box
from staygrid.operators.skew import split_join
from staygrid.schema import (
    DEFAULT_PAGE_SIZE,
    DEFAULT_RADIUS_KM,
    DOMAINS,
    FOOD_TYPES,
    FOREIGN_KEYS,
    GENDER_PREFERENCES,
    GENDERS,
    KEYS,
    MAX_COMMENT_LENGTH,
    MAX_PHOTO_BYTES,
    MAX_PHOTOS_PER_LISTING,
    MIN_AGE_YEARS,
    NOT_NULL,
    PG_TYPES,
    PHOTO_EXTENSIONS,
    ROLES,
    SHARING_TYPES,
)
from staygrid.session import stored


def first_reason(*rules: tuple[Column, str]) -> Column:
    """The message of the first rule that is violated."""
    return F.coalesce(*[F.when(broken, F.lit(message)) for broken, message in rules])


def accepted(df: DataFrame) -> DataFrame:
    return df.where(F.col("reason").isNull()).drop("reason")


def rejected(df: DataFrame) -> DataFrame:
    return df.where(F.col("reason").isNotNull())


def _outside(column: str, domain: tuple) -> Column:
    """Not one of ``domain``; a missing value is outside too."""
    return ~F.coalesce(F.col(column).isin(*domain), F.lit(False))


def _blank(column: str) -> Column:
    return F.coalesce(is_blank(column), F.lit(True))


# --- validation ------------------------------------------------------------


def validate_listings(drafts: DataFrame, rooms: DataFrame) -> DataFrame:
    """Listing drafts (draft_id, ...) with their rooms (draft_id, pos, ...).

    The listing's own fields are checked first, then its rooms in array order. The
    first broken room is found by a combining minimum, not by collecting rooms.
    """
    room_reason = first_reason(
        (_outside("sharing_type", SHARING_TYPES), "sharing_type"),
        (F.col("monthly_rent") <= 0, "rent"),
        (F.col("available_beds") > F.col("total_beds"), "beds"),
    )
    broken = (
        rooms.withColumn("_why", room_reason)
        .where(F.col("_why").isNotNull())
        .groupBy("draft_id")
        .agg(F.min_by("_why", "pos").alias("_room_reason"))
    )
    lat, lng = F.col("latitude"), F.col("longitude")
    off_globe = ~(lat.between(-90, 90) & lng.between(-180, 180)) | F.isnan(lat) | F.isnan(lng)
    reason = F.coalesce(
        first_reason(
            (_blank("title"), "title"),
            (_blank("address_line"), "address"),
            (_blank("locality"), "locality"),
            (_outside("gender_preference", GENDER_PREFERENCES), "gender_preference"),
            (_outside("pg_type", PG_TYPES), "pg_type"),
            (_outside("food_type", FOOD_TYPES), "food_type"),
            (F.coalesce(off_globe, F.lit(True)), "coordinates"),
        ),
        F.col("_room_reason"),
    )
    return drafts.join(broken, "draft_id", "left").withColumn("reason", reason).drop("_room_reason")


def validate_reviews(drafts: DataFrame, listings: DataFrame) -> DataFrame:
    """Review drafts (listing_id, rating, comment); ``comment`` comes out trimmed."""
    targets = listings.select(F.col("id").alias("listing_id"), F.col("status").alias("_status"), F.lit(True).alias("_found"))
    known = drafts.join(targets, "listing_id", "left").withColumn("comment", trim_ws("comment"))
    reason = first_reason(
        (F.col("_found").isNull(), "listing not found"),
        (~F.col("_status").eqNullSafe("ACTIVE"), "listing not active"),
        (~F.coalesce(F.col("rating").between(1, 5), F.lit(False)), "rating"),
        (F.coalesce(F.col("comment") == "", F.lit(True)), "comment blank"),
        (utf16_length("comment") > MAX_COMMENT_LENGTH, "comment too long"),
    )
    return known.withColumn("reason", reason).drop("_status", "_found")


def validate_users(registrations: DataFrame, as_of: Column) -> DataFrame:
    """Registrations (role, gender, dob as text) judged at the date ``as_of``.

    ``role`` comes out upper-cased.
    """
    day = F.col("dob").try_cast("date")
    shaped = full_match("dob", ISO_DATE_SHAPE)
    reason = first_reason(
        (~F.coalesce(F.upper("role").isin(*ROLES), F.lit(False)), "role"),
        (F.col("gender").isNotNull() & ~F.col("gender").isin(*GENDERS), "gender"),
        (F.col("dob").isNotNull() & ~shaped, "dob format"),
        (F.col("dob").isNotNull() & day.isNull(), "dob not a date"),
        (age_years(day, as_of) < MIN_AGE_YEARS, "under age"),
    )
    return registrations.withColumn("reason", reason).withColumn("role", F.upper("role"))


def validate_requests(requests: DataFrame) -> DataFrame:
    """Search requests with defaults and the page-size clamp applied."""
    ready = requests.withColumns(
        {
            "radius_km": F.coalesce(F.col("radius_km"), F.lit(DEFAULT_RADIUS_KM)),
            "page": F.coalesce(F.col("page"), F.lit(0)),
            "size": clamp_size(F.coalesce(F.col("size"), F.lit(DEFAULT_PAGE_SIZE))),
        }
    )
    radius = F.col("radius_km")
    reason = first_reason(
        (F.col("lat").isNull(), "lat missing"),
        (F.col("lng").isNull(), "lng missing"),
        (~in_query_box(F.col("lat"), F.col("lng")), "outside the supported area"),
        (F.col("page") < 0, "negative page"),
        (F.isnan(radius) | (radius < 0), "radius"),
    )
    return ready.withColumn("reason", reason)


def validate_availability(events: DataFrame, rooms: DataFrame, listings: DataFrame) -> DataFrame:
    """Availability events (actor_id, listing_id, room_id, available_beds)."""
    targets = listings.select(
        F.col("id").alias("listing_id"), F.col("owner_id").alias("_owner"),
        F.col("status").alias("_status"), F.lit(True).alias("_found"),
    )
    beds = rooms.select(
        "listing_id", F.col("id").alias("room_id"), F.col("total_beds").alias("_beds"),
        F.lit(True).alias("_room"),
    )
    known = events.join(targets, "listing_id", "left").join(beds, ["listing_id", "room_id"], "left")
    reason = first_reason(
        (F.col("_found").isNull(), "listing not found"),
        (~F.col("_owner").eqNullSafe(F.col("actor_id")), "not the owner"),
        (F.col("_room").isNull(), "room not found"),
        (~F.col("_status").eqNullSafe("ACTIVE"), "listing not active"),
        (
            ~F.coalesce(F.col("available_beds").between(0, F.col("_beds")), F.lit(False)),
            "available beds out of range",
        ),
    )
    return known.withColumn("reason", reason).drop("_owner", "_status", "_found", "_beds", "_room")


def validate_photos(meta: DataFrame, counts: DataFrame) -> DataFrame:
    """Photo uploads (listing_id, uploaded_at, upload_key, content_type, file_name,
    size_bytes) on top of the existing photo ``counts`` per listing.

    A failed upload takes no place. A good one gets ``display_order`` = number of
    photos before it and is refused from the sixth on; a full listing refuses before it
    looks at the file. Every upload row is judged once, equal rows one after the other.
    A listing needs to know no more than its first six good uploads, which a bounded
    ranking finds task by task, so no task ranks all uploads of a listing. The uploads are
    stored once with a row number.
    """
    file_reason = first_reason(
        (~F.coalesce(F.col("content_type").startswith("image/"), F.lit(False)), "content type"),
        (
            ~F.coalesce(file_ext(F.coalesce("file_name", F.lit("upload"))).isin(*PHOTO_EXTENSIONS), F.lit(False)),
            "extension",
        ),
        (F.col("size_bytes") > MAX_PHOTO_BYTES, "too large"),
    )
    numbered = stored(meta.withColumns({"_file": file_reason, "_row": F.monotonically_increasing_id()}), "uploads")
    arrival = F.struct("uploaded_at", "upload_key")
    first = Window.partitionBy("listing_id").orderBy("uploaded_at", "upload_key", "_row")
    good = numbered.where(F.col("_file").isNull()).select("listing_id", "uploaded_at", "upload_key", "_row")
    good = good.withColumn("_place", F.row_number().over(first)).where(F.col("_place") <= MAX_PHOTOS_PER_LISTING)
    firsts = good.groupBy("listing_id").agg(
        F.sort_array(F.collect_list(F.struct("_place", "_row", arrival.alias("arrival")))).alias("_firsts")
    )
    known = firsts.join(counts.select("listing_id", "photo_count"), "listing_id", "full")
    placed = split_join(numbered, known, ["listing_id"], "left", "upload_key").withColumn(
        "photo_count", F.coalesce("photo_count", F.lit(0))
    )
    place = F.array_position(F.col("_firsts")["_row"], F.col("_row"))
    taken = F.col("photo_count") + place - 1
    room = F.lit(MAX_PHOTOS_PER_LISTING) - F.col("photo_count")
    # The upload that takes the last place; equal arrivals of good files come first.
    last = F.get(F.col("_firsts"), (room - 1).cast("int"))["arrival"]
    is_good = F.col("_file").isNull()
    full = (room <= 0) | F.when(is_good, F.coalesce(place, F.lit(0)) == 0).otherwise(F.lit(False)) | F.when(
        is_good, taken >= MAX_PHOTOS_PER_LISTING
    ).otherwise(F.coalesce(last <= arrival, F.lit(False)))
    return placed.withColumns(
        {
            "display_order": F.when(~full & is_good, taken.cast("int")),
            "reason": F.when(full, F.lit("too many photos")).otherwise(F.col("_file")),
        }
    ).drop("_file", "_row", "_firsts", "photo_count")


def check_id_shape(df: DataFrame, column: str) -> DataFrame:
    """Ids are 36 hex digits and dashes; looser than a UUID on purpose."""
    return df.withColumn(
        "reason", F.when(~F.coalesce(valid_id_shape(column), F.lit(False)), F.lit("id shape"))
    )


# --- audits ----------------------------------------------------------------


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _text_key(columns) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in columns])


def audit_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """Keys that occur more than once: (table, key, value, rows).

    NULL keys are ignored; Postgres treats them as distinct under UNIQUE, and a
    NULL in a primary key is a case for ``audit_nulls``. Counts combine map-side.
    """
    found = []
    for table, columns, _ in KEYS:
        if table not in tables or not set(columns) <= set(tables[table].columns):
            continue
        keyed = tables[table].select(*columns).dropna("any")
        twice = keyed.groupBy(*columns).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)
        found.append(
            twice.select(
                F.lit(table).alias("table_name"), F.lit(",".join(columns)).alias("key"),
                _text_key(columns).alias("value"), "rows",
            )
        )
    return _union(found)


def audit_orphans(tables: dict[str, DataFrame]) -> DataFrame:
    """References without a parent row: (table, column, value, rows).

    References are counted per value before the anti join, so a value shared by
    very many rows is one row there. NULL references are fine.
    """
    found = []
    for child, column, parent, _ in FOREIGN_KEYS:
        if child not in tables or parent not in tables or column not in tables[child].columns:
            continue
        counted = (
            tables[child].where(F.col(column).isNotNull())
            .groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
        )
        parents = tables[parent].select(F.col("id").alias(column))
        found.append(
            counted.join(parents, column, "left_anti").select(
                F.lit(child).alias("table_name"), F.lit(column).alias("column_name"),
                F.col(column).cast("string").alias("value"), "rows",
            )
        )
    return _union(found)


def audit_domains(tables: dict[str, DataFrame]) -> DataFrame:
    """Values outside their closed domain: (table, column, value, rows); NULL passes."""
    found = []
    for (table, column), domain in DOMAINS.items():
        if table not in tables or column not in tables[table].columns:
            continue
        outside = tables[table].where(~F.col(column).isin(*domain))
        found.append(
            outside.groupBy(column).agg(F.count(F.lit(1)).alias("rows")).select(
                F.lit(table).alias("table_name"), F.lit(column).alias("column_name"),
                F.col(column).cast("string").alias("value"), "rows",
            )
        )
    return _union(found)


def audit_nulls(tables: dict[str, DataFrame]) -> DataFrame:
    """NULLs in NOT NULL and primary-key columns: one scan and one row per table column."""
    found = []
    for table, df in tables.items():
        required = list(NOT_NULL.get(table, ()))
        for name, columns, primary in KEYS:
            if name == table and primary:
                required = [*columns, *[c for c in required if c not in columns]]
        required = [c for c in required if c in df.columns]
        counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
        found.append(
            counted.unpivot([], required, "column_name", "nulls").select(
                F.lit(table).alias("table_name"), "column_name", "nulls"
            )
        )
    return _union(found).where(F.col("nulls") > 0)


def cascade_plan(tables: dict[str, DataFrame], doomed: dict[str, DataFrame]) -> DataFrame:
    """What deleting the ``doomed`` ids ({'users': ids, 'listings': ids}) would do.

    Rows (table, key, action): 'delete' for rows that go along, 'blocked' for rows
    whose reference has no cascade and therefore stops the deletion. Deleting a
    user takes the user's listings along, and those take their children. A row that
    is deleted through one reference and blocked through another is listed as both.

    The doomed ids are one table (parent, id), written once. Every child is read once:
    its references are turned into rows and meet the table in one join.
    """
    spark = next(iter(tables.values())).sparkSession
    kind = "string"
    named = [
        ids.select(F.lit(name).alias("parent"), F.col("id").cast(kind).alias("ref"))
        for name, ids in doomed.items()
    ]
    if "users" in doomed:
        owned = tables["listings"].join(
            doomed["users"].select(F.col("id").alias("owner_id")), "owner_id", "left_semi"
        )
        named.append(owned.select(F.lit("listings").alias("parent"), F.col("id").cast(kind).alias("ref")))
    gone = stored(_union(named).distinct(), "doomed")

    primary = {table: columns for table, columns, is_primary in KEYS if is_primary}
    references: dict[str, list[tuple[str, str, bool]]] = {}
    for name in ("users", "listings"):
        references[name] = [("id", name, True)]
    for child, column, parent, cascades in FOREIGN_KEYS:
        if parent in ("users", "listings") and child != "listings":
            references.setdefault(child, []).append((column, parent, cascades))
    plan = []
    for child, columns in references.items():
        if child not in tables:
            continue
        df = tables[child]
        key = [c for c in primary[child] if c in df.columns] or ["tenant_id", "listing_id"]
        pointed = [
            F.struct(
                F.lit(parent).alias("parent"), F.col(column).cast(kind).alias("ref"),
                F.lit("delete" if cascades else "blocked").alias("action"),
            )
            for column, parent, cascades in columns if column in df.columns
        ]
        rows = df.select(_text_key(key).alias("row_key"), F.explode(F.array(*pointed)).alias("_r"))
        hit = rows.select("row_key", "_r.*").join(gone, ["parent", "ref"], "left_semi")
        found = hit.select(F.lit(child).alias("table_name"), "row_key", "action")
        # Only a row with several references can turn up twice.
        plan.append(found.distinct() if len(pointed) > 1 else found)
    if not plan:
        return spark.createDataFrame([], "table_name string, row_key string, action string")
    return _union(plan)


def rating_drift(listings: DataFrame, reviews: DataFrame) -> DataFrame:
    """Listings whose stored rating or count differs from the reviews."""
    sums = reviews.groupBy(F.col("listing_id").alias("id")).agg(
        F.sum("rating").alias("_sum"), F.count(F.lit(1)).alias("_n")
    )
    both = listings.join(sums, "id", "left").na.fill(0, ["_sum", "_n"])
    both = both.select(
        "id", "avg_rating", "review_count",
        rating_of(F.col("_sum"), F.col("_n")).alias("true_rating"),
        F.col("_n").cast("int").alias("true_count"),
    )
    same = F.col("avg_rating").eqNullSafe(F.col("true_rating")) & F.col("review_count").eqNullSafe(
        F.col("true_count")
    )
    return both.where(~same)
