"""Tables, domains and constraints of the marketplace, declared once.

Keys are text (canonical lower-case ids) in the declared schemas; operators never
assume a key type, so numeric keys work as well.
"""

from __future__ import annotations

from pyspark.sql import types as T

S, I, D, B = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
TS, DT = T.TimestampType(), T.DateType()


def _table(*columns: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns])


TABLES: dict[str, T.StructType] = {
    "users": _table(
        ("id", S), ("firebase_uid", S), ("phone", S), ("full_name", S), ("email", S),
        ("role", S), ("profile_photo_url", S), ("is_verified", B), ("gender", S),
        ("dob", DT), ("created_at", TS), ("updated_at", TS),
    ),
    "listings": _table(
        ("id", S), ("owner_id", S), ("title", S), ("description", S), ("address_line", S),
        ("locality", S), ("city", S), ("pincode", S), ("contact_phone", S), ("lat", D),
        ("lng", D), ("gender_preference", S), ("pg_type", S), ("food_type", S),
        ("rules", S), ("status", S), ("avg_rating", T.DecimalType(2, 1)),
        ("review_count", I), ("created_at", TS), ("updated_at", TS),
    ),
    "room_options": _table(
        ("id", S), ("listing_id", S), ("sharing_type", S), ("monthly_rent", I),
        ("security_deposit", I), ("total_beds", I), ("available_beds", I),
        ("notice_period_days", I),
    ),
    "amenities": _table(("id", I), ("name", S), ("icon_key", S)),
    "listing_amenities": _table(("listing_id", S), ("amenity_id", I)),
    "listing_photos": _table(
        ("id", S), ("listing_id", S), ("url", S), ("thumbnail_url", S),
        ("display_order", I), ("uploaded_at", TS),
    ),
    "favorites": _table(("user_id", S), ("listing_id", S), ("created_at", TS)),
    "reviews": _table(
        ("id", S), ("listing_id", S), ("user_id", S), ("rating", I), ("comment", S),
        ("stayed_from", DT), ("stayed_until", DT), ("is_flagged", B), ("created_at", TS),
    ),
    "inquiries": _table(
        ("id", S), ("listing_id", S), ("tenant_id", S), ("message", S), ("status", S),
        ("created_at", TS), ("last_attempt_at", TS),
    ),
}

# Closed domains of the columns.
ROLES = ("TENANT", "OWNER")
GENDERS = ("MALE", "FEMALE", "OTHER", "PREFER_NOT_TO_SAY")
GENDER_PREFERENCES = ("MALE", "FEMALE", "COED")
PG_TYPES = ("PG", "HOSTEL", "COLIVING")
FOOD_TYPES = ("VEG", "NON_VEG", "BOTH", "NONE")
LISTING_STATUSES = ("ACTIVE", "PAUSED", "DELETED")
SHARING_TYPES = ("SINGLE", "DOUBLE", "TRIPLE", "QUAD")
INQUIRY_STATUSES = ("PENDING", "RESPONDED", "CLOSED")
RATINGS = (1, 2, 3, 4, 5)

DOMAINS: dict[tuple[str, str], tuple] = {
    ("users", "role"): ROLES,
    ("users", "gender"): GENDERS,
    ("listings", "gender_preference"): GENDER_PREFERENCES,
    ("listings", "pg_type"): PG_TYPES,
    ("listings", "food_type"): FOOD_TYPES,
    ("listings", "status"): LISTING_STATUSES,
    ("room_options", "sharing_type"): SHARING_TYPES,
    ("reviews", "rating"): RATINGS,
    ("inquiries", "status"): INQUIRY_STATUSES,
}

# The amenity dimension (id, name, icon key).
AMENITIES = (
    (1, "WiFi", "wifi"),
    (2, "AC", "ac_unit"),
    (3, "Laundry", "local_laundry_service"),
    (4, "Parking", "local_parking"),
    (5, "Power Backup", "bolt"),
    (6, "CCTV", "videocam"),
    (7, "Hot Water", "shower"),
    (8, "Refrigerator", "kitchen"),
    (9, "Housekeeping", "cleaning_services"),
    (10, "TV", "tv"),
    (11, "Gym", "fitness_center"),
    (12, "Food Included", "restaurant"),
)

# Column defaults applied when a source leaves the column out.
DEFAULTS: dict[tuple[str, str], object] = {
    ("users", "is_verified"): False,
    ("listings", "city"): "Bengaluru",
    ("listings", "status"): "ACTIVE",
    ("listings", "avg_rating"): 0,
    ("listings", "review_count"): 0,
    ("room_options", "notice_period_days"): 30,
    ("listing_photos", "display_order"): 0,
    ("reviews", "is_flagged"): False,
    ("inquiries", "status"): "PENDING",
}

# Fixed values: (table, key columns, is_primary); a primary key may not be NULL, a unique key may.
KEYS: tuple[tuple[str, tuple[str, ...], bool], ...] = (
    ("users", ("id",), True),
    ("users", ("firebase_uid",), False),
    ("users", ("phone",), False),
    ("listings", ("id",), True),
    ("room_options", ("id",), True),
    ("amenities", ("id",), True),
    ("amenities", ("name",), False),
    ("listing_amenities", ("listing_id", "amenity_id"), True),
    ("listing_photos", ("id",), True),
    ("favorites", ("user_id", "listing_id"), True),
    ("reviews", ("id",), True),
    ("reviews", ("listing_id", "user_id"), False),
    ("inquiries", ("id",), True),
    ("inquiries", ("tenant_id", "listing_id"), False),
)

# Fixed values: (child table, child column, parent table, deleting the parent removes the child)
FOREIGN_KEYS: tuple[tuple[str, str, str, bool], ...] = (
    ("listings", "owner_id", "users", True),
    ("room_options", "listing_id", "listings", True),
    ("listing_amenities", "listing_id", "listings", True),
    ("listing_amenities", "amenity_id", "amenities", False),
    ("listing_photos", "listing_id", "listings", True),
    ("favorites", "user_id", "users", True),
    ("favorites", "listing_id", "listings", True),
    ("reviews", "listing_id", "listings", True),
    ("reviews", "user_id", "users", False),
    ("inquiries", "listing_id", "listings", False),
    ("inquiries", "tenant_id", "users", False),
)

# Columns that must have a value.
NOT_NULL: dict[str, tuple[str, ...]] = {
    "users": ("firebase_uid", "phone", "role"),
    "listings": ("owner_id", "title", "address_line", "locality", "city", "lat", "lng"),
    "room_options": (
        "listing_id", "monthly_rent", "security_deposit", "total_beds", "available_beds",
    ),
    "amenities": ("name",),
    "listing_photos": ("listing_id", "url", "thumbnail_url"),
    "reviews": ("listing_id", "user_id", "rating"),
    "inquiries": ("listing_id", "tenant_id", "last_attempt_at"),
}

# Limits of the marketplace rules.
INDIA_LAT = (8.0, 37.0)
INDIA_LNG = (68.0, 98.0)
DEFAULT_RADIUS_KM = 5.0
DEFAULT_PAGE_SIZE = 20
MAX_PAGE_SIZE = 50
RECENT_REVIEWS = 5
INQUIRY_SUMMARY_CAP = 100
MAX_PHOTOS_PER_LISTING = 6
MAX_PHOTO_BYTES = 5 * 1024 * 1024
PHOTO_EXTENSIONS = ("jpg", "jpeg", "png", "webp")
MAX_COMMENT_LENGTH = 1000
MIN_AGE_YEARS = 18

# What is shown for a missing category.
DISPLAY_DEFAULTS = {"gender_preference": "COED", "pg_type": "PG", "food_type": "BOTH"}
DEFAULT_SHARING = "DOUBLE"
