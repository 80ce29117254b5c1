"""Request parameters and derived inputs shared by the queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staygrid.catalog.fixtures import owner_of

POINT_FILTERS = {
    "lat": 12.97, "lng": 77.64, "radius_km": 6.0, "low": 6000, "high": 16000, "gender": "female",
}
POINT_REQUEST = {
    "user_id": 7, "lat": 12.97, "lng": 77.64, "radius_km": 6.0, "min_rent_asked": 6000,
    "max_rent_asked": 16000, "gender": "female", "page_number": 0, "size": 20,
}
RENT_BOUNDS = (7000, 7400)
CATEGORY_REQUEST = {"gender": "female", "food": "veg"}
SPLIT_TIME = "2024-01-16 00:00:00"
AS_OF_DATE = "2024-01-01"
AS_OF_TIME = "2024-06-01 00:00:00"
SEED = 11

RAW_REQUESTS = """
select request_id,
  case when request_id % 7 = 0 then 'north' else cast(lat as string) end as lat,
  case when request_id % 11 = 0 then concat(' ', cast(lng as string)) else cast(lng as string) end as lng,
  case when request_id % 5 = 0 then null when request_id % 13 = 0 then '2,5' when request_id % 17 = 0 then '2.5f'
    when request_id % 23 = 0 then '-1e2D ' else '2.5' end as radius_km,
  case when request_id % 3 = 0 then '+6000' when request_id % 4 = 0 then '6000.5' end as min_rent,
  case when request_id % 2 = 0 then '12000' when request_id % 17 = 0 then '' end as max_rent,
  case request_id % 4 when 0 then ' 1' when 1 then '1' when 2 then 'one' end as page,
  case request_id % 5 when 0 then '0' when 1 then '100' when 2 then '30' when 3 then '99999999999' end as size
from search_requests_v
"""

FAR_PAIRS = """
select c_custkey as id, cast((c_custkey * 37) % 1700 as double) / 10 - 85 as req_lat,
  cast((c_custkey * 53) % 1000 as double) / 10 - 90 as req_lng, cast((c_custkey * 91) % 1700 as double) / 10 - 85 as lat,
  cast((c_custkey * 53) % 1000 as double) / 10 - 90 + cast((c_custkey * 17) % 1500 as double) / 10 as lng
from customer
"""

# Points and, within half a degree, their antipodes.
ANTIPODAL_PAIRS = """
select c_custkey as id, cast((c_custkey * 37) % 1700 as double) / 10 - 85 as req_lat,
  cast((c_custkey * 53) % 1000 as double) / 10 - 90 as req_lng,
  85 - cast((c_custkey * 37) % 1700 as double) / 10 + cast((c_custkey * 7) % 11 - 5 as double) / 10 as lat,
  cast((c_custkey * 53) % 1000 as double) / 10 + 90 + cast((c_custkey * 13) % 11 - 5 as double) / 10 as lng
from customer
"""

EDGE_REQUESTS = """
select request_id, case when request_id % 7 = 0 then null else lat end as lat,
  case when request_id % 11 = 0 then null when request_id % 12 = 0 then 120.5 else lng end as lng,
  case when request_id % 13 = 0 then -1.0 when request_id % 6 = 0 then null else radius_km end as radius_km,
  case when request_id % 17 = 0 then -1 when request_id % 4 = 0 then null else page end as page,
  case when request_id % 9 = 0 then null else size end as size
from search_requests_v
"""

PROFILE_UIDS = """
select distinct concat('uid-', cast(user_id as string)) as firebase_uid
from interactions_v where event_type = 'signup'
"""

ONE_COVER_EVENT = """
select listing_id, max(listing_id * 10 + 1 + id % 6) as photo_id from photos_v group by listing_id
"""

GATE_EVENTS = f"""
select event_id,
  case event_type when 'click' then case when k % 2 = 0 then 'favorite_add' else 'favorite_remove' end
    when 'view' then 'inquiry' when 'purchase' then case when k % 2 = 0 then 'review' else 'review_delete' end
    when 'signup' then case k % 4 when 0 then 'edit' when 1 then 'soft_delete' when 2 then 'photo_upload' else 'photo_delete' end
    else case when k % 2 = 0 then 'cover' else 'availability' end end as op,
  case when event_type in ('signup', 'error') and k % 5 <> 0
       then {owner_of("listing_id")} - case when k % 9 = 0 then 1 else 0 end
       when k % 29 = 0 then user_id + 1000000 else user_id end as actor_id,
  case when k % 31 = 0 then listing_id + 1000000 else listing_id end as listing_id,
  case when k % 31 = 0 then null else listing_id * 10 + 1 + k % 7 end as photo_id
from interactions_v
"""

REVIEW_DRAFTS = """
select event_id as draft_id, k * 25 as listing_id, cast(k % 7 as int) as rating,
  case k % 8 when 0 then concat(chr(9), ' ', chr(10)) when 1 then '\u2028 stay \u00a0'
    when 2 then repeat('x', 1000) when 3 then repeat('x', 1001) when 4 then repeat('😀', 501)
    when 5 then repeat('😀', 500) when 6 then null else concat('  stay ', cast(k as string), chr(9)) end as comment
from interactions_v where event_type = 'purchase'
"""

REGISTRATIONS = """
select c_custkey as uid,
  case c_custkey % 5 when 0 then 'tenant' when 1 then 'Owner' when 2 then 'TENANT' when 3 then 'admin' else 'OWNER' end as role,
  case c_custkey % 7 when 0 then 'MALE' when 1 then 'male' when 2 then 'PREFER_NOT_TO_SAY' else null end as gender,
  case c_custkey % 11 when 0 then '2023-02-30' when 1 then '2000-2-03' when 2 then 'x2000-02-03'
    when 3 then '2005-12-31' when 4 then '2006-01-01' when 5 then '2006-01-02' when 6 then null
    else cast(date '1980-01-01' + cast((c_custkey * 13) % 12000 as int) as string) end as dob
from customer
"""

TEXT_IDS = """
select c_custkey as doc_key,
  case c_custkey % 6 when 0 then repeat('-', 36) when 1 then concat('0a1B2c3D-0000-4000-8000-00000000', lpad(cast(c_custkey % 10000 as string), 4, '0'))
    when 2 then concat(repeat('a', 36), chr(10)) when 3 then repeat('f', 35) when 4 then concat(repeat('a', 35), 'g') end as id
from customer
"""

DRAFT_LINES = """
select concat('{"title": "', p_name, '", "addressLine": "a", "locality": "l", "genderPreference": ', case when p_partkey % 6 = 0 then 'MALE' else '"MALE"' end, ', "pgType": "PG", ',
  case when p_partkey % 7 = 0 then '' else '"foodType": "VEG", ' end,
  case p_partkey % 5 when 0 then '"city": null, ' when 1 then '"city": "Mysuru", ' else '' end,
  case p_partkey % 3 when 0 then '"roomOptions": [{"sharingType": "SINGLE", "monthlyRent": 1, "securityDeposit": 0, "totalBeds": 1, "availableBeds": 1}], '
    when 1 then '"roomOptions": [{"sharingType": "SINGLE", "monthlyRent": 1, "securityDeposit": 0, "totalBeds": 1, "availableBeds": 1, "noticePeriodDays": 15}], ' else '' end,
  case p_partkey % 4 when 0 then '"amenityIds": [1, "2"], ' when 1 then '"amenityIds": [], ' else '' end,
  case when p_partkey % 11 = 0 then 'extra: true, ' else '' end,
  case when p_partkey % 17 = 0 then '"latitude": "12.9", ' else '"latitude": 12.9, ' end, '"longitude": 77.6', case when p_partkey % 13 = 0 then '' else '}' end) as line
from part
"""

RATING_TARGETS = """
select p_name as title, substr('5,4,4,3,5,2,4,5,3,1,4', 1, cast(1 + 2 * (min(p_partkey) % 6) as int)) as ratings
from part group by p_name
"""

COMMENT_POOL = """
select cast(1 + c_custkey % 5 as int) as rating, row_number() over (partition by c_custkey % 5 order by c_custkey) as ord,
  concat('comment ', cast(c_custkey as string)) as comment
from customer
"""

# Prior snapshots for the folds: what an earlier load left, and the events after it. One
# event in five comes in late: it belongs to the second batch whatever its time.
FIRST_BATCH = f"ts < timestamp '{SPLIT_TIME}' and event_id % 5 <> 0"
PRIOR_REVIEWS = """
select user_id, listing_id, min(event_id) as id, max_by(rating, ts) as rating, max_by(comment, ts) as comment,
  min(event_id) % 3 = 0 as is_flagged, max(ts) as created_at
from review_events_v where op = 'upsert' and {first} group by user_id, listing_id
""".format(first=FIRST_BATCH)
PRIOR_INQUIRIES = """
select 1000000 + min(event_id) as id, tenant_id, listing_id, min(ts) as created_at, max(ts) as last_attempt_at,
  case when min(event_id) % 2 = 0 then 'RESPONDED' else 'PENDING' end as status,
  case when min(event_id) % 3 = 0 then 'hello' end as message
from inquiry_events_v where {first} group by tenant_id, listing_id
""".format(first=FIRST_BATCH)
# Accounts that hold the phone another account's first event with a phone asks for.
PRIOR_USERS = """
select 2000000 + min(event_id) as id, concat('held-', firebase_uid) as firebase_uid, min_by(phone, event_id) as phone,
  'OWNER' as role, 'Holder' as full_name, true as is_verified, timestamp '2020-01-01 00:00:00' as created_at,
  'me.jpg' as profile_photo_url, timestamp '2021-01-01 00:00:00' as updated_at
from user_events_v where phone is not null group by firebase_uid
"""

DOOMED_USERS = """
select c_custkey as id from customer where c_acctbal < 0
union all select -1 - s_suppkey from supplier where s_acctbal < 0
"""
DOOMED_LISTINGS = """
select id from listings_v where status = 'DELETED'
"""


def drafts(f) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Drafts, their rooms and their amenity links."""
    given = f.view("listing_drafts_v").withColumn("ts", F.lit(AS_OF_TIME).cast("timestamp"))
    return (
        given.drop("amenity_id"),
        f.view("draft_rooms_v").drop("id"),
        given.select("draft_id", "amenity_id"),
    )


def loads(f) -> dict[str, DataFrame]:
    """The loads with broken rows under their table names."""
    return {
        "users": f.view("users_load_v"),
        "listings": f.view("listings_load_v"),
        "room_options": f.view("rooms_load_v"),
        "favorites": f.view("favorites_load_v"),
        "reviews": f.view("reviews_load_v"),
        "inquiries": f.view("inquiries_load_v"),
        "listing_amenities": f.links,
        "amenities": f.amenities,
    }


def clean_tables(f) -> dict[str, DataFrame]:
    return {
        "users": f.users, "listings": f.listings, "room_options": f.rooms,
        "listing_amenities": f.links, "listing_photos": f.photos, "favorites": f.favorites,
        "reviews": f.reviews, "inquiries": f.inquiries, "amenities": f.amenities,
    }


# Event views as transformations of the interactions, for streams.


def inquiry_events(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_type") == "view").select(
        "event_id", "ts", F.col("user_id").alias("tenant_id"), "listing_id"
    )


def favorite_events(events: DataFrame) -> DataFrame:
    op = F.when(F.col("event_type") == "click", "add").otherwise("remove")
    return events.where(F.col("event_type").isin("click", "error")).select(
        "event_id", "ts", "user_id", "listing_id", op.alias("op")
    )


def review_events(events: DataFrame) -> DataFrame:
    upsert = F.col("event_type") == "purchase"
    return events.where(F.col("event_type").isin("purchase", "signup")).select(
        "event_id", "ts", "user_id", "listing_id",
        F.when(upsert, "upsert").otherwise("delete").alias("op"),
        F.when(upsert, (1 + F.col("k") % 5).cast("int")).alias("rating"),
        F.when(upsert, F.concat(F.lit("stay "), F.col("k").cast("string"))).alias("comment"),
    )


def user_events(events: DataFrame) -> DataFrame:
    signup, k, uid = F.col("event_type") == "signup", F.col("k"), F.col("user_id")
    return events.where(F.col("event_type").isin("signup", "click")).select(
        "event_id", "ts", F.concat(F.lit("uid-"), uid.cast("string")).alias("firebase_uid"),
        F.when(signup & (k % 2 == 0), "OWNER").otherwise("TENANT").alias("role"),
        F.when(signup, F.concat(F.lit("Name "), k.cast("string"))).alias("full_name"),
        F.when(signup & (k % 3 == 0), F.concat(F.lit("+94"), (uid * 100 + k).cast("string"))).alias("phone"),
    )
