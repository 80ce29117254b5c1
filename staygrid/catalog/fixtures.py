"""Marketplace-shaped inputs derived from the TPC-H-like test tables.

The same SQL text defines a view here and in the DuckDB checks (integer arithmetic
and literals only). See FIXTURES.md.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staygrid.session import tune, work_path
from staygrid.sources.tables import amenities as amenity_table
from staygrid.sources.tables import conform, read_events



def owner_of(listing: str) -> str:
    """The owner of a listing: one owner has every third, the others share the rest."""
    return f"(-1 - case when {listing} % 3 = 0 then 0 else {listing} % (select count(*) from supplier) end)"


# Every user turns to six listings, spread over all of them, and one listing in
# between gets a quarter of all events.
HOT_LISTING = 7
TOUCHED_LISTING = f"""case when event_id % 4 = 0 then {HOT_LISTING}
  else (user_id * 31 + (k % 6) * 7) % (select count(*) from part) end"""

VIEWS: dict[str, str] = {
    "users_v": """
select c_custkey as id, concat('uid-', cast(c_custkey as string)) as firebase_uid,
  case when c_custkey % 3 = 0 then concat('email:uid-', cast(c_custkey as string))
       else concat('+91', cast(9000000000 + c_custkey as string)) end as phone,
  case when c_custkey % 13 = 0 then null else c_name end as full_name, 'TENANT' as role,
  case c_custkey % 5 when 0 then 'MALE' when 1 then 'FEMALE' when 2 then 'OTHER'
       when 3 then 'PREFER_NOT_TO_SAY' end as gender,
  date '1980-01-01' + cast((c_custkey * 13) % 12000 as int) as dob, c_custkey % 2 = 0 as is_verified
from customer
union all
select -1 - s_suppkey, concat('own-', cast(s_suppkey as string)), concat('+92', cast(s_suppkey as string)),
  s_name, 'OWNER', null, cast(null as date), s_suppkey % 2 = 0
from supplier
""",
    "listings_v": f"""
select p_partkey as id, {owner_of("p_partkey")} as owner_id, p_name as title, p_brand as locality,
  concat(p_type, ' ', p_brand) as address_line,
  case when p_partkey % 4 = 0 then concat('+93', cast(p_partkey as string)) end as contact_phone,
  12.8 + cast((p_partkey * 37) % 400 as double) / 1000 as lat,
  77.5 + cast((p_partkey * 53) % 397 as double) / 1000 as lng,
  case p_size % 4 when 0 then 'MALE' when 1 then 'FEMALE' when 2 then 'COED' end as gender_preference,
  case p_partkey % 7 when 0 then null when 1 then 'HOSTEL' when 2 then 'COLIVING' else 'PG' end as pg_type,
  case p_partkey % 5 when 0 then 'VEG' when 1 then 'NON_VEG' when 2 then 'BOTH' when 3 then 'NONE' end as food_type,
  case (p_partkey * 7 + p_size) % 10 when 8 then 'PAUSED' when 9 then 'DELETED' else 'ACTIVE' end as status,
  cast(cast(p_partkey % 50 as double) / 10 as decimal(2,1)) as avg_rating, cast(p_partkey % 9 as int) as review_count,
  case when p_partkey % 97 = 0 then null
       else cast(date '2023-01-01' + cast(p_partkey % 365 as int) as timestamp) end as created_at
from part
""",
    "rooms_v": """
select p * 10 + l_linenumber as id, p as listing_id,
  case l_linenumber % 5 when 0 then 'SINGLE' when 1 then 'DOUBLE' when 2 then 'TRIPLE' when 3 then 'QUAD' end as sharing_type,
  5000 + cast(floor(min(l_extendedprice)) as int) % 15000 as monthly_rent,
  1 + cast(floor(max(l_quantity)) as int) % 4 as total_beds,
  least(cast(floor(min(l_quantity)) as int) % 4, 1 + cast(floor(max(l_quantity)) as int) % 4) as available_beds,
  case when l_linenumber = 6 then null else 30 end as notice_period_days
from (select *, case when l_partkey % 11 = 0 and l_partkey > 0 then l_partkey - 1 else l_partkey end as p from lineitem) x
group by p, l_linenumber
""",
    "photos_v": """
select distinct p * 10 + l_linenumber as id, p as listing_id,
  concat('https://cdn.example/', cast(p * 10 + l_linenumber as string), '.jpg') as url,
  case when l_linenumber = 5 then null else cast((l_linenumber * 4 + p) % 6 as int) end as display_order
from (select *, case when l_partkey % 7 = 0 and l_partkey > 0 then l_partkey - 1 else l_partkey end as p from lineitem) x
""",
    "amenities_v": """
select * from (values (1,'WiFi','wifi'),(2,'AC','ac_unit'),(3,'Laundry','local_laundry_service'),
 (4,'Parking','local_parking'),(5,'Power Backup','bolt'),(6,'CCTV','videocam'),(7,'Hot Water','shower'),
 (8,'Refrigerator','kitchen'),(9,'Housekeeping','cleaning_services'),(10,'TV','tv'),
 (11,'Gym','fitness_center'),(12,'Food Included','restaurant')) as t(id, name, icon_key)
""",
    "listing_amenities_v": """
select p_partkey as listing_id, a.id as amenity_id from part cross join amenities_v a
where (p_partkey + a.id * a.id) % 4 = 0
""",
    "interactions_v": f"""
select event_id, ts, user_id, event_type, k, {TOUCHED_LISTING} as listing_id
from (select *, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k from events) e
""",
    "favorites_v": """
select user_id, listing_id, min(ts) as created_at from interactions_v
where event_type = 'click' group by user_id, listing_id
""",
    "reviews_v": """
select event_id as id, listing_id, user_id, cast(1 + k % 5 as int) as rating,
  concat('stay ', cast(k as string)) as comment,
  case k % 11 when 0 then true when 1 then null else false end as is_flagged, ts as created_at
from (select *, row_number() over (partition by user_id, listing_id order by ts desc, event_id desc) as rn
      from interactions_v where event_type = 'purchase') r
where rn = 1
""",
    "inquiries_v": """
select user_id as tenant_id, listing_id, min(ts) as created_at, max(ts) as last_attempt_at
from interactions_v where event_type = 'view' group by user_id, listing_id
""",
    "favorite_events_v": """
select event_id, ts, user_id, listing_id, case event_type when 'click' then 'add' else 'remove' end as op
from interactions_v where event_type in ('click', 'error')
""",
    "review_events_v": """
select event_id, ts, user_id, listing_id, case event_type when 'purchase' then 'upsert' else 'delete' end as op,
  case event_type when 'purchase' then cast(1 + k % 5 as int) end as rating,
  case event_type when 'purchase' then concat('stay ', cast(k as string)) end as comment
from interactions_v where event_type in ('purchase', 'signup')
""",
    "inquiry_events_v": """
select event_id, ts, user_id as tenant_id, listing_id from interactions_v where event_type = 'view'
""",
    "user_events_v": """
select event_id, ts, concat('uid-', cast(user_id as string)) as firebase_uid,
  case when event_type = 'signup' and k % 2 = 0 then 'OWNER' else 'TENANT' end as role,
  case when event_type = 'signup' then concat('Name ', cast(k as string)) end as full_name,
  case when event_type = 'signup' and k % 3 = 0 then concat('+94', cast(user_id * 100 + k as string)) end as phone
from interactions_v where event_type in ('signup', 'click')
""",
    "availability_events_v": f"""
select event_id, ts, {owner_of("listing_id")} - case when k % 9 = 0 then 1 else 0 end as actor_id,
  listing_id, listing_id * 10 + 1 + k % 7 as room_id,
  cast(k % 7 as int) - 1 as available_beds
from interactions_v where event_type = 'error'
""",
    "cover_events_v": """
select event_id, ts, listing_id, listing_id * 10 + 1 + k % 6 as photo_id
from interactions_v where event_type = 'signup'
""",
    "search_requests_v": """
select c_custkey as request_id, c_custkey as user_id,
  case when c_custkey % 50 = 0 then 51.5 else 12.8 + cast((c_custkey * 91) % 400 as double) / 1000 end as lat,
  77.5 + cast((c_custkey * 17) % 397 as double) / 1000 as lng,
  case when c_custkey % 75 = 0 then 60.0 else cast(1 + c_custkey % 5 as double) end as radius_km,
  case when c_custkey % 3 = 0 then 6000 end as min_rent, case when c_custkey % 2 = 0 then 12000 end as max_rent,
  case c_custkey % 6 when 0 then 'male' when 1 then 'FEMALE' when 2 then 'co-ed' else null end as gender,
  case c_custkey % 9 when 0 then 'veg' when 1 then 'non-veg' when 2 then '' else null end as food,
  case c_custkey % 8 when 0 then 'Coliving' else null end as pg_type,
  case when c_custkey % 75 = 0 then 28 else cast(c_custkey % 3 as int) end as page,
  case when c_custkey % 75 = 0 then 50 else case c_custkey % 10 when 0 then 0 when 1 then 100 else 5 end end as size
from customer
""",
    "listing_drafts_v": f"""
select p_partkey as draft_id, {owner_of("p_partkey")} as owner_id,
  case when p_partkey % 17 = 0 then '  ' else p_name end as title,
  case when p_partkey % 19 = 0 then '' else concat(p_type, ' road') end as address_line, p_brand as locality,
  case when p_partkey % 23 = 0 then 'ANY' when p_partkey % 2 = 0 then 'MALE' else 'COED' end as gender_preference,
  case when p_partkey % 29 = 0 then 'pg' else 'PG' end as pg_type, 'VEG' as food_type,
  case when p_partkey % 31 = 0 then 91.0 else 12.9 end as latitude, 77.6 as longitude,
  case when p_partkey % 37 = 0 then 99 else 1 + cast(p_partkey % 12 as int) end as amenity_id
from part
""",
    "draft_rooms_v": """
select id, listing_id as draft_id, row_number() over (partition by listing_id order by id) - 1 as pos,
  coalesce(sharing_type, case when id % 3 = 0 then 'PENTA' else 'SINGLE' end) as sharing_type,
  case when id % 41 = 0 then 0 else monthly_rent end as monthly_rent, total_beds,
  case when id % 43 = 0 then total_beds + 1 else available_beds end as available_beds
from rooms_v
""",
    "photo_meta_v": """
select l_partkey as listing_id, l_orderkey * 10 + l_linenumber as upload_key, min(l_shipdate) as uploaded_at,
  case when l_orderkey % 7 = 0 then 'application/pdf' else 'image/jpeg' end as content_type,
  concat('p', cast(l_orderkey as string), case l_orderkey % 5 when 0 then '.JPG' when 1 then '.webp'
    when 2 then '.gif' when 3 then '' else '.tar.png' end) as file_name,
  case l_orderkey % 3 when 0 then 5242880 when 1 then 5242881 else 1000 end as size_bytes
from lineitem group by l_partkey, l_orderkey, l_linenumber
""",
}

# Loads with broken rows, for the audits: repeated keys, dangling references,
# values outside their domain, missing values.
VIEWS |= {
    "favorites_load_v": """
select case when k % 17 = 0 then null else user_id end as user_id, k * 25 as listing_id, ts as created_at
from interactions_v where event_type = 'click'
""",
    "reviews_load_v": """
select event_id - event_id % 3 as id, case when k % 19 = 0 then null else k * 25 end as listing_id,
  user_id * 12 as user_id, case when k % 13 = 0 then null else cast(k % 7 as int) end as rating, ts as created_at
from interactions_v where event_type = 'purchase'
""",
    "inquiries_load_v": """
select event_id as id, k * 25 as listing_id, user_id as tenant_id,
  case k % 4 when 0 then 'PENDING' when 1 then 'CLOSED' when 2 then 'OPEN' end as status,
  case when k % 23 = 0 then null else ts end as last_attempt_at
from interactions_v where event_type = 'view'
""",
    "rooms_load_v": """
select case when id % 47 = 0 then id - 1 else id end as id, draft_id as listing_id, sharing_type,
  case when id % 53 = 0 then null else monthly_rent end as monthly_rent, total_beds, available_beds
from draft_rooms_v
""",
    "users_load_v": """
select id, firebase_uid, case when id % 31 = 0 then '+910000000000' else phone end as phone, full_name,
  case when id % 37 = 0 then 'ADMIN' else role end as role,
  case when id % 41 = 0 then 'N/A' else gender end as gender
from users_v
""",
    "listings_load_v": """
select id, case when id % 59 = 0 then 99 - id * 1000 else owner_id end as owner_id,
  case when id % 61 = 0 then null else title end as title, address_line, locality, 'Bengaluru' as city, lat, lng,
  case when id % 67 = 0 then 'ANY' else gender_preference end as gender_preference, pg_type, food_type, status
from listings_v
""",
}

# The same rows without a cross join: the twelve amenity ids are exploded per part.
SPARK_FORMS = {
    "listing_amenities_v": """
select listing_id, amenity_id from (select p_partkey as listing_id, explode(sequence(1, 12)) as amenity_id from part)
where (listing_id + amenity_id * amenity_id) % 4 = 0
""",
}

BASE_TABLES = ("customer", "supplier", "part", "orders", "lineitem", "events")


def _needs(sql: str) -> list[str]:
    return [name for name in VIEWS if re.search(rf"\b{name}\b", sql)]


def with_views(sql: str, head: str = "", views: dict[str, str] = VIEWS) -> str:
    """Prefix ``sql`` with the views it mentions, directly or through other views."""
    wanted: set[str] = set()
    todo = _needs(sql)
    while todo:
        name = todo.pop()
        if name not in wanted:
            wanted.add(name)
            todo.extend(_needs(views[name]))
    parts = ([head] if head else []) + [
        f"{name} as ({views[name].strip()})" for name in VIEWS if name in wanted
    ]
    return f"with {', '.join(parts)} {sql.strip()}" if parts else sql.strip()


def _scan(table: str, sf_dir: str) -> str:
    source = f"parquet.`{sf_dir.rstrip('/')}/{table}.parquet`"
    if table == "events":
        columns = "event_id, cast(ts as timestamp) as ts, user_id, event_type, value, props"
    elif table == "lineitem":
        columns = (
            "l_orderkey, l_partkey, l_linenumber, l_quantity, l_extendedprice, "
            "cast(l_shipdate as timestamp) as l_shipdate"
        )
    else:
        columns = "*"
    return f"{table} as (select {columns} from {source})"


class Fixtures:
    """The derived tables of one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = tune(spark)
        self.sf_dir = sf_dir

    def view(self, name: str) -> DataFrame:
        return self.sql(f"select * from {name}")

    def sql(self, text: str) -> DataFrame:
        views = VIEWS | SPARK_FORMS
        body = with_views(text, views=views)
        used = [t for t in BASE_TABLES if re.search(rf"\b{t}\b", body)]
        return self.spark.sql(
            with_views(text, ", ".join(_scan(t, self.sf_dir) for t in used), views)
        )

    @property
    def users(self) -> DataFrame:
        return conform(self.view("users_v"), "users")

    @property
    def listings(self) -> DataFrame:
        return conform(self.view("listings_v"), "listings")

    @property
    def rooms(self) -> DataFrame:
        return conform(self.view("rooms_v"), "room_options")

    @property
    def photos(self) -> DataFrame:
        view = self.view("photos_v").withColumn("thumbnail_url", F.col("url"))
        return conform(view, "listing_photos")

    @property
    def amenities(self) -> DataFrame:
        return amenity_table(self.spark)

    @property
    def links(self) -> DataFrame:
        return self.view("listing_amenities_v")

    @property
    def favorites(self) -> DataFrame:
        return conform(self.view("favorites_v"), "favorites")

    @property
    def reviews(self) -> DataFrame:
        return conform(self.view("reviews_v"), "reviews")

    @property
    def inquiries(self) -> DataFrame:
        return self.view("inquiries_v")

    @property
    def requests(self) -> DataFrame:
        return self.view("search_requests_v")

    def event_stream(self) -> DataFrame:
        """The event table as a stream of four micro-batches that each span all of its
        time, so that most events of the later ones are late."""
        path = work_path(self.spark, "events")
        columns = ["event_id", "ts", "user_id", "event_type", "props"]
        events = self.sql("select * from events").select(*columns)
        events.repartitionByRange(4, F.col("event_id") % 4).write.parquet(path)
        return read_events(self.spark, path, events.schema, maxFilesPerTrigger=1)


def interactions(events: DataFrame, listings: int) -> DataFrame:
    """The view ``interactions_v`` as a transformation, for streams."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")
    touched = F.when(F.col("event_id") % 4 == 0, HOT_LISTING).otherwise(
        (F.col("user_id") * 31 + (F.col("k") % 6) * 7) % listings
    )
    return events.withColumn("k", k).select(
        "event_id", "ts", "user_id", "event_type", "k", touched.cast("bigint").alias("listing_id")
    )
