"""Every operator as a named query over a folder of test tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staygrid.catalog import inputs
from staygrid.catalog.fixtures import Fixtures, interactions
from staygrid.functions.geo import VINCENTY_PASSES, with_geodesic_m, with_point
from staygrid.operators import enrich, filters, folds, gates, quality, spatial
from staygrid.operators.paging import newest_first
from staygrid.operators.skew import with_group_number
from staygrid.plans import documents, generate, reports, search
from staygrid.session import work_path
from staygrid.sources.drafts import read_drafts
from staygrid.sources.sinks import envelope, read_snapshot, write_documents, write_snapshot
from staygrid.sources.tables import load_tables
from staygrid.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def checkable(df: DataFrame) -> DataFrame:
    """Plain column types, so that two engines print the same values: times as
    microseconds, dates as text, decimals as doubles, distances to a millimetre."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            column = F.unix_micros(column)
        elif isinstance(field.dataType, T.DateType):
            column = column.cast("string")
        elif isinstance(field.dataType, T.DecimalType):
            column = column.cast("double")
        elif field.name == "distance_m":
            column = F.round(column, 3)
        columns.append(column.alias(field.name))
    return df.select(*columns)


def query(body: Callable[[Fixtures], DataFrame]) -> Callable[[Fixtures], DataFrame]:
    """Register a query under the function's name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return checkable(body(Fixtures(spark, sf_dir)))

    QUERIES[body.__name__] = run
    return body


# --- search -----------------------------------------------------------------


@query
def search_point(f):
    return search.search_point(f.listings, f.rooms, f.photos, f.favorites, **inputs.POINT_REQUEST)


@query
def search_point_total(f):
    matches = search.point_matches(f.listings, f.rooms, **inputs.POINT_FILTERS)
    return matches.agg(F.count(F.lit(1)).cast("int").alias("total"))


@query
def search_rent_semi(f):
    found = filters.rent_filter(filters.live(f.listings, "active"), f.rooms, *inputs.RENT_BOUNDS)
    return found.select("id", "title")


@query
def search_category(f):
    found = filters.category_filter(filters.live(f.listings, "active"), **inputs.CATEGORY_REQUEST)
    return filters.display_defaults(found).select(
        "id", "gender_preference", "food_type", "pg_type"
    )


@query
def search_batch_page(f):
    return search.geo_search(f.requests, f.listings, f.rooms, f.photos, f.favorites)


@query
def search_batch_sphere(f):
    return search.geo_search(
        f.requests, f.listings, f.rooms, f.photos, f.favorites, metric="sphere"
    ).select("request_id", "position", "listing_id", "distance_m")


@query
def search_batch_total(f):
    valid = quality.accepted(quality.validate_requests(f.requests))
    return search.match_totals(valid, f.listings, f.rooms)


@query
def search_dense_total(f):
    """Totals with a low limit for dense cells, so that most requests count summaries."""
    valid = quality.accepted(quality.validate_requests(f.requests))
    return search.match_totals(valid, f.listings, f.rooms, dense=64)


@query
def search_dense_page(f):
    """Pages with a low limit for dense cells, so that most requests select by summaries."""
    return search.geo_search(f.requests, f.listings, f.rooms, f.photos, f.favorites, dense=64)


@query
def radius_join_pairs(f):
    asked = f.requests.select(
        "request_id", F.col("lat").alias("req_lat"), F.col("lng").alias("req_lng"),
        (F.col("radius_km") * 1000).alias("radius_m"),
    )
    offered = f.listings.select(F.col("id").alias("listing_id"), "lat", "lng")
    return spatial.radius_join(asked, offered).select("request_id", "listing_id", "distance_m")


@query
def geodesic_distance(f):
    pairs = f.requests.select(
        F.col("request_id").alias("id"), F.col("lat").alias("req_lat"), F.col("lng").alias("req_lng")
    ).join(f.listings.select("id", "lat", "lng"), "id")
    return with_geodesic_m(
        pairs, "req_lat", "req_lng", "lat", "lng", passes=VINCENTY_PASSES
    ).select("id", "distance_m")


@query
def geodesic_far(f):
    """Pairs over the whole globe, up to 150 degrees of longitude apart."""
    return with_geodesic_m(f.sql(inputs.FAR_PAIRS), "req_lat", "req_lng", "lat", "lng").select("id", "distance_m")


@query
def geodesic_antipodal(f):
    """Pairs up to the exact antipode, to the centimetre."""
    found = with_geodesic_m(f.sql(inputs.ANTIPODAL_PAIRS), "req_lat", "req_lng", "lat", "lng", "metres")
    return found.select("id", F.round("metres", 2).alias("metres"))


@query
def normalise_requests(f):
    return filters.normalise_requests(f.sql(inputs.RAW_REQUESTS)).select(
        "request_id", "lat", "lng", "radius_km", "min_rent", "max_rent", "page", "size"
    )


# --- documents ----------------------------------------------------------------


@query
def cover_photo(f):
    return enrich.cover_photo(f.photos)


@query
def min_rent(f):
    return enrich.with_room_stats(f.listings, f.rooms).select("id", "min_rent", "room_count")


@query
def photo_count(f):
    return enrich.photo_count(f.photos)


@query
def listing_core(f):
    core = documents.listing_core(f.listings, f.users).withColumnRenamed("id", "listing_id")
    asked = core.withColumn("user_id", F.col("listing_id") % 150)
    return enrich.with_favorite_flag(asked, f.favorites).select(
        "listing_id", "user_id", "title", "gender_preference", "pg_type", "food_type",
        "avg_rating", "review_count", "status", "owner_id", "owner_name", "owner_phone",
        "owner_verified", "is_favorite",
    )


@query
def listing_rooms(f):
    return enrich.room_options(f.rooms).orderBy("listing_id", "monthly_rent", "id").select(
        "listing_id", "id", "sharing_type", "monthly_rent", "total_beds", "available_beds",
        "notice_period_days",
    )


@query
def listing_photos(f):
    return enrich.photos_ordered(f.photos)


@query
def listing_amenities(f):
    return enrich.with_amenities(f.links, f.amenities).orderBy("listing_id", "name").select(
        "listing_id", "amenity_id", "name", "icon_key"
    )


@query
def recent_reviews(f):
    return enrich.recent_reviews(f.reviews, f.users).select(
        "listing_id", "position", "id", "user_id", "user_name", "rating", "comment", "created_at"
    )


@query
def listing_documents(f):
    """Documents with each array flattened to text, so that SQL can check them."""
    docs = documents.listing_documents(
        f.listings, f.users, f.rooms, f.photos, f.links, f.amenities, f.reviews
    )

    def flat(array: str, *fields: str):
        parts = F.transform(
            array, lambda x: F.concat_ws(":", *[x[n].cast("string") for n in fields])
        )
        return F.array_join(parts, ",").alias(array)

    return docs.select(
        "id", "title", "city", "status", "gender_preference", "avg_rating", "review_count",
        F.col("owner.id").alias("owner_id"), F.col("owner.phone").alias("owner_phone"),
        flat("room_options", "id", "sharing_type", "monthly_rent", "notice_period_days"),
        flat("photos", "id", "url", "display_order"),
        flat("amenities", "id", "name", "icon_key"),
        flat("recent_reviews", "id", "user_id", "rating", "comment"),
    )


# --- reports --------------------------------------------------------------------


@query
def owner_portfolio(f):
    return reports.owner_portfolio(f.listings, f.rooms)


@query
def inquiries_on_listings(f):
    return reports.inquiries_on_listings(f.inquiries, f.listings)


@query
def inquiry_summary(f):
    return reports.inquiry_summary(f.inquiries, f.listings)


@query
def inquirer_estimates(f):
    """The exact count of inquirers, and whether the merged sketches keep to their error."""
    estimated = reports.inquirer_estimates(reports.inquirer_sketches(f.inquiries)).drop("latest")
    exact = f.inquiries.groupBy("listing_id").agg(F.countDistinct("tenant_id").alias("exact"))
    return exact.join(estimated, "listing_id").select(
        "listing_id", "exact", (F.abs(F.col("inquirers") - F.col("exact")) <= reports.SKETCH_ERROR * F.col("exact")).alias("within")
    )


@query
def favorites_list(f):
    return reports.favorites_list(f.favorites, f.listings, f.rooms, f.photos)


@query
def listing_ratings(f):
    return enrich.listing_ratings(f.reviews)


@query
def rating_drift(f):
    return quality.rating_drift(f.listings, f.reviews)


@query
def user_profiles(f):
    return reports.user_profiles(f.users, f.sql(inputs.PROFILE_UIDS))


@query
def status_lookup(f):
    return reports.target_lookup(f.view("cover_events_v"), f.listings, f.photos).select(
        "event_id", "listing_id", "photo_id", "owner_id", "status", "is_active", "photo_count",
        "photo_url", "photo_order",
    )


@query
def only_reviewed(f):
    reviewed = f.reviews.select(F.col("listing_id").alias("id")).distinct()
    return f.listings.join(reviewed, "id", "left_semi").select("id", "title")


@query
def newest_listings(f):
    return filters.live(f.listings, "visible").orderBy(*newest_first("created_at", "id")).select(
        "id", "status", "created_at"
    )


# --- folds ----------------------------------------------------------------------


@query
def fold_favorites(f):
    return folds.fold_favorites(f.view("favorite_events_v"))


@query
def fold_favorites_on_prior(f):
    """January's first half as the prior snapshot, the rest as the event batch."""
    events = f.view("favorite_events_v")
    early = F.col("ts") < F.lit(inputs.SPLIT_TIME).cast("timestamp")
    prior = folds.fold_favorites(events.where(early))
    return folds.fold_favorites(events.where(~early), prior)


@query
def fold_reviews(f):
    return folds.fold_reviews(f.view("review_events_v")).select(
        "id", "user_id", "listing_id", "rating", "comment", "is_flagged", "created_at"
    )


def _second_batch(f, view):
    return f.sql(f"select * from {view} where not ({inputs.FIRST_BATCH})")


@query
def fold_reviews_on_prior(f):
    """Late upserts, resets and flagged rows on top of an earlier snapshot."""
    prior = f.sql(inputs.PRIOR_REVIEWS).withColumns(
        {n: F.lit(None).cast("date") for n in ("stayed_from", "stayed_until")}
    )
    return folds.fold_reviews(_second_batch(f, "review_events_v"), prior).select(
        "id", "user_id", "listing_id", "rating", "comment", "is_flagged", "created_at"
    )


@query
def fold_inquiries_on_prior(f):
    events = _second_batch(f, "inquiry_events_v")
    return folds.fold_inquiries(events, f.sql(inputs.PRIOR_INQUIRIES)).select(
        "id", "tenant_id", "listing_id", "message", "status", "created_at", "last_attempt_at"
    )


@query
def fold_users_on_prior(f):
    """Accounts whose first phone is held by a user that was there before."""
    return folds.fold_users(f.view("user_events_v"), f.sql(inputs.PRIOR_USERS)).select(
        "id", "firebase_uid", "phone", "role", "full_name", "is_verified", "profile_photo_url",
        "created_at", "updated_at",
    )


@query
def inquiry_summary_all(f):
    return reports.inquiry_summary(f.inquiries, f.listings, n=None)


@query
def fold_inquiries(f):
    return folds.fold_inquiries(f.view("inquiry_events_v")).select(
        "id", "tenant_id", "listing_id", "status", "created_at", "last_attempt_at"
    )


@query
def fold_users(f):
    return folds.fold_users(f.view("user_events_v")).select(
        "id", "firebase_uid", "phone", "role", "full_name", "is_verified", "created_at"
    )


@query
def refresh_ratings(f):
    events = f.view("review_events_v")
    after = folds.fold_reviews(events)
    changed = folds.changed_listings(events, f.reviews, after)
    return folds.refresh_ratings(changed, after, f.listings).select(
        "id", "avg_rating", "review_count"
    )


@query
def create_listings(f):
    drafts, rooms, links = inputs.drafts(f)
    made = folds.apply_listing_creates(drafts, rooms, links, f.amenities)
    rooms_made = made["room_options"].groupBy("listing_id").agg(
        F.count(F.lit(1)).cast("int").alias("rooms"), F.sum("monthly_rent").alias("rent_sum")
    )
    links_made = made["listing_amenities"].withColumnRenamed("amenity_id", "amenity")
    return (
        made["listings"].withColumnRenamed("id", "listing_id")
        .join(rooms_made, "listing_id", "left").join(links_made, "listing_id", "left")
        .select("listing_id", "owner_id", "title", "city", "lat", "lng", "status", "avg_rating",
                "review_count", "rooms", "rent_sum", "amenity")
    )


def _replaced(f):
    drafts, rooms, links = inputs.drafts(f)
    drafts = drafts.withColumn("listing_id", F.col("draft_id"))
    tables = {"listings": f.listings, "room_options": f.rooms, "listing_amenities": f.links}
    return folds.apply_listing_updates(drafts, rooms, links, f.amenities, tables)


@query
def replace_listings(f):
    return _replaced(f)["listings"].select(
        "id", "owner_id", "title", "address_line", "lat", "lng", "gender_preference",
        "food_type", "status", "avg_rating", "review_count", "created_at", "updated_at",
    )


@query
def replace_listing_rooms(f):
    return _replaced(f)["room_options"].select(
        "listing_id", "sharing_type", "monthly_rent", "total_beds", "available_beds"
    )


@query
def replace_listing_amenities(f):
    return _replaced(f)["listing_amenities"].select("listing_id", "amenity_id")


@query
def soft_delete(f):
    gone = f.view("cover_events_v").select(F.col("listing_id").alias("id"), "ts")
    return folds.apply_soft_deletes(gone, f.listings).select("id", "status", "updated_at")


@query
def rooms_with_status(f):
    return folds.rooms_with_status(f.rooms, f.listings).select(
        "id", "listing_id", "total_beds", "owner_id", "listing_status"
    )


@query
def set_availability(f):
    return folds.apply_availability(
        f.view("availability_events_v"), f.rooms, f.listings
    ).select("id", "listing_id", "total_beds", "available_beds")


@query
def photo_append(f):
    return folds.apply_photo_inserts(f.view("photo_meta_v"), f.photos).select(
        "listing_id", "id", "url", "display_order"
    )


@query
def photo_delete(f):
    return folds.apply_photo_deletes(f.view("cover_events_v"), f.photos).select(
        "listing_id", "id", "display_order"
    )


@query
def set_cover(f):
    events = f.sql(inputs.ONE_COVER_EVENT)
    return folds.apply_cover_change(events, f.photos).select("listing_id", "id", "display_order")


@query
def set_cover_many(f):
    return folds.apply_cover_changes(f.view("cover_events_v"), f.photos).select(
        "listing_id", "id", "display_order"
    )


@query
def gate_events(f):
    return gates.gate_events(f.sql(inputs.GATE_EVENTS), f.listings, f.users, f.photos).select(
        "event_id", "op", "actor_id", "listing_id", "reason"
    )


@query
def insert_absent(f):
    new = f.view("favorites_load_v").where(F.col("user_id").isNotNull())
    return folds.insert_absent(new, f.favorites, ["user_id", "listing_id"], ["created_at"])


# --- validation -------------------------------------------------------------------


@query
def validate_listings(f):
    drafts, rooms, _ = inputs.drafts(f)
    return quality.validate_listings(drafts, rooms).select("draft_id", "reason")


@query
def validate_reviews(f):
    return quality.validate_reviews(f.sql(inputs.REVIEW_DRAFTS), f.listings).select(
        "draft_id", "listing_id", "rating", F.length("comment").alias("comment_length"), "reason"
    )


@query
def validate_users(f):
    as_of = F.lit(inputs.AS_OF_DATE).cast("date")
    return quality.validate_users(f.sql(inputs.REGISTRATIONS), as_of).select("uid", "role", "reason")


@query
def validate_requests(f):
    return quality.validate_requests(f.sql(inputs.EDGE_REQUESTS)).select(
        "request_id", "radius_km", "page", "size", "reason"
    )


@query
def validate_availability(f):
    return quality.validate_availability(
        f.view("availability_events_v"), f.rooms, f.listings
    ).select("event_id", "reason")


@query
def validate_photos(f):
    return quality.validate_photos(f.view("photo_meta_v"), enrich.photo_count(f.photos)).select(
        "listing_id", "upload_key", "display_order", "reason"
    )


@query
def validate_ids(f):
    return quality.check_id_shape(f.sql(inputs.TEXT_IDS), "id").select("doc_key", "reason")


@query
def draft_ingest(f):
    path = work_path(f.spark, "drafts")
    f.sql(inputs.DRAFT_LINES).write.text(path)
    return read_drafts(f.spark, path).select(
        "title", "city", "latitude", F.size("rooms").alias("rooms"),
        F.try_element_at("rooms", F.lit(1))["notice_period_days"].alias("notice"),
        F.size("amenity_ids").alias("amenities"), "reason",
    )


# --- audits -----------------------------------------------------------------------


@query
def audit_keys(f):
    return quality.audit_keys(inputs.loads(f))


@query
def audit_orphans(f):
    return quality.audit_orphans(inputs.loads(f))


@query
def audit_domains(f):
    return quality.audit_domains(inputs.loads(f))


@query
def audit_nulls(f):
    return quality.audit_nulls(inputs.loads(f))


@query
def cascade_plan(f):
    doomed = {"users": f.sql(inputs.DOOMED_USERS), "listings": f.sql(inputs.DOOMED_LISTINGS)}
    return quality.cascade_plan(inputs.clean_tables(f), doomed)


# --- streams ------------------------------------------------------------------------


def _streamed(f, label, start, shape):
    """Run a stream over the event table to its end; returns the output path."""
    path = work_path(f.spark, label)
    listings = f.sql("select count(*) as n from part").first()["n"]
    start(shape(interactions(f.event_stream(), listings)), path).awaitTermination()
    return path


@query
def stream_inquiries(f):
    path = _streamed(f, "stream-inquiries", jobs.stream_inquiries, inputs.inquiry_events)
    return jobs.read_inquiries(f.spark, path)


@query
def stream_favorites(f):
    path = _streamed(f, "stream-favorites", jobs.stream_favorites, inputs.favorite_events)
    return jobs.read_favorites(f.spark, path)


@query
def stream_reviews(f):
    path = _streamed(f, "stream-reviews", jobs.stream_reviews, inputs.review_events)
    return jobs.read_reviews(f.spark, path).select(
        "id", "user_id", "listing_id", "rating", "comment", "is_flagged", "created_at"
    )


@query
def stream_users(f):
    path = _streamed(f, "stream-users", jobs.stream_users, inputs.user_events)
    return jobs.read_users(f.spark, path).select(
        "firebase_uid", "phone", "role", "full_name", "is_verified", "created_at"
    )


@query
def stream_ratings(f):
    path = _streamed(f, "stream-ratings", jobs.stream_ratings, inputs.review_events)
    return jobs.read_ratings(f.spark, path)


@query
def stream_inquiry_summary(f):
    path = _streamed(f, "stream-summary", jobs.stream_inquiries, inputs.inquiry_events)
    return jobs.read_inquiry_summary(f.spark, path, f.listings)


@query
def stream_favorites_compacted(f):
    """The favourite log folded into a base twice, the second time over its own result."""
    path = _streamed(f, "stream-compact", jobs.stream_favorites, inputs.favorite_events)
    for _ in range(2):
        jobs.compact(f.spark, path, jobs.retain_favorites)
    return jobs.read_favorites(f.spark, path)


# --- sources and sinks ---------------------------------------------------------------


@query
def event_source(f):
    """The event folder read as a stream, counted per type."""
    path = work_path(f.spark, "event-source")
    counted = f.event_stream().groupBy("event_type").count()

    def keep(batch, epoch):
        batch.write.mode("overwrite").parquet(f"{path}/out/epoch={epoch}")

    counted.writeStream.outputMode("complete").foreachBatch(keep).option(
        "checkpointLocation", f"{path}/checkpoint"
    ).trigger(availableNow=True).start().awaitTermination()
    rows = f.spark.read.parquet(f"{path}/out")
    return rows.groupBy("event_type").agg(F.max_by("count", "epoch").alias("events"))


@query
def table_scan(f):
    """Tables written in their own layout and read by the typed scan."""
    path = work_path(f.spark, "tables")
    for name, df in inputs.clean_tables(f).items():
        df.write.parquet(f"{path}/{name}")
    tables = load_tables(f.spark, path)
    return reduce(
        DataFrame.unionByName,
        [df.agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("rows")) for n, df in tables.items()],
    )


@query
def document_roundtrip(f):
    """Documents written as JSON lines and read back."""
    path = work_path(f.spark, "documents")
    write_documents(
        documents.listing_documents(
            f.listings, f.users, f.rooms, f.photos, f.links, f.amenities, f.reviews
        ), path,
    )
    shape = ("id long, title string, room_options array<struct<id:long>>, photos array<struct<id:long>>, "
             "amenities array<struct<id:long>>")
    return f.spark.read.schema(shape).json(path).select(
        "id", "title", F.size("room_options").alias("rooms"), F.size("photos").alias("photos"),
        F.size("amenities").alias("amenities"),
    )


@query
def snapshot_roundtrip(f):
    """Two versions of two tables; the older one is read back by number."""
    path = work_path(f.spark, "snapshots")
    first = write_snapshot({"favorites": f.favorites, "reviews": f.reviews}, path)
    write_snapshot({"favorites": f.favorites.limit(0), "reviews": f.reviews.limit(0)}, path)
    return read_snapshot(f.spark, path, "favorites", first)


@query
def listing_cells(f):
    """Listings stored from (longitude, latitude) drafts, counted per grid cell."""
    drafts = f.listings.select("id", F.col("lng").alias("longitude"), F.col("lat").alias("latitude"))
    return spatial.grid_columns(with_point(drafts), 2).groupBy("cell_lat", "cell_lng").agg(
        F.count(F.lit(1)).alias("listings")
    )


@query
def search_envelope(f):
    """One response per valid request, empty pages included."""
    valid = quality.accepted(quality.validate_requests(f.requests))
    rows, found = search.search_pages(valid, f.listings, f.rooms)
    totals = valid.select("request_id", "page", "size").join(found, "request_id")
    return envelope(totals, rows, "request_id", ["listing_id"]).select(
        "request_id", F.size("data").alias("rows"), "meta.page", "meta.size", "meta.total",
        F.try_element_at("data", F.lit(1))["listing_id"].alias("first_listing"),
    )


@query
def documents_for(f):
    """Documents of the listings each user has as favourites, and of one more."""
    asked = f.favorites.select("user_id", "listing_id").unionByName(
        f.favorites.select("user_id", (F.col("listing_id") + 1).alias("listing_id"))
    ).distinct()
    found = documents.documents_for(
        asked, f.listings, f.users, f.rooms, f.photos, f.links, f.amenities, f.reviews, f.favorites
    )
    return found.select(
        "user_id", "listing_id", "is_favorite", "title", F.size("room_options").alias("rooms"),
        F.size("photos").alias("photos"), F.size("recent_reviews").alias("reviews"),
    )


# --- generators -----------------------------------------------------------------------


def _comment_pool(f):
    """The comments numbered within their rating by a distributed sort."""
    texts = f.sql("select cast(1 + c_custkey % 5 as int) as rating, c_custkey, "
                  "concat('comment ', cast(c_custkey as string)) as comment from customer")
    return with_group_number(texts, ["rating"], ["c_custkey"], "ord").select("rating", "ord", "comment")


def _backfill(f):
    return generate.backfill_reviews(
        f.sql(inputs.RATING_TARGETS).withColumn("ratings", F.split("ratings", ",").cast("array<int>")),
        f.listings, f.users.where(F.col("firebase_uid").startswith("uid-")),
        _comment_pool(f), f.reviews, F.lit(inputs.AS_OF_TIME).cast("timestamp"),
    )


@query
def backfill_reviews(f):
    return _backfill(f)


@query
def backfill_ratings(f):
    return generate.backfilled_ratings(f.reviews, _backfill(f), f.listings)


@query
def generate_rooms(f):
    return generate.generate_rooms(f.listings, inputs.SEED)


@query
def generate_links(f):
    return generate.generate_links(f.listings, f.amenities, inputs.SEED)
