"""Folds of timestamped events into keyed state: (events, prior snapshot) -> snapshot.

Order inside a key is (ts, event_id). Prior rows count as events older than any
event of the same instant. Everything per key is done by combining aggregates, so
a key with a large share of the events never lands on one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staygrid.functions.ratings import rating_of
from staygrid.functions.text import default_phone
from staygrid.operators.enrich import photo_count
from staygrid.operators.quality import (
    accepted,
    validate_availability,
    validate_listings,
    validate_photos,
)
from staygrid.operators.skew import split_join
from staygrid.session import stored

def event_time() -> Column:
    return F.struct("ts", "event_id")


def after_last_reset(events: DataFrame, keys: list[str], resets: Column) -> DataFrame:
    """Events of each key that come after its last reset event."""
    cuts = (
        events.where(resets)
        .groupBy(*keys)
        .agg(F.max(event_time()).alias("_cut"))
    )
    kept = split_join(events.where(~resets), cuts, keys, "left", "event_id")
    return kept.where(F.col("_cut").isNull() | (event_time() > F.col("_cut"))).drop("_cut")


def fold_favorites(events: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """'add' keeps the first created_at, 'remove' deletes, a later add starts anew.

    ``events``: event_id, ts, user_id, listing_id, op.
    """
    keys = ["user_id", "listing_id"]
    log = events.select("event_id", "ts", *keys, "op")
    if prior is not None:
        log = log.unionByName(
            prior.select(
                F.lit(None).cast(log.schema["event_id"].dataType).alias("event_id"),
                F.col("created_at").alias("ts"), *keys, F.lit("add").alias("op"),
            )
        )
    adds = after_last_reset(log, keys, F.col("op") == "remove")
    return adds.groupBy(*keys).agg(F.min_by("ts", event_time()).alias("created_at"))


KEPT_REVIEW_FIELDS = ["id", "stayed_from", "stayed_until", "is_flagged"]


def fold_reviews(events: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Upsert overwrites rating, comment and created_at and keeps the rest; delete
    removes; an upsert after a delete is a new row with fresh defaults.

    ``events``: event_id, ts, user_id, listing_id, op, rating, comment. A new row
    takes its first event's id as id, so a rerun gives the same ids. A row that was
    there before keeps its id, stay dates and moderation flag, also when an event
    with an earlier time comes in late.
    """
    keys = ["user_id", "listing_id"]
    fresh = events.select(
        "event_id", "ts", *keys, "op", "rating", "comment",
        F.col("event_id").alias("id"),
        F.lit(None).cast("date").alias("stayed_from"),
        F.lit(None).cast("date").alias("stayed_until"),
        F.lit(False).alias("is_flagged"), F.lit(1).alias("_age"),
    )
    log = fresh
    if prior is not None:
        log = fresh.unionByName(
            prior.select(
                F.lit(None).cast(fresh.schema["event_id"].dataType).alias("event_id"),
                F.col("created_at").alias("ts"), *keys, F.lit("upsert").alias("op"),
                "rating", "comment", *KEPT_REVIEW_FIELDS, F.lit(0).alias("_age"),
            )
        )
    upserts = after_last_reset(log, keys, F.col("op") == "delete")
    folded = upserts.groupBy(*keys).agg(
        F.min_by(F.struct(*KEPT_REVIEW_FIELDS), F.struct("_age", "ts", "event_id")).alias("_kept"),
        F.max_by(F.struct("rating", "comment", F.col("ts").alias("created_at")), event_time()).alias("_last"),
    )
    return folded.select("_kept.id", *keys, "_last.rating", "_last.comment",
                         "_kept.stayed_from", "_kept.stayed_until", "_kept.is_flagged",
                         "_last.created_at")


def fold_inquiries(events: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """First and latest attempt per (tenant, listing); id, status and message stay.

    Any order and any split of the events gives the same times and texts. A new row
    takes its first event's id.
    """
    keys = ["tenant_id", "listing_id"]
    log = events.select(
        *keys, F.col("ts").alias("created_at"), F.col("ts").alias("last_attempt_at"),
        F.col("event_id").alias("id"),
        F.lit(None).cast("string").alias("message"), F.lit("PENDING").alias("status"),
        F.struct(F.lit(1).alias("age"), "ts", "event_id").alias("_age"),
    )
    if prior is not None:
        log = log.unionByName(
            prior.withColumns(
                {
                    name: F.col(name) if name in prior.columns else F.lit(value).cast(log.schema[name].dataType)
                    for name, value in (("id", None), ("message", None), ("status", "PENDING"))
                }
            ).select(
                *keys, "created_at", "last_attempt_at", "id", "message", "status",
                F.struct(F.lit(0).alias("age"), F.col("created_at").alias("ts"),
                         F.lit(None).cast(events.schema["event_id"].dataType).alias("event_id")).alias("_age"),
            )
        )
    # A prior row's id, message and status win over those of a first attempt.
    return log.groupBy(*keys).agg(
        F.min("created_at").alias("created_at"),
        F.max("last_attempt_at").alias("last_attempt_at"),
        F.min_by(F.struct("id", "message", "status"), "_age").alias("_text"),
    ).select("_text.id", *keys, "_text.message", "_text.status", "created_at", "last_attempt_at")


USER_FIELDS = ["role", "full_name", "email", "gender", "dob", "profile_photo_url", "updated_at"]
USER_KINDS = {"dob": "date", "updated_at": "timestamp"}


def user_candidates(events: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """The earliest event of each (uid, phone): all that can ever create a user.

    Phones are never freed, so a later try with the same phone cannot succeed
    where an earlier one failed. Prior users precede every event.
    """
    log = events.select(
        F.col("firebase_uid"), default_phone("phone", "firebase_uid").alias("phone"),
        *[
            F.col(n) if n in events.columns else F.lit(None).cast(USER_KINDS.get(n, "string")).alias(n)
            for n in USER_FIELDS
        ],
        F.lit(False).alias("is_verified"), F.col("event_id").alias("id"),
        F.struct(F.lit(1).alias("era"), "ts", "event_id").alias("_at"),
    )
    if prior is not None:
        kinds = log.schema["_at"].dataType
        log = log.unionByName(
            prior.select(
                "firebase_uid", "phone",
                *[
                    F.col(n) if n in prior.columns else F.lit(None).cast(log.schema[n].dataType).alias(n)
                    for n in USER_FIELDS
                ],
                F.coalesce("is_verified", F.lit(False)).alias("is_verified"),
                F.col("id") if "id" in prior.columns else F.lit(None).cast(log.schema["id"].dataType).alias("id"),
                F.struct(
                    F.lit(0).alias("era"), F.col("created_at").cast("timestamp").alias("ts"),
                    F.lit(None).cast(kinds["event_id"].dataType).alias("event_id"),
                ).alias("_at"),
            )
        )
    rest = [*USER_FIELDS, "is_verified", "id"]
    return (
        log.groupBy("firebase_uid", "phone")
        .agg(F.min("_at").alias("_at"), F.min_by(F.struct(*rest), "_at").alias("_row"))
        .select("firebase_uid", "phone", "_at", "_row.*")
    )


def fold_users(events: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """The first event of an account wins for every field; a phone that another
    account already holds refuses the event, and the account's next one may succeed.

    ``events``: event_id, ts, firebase_uid, role, full_name, phone. Each round lets
    every account try its earliest open event; a try loses if an earlier try wants
    the same phone, and is struck off. When nobody loses, the tries are the users.
    Equal to handling the events one by one in time order. Without a phone clash
    the first round settles it. Users that were there before keep all they have; a new
    one takes its event's id. Jobs run while the plan is built.
    """
    open_tries = user_candidates(events, prior)
    while True:
        everything = F.struct(*[F.col(n) for n in open_tries.columns if n != "firebase_uid"])
        tries = open_tries.groupBy("firebase_uid").agg(F.min_by(everything, "_at").alias("_t"))
        tries = tries.select("firebase_uid", "_t.*")
        winners = tries.groupBy("phone").agg(F.min("_at").alias("_best"))
        # A phone many accounts ask for is one row in ``winners``.
        losers = split_join(tries, winners, ["phone"], "inner", "firebase_uid").where(
            F.col("_at") > F.col("_best")
        ).select("firebase_uid", "phone")
        lost = stored(losers, "phone-clash")
        if lost.isEmpty():
            return tries.withColumn("created_at", F.col("_at.ts")).drop("_at")
        open_tries = stored(
            open_tries.join(lost, ["firebase_uid", "phone"], "left_anti"), "user-tries"
        )


def refresh_ratings(changed: DataFrame, reviews: DataFrame, listings: DataFrame) -> DataFrame:
    """Listings with ratings recomputed where ``changed`` (listing_id) names them.

    A changed listing whose last review is gone falls back to 0.0 and 0. Reviews
    are summed before the semi join: a much-reviewed listing is one row in it, and
    Catalyst still pushes the semi join down to the scan when ``changed`` is small.
    """
    touched = changed.select(F.col("listing_id").alias("id")).distinct()
    sums = reviews.groupBy(F.col("listing_id").alias("id")).agg(
        F.sum("rating").alias("_sum"), F.count(F.lit(1)).alias("_n")
    )
    fresh = touched.join(sums, "id", "left").na.fill(0, ["_sum", "_n"]).select(
        "id", rating_of(F.col("_sum"), F.col("_n")).alias("_rating"),
        F.col("_n").cast("int").alias("_count"),
    )
    updated = listings.join(fresh, "id", "left")
    hit = F.col("_count").isNotNull()
    return updated.withColumns(
        {
            "avg_rating": F.when(hit, F.col("_rating")).otherwise(F.col("avg_rating")),
            "review_count": F.when(hit, F.col("_count")).otherwise(F.col("review_count")),
        }
    ).drop("_rating", "_count")


def changed_listings(review_events: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Listings whose rating must be recomputed after a review fold: those with an
    upsert, and those that lost a row. A delete that found nothing changes nothing."""
    upserted = review_events.where(F.col("op") == "upsert").select("listing_id")
    keys = ["user_id", "listing_id"]
    removed = before.select(*keys).join(after.select(*keys), keys, "left_anti").select("listing_id")
    return upserted.unionByName(removed).distinct()


# --- owner-side folds --------------------------------------------------------

DRAFT_FIELDS = [
    "title", "description", "address_line", "locality", "city", "pincode", "contact_phone",
    "lat", "lng", "gender_preference", "pg_type", "food_type",
]


def _draft_column(drafts: DataFrame, name: str) -> Column:
    source = {"lat": "latitude", "lng": "longitude"}.get(name, name)
    if source in drafts.columns:
        return F.col(source).alias(name)
    return F.lit("Bengaluru" if name == "city" else None).cast("string").alias(name)


def known_amenities_only(drafts: DataFrame, links: DataFrame, amenities: DataFrame) -> DataFrame:
    """Drafts all of whose amenity ids exist: one unknown id refuses the draft."""
    known = F.broadcast(amenities.select(F.col("id").alias("amenity_id")))
    unknown = links.join(known, "amenity_id", "left_anti").select("draft_id").distinct()
    return drafts.join(unknown, "draft_id", "left_anti")


def apply_listing_creates(
    drafts: DataFrame, rooms: DataFrame, links: DataFrame, amenities: DataFrame
) -> dict[str, DataFrame]:
    """New listings with their rooms and amenity links, all or nothing per draft.

    ``drafts`` (draft_id, owner_id, ts, ...), ``rooms`` (draft_id, pos, ...),
    ``links`` (draft_id, amenity_id). A listing's id is its draft's id and a room's
    is (listing, pos): task retries must not draw new ids.
    """
    good = known_amenities_only(accepted(validate_listings(drafts, rooms)), links, amenities)
    ids = good.select("draft_id")
    listings = good.select(
        F.col("draft_id").alias("id"), "owner_id",
        *[_draft_column(good, n) for n in DRAFT_FIELDS],
        F.lit("ACTIVE").alias("status"), F.lit(0).cast("decimal(2,1)").alias("avg_rating"),
        F.lit(0).alias("review_count"), F.col("ts").alias("created_at"),
        F.col("ts").alias("updated_at"),
    )
    return {
        "listings": listings,
        "room_options": rooms.join(ids, "draft_id", "left_semi").withColumnRenamed("draft_id", "listing_id"),
        "listing_amenities": links.join(ids, "draft_id", "left_semi")
        .select(F.col("draft_id").alias("listing_id"), "amenity_id").distinct(),
    }


def apply_listing_updates(
    drafts: DataFrame,
    rooms: DataFrame,
    links: DataFrame,
    amenities: DataFrame,
    tables: dict[str, DataFrame],
) -> dict[str, DataFrame]:
    """Replace listings: fields overwritten, rooms and links exchanged wholesale.

    ``drafts`` additionally carry listing_id; the last valid draft of a listing
    wins. created_at, status, ratings and owner stay, updated_at moves.
    """
    valid = known_amenities_only(accepted(validate_listings(drafts, rooms)), links, amenities)
    # Only an owner's own existing listing can be replaced.
    own = tables["listings"].select(F.col("id").alias("listing_id"), "owner_id")
    payload = F.struct("draft_id", "ts", *[_draft_column(valid, n) for n in DRAFT_FIELDS])
    last = (
        valid.groupBy("listing_id", "owner_id")
        .agg(F.max_by(payload, F.struct("ts", "draft_id")).alias("_d"))
        .join(own, ["listing_id", "owner_id"], "left_semi")
    )
    patch = last.select(
        F.col("listing_id").alias("id"),
        *[F.col(f"_d.{n}").alias(f"_{n}") for n in DRAFT_FIELDS], F.col("_d.ts").alias("_ts"),
    )
    current = tables["listings"]
    hit = F.col("_ts").isNotNull()
    fields = [n for n in DRAFT_FIELDS if n in current.columns]
    updated = current.join(patch, "id", "left").withColumns(
        {n: F.when(hit, F.col(f"_{n}")).otherwise(F.col(n)) for n in fields}
        | {"updated_at": F.coalesce("_ts", F.col("updated_at") if "updated_at" in current.columns
                                    else F.lit(None).cast("timestamp"))}
    ).drop(*[f"_{n}" for n in DRAFT_FIELDS], "_ts")

    replaced = last.select("listing_id", F.col("_d.draft_id").alias("draft_id"))
    gone = replaced.select("listing_id")
    new_rooms = rooms.join(replaced, "draft_id").drop("draft_id")
    new_links = links.join(replaced, "draft_id").select("listing_id", "amenity_id").distinct()
    old_rooms = tables["room_options"].join(gone, "listing_id", "left_anti")
    old_links = tables["listing_amenities"].join(gone, "listing_id", "left_anti")
    return {
        "listings": updated,
        "room_options": old_rooms.unionByName(new_rooms, allowMissingColumns=True),
        "listing_amenities": old_links.unionByName(new_links),
    }


def apply_soft_deletes(events: DataFrame, listings: DataFrame) -> DataFrame:
    """Status DELETED and a new updated_at; children stay. ``events``: id, ts."""
    last = events.groupBy("id").agg(F.max("ts").alias("_ts"))
    hit = F.col("_ts").isNotNull()
    before = F.col("updated_at") if "updated_at" in listings.columns else F.lit(None).cast("timestamp")
    return listings.join(last, "id", "left").withColumns(
        {
            "status": F.when(hit, F.lit("DELETED")).otherwise(F.col("status")),
            "updated_at": F.coalesce(F.col("_ts"), before),
        }
    ).drop("_ts")


def rooms_with_status(rooms: DataFrame, listings: DataFrame) -> DataFrame:
    """Rooms with the state of the listing they belong to."""
    state = listings.select(
        F.col("id").alias("listing_id"), "owner_id", F.col("status").alias("listing_status")
    )
    return rooms.join(state, "listing_id")


def apply_availability(events: DataFrame, rooms: DataFrame, listings: DataFrame) -> DataFrame:
    """Rooms with available_beds set by the last valid event.

    Validity depends on (actor, listing, room, value) only, so events shrink to the
    latest of each such combination before they meet rooms and listings.
    """
    what = ["actor_id", "listing_id", "room_id", "available_beds"]
    latest = events.groupBy(*what).agg(F.max(event_time()).alias("_at"))
    valid = accepted(validate_availability(latest, rooms, listings))
    final = valid.groupBy(F.col("room_id").alias("id")).agg(
        F.max_by("available_beds", "_at").alias("_beds")
    )
    return rooms.join(final, "id", "left").withColumn(
        "available_beds", F.coalesce("_beds", "available_beds")
    ).drop("_beds")


def apply_photo_inserts(meta: DataFrame, photos: DataFrame) -> DataFrame:
    """The rows that uploads add to ``photos``: at display_order = number of photos so
    far, six at most; the thumbnail is the url."""
    good = accepted(validate_photos(meta, photo_count(photos)))
    return good.select(
        F.col("upload_key").alias("id"), "listing_id",
        F.col("file_name").alias("url"), F.col("file_name").alias("thumbnail_url"),
        "display_order", "uploaded_at",
    )


def apply_photo_deletes(events: DataFrame, photos: DataFrame) -> DataFrame:
    """Photos without the deleted ones; the others keep their order.

    ``events``: listing_id, photo_id; a photo of another listing is not touched.
    """
    gone = events.select("listing_id", F.col("photo_id").alias("id"))
    return photos.join(gone, ["listing_id", "id"], "left_anti")


def apply_cover_change(events: DataFrame, photos: DataFrame) -> DataFrame:
    """Set-cover with at most one event per listing: (listing_id, photo_id).

    Photos ahead of the chosen one move back by one and it takes place 0. An order
    of 0 or NULL makes the event a no-op.
    """
    chosen = photos.join(
        events.select("listing_id", F.col("photo_id").alias("id")), ["listing_id", "id"], "left_semi"
    ).select("listing_id", F.col("id").alias("_chosen"), F.col("display_order").alias("_old"))
    moved = photos.join(chosen.where(F.coalesce("_old", F.lit(0)) != 0), "listing_id", "left")
    order = F.col("display_order")
    return moved.withColumn(
        "display_order",
        F.when(F.col("id") == F.col("_chosen"), F.lit(0))
        .when((order >= 0) & (order < F.col("_old")), order + 1)
        .otherwise(order),
    ).drop("_chosen", "_old")


def apply_cover_changes(events: DataFrame, photos: DataFrame) -> DataFrame:
    """Set-cover with any number of events per listing, in (ts, event_id) order.

    Only the last event of each photo matters: choosing a photo again later makes
    its earlier turn irrelevant to every other photo's place. So events shrink by a
    combining maximum to at most one per photo before they are brought together,
    and a listing's arrays are no longer than its photos (six by the upload rule).
    """
    last = events.groupBy("listing_id", "photo_id").agg(F.max(event_time()).alias("_at"))
    last = last.join(
        photos.select("listing_id", F.col("id").alias("photo_id")), ["listing_id", "photo_id"], "left_semi"
    )
    turns = last.groupBy("listing_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("_at", "photo_id"))), lambda t: t["photo_id"]
        ).alias("_turns")
    )
    shelf = photos.join(turns.select("listing_id"), "listing_id", "left_semi").groupBy("listing_id").agg(
        F.collect_list(F.struct("id", F.col("display_order").alias("place"))).alias("_shelf")
    )

    def take(state: Column, photo: Column) -> Column:
        old = F.element_at(F.filter(state, lambda p: p["id"] == photo), 1)["place"]
        return F.when(
            F.coalesce(old, F.lit(0)) == 0, state
        ).otherwise(
            F.transform(
                state,
                lambda p: F.struct(
                    p["id"].alias("id"),
                    F.when(p["id"] == photo, F.lit(0))
                    .when((p["place"] >= 0) & (p["place"] < old), p["place"] + 1)
                    .otherwise(p["place"]).alias("place"),
                ),
            )
        )

    folded = (
        shelf.join(turns, "listing_id")
        .select("listing_id", F.explode(F.aggregate("_turns", F.col("_shelf"), take)).alias("_p"))
        .select("listing_id", F.col("_p.id").alias("id"), F.col("_p.place").alias("_place"),
                F.lit(True).alias("_seen"))
    )
    return photos.join(folded, ["listing_id", "id"], "left").withColumn(
        "display_order", F.when(F.col("_seen"), F.col("_place")).otherwise(F.col("display_order"))
    ).drop("_place", "_seen")


def insert_absent(
    new: DataFrame, existing: DataFrame, keys: list[str], order: list[str] | None = None
) -> DataFrame:
    """Rows of ``new`` whose key is not there yet, once per key.

    Of several rows with one key the first by ``order`` stays; the values of all
    columns break ties and are the order if none is given.
    """
    rest = [c for c in new.columns if c not in keys]
    once = new.select(*keys).distinct()
    if rest:
        everything = F.struct(*rest)
        place = F.struct(*(order or []), *[c for c in rest if c not in (order or [])])
        once = new.groupBy(*keys).agg(F.min_by(everything, place).alias("_row")).select(*keys, "_row.*")
    return once.join(existing.select(*keys), keys, "left_anti").select(*new.columns)
