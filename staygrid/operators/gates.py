"""Authority and target-state gates: every event gets its refusal reason or NULL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staygrid.operators.quality import first_reason

# What each operation asks for: the actor's role, ownership of the listing, an
# ACTIVE listing, an existing listing, a photo of that listing.
RULES: dict[str, dict[str, object]] = {
    "review": {"role": "TENANT", "exists": True, "active": True},
    "review_delete": {"role": "TENANT"},
    "inquiry": {"role": "TENANT", "exists": True, "active": True},
    "favorite_add": {"exists": True, "active": True},
    "favorite_remove": {},
    "availability": {"role": "OWNER", "exists": True, "owns": True, "active": True},
    "edit": {"role": "OWNER", "exists": True, "owns": True},
    "soft_delete": {"role": "OWNER", "exists": True, "owns": True},
    "photo_upload": {"role": "OWNER", "exists": True, "owns": True},
    "photo_delete": {"role": "OWNER", "exists": True, "owns": True, "photo": True},
    "cover": {"role": "OWNER", "exists": True, "owns": True, "photo": True, "active": True},
}


def gate_events(
    events: DataFrame, listings: DataFrame, users: DataFrame, photos: DataFrame | None = None
) -> DataFrame:
    """``events`` (op, actor_id, listing_id, and photo_id where asked for) + ``reason``.

    Checks run in a fixed order: registered, role, listing exists, ownership, photo
    exists, ACTIVE. Favourite operations create the account on contact, so they
    need no registration.
    """
    actors = users.select(F.col("id").alias("actor_id"), F.col("role").alias("_role"))
    targets = listings.select(
        F.col("id").alias("listing_id"), F.col("owner_id").alias("_owner"),
        F.col("status").alias("_status"), F.lit(True).alias("_found"),
    )
    known = events.join(targets, "listing_id", "left").join(actors, "actor_id", "left")
    if photos is not None and "photo_id" in events.columns:
        shelf = photos.select("listing_id", F.col("id").alias("photo_id"), F.lit(True).alias("_photo"))
        known = known.join(shelf, ["listing_id", "photo_id"], "left")
    else:
        known = known.withColumn("_photo", F.lit(None).cast("boolean"))

    def asks(what: str):
        return F.col("op").isin(*[op for op, rule in RULES.items() if what in rule])

    def role_of(role: str):
        return F.col("op").isin(*[op for op, rule in RULES.items() if rule.get("role") == role])

    wrong_role = (role_of("TENANT") & ~F.col("_role").eqNullSafe("TENANT")) | (
        role_of("OWNER") & ~F.col("_role").eqNullSafe("OWNER")
    )
    reason = first_reason(
        (~F.col("op").isin(*RULES), "unknown operation"),
        (asks("role") & F.col("_role").isNull(), "not registered"),
        (wrong_role, "wrong role"),
        (asks("exists") & F.col("_found").isNull(), "listing not found"),
        (asks("owns") & ~F.col("_owner").eqNullSafe(F.col("actor_id")), "not the owner"),
        (asks("photo") & F.col("_photo").isNull(), "photo not found"),
        (asks("active") & ~F.col("_status").eqNullSafe("ACTIVE"), "listing not active"),
    )
    return known.withColumn("reason", reason).drop("_role", "_owner", "_status", "_found", "_photo")
