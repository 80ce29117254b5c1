"""Continuous folds with Structured Streaming.

Each job appends what a micro-batch adds to a log of epoch folders and leaves the
fold to the reader: writing costs as much as the batch, not as the state, and
replaying a batch after a failure overwrites its own folder. An epoch counts once
its folder is complete (Spark's success marker). ``compact`` folds the complete
epochs into one published version and removes those an earlier version already
holds, so the log stays about as small as the state. No job keeps a state store.
Order is event time, never arrival, so late events land where they belong.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce as reduce_frames

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from staygrid.operators.enrich import listing_ratings
from staygrid.operators.folds import (
    event_time,
    after_last_reset,
    fold_favorites,
    fold_reviews,
    fold_users,
)
from staygrid.plans.reports import inquiry_summary
from staygrid.sources.sinks import names_under, read_snapshot, remove, versions, write_snapshot

Reduce = Callable[[DataFrame], DataFrame]


def _start(stream: DataFrame, path: str, write: Callable[[DataFrame, int], None], mode: str) -> StreamingQuery:
    return (
        stream.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def _append_epoch(df: DataFrame, path: str, epoch: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/log/epoch={epoch}")


def log_stream(stream: DataFrame, path: str, reduce: Reduce) -> StreamingQuery:
    """Append each micro-batch, reduced to what can still matter, as one epoch."""
    return _start(
        stream, path, lambda batch, epoch: _append_epoch(reduce(batch), path, epoch), "append"
    )


def finished_epochs(spark: SparkSession, path: str) -> list[int]:
    """Epochs whose folder is complete, in order; the one being written is not."""
    return sorted(
        int(name.split("=")[1]) for name in names_under(spark, f"{path}/log/epoch=*")
        if names_under(spark, f"{path}/log/{name}/_SUCCESS")
    )


def _compacted_to(spark: SparkSession, path: str, version: int) -> int:
    return read_snapshot(spark, f"{path}/base", "upto", version).first()["epoch"]


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All rows that can still matter: the compacted base and the epochs after it."""
    published = versions(spark, f"{path}/base")
    upto = _compacted_to(spark, path, published[-1]) if published else -1
    later = [f"{path}/log/epoch={e}" for e in finished_epochs(spark, path) if e > upto]
    parts = [read_snapshot(spark, f"{path}/base", "log", published[-1])] if published else []
    if later or not parts:
        parts.append(spark.read.option("basePath", f"{path}/log").parquet(*later).drop("epoch"))
    return reduce_frames(DataFrame.unionByName, parts)


def compact(spark: SparkSession, path: str, reduce: Reduce) -> int:
    """Publish base and complete epochs as one new version; returns its number.

    The epochs are listed once, before anything is read. Those the version before held
    already are removed afterwards; a reader that has just begun still finds its own.
    """
    published = versions(spark, f"{path}/base")
    before = _compacted_to(spark, path, published[-1]) if published else -1
    epochs = finished_epochs(spark, path)
    upto = spark.createDataFrame([(max([before, *epochs]),)], "epoch long")
    number = write_snapshot({"log": reduce(read_log(spark, path)), "upto": upto}, f"{path}/base")
    for epoch in epochs:
        if epoch <= before:
            remove(spark, f"{path}/log/epoch={epoch}")
    return number


# --- what each fold has to remember ------------------------------------------


def _last_reset_and_later(events: DataFrame, reset: str) -> DataFrame:
    """Per key the last reset event and everything after it."""
    keys = ["user_id", "listing_id"]
    resets = events.where(F.col("op") == reset)
    everything = F.struct(*events.columns)
    last = resets.groupBy(*keys).agg(F.max_by(everything, event_time()).alias("_e")).select("_e.*")
    later = after_last_reset(events, keys, F.col("op") == reset)
    return last.unionByName(later)


def retain_favorites(events: DataFrame) -> DataFrame:
    return _last_reset_and_later(events, "remove")


def retain_reviews(events: DataFrame) -> DataFrame:
    return _last_reset_and_later(events, "delete")


def retain_users(events: DataFrame) -> DataFrame:
    """The earliest event per account and phone."""
    everything = F.struct(*events.columns)
    return (
        events.withColumn("_phone", F.coalesce("phone", F.lit("")))
        .groupBy("firebase_uid", "_phone")
        .agg(F.min_by(everything, event_time()).alias("_e"))
        .select("_e.*")
    )


# --- jobs ---------------------------------------------------------------------


def stream_favorites(events: DataFrame, path: str) -> StreamingQuery:
    return log_stream(events, path, retain_favorites)


def read_favorites(spark: SparkSession, path: str) -> DataFrame:
    return fold_favorites(read_log(spark, path))


def stream_reviews(events: DataFrame, path: str) -> StreamingQuery:
    return log_stream(events, path, retain_reviews)


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    return fold_reviews(read_log(spark, path))


def stream_users(events: DataFrame, path: str) -> StreamingQuery:
    return log_stream(events, path, retain_users)


def read_users(spark: SparkSession, path: str) -> DataFrame:
    return fold_users(read_log(spark, path))


def first_and_last(rows: DataFrame) -> DataFrame:
    """First and latest attempt per (tenant, listing); applies to its own result again."""
    return rows.groupBy("tenant_id", "listing_id").agg(
        F.min("created_at").alias("created_at"), F.max("last_attempt_at").alias("last_attempt_at")
    )


def stream_inquiries(events: DataFrame, path: str) -> StreamingQuery:
    """First and latest attempt per (tenant, listing).

    Minimum and maximum commute, so each micro-batch is reduced by itself and the rows
    can be combined in any order; no state is kept.
    """
    timed = events.select(
        "tenant_id", "listing_id", F.col("ts").alias("created_at"), F.col("ts").alias("last_attempt_at")
    )
    return log_stream(timed, path, first_and_last)


def read_inquiries(spark: SparkSession, path: str) -> DataFrame:
    return first_and_last(read_log(spark, path))


def read_inquiry_summary(spark: SparkSession, path: str, listings: DataFrame) -> DataFrame:
    """The owners' summary over the continuously kept inquiries."""
    return inquiry_summary(read_inquiries(spark, path), listings)


# Reviews of the rating job lie in this many folders per epoch, by listing, so that a
# micro-batch reads the folders of the listings it touches.
BUCKETS = 64


def _bucketed(df: DataFrame) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64("listing_id"), F.lit(BUCKETS)).cast("int"))


def stream_ratings(events: DataFrame, path: str) -> StreamingQuery:
    """Reviews as above, and after each micro-batch the ratings of the listings it
    touched, as one more epoch of a rating log."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        kept = _bucketed(retain_reviews(batch))
        kept.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/log/epoch={epoch}")
        touched = _bucketed(batch.select("listing_id").distinct())
        buckets = [r["bucket"] for r in touched.select("bucket").distinct().collect()]
        log = read_log(spark, path).where(F.col("bucket").isin(*buckets)).drop("bucket")
        reviews = fold_reviews(log.join(touched.select("listing_id"), "listing_id", "left_semi"))
        rated = touched.join(listing_ratings(reviews), "listing_id", "left").select(
            "listing_id",
            F.coalesce("avg_rating", F.lit(0).cast("decimal(2,1)")).alias("avg_rating"),
            F.coalesce("review_count", F.lit(0)).alias("review_count"),
        )
        rated.write.mode("overwrite").parquet(f"{path}/ratings/epoch={epoch}")

    return _start(events, path, write, "append")


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """The newest epoch's rating of every listing ever touched."""
    rated = spark.read.parquet(f"{path}/ratings")
    return rated.groupBy("listing_id").agg(
        F.max_by(F.struct("avg_rating", "review_count"), "epoch").alias("_r")
    ).select("listing_id", "_r.avg_rating", "_r.review_count")
