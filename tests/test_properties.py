"""Laws that hold for any input: brute force, replays, splits, streams."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from staygrid.functions.geo import within
from staygrid.operators import folds, quality
from staygrid.operators.paging import page_per_request
from staygrid.operators.skew import split_join, with_group_number, with_row_number
from staygrid.operators.spatial import radius_join
from staygrid.sources.sinks import read_snapshot, versions, write_snapshot
from staygrid.streaming import jobs

START = dt.datetime(2024, 1, 1)


def points(spark, rng, n, key, lat, lng, box):
    rows = [(i, rng.uniform(*box[0]), rng.uniform(*box[1])) for i in range(n)]
    # A third of all points share one place.
    rows = [(i, *( (12.95, 77.6) if i % 3 == 0 else (a, b))) for i, a, b in rows]
    return spark.createDataFrame(rows, f"{key} long, {lat} double, {lng} double")


@pytest.mark.parametrize("per_task", [7, 50_000])
@pytest.mark.parametrize("radii", [[0.0, 300.0, 2500.0], [5_000.0, 80_000.0], [900_000.0, 6_000_000.0]])
def test_radius_join_is_brute_force(spark, radii, per_task):
    rng = random.Random(4)
    box = ((12.7, 13.2), (77.4, 77.9)) if max(radii) < 1e5 else ((8.0, 37.0), (68.0, 98.0))
    requests = points(spark, rng, 60, "request_id", "req_lat", "req_lng", box)
    requests = requests.withColumn(
        "radius_m", F.element_at(F.array(*[F.lit(r) for r in radii]), (F.col("request_id") % len(radii) + 1).cast("int"))
    )
    listings = points(spark, rng, 120, "listing_id", "lat", "lng", box)
    got = radius_join(requests, listings, pairs_per_cell_task=per_task)
    want = within(requests.crossJoin(listings), "req_lat", "req_lng", "lat", "lng", "radius_m")
    columns = ["request_id", "listing_id", "distance_m"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_pages_partition_the_matches(spark):
    rng = random.Random(5)
    rows = [(r, i, round(rng.uniform(0, 1000), 0 if i % 2 else 3)) for r in range(2) for i in range(1400)]
    matches = spark.createDataFrame(rows, "request_id long, listing_id long, distance_m double")
    asked = [(r, 1000.0, p, 50) for r in range(2) for p in (0, 3, 19, 20, 27, 28)]
    want, got = {}, {}
    for r, radius, p, size in asked:
        ranked = sorted((d, i) for q, i, d in rows if q == r)[p * size:(p + 1) * size]
        want[(r, p)] = [(p * size + k + 1, i, 1400) for k, (_, i) in enumerate(ranked)]
    for p in {p for _, _, p, _ in asked}:
        here = spark.createDataFrame([a for a in asked if a[2] == p], "request_id long, radius_m double, page int, size int")
        found = page_per_request(matches, here.drop("radius_m"))
        for row in found.collect():
            got.setdefault((row["request_id"], p), []).append((row["position"], row["listing_id"], row["total"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_numbering_without_a_single_task(spark):
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("k"), (F.col("id") % 3 % 2).alias("g"))
    got = with_group_number(with_row_number(df, ["k"], "n"), ["g"], ["k"], "m")
    want = df.withColumn("n", F.row_number().over(Window.orderBy("k"))).withColumn(
        "m", F.row_number().over(Window.partitionBy("g").orderBy("k"))
    )
    assert sorted(map(tuple, got.select("k", "g", "n", "m").collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_split_join_equals_join(spark, how):
    many = spark.range(300).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 9).alias("k"), F.col("id").alias("v"))
    one = spark.range(6).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    got = split_join(many, one, ["k"], how, "v", rows_per_split=20)
    assert sorted(map(str, got.select("k", "v", "w").collect())) == sorted(
        map(str, many.join(one, "k", how).select("k", "v", "w").collect())
    )


def events(spark, rng, n, ops):
    rows = [
        (i, START + dt.timedelta(minutes=rng.randrange(200)), rng.randrange(4), rng.randrange(3),
         rng.choice(ops), rng.randrange(1, 6), f"c{i}")
        for i in range(n)
    ]
    return rows, spark.createDataFrame(
        rows, "event_id long, ts timestamp, user_id long, listing_id long, op string, rating int, comment string"
    )


def replay_favorites(rows):
    state = {}
    for e, ts, u, l, op, *_ in sorted(rows, key=lambda r: (r[1], r[0])):
        if op == "add":
            state.setdefault((u, l), ts)
        else:
            state.pop((u, l), None)
    return state


def replay_reviews(rows):
    state = {}
    for e, ts, u, l, op, rating, comment in sorted(rows, key=lambda r: (r[1], r[0])):
        if op == "upsert":
            first = state.get((u, l), (e,))[0]
            state[(u, l)] = (first, rating, comment, ts)
        else:
            state.pop((u, l), None)
    return state


@pytest.mark.parametrize("seed", range(3))
def test_favourite_fold_is_a_replay_and_splits(spark, seed):
    rows, log = events(spark, random.Random(seed), 120, ["add", "add", "remove"])
    want = replay_favorites(rows)

    def state(df):
        return {(r["user_id"], r["listing_id"]): r["created_at"] for r in df.collect()}

    assert state(folds.fold_favorites(log)) == want
    cut = F.col("ts") < F.lit(START + dt.timedelta(minutes=100))
    prior = folds.fold_favorites(log.where(cut))
    assert state(folds.fold_favorites(log.where(~cut), prior)) == want


@pytest.mark.parametrize("seed", range(3))
def test_review_fold_is_a_replay_and_splits(spark, seed):
    rows, log = events(spark, random.Random(seed), 120, ["upsert", "upsert", "delete"])
    want = replay_reviews(rows)

    def state(df):
        return {(r["user_id"], r["listing_id"]): (r["id"], r["rating"], r["comment"], r["created_at"]) for r in df.collect()}

    assert state(folds.fold_reviews(log)) == want
    cut = F.col("ts") < F.lit(START + dt.timedelta(minutes=100))
    prior = folds.fold_reviews(log.where(cut))
    assert state(folds.fold_reviews(log.where(~cut), prior)) == want


@pytest.mark.parametrize("seed", range(3))
def test_user_fold_handles_phone_clashes_like_a_replay(spark, seed):
    rng = random.Random(seed)
    rows = [
        (i, START + dt.timedelta(minutes=rng.randrange(30)), f"u{rng.randrange(8)}", rng.choice(["TENANT", "OWNER"]),
         f"n{i}", rng.choice([None, "p1", "p2", "p3", "email:u1"]))
        for i in range(25)
    ]
    want, phones = {}, set()
    for e, ts, uid, role, name, phone in sorted(rows, key=lambda r: (r[1], r[0])):
        phone = phone or f"email:{uid}"
        if uid not in want and phone not in phones:
            want[uid] = (phone, role, name)
            phones.add(phone)
    log = spark.createDataFrame(rows, "event_id long, ts timestamp, firebase_uid string, role string, full_name string, phone string")
    got = {r["firebase_uid"]: (r["phone"], r["role"], r["full_name"]) for r in folds.fold_users(log).collect()}
    assert got == want


def replay_covers(photos, turns):
    state = dict(photos)
    for _, _, listing, photo in sorted(turns, key=lambda t: (t[1], t[0])):
        old = state.get((listing, photo))
        if not old:
            continue
        for key, order in state.items():
            if key[0] == listing and order is not None and 0 <= order < old:
                state[key] = order + 1
        state[(listing, photo)] = 0
    return state


@pytest.mark.parametrize("seed", range(4))
def test_set_cover_is_a_replay(spark, seed):
    rng = random.Random(seed)
    photos = {(l, p): rng.choice([None, 0, 0, 1, 2, 3, 3, 5]) for l in range(6) for p in range(rng.randrange(1, 6))}
    turns = [(i, START + dt.timedelta(minutes=rng.randrange(20)), rng.randrange(7), rng.randrange(6)) for i in range(60)]
    frame = spark.createDataFrame([(l, p, o) for (l, p), o in photos.items()], "listing_id long, id long, display_order int")
    log = spark.createDataFrame(turns, "event_id long, ts timestamp, listing_id long, photo_id long")

    def state(df):
        return {(r["listing_id"], r["id"]): r["display_order"] for r in df.collect()}

    want = replay_covers(photos, turns)
    assert state(folds.apply_cover_changes(log, frame)) == want
    single = {t[2]: t for t in turns}
    one = spark.createDataFrame(list(single.values()), log.schema)
    assert state(folds.apply_cover_change(one, frame)) == replay_covers(photos, list(single.values()))
    once = folds.apply_cover_change(one, frame)
    assert state(folds.apply_cover_change(one, once)) == state(once)


def test_refreshed_ratings_do_not_drift(spark):
    rows, log = events(spark, random.Random(9), 150, ["upsert", "upsert", "delete"])
    listings = spark.range(5).select("id", F.lit(1.0).cast("decimal(2,1)").alias("avg_rating"), F.lit(7).alias("review_count"))
    reviews = folds.fold_reviews(log)
    fresh = folds.refresh_ratings(listings.select(F.col("id").alias("listing_id")), reviews, listings)
    assert quality.rating_drift(fresh, reviews).count() == 0
    assert quality.rating_drift(listings, reviews).count() > 0


def write_parts(df, path, parts):
    """Several files, in an order that has nothing to do with event time."""
    for i in range(parts):
        df.where(F.col("event_id") % parts == i).coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("compacted", [False, True])
def test_streams_equal_batches(spark, tmp_path, compacted):
    _, favs = events(spark, random.Random(1), 150, ["add", "remove"])
    _, revs = events(spark, random.Random(2), 150, ["upsert", "upsert", "delete"])
    asks = favs.select("event_id", "ts", F.col("user_id").alias("tenant_id"), "listing_id")
    cases = [
        (favs, jobs.stream_favorites, jobs.read_favorites, folds.fold_favorites, jobs.retain_favorites),
        (revs, jobs.stream_reviews, jobs.read_reviews, folds.fold_reviews, jobs.retain_reviews),
    ]
    if not compacted:
        cases.append((asks, jobs.stream_inquiries, jobs.read_inquiries,
                      lambda e: folds.fold_inquiries(e).drop("message", "status"), None))
    for k, (log, start, read, fold, retain) in enumerate(cases):
        source, out = str(tmp_path / f"in{k}"), str(tmp_path / f"out{k}")
        write_parts(log.where("event_id < 75"), source, 3)

        def run():
            stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(source)
            start(stream, out).awaitTermination()

        run()
        if compacted:
            jobs.compact(spark, out, retain)
        write_parts(log.where("event_id >= 75"), source, 3)
        run()
        got = read(spark, out)
        assert sorted(map(str, got.collect())) == sorted(map(str, fold(log).select(got.columns).collect()))
        assert spark.read.parquet(f"{out}/log").select("epoch").distinct().count() >= 4


def test_stream_of_ratings_follows_reviews(spark, tmp_path):
    _, revs = events(spark, random.Random(3), 120, ["upsert", "delete"])
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    write_parts(revs, source, 4)
    stream = spark.readStream.schema(revs.schema).option("maxFilesPerTrigger", 1).parquet(source)
    jobs.stream_ratings(stream, out).awaitTermination()
    listings = revs.select(F.col("listing_id").alias("id")).distinct().withColumns(
        {"avg_rating": F.lit(0).cast("decimal(2,1)"), "review_count": F.lit(0)}
    )
    want = folds.refresh_ratings(revs.select("listing_id"), folds.fold_reviews(revs), listings)
    assert sorted(map(tuple, jobs.read_ratings(spark, out).collect())) == sorted(map(tuple, want.collect()))


def test_snapshots_publish_together(spark, tmp_path):
    path = str(tmp_path / "snap")
    a, b = spark.range(3), spark.range(5)
    assert write_snapshot({"a": a, "b": b}, path) == 1
    assert write_snapshot({"a": b, "b": a}, path) == 2
    # Files without a marker are unfinished and stay invisible.
    spark.range(9).write.parquet(f"{path}/data-unfinished/a")
    assert versions(spark, path) == [1, 2]
    assert read_snapshot(spark, path, "a").count() == 5
    assert read_snapshot(spark, path, "a", 1).count() == 3


def test_accepted_and_rejected_split_the_input(spark):
    df = spark.range(20).select(F.concat(F.repeat(F.lit("a"), 36), F.when(F.col("id") % 3 == 0, "x").otherwise("")).alias("id"))
    checked = quality.check_id_shape(df, "id")
    assert quality.accepted(checked).count() + quality.rejected(checked).count() == 20
    assert quality.rejected(checked).count() == 7
