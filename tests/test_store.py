"""Bucketed state tables: partial rewrites, atomic versions, replay, and the streams on top of them."""

import glob
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hearthmark.plans import ingest
from hearthmark.sources.store import Facts, Keyed, Store
from hearthmark.streaming import jobs

SCHEMA = "user_id int, source_id string, external_id string, price double"
TABLES = {"rows": Keyed(("user_id", "source_id", "external_id"), ("user_id", "source_id"), buckets=8, parts=2, most_deltas=3), "facts": Facts()}


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def files(folder, pattern="**/*.parquet"):
    return {os.path.relpath(f, folder): os.path.getmtime(f) for f in glob.glob(f"{folder}/{pattern}", recursive=True)}


def test_random_batches_against_a_dictionary(spark, tmp_path):
    rng, folder = random.Random(1), str(tmp_path)
    store, state, facts = Store(spark, folder, TABLES), {}, []
    for version in range(9):
        batch = {(rng.randint(1, 3), f"s{rng.randint(1, 4)}", str(rng.randint(1, 30))): float(rng.randint(1, 99)) for _ in range(rng.choice([0, 3, 25]))}
        rows = frame(spark, [(*k, p) for k, p in batch.items()])
        before = files(folder)
        store.commit(version, {"rows": rows, "facts": rows})
        assert {k: v for k, v in files(folder).items() if k in before} == before  # what was there is left alone
        state |= batch
        facts += [(*k, p) for k, p in batch.items()]
        assert sorted(map(tuple, store.read("rows").collect())) == sorted((*k, p) for k, p in state.items())
        assert sorted(map(tuple, store.read("facts").collect())) == sorted(facts)
    like = frame(spark, [(1, "s1", "x", 0.0), (2, "s3", "y", 0.0)])
    part = sorted(map(tuple, store.read("rows", like=like).collect()))
    assert part == sorted((*k, p) for k, p in state.items() if k[:2] in ((1, "s1"), (2, "s3")))
    manifest = store.manifest()
    assert all(len(runs) <= 3 for runs in manifest["rows"]["buckets"].values()) and len(manifest["facts"]["runs"]) == 2
    assert store.versions() == list(range(9))


def test_only_touched_buckets_are_written_and_read(spark, tmp_path):
    store = Store(spark, str(tmp_path), {"rows": Keyed(("external_id",), (), buckets=32, parts=1, most_deltas=1)})
    store.commit(0, {"rows": frame(spark, [(1, "s", str(i), 1.0) for i in range(500)])})
    first = store.manifest(0)["rows"]["buckets"]
    store.commit(1, {"rows": frame(spark, [(1, "s", "7", 2.0)])})
    second = store.manifest(1)["rows"]["buckets"]
    moved = [b for b in first if first[b] != second[b]]
    assert len(first) == 32 and len(moved) == 1 and second[moved[0]] == [[1, 1]]
    assert store.read("rows").where("external_id = '7'").first()["price"] == 2.0 and store.read("rows").count() == 500


def test_a_batch_that_fails_between_tables_is_not_seen(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path), TABLES)
    one, two = frame(spark, [(1, "s", "a", 1.0)]), frame(spark, [(1, "s", "a", 2.0), (1, "s", "b", 3.0)])
    store.commit(0, {"rows": one, "facts": one})
    add = Store._add_facts

    def failing(self, *args):
        raise OSError("lost")

    monkeypatch.setattr(Store, "_add_facts", failing)
    with pytest.raises(OSError, match="lost"):
        store.commit(1, {"rows": two, "facts": two})
    # the rows of the batch are on disk, yet no reader sees them
    assert files(str(tmp_path), "rows/_v=1/**/*.parquet") and store.latest() == 0
    assert [r["price"] for r in store.read("rows").collect()] == [1.0] and store.read("facts").count() == 1
    monkeypatch.setattr(Store, "_add_facts", add)
    store.commit(1, {"rows": two, "facts": two})
    store.commit(1, {"rows": one, "facts": one})  # committed already
    assert sorted(r["price"] for r in store.read("rows").collect()) == [2.0, 3.0] and store.read("facts").count() == 3
    assert [r["price"] for r in store.read("rows", version=0).collect()] == [1.0]


LISTING = "id long, user_id int, source_id string, external_id string, title string, description string, price double, surface_m2 double, rooms int, property_type string, lat double, lng double, contact_name string, phashes array<string>"
NOW = datetime(2024, 1, 10)
WORDS = "belle maison lumineuse jardin terrasse garage proche centre calme vue balcon renove studio meuble ecole gare parking cave".split()


def listing(rng, i, source, key):
    words = " ".join(rng.choices(WORDS, k=4))
    return (i, 1 + i % 2, source, key, words, words + " " + rng.choice(WORDS), 1000.0 * rng.randint(50, 60), 40.0 + rng.randint(0, 3), 2, "maison", 45.5, 4.8, "A", None)


def test_ingest_stream_keeps_the_tables_of_whole_plans(spark, tmp_path):
    rng = random.Random(4)
    stored = [listing(rng, 1000 + i, f"s{i % 4}", f"k{i}") for i in range(60)]
    batches = [
        [listing(rng, 2000 + 100 * b + i, f"s{(b + i % 2) % 4}", f"k{rng.randrange(90)}") for i in range(14)] for b in range(2)
    ]
    listings = ingest.with_fingerprint(spark.createDataFrame(stored, LISTING)).withColumns(
        {"source_status": F.lit("active"), "disappeared": F.lit(False), "relevance_score": F.lit(0), **{c: F.lit(NOW) for c in ("first_seen_at", "last_seen_at", "last_changed_at")}}
    )
    versions = listings.select(F.col("id").alias("listing_id"), F.col("first_seen_at").alias("captured_at"), "price")
    edges = spark.createDataFrame([(1000, 1001, 80, "probable_identique")], "a long, b long, score int, bucket string")
    alerts = spark.createDataFrame([], "type string, title string, listing_id long, user_id int, created_at timestamp")
    initial = ingest.State(listings, versions, edges, alerts)
    folder, source = str(tmp_path / "out"), str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, LISTING).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(LISTING).option("maxFilesPerTrigger", 1).parquet(source)
        query = jobs.start_ingest_stream(stream, initial, folder, lambda batch: F.lit(NOW + timedelta(days=batch)))
        query.awaitTermination()
        assert query.exception() is None
    store = ingest.ingest_store(spark, f"{folder}/state")
    # the same batches, each planned and applied on whole tables
    state = initial
    for b, rows in enumerate(batches):
        incoming = ingest.last_per_key(spark.createDataFrame(rows, LISTING), ["user_id", "source_id", "external_id"], "id")
        known = state.listings.join(incoming.select("user_id", "source_id").distinct(), ["user_id", "source_id"], "left_semi")
        state = ingest.apply_plan(state, ingest.plan_ingestion(incoming, known), F.lit(NOW + timedelta(days=b)))
    for name in ("listings", "versions", "edges", "notifications"):
        want, got = getattr(state, name), store.read(name)
        columns = [c for c in got.columns if c in want.columns]
        assert set(want.columns) <= set(got.columns), name
        assert sorted(map(repr, got.select(*columns).collect())) == sorted(map(repr, want.select(*columns).collect())), name
    # a batch that is lost between commit and progress is run again and changes nothing
    before = {name: sorted(map(repr, store.read(name).collect())) for name in ("listings", "edges", "versions", "notifications")}
    lose_commit(f"{folder}/progress/commits", tmp_path)
    query = jobs.start_ingest_stream(stream, initial, folder, lambda batch: F.lit(NOW))
    query.awaitTermination()
    assert {name: sorted(map(repr, store.read(name).collect())) for name in before} == before


def lose_commit(folder, tmp_path):
    """As if the driver had died after the batch was written and before that was noted."""
    last = max(int(name) for name in os.listdir(folder) if name.isdigit())
    for name in (str(last), f".{last}.crc"):
        os.rename(f"{folder}/{name}", str(tmp_path / f"lost{name}"))


def write_parts(spark, folder, schema, *parts):
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_price_stream_touches_its_own_keys_only(spark, tmp_path):
    rng, schema = random.Random(7), "listing_id long, captured_at timestamp, tiebreak long, price double"
    parts, at = [], 0
    for b in range(8):
        rows = []
        for _ in range(400 if b == 0 else 12):
            at += 1
            rows.append((rng.randrange(300), datetime(2024, 1, 1) + timedelta(minutes=at), at, rng.choice([None, 1.0, 2.0, 3.0])))
        parts.append(rows)
    stream = write_parts(spark, tmp_path / "in", schema, *parts)
    query = jobs.price_change_stream(stream, str(tmp_path / "out"))
    query.awaitTermination()
    want, last = [], {}
    for key, when, tiebreak, price in (r for rows in parts for r in rows):
        if price is not None and last.get(key) != price:
            want.append((key, when, tiebreak, price))
            last[key] = price
    got = spark.read.parquet(str(tmp_path / "out/points"))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    updates = [p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["numInputRows"]]
    assert len(updates) == 8 and all(n <= 12 for n in updates[1:]) and updates[0] > 100


def test_dispatch_survives_a_lost_commit(spark, tmp_path):
    schema, out = "notification_id long, dispatched_at timestamp", str(tmp_path / "out")
    first = write_parts(spark, tmp_path / "in", schema, [(i, None) for i in range(50)], [(i, None) for i in range(25, 60)])
    jobs.dispatch_once_stream(first, out, lambda: F.lit(NOW)).awaitTermination()
    # the files are written, the progress of the last batch is not
    lose_commit(f"{out}/progress/commits", tmp_path)
    again = write_parts(spark, tmp_path / "in", schema, [(59, None), (70, None), (None, None), (71, NOW)])
    query = jobs.dispatch_once_stream(again, out, lambda: F.lit(NOW))
    query.awaitTermination()
    ids = [r["notification_id"] for r in spark.read.parquet(f"{out}/dispatched").collect()]
    assert sorted(ids, key=str) == sorted([*range(60), 70, None], key=str)
