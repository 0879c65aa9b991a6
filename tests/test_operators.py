"""Operators against small brute-force references."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hearthmark.operators import alerts, clusters, history, market, matching, ordered, qualification, runs, zones
from hearthmark.operators.relevance import criteria_rows, relevance

T0 = datetime(2024, 1, 1)


def points(spark, rows):
    return spark.createDataFrame(
        [(k, T0 + timedelta(hours=h), float(p), i) for i, (k, h, p) in enumerate(rows)],
        "listing_id string, observed_at timestamp, price double, tiebreak long",
    )


def test_price_summary_golden(spark):
    row = history.price_summary(points(spark, [("a", 0, 260), ("a", 30, 250), ("a", 60, 240)])).first()
    assert (row["first"], row["last"], row["direction"], row["drops"], row["change_pct"]) == (260, 240, "down", 2, -7.7)
    single = history.price_summary(points(spark, [("a", 0, 5)])).first()
    assert (single["direction"], single["change_pct"], single["drops"]) == ("flat", 0.0, 0)


def test_sliced_helpers_equal_plain_windows(spark):
    """One key holds most of the rows; slices of different sizes give the plain window's answer."""
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.8 else rng.choice("abc"), rng.randrange(200), rng.randrange(5)) for _ in range(400)]
    df = points(spark, rows).withColumn("known", F.when(F.col("price") > 2, F.col("price")))
    for size in ("day", "month"):
        cut = F.date_trunc(size, F.col("observed_at"))
        order = ["observed_at", "tiebreak"]
        out = ordered.with_previous(df, ["listing_id"], order, ["price"], cut)
        out = ordered.with_rank(out, ["listing_id"], order, cut)
        out = ordered.with_last_known(out, ["listing_id"], order, "known", cut).collect()
        by_key = {}
        for r in sorted(out, key=lambda r: (r["observed_at"], r["tiebreak"])):
            seen = by_key.setdefault(r["listing_id"], [])
            assert (r["previous"]["price"] if r["previous"] else None) == (seen[-1]["price"] if seen else None)
            assert r["rank"] == len(seen) + 1
            known = [s["known"] for s in [*seen, r] if s["known"] is not None]
            assert r["last_known"] == (known[-1] if known else None)
            seen.append(r)
        assert len(out) == len(rows)


def test_nested_history_pages_keep_every_point(spark):
    df = points(spark, [("a", h, h) for h in range(25)] + [("b", 1, 1)])
    pages = {(r["listing_id"], r["page"]): [p["price"] for p in r["points"]] for r in history.nested_history(df, page_rows=10).collect()}
    assert [len(pages["a", i]) for i in range(3)] == [10, 10, 5]
    assert sum((pages["a", i] for i in range(3)), []) == [float(h) for h in range(25)]


def test_rank_quantile_takes_the_upper_middle(spark):
    sales = spark.createDataFrame([("x", "Maison", float(v), 10.0) for v in (3000, 4000, 5000, 6000)], "area string, type_local string, value double, surface double")
    row = market.market_reference(sales).first()
    assert (row["count"], row["median"], row["p25"], row["p75"]) == (4, 500, 400, 600)
    tiny = sales.withColumn("surface", F.lit(4.0))
    assert market.market_reference(tiny).first()["count"] == 0


def test_run_metrics_golden(spark):
    rows = [("r1", "success", T0, 5, 2, 0), ("r2", "error", T0, 0, 0, 2), ("r3", "partial", T0 + timedelta(days=1), 0, 4, 1)]
    row = runs.run_metrics(spark.createDataFrame(rows, "run_id string, status string, at timestamp, added int, updated int, warnings int")).first()
    assert (row["success_rate"], row["total_added"], row["total_updated"], row["total_warnings"]) == (33, 5, 6, 3)


def test_qualification_fold(spark):
    log = spark.createDataFrame(
        [
            (1, "a", "tag", None, "x", None, None),
            (2, "a", "tag", None, "y", None, None),
            (3, "a", "tag", None, "x", None, None),
            (4, "b", "verification", None, None, True, 2),
            (5, "c", "status", "contactee", None, None, None),
            (6, "c", "verification", None, None, False, 1),
            (7, "c", "verification", None, None, False, 0),
            (8, "d", "note", None, None, None, None),
        ],
        "seq long, listing_id string, action string, status string, tag string, verified boolean, anomaly_count int",
    )
    got = {r["listing_id"]: (r["status"], r["tags"]) for r in qualification.fold_qualification(log).collect()}
    assert got == {"a": ("a_revoir", ["y"]), "b": ("verifiee", []), "c": ("suspecte", [])}


def test_read_state_fold(spark):
    log = spark.createDataFrame(
        [(1, 1, 7, "noop"), (2, 1, 7, "read"), (3, 1, 7, "read"), (4, 1, 8, "read"), (5, 1, 8, "unread"), (6, 1, None, "read_all"), (7, 1, 9, "noop")],
        "seq long, user_id int, notification_id long, action string",
    ).withColumn("at", F.timestamp_seconds("seq"))
    got = {r["notification_id"]: r["s"] for r in alerts.fold_read_state(log, 2).withColumn("s", F.unix_seconds("read_at")).collect()}
    assert got == {7: 2, 8: 6, 9: None}


def test_zone_join_near_the_date_line(spark):
    pts = spark.createDataFrame([(1, 10.0, 179.99), (2, 10.0, -179.99), (3, 10.0, 170.0)], "id long, lat double, lng double")
    zone = spark.createDataFrame([(1, 10.0, 179.995, 5.0)], "search_id int, center_lat double, center_lng double, radius_km double")
    assert sorted(r["id"] for r in zones.radius_join(pts, zone).collect()) == [1, 2]


def search(spark, **values):
    base = dict(
        search_id=1, price_min=None, price_max=None, surface_min=None, surface_max=None, rooms_min=None, rooms_max=None,
        property_types="", keywords_required="", keywords_excluded="", center_lat=None, center_lng=None, radius_km=None,
    )
    schema = (
        "search_id int, price_min double, price_max double, surface_min double, surface_max double, rooms_min int, rooms_max int, "
        "property_types string, keywords_required string, keywords_excluded string, center_lat double, center_lng double, radius_km double"
    )
    return criteria_rows(spark.createDataFrame([tuple({**base, **values}.values())], schema))


def listing(spark, **values):
    base = dict(id=1, search_id=1, title="Bel appartement avec balcon", description=None, price=240000.0, surface_m2=68.0, rooms=3,
                property_type="appartement", lat=45.75, lng=4.85)
    schema = "id long, search_id int, title string, description string, price double, surface_m2 double, rooms int, property_type string, lat double, lng double"
    return spark.createDataFrame([tuple({**base, **values}.values())], schema)


@pytest.mark.parametrize(
    "criteria, check",
    [
        (dict(price_min=200000.0, price_max=260000.0, rooms_min=3, rooms_max=4, property_types="appartement", keywords_required="BALCON"),
         lambda r: r["score"] > 80 and not r["excluded"]),
        (dict(keywords_excluded="viager, Balcon"), lambda r: r["excluded"] and r["score"] == 0 and "Balcon" in r["reason"]),
        (dict(center_lat=48.85, center_lng=2.35, radius_km=10.0), lambda r: r["excluded"]),
        (dict(price_max=120000.0), lambda r: not r["excluded"] and r["score"] < 60),
    ],
)
def test_relevance(spark, criteria, check):
    assert check(relevance(listing(spark), search(spark, **criteria)).first()["relevance"])


def test_relevance_without_any_factor_is_neutral(spark):
    bare = listing(spark, price=None, surface_m2=None, rooms=None, property_type=None)
    assert relevance(bare, search(spark)).first()["relevance"]["score"] == 50


def test_clusters_golden(spark):
    edges = spark.createDataFrame(
        [("L1", "L2", 95, "doublon_exact"), ("L2", "L3", 82, "probable_identique"), ("L4", "L5", 80, "probable_identique"), ("L6", "L7", 60, "similaire"), ("L8", "L8", 99, "doublon_exact")],
        "a string, b string, score int, bucket string",
    )
    membership, summary = clusters.build_clusters(edges)
    groups = {}
    for r in membership.collect():
        groups.setdefault(r["component"], set()).add(r["node"])
    assert groups == {"L1": {"L1", "L2", "L3"}, "L4": {"L4", "L5"}}
    best = {r["component"]: (r["max_score"], r["kind"], r["members"]) for r in summary.collect()}
    assert best == {"L1": (95, "doublon_exact", 3), "L4": (80, "probable_identique", 2)}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(500 + i, 501 + i) for i in range(40)] + [(900, 901 + i) for i in range(30)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    got = {r["node"]: r["component"] for r in clusters.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_canonical_edges_keep_the_last_write(spark):
    edges = spark.createDataFrame([(2, 1, 10, 1), (1, 2, 20, 2), (3, 3, 9, 3)], "a int, b int, score int, seq int")
    assert [tuple(r) for r in matching.canonical_edges(edges, "seq").select("a", "b", "score").collect()] == [(1, 2, 20)]


def test_read_all_reaches_notifications_without_an_action(spark):
    notes = spark.createDataFrame(
        [(1, 7, 10, None), (1, 8, 50, None), (1, 9, 10, 5), (2, 7, 10, None), (1, 6, 10, 4)],
        "user_id int, notification_id long, created long, had long",
    ).select("user_id", "notification_id", F.timestamp_seconds("created").alias("created_at"), F.timestamp_seconds("had").alias("read_at"))
    log = spark.createDataFrame(
        [(1, 1, None, "read_all", 20), (2, 1, 6, "unread", 30)], "seq long, user_id int, notification_id long, action string, t long"
    ).select("seq", "user_id", "notification_id", "action", F.timestamp_seconds("t").alias("at"))
    rows = alerts.fold_read_state(log, notifications=notes).withColumn("s", F.unix_seconds("read_at")).collect()
    assert {(r["user_id"], r["notification_id"]): r["s"] for r in rows} == {(1, 7): 20, (1, 8): None, (1, 9): 5, (2, 7): None, (1, 6): None}


def test_image_hash_needs_all_values(one):
    from hearthmark.functions import images

    good, short, error, fine = one(
        images.dhash(F.sequence(F.lit(1), F.lit(72))),
        images.dhash(F.array(F.lit(1), F.lit(2), F.lit(3))),
        images.dhash_error(F.lit(None).cast("array<int>")),
        images.dhash_error(F.sequence(F.lit(1), F.lit(72))),
    )
    assert (good, short, fine) == ("f" * 16, None, None) and error == images.GRAY_ERROR


def test_one_crowded_cell(spark):
    pts = spark.range(400).select("id", (F.lit(45.0) + F.col("id") * 1e-5).alias("lat"), F.lit(4.8).alias("lng"))
    round_zones = spark.range(30).select(F.col("id").cast("int").alias("search_id"), F.lit(45.0).alias("center_lat"), F.lit(4.8).alias("center_lng"), (F.col("id") * 0.02).alias("radius_km"))
    whole = sorted((r["id"], r["search_id"]) for r in zones.radius_join(pts, round_zones).collect())
    split = sorted((r["id"], r["search_id"]) for r in zones.radius_join(pts, round_zones, piece_rows=7).collect())
    assert split == whole and 1000 < len(whole) < 12000
