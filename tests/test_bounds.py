"""Bounds of pair scores from short rows against the scores themselves."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from hearthmark.operators import bounds, matching
from test_matching import SCHEMA, WORDS, fixture


def templates(rng):
    return [
        dict(words=rng.sample(WORDS, 9), price=rng.randrange(80, 400) * 1000.0, surface=rng.randrange(20, 150) * 1.0, rooms=rng.randrange(1, 6),
             kind=rng.choice(["maison", "appartement"]), lat=45.5 + rng.random() / 20, lng=4.8 + rng.random() / 20, hash=f"{rng.getrandbits(64):016x}")
        for _ in range(6)
    ]


def probing(rows, least, promoted=False):
    return rows.withColumns({"_least": F.lit(least), "_own": F.lit(None).cast("long"), "_score": F.lit(None).cast("int"), "_promoted": F.lit(promoted)})


def test_bounds_lose_no_pair(spark, monkeypatch):
    rng = random.Random(3)
    bases = templates(rng)
    rows = [fixture(rng, 60, start, bases) for start in (1, 2)]
    # long texts have wider bit fields, numbers may be negative
    for i, side in enumerate(rows):
        for n, words in ((1000, 700), (1002, 90)):
            text = " ".join(f"mot{rng.randrange(900)}" for _ in range(words))
            side.append((n + i, 1, text, "fin", -5000.0 - i, 40.0, 2, "maison", 45.5, 4.8, "Agence A", ["0" * 20, "ff"]))
    left, right = (matching.comparable(spark.createDataFrame(x, SCHEMA)).cache() for x in rows)
    monkeypatch.setattr(bounds, "PROBE_ROWS", 25)
    monkeypatch.setattr(bounds, "OTHER_ROWS", 30)
    a, b = bounds.outlines(left, ["user_id"]), bounds.outlines(right, ["user_id"])
    pairs = left.select(F.col("id").alias("a"), "user_id").join(right.select(F.col("id").alias("b"), "user_id"), "user_id").select("a", "b")
    exact = {(r.a, r.b): (r.score, r.bucket) for r in matching.score_pairs(pairs, left, right, explain=False).collect()}
    for least in (77.5, 30.5):
        got = bounds.pairs_within(probing(a, least, True), b, ["user_id"], matching.WEIGHTS, matching.PROMOTED_IMAGE).collect()
        found = {(r.a, r.b): r.bound for r in got}
        assert len(got) == len(found) and found.keys() <= exact.keys()
        assert all(value + 0.5 + bounds.SLACK >= exact[pair][0] for pair, value in found.items())
        wanted = {pair for pair, (score, bucket) in exact.items() if score >= least or bucket == "doublon_exact"}
        assert wanted and wanted <= found.keys()
        assert sum(1 for x in found if x not in wanted) < 0.3 * len(exact)


def test_pairs_that_cannot_win_carry_no_texts(spark, monkeypatch):
    """Listings that agree in all but their texts, each with one near copy: few pairs are scored."""
    rng = random.Random(9)
    new, known = [], []
    for i in range(300):
        text = [f"m{rng.randrange(10**6)}" for _ in range(30)]
        base = (1000.0, 20.0, 1, "maison", 45.5, 4.8, "Agence A", None)
        new.append((2 * i + 1, 1, "annonce", " ".join(text), *base))
        known.append((2 * i, 1, "annonce", " ".join([*text[:-1], "autre"]), *base))
    scored, plain = [], matching.score_pairs

    def counted(pairs, *sides, **options):
        scored.append(pairs.count())
        return plain(pairs, *sides, **options)

    def never(*_):
        raise AssertionError("words of candidate pairs were moved")

    monkeypatch.setattr(matching, "score_pairs", counted)
    monkeypatch.setattr(matching._Sides, "enough_words", never)
    new, known = (spark.createDataFrame(x, SCHEMA).repartition(4) for x in (new, known))
    got = {(r["id"], r["with_id"]) for r in matching.best_matches(new, known, ["user_id"]).collect()}
    assert got == {(2 * i + 1, 2 * i) for i in range(300)}
    assert sum(scored) <= 2 * 300


def test_a_shuffle_holds_one_piece_of_the_probes(spark, monkeypatch):
    """Many pieces on both sides: the rows that meet in one turn stay in proportion to the others."""
    monkeypatch.setattr(bounds, "PROBE_ROWS", 100)
    monkeypatch.setattr(bounds, "OTHER_ROWS", 100)
    probes, others = (spark.range(1000).withColumn("user_id", F.col("id") % 1) for _ in range(2))
    sizes = bounds._sizes(probes, others, ["user_id"])
    turns = [bounds._cut(probes, others, ["user_id"], sizes, turn).count().collect() for turn in range(10)]
    moved = [sum(r["count"] for r in turn) for turn in turns]
    assert sum(moved) == 10 * 1000 + 10 * 1000 and max(moved) < 1000 + 10 * 150


def test_pairs_are_scored_in_turns(spark, monkeypatch):
    """More pairs than a turn takes: as many calls, the same matches."""
    rng = random.Random(11)
    bases = templates(rng)
    new, known = (spark.createDataFrame(fixture(rng, 80, start, bases), SCHEMA) for start in (1, 2))
    wanted = {tuple(r) for r in matching.best_matches(new, known, ["user_id"], mode="exact").collect()}
    scored, plain = [], matching.score_pairs

    def counted(pairs, *sides, **options):
        scored.append(pairs.count())
        return plain(pairs, *sides, **options)

    monkeypatch.setattr(matching, "score_pairs", counted)
    monkeypatch.setattr(matching, "LEAST_SCORED", 10)
    got = {tuple(r) for r in matching.best_matches(new, known, ["user_id"]).collect()}
    assert wanted and got == wanted
    assert len(scored) > 3 and max(scored) < 80


def outline_table(rows):
    """Outlines as an Arrow table, without Spark."""
    fields = [bounds._sketch({w.encode() for w in r["words"]}, np.unique(np.array(r["grams"], dtype=np.int64))) for r in rows]
    plain = {c: pa.array([r.get(c) for r in rows], kind) for c, kind in (("id", pa.int64()), *[(c, pa.float64()) for c in bounds.ATTRIBUTES], ("_kind", pa.int64()), ("_contact", pa.int64()))}
    lists = {c: pa.array([r.get(c) for r in rows], pa.list_(pa.int64())) for c in ("_lengths", "_codes")}
    sketch = {f"_{name}": pa.array([f[n] for f in fields]) for n, name in enumerate(bounds._SKETCH)}
    return pa.table({**plain, **lists, "_blank": pa.array([not r["words"] for r in rows]), **sketch})


def outline_rows(rng, n, start):
    number = [0.0, float("nan"), -5.0, 1e-30, 1e35, None]
    rows = []
    for i in range(n):
        near = rng.randrange(6)
        words = [f"mot{near}{k}" for k in range(8)] + [f"x{rng.randrange(200)}" for _ in range(rng.randrange(60))]
        row = {"id": start + i, "words": words if rng.random() < 0.95 else [], "grams": list(range(near * 40, near * 40 + rng.randrange(1, 60)))}
        row |= {"price": rng.choice([*number, 1000.0 * rng.randrange(50, 400)] + [1000.0 * (near + 1) * 50] * 6), "surface_m2": rng.choice([None, 0.0, 20.0 * near + rng.random()])}
        row |= {"rooms": rng.choice([None, 0.0, 1.0, 2.0, 3.0]), "_kind": rng.choice([None, 1, 2, 3]), "_contact": rng.choice([None, 7, 8])}
        if rng.random() < 0.8:
            row |= {"lat": 45.5 + near / 50 + rng.random() / 200, "lng": 4.8 + near / 50}
        if rng.random() < 0.5:
            codes = [rng.getrandbits(62) if rng.random() < 0.5 else (1 << near) for _ in range(rng.randrange(3))]
            row |= {"_lengths": [rng.choice([16, 16, 20]) for _ in codes], "_codes": codes}
        rows.append(row)
    return rows


def test_tiles_leave_out_no_pair():
    """Tile by tile the same pairs as one look at all of them, also with odd numbers and several images."""
    rng = random.Random(21)
    left, right = (bounds._Block(outline_table(outline_rows(rng, 400, start)), matching.WEIGHTS, size) for start, size in ((0, 16), (1000, 4)))
    found = bounds._Bounds(left, right, matching.WEIGHTS, 3.2)
    every = [x.ravel() for x in np.meshgrid(np.arange(left.n), np.arange(right.n), indexing="ij")]
    with np.errstate(all="ignore"):
        for least in (77.5, 50.0, 0.0):
            for promoted in (True, False):
                asked = np.full(left.n, least), np.full(left.n, promoted)
                got = {(i, j) for t in range(len(left.starts) - 1) for i, j in zip(*found.of(t, *asked)[:2], strict=True)}
                i, j, _, maybe = found._exact(*every, np.full(len(every[0]), (least - bounds.SLACK) / 100), np.full(len(every[0]), promoted))
                assert got == set(zip(i, j, strict=True)) and got and (not promoted or maybe.any())


def test_tiles_that_lie_apart_are_not_compared(monkeypatch):
    """Listings of many places and prices: most pairs are left out without a look at them."""
    rng = random.Random(22)
    rows = [
        [
            {"id": start + i, "words": [f"w{rng.randrange(900)}" for _ in range(20)], "grams": list(range(i % 50, i % 50 + 30)), "price": 1000.0 * rng.randrange(50, 900),
             "surface_m2": 1.0 * rng.randrange(15, 300), "rooms": 1.0 * rng.randrange(1, 7), "_kind": rng.randrange(5), "lat": 43 + 5 * rng.random(), "lng": 5 * rng.random()}
            for i in range(2000)
        ]
        for start in (0, 10_000)
    ]
    left, right = (bounds._Block(outline_table(x), matching.WEIGHTS, size) for x, size in zip(rows, (bounds.PROBE_TILE, bounds.OTHER_TILE), strict=True))
    found, looked = bounds._Bounds(left, right, matching.WEIGHTS, 3.2), []
    likely = found._likely
    monkeypatch.setattr(found, "_likely", lambda own, others, *rest: (looked.append(len(own) * len(others)), likely(own, others, *rest))[1])
    for tile in range(len(left.starts) - 1):
        found.of(tile, np.full(left.n, 77.5), np.full(left.n, False))
    assert sum(looked) < 0.6 * left.n * right.n


def test_rows_with_few_pairs_are_searched_once(spark, monkeypatch):
    searches, plain = [], matching.pairs_within
    monkeypatch.setattr(matching, "pairs_within", lambda *args, **options: (searches.append(1), plain(*args, **options))[1])
    rows = [(i, 1, f"annonce {i}", f"texte numero {i} de la rue {i * 7}", 1000.0 * 3 ** (i // 2), 20.0 * 2 ** (i // 2), 1, "maison", None, None, None, None) for i in range(40)]
    new, known = (spark.createDataFrame([r for r in rows if r[0] % 2 == part], SCHEMA) for part in (1, 0))
    got = {tuple(r) for r in matching.best_matches(new, known, ["user_id"]).collect()}
    assert got == {tuple(r) for r in matching.best_matches(new, known, ["user_id"], mode="exact").collect()}
    assert len(searches) == 1


def test_outlines_and_scores_of_folded_texts(spark):
    """Sets made outside of Spark are those of the column expressions, blank and odd texts included."""
    texts = ["", None, "   ", "́", " ́abc é", "a  b\t c", "İstanbul ÀÉÎ", "😀 😀a b😀", "le la les", "\x1c a\x85b", "AB12 cd-ef", "﻿abc", "Maison à vendre, 3 pièces"]
    rows = [(100 * i + j, 1, t, d, 1.0, None, 1, None, None, None, " Ag  X ", None) for i, t in enumerate(texts) for j, d in enumerate(texts)]
    listings = spark.createDataFrame(rows, SCHEMA)
    plain, folded = matching.comparable(listings), matching.folded_rows(listings)
    columns = ["id", "_blank", "_n_words", "_n_grams", "_contact"]
    assert {tuple(r) for r in bounds.outlines(plain, []).select(*columns).collect()} == {tuple(r) for r in bounds.outlines(folded, []).select(*columns).collect()}
    pairs = listings.select(F.col("id").alias("a"), ((F.col("id") * 7 + 3) % 1213).alias("b"))
    scored = [{tuple(r) for r in matching.score_pairs(pairs, x, x, explain=False).collect()} for x in (plain, folded)]
    assert scored[0] and scored[0] == scored[1]
