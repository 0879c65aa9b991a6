"""Operators 9 and 10, the pipeline, and the registration of all queries."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from hearthmark.llm import queries, scoring, sharding

TEST_DATA = "/root/testdata/sf0.001"


def test_tree_finds_the_tightest_bin():
    rng, bins, plain = random.Random(1), sharding.Bins(), []
    for i in range(4000):
        if rng.random() < 0.6:
            plain.append((rng.randint(0, 300), i))
            bins.add(plain[-1])
        else:
            size = rng.randint(0, 300)
            want = min((b for b in plain if b[0] >= size), default=None)
            assert bins.take(size) == want
            if want:
                plain.remove(want)
    assert bins.root is None or bins.root.height < 20


def best_fit(sizes, capacity):
    """Best fit decreasing item by item: remaining capacity of each bin and the bin of each item."""
    rest, place = [], []
    for size in sorted(sizes, reverse=True):
        fits = [(r, i) for i, r in enumerate(rest) if r >= size]
        number = min(fits)[1] if fits else len(rest)
        if not fits:
            rest.append(max(capacity, size))
        rest[number] -= size
        place.append(number)
    return place


def bins_of(runs):
    """Bin of every item, by falling size and then by rank."""
    return [r.bin + k // r.each for r in sorted(runs, key=lambda r: (-r.size, r.first)) for k in range(r.count)]


def classes_of(sizes):
    return sorted(Counter(sizes).items(), reverse=True)


def test_packing():
    assert bins_of(sharding.pack(classes_of([6, 5, 4, 3, 2]), 10)) == [0, 1, 0, 1, 1]
    assert bins_of(sharding.pack(classes_of([12, 3]), 10)) == [0, 1]
    assert sharding.pack(classes_of([6, 5, 4, 3, 2]), 10, most=1) is None
    place = bins_of(sharding.balanced(classes_of([50, 9, 8, 7, 6, 5, 4, 3]), 4))
    load = Counter()
    for size, shard in zip([50, 9, 8, 7, 6, 5, 4, 3], place):
        load[shard] += size
    assert load[0] == 50 and sorted(load[k] for k in (1, 2, 3)) == [14, 14, 14]


@pytest.mark.parametrize("seed", range(40))
def test_packing_by_size_is_best_fit_item_by_item(seed):
    rng = random.Random(seed)
    sizes = sorted((rng.randint(1, rng.choice([6, 40, 130])) for _ in range(rng.randint(1, 300))), reverse=True)
    capacity = rng.randint(5, 150)
    assert bins_of(sharding.pack(classes_of(sizes), capacity)) == best_fit(sizes, capacity)


@pytest.mark.parametrize(("sizes", "shards"), [([], 3), ([7], 3), ([8] * 50, 4), ([90, 90, 90, 1, 1], 3), ([40] * 3 + [1] * 100, 5)])
def test_balanced_loads(sizes, shards):
    place = bins_of(sharding.balanced(classes_of(sizes), shards))
    assert len(place) == len(sizes) and all(0 <= b < shards for b in place)
    load = Counter()
    for size, number in zip(sizes, place, strict=True):
        load[number] += size
    assert max(load.values(), default=0) <= max([-(-sum(sizes) // shards) + max(sizes, default=0), *sizes])


def test_shards(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, rng.choice(["x" * 40, "ünï" * 3, None, ""]) if rng.random() < 0.4 else f"t{i}" * rng.randint(1, 40)) for i in range(900)]
    rows += rows[:3] + [(None, "no id")]
    df = spark.createDataFrame([(*r, "own", "x", 1, 2) for r in rows], "doc_id long, text string, slot string, _GROUP string, _piece int, _n int").repartition(4)
    for parts in (1000, 1):
        monkeypatch.setattr(sharding, "HOT_PARTS", parts)
        found = sharding.shard(df, 5).collect()
        assert all((r._GROUP, r._piece, r._n) == ("x", 1, 2) for r in found)
        assert sorted(((r.doc_id, r.text) for r in found), key=str) == sorted(rows, key=str)
        load, slots, homes = Counter(), defaultdict(list), defaultdict(set)
        for r in found:
            assert r.size == len((r.text or "").encode()) + 8 and r.text_crc32 == zlib.crc32((r.text or "").encode())
            load[r.shard] += r.size
            slots[r.shard].append(r.slot)
            homes[r.text].add(r.shard)
        assert set(load) == set(range(5)) and all(sorted(s) == [*range(len(s))] for s in slots.values())
        assert all(len(h) == 1 for h in homes.values())
    largest = max(sum(r.size for r in found if r.text == t) for t in homes)
    assert max(load.values()) <= max(1.1 * sum(load.values()) / 5, largest)
    size_of = Counter()
    for _, t in rows:
        size_of[t] += len((t or "").encode()) + 8
    monkeypatch.setattr(sharding, "BROADCAST_RUNS", 0)
    fixed = sharding.shard(df, capacity=2000).collect()
    want, sizes = defaultdict(list), sorted(size_of.values(), reverse=True)
    for size, number in zip(sizes, best_fit(sizes, 2000)):
        want[number].append(size)
    held = defaultdict(set)
    for r in fixed:
        held[r.shard].add(r.text)
    assert {k: sorted(size_of[t] for t in v) for k, v in held.items()} == {k: sorted(v) for k, v in want.items()}
    load = Counter()
    for r in fixed:
        load[r.shard] += r.size
    assert all(v <= max(2000, largest) for v in load.values())
    assert sharding.placement(df.where("false")).collect() == []


def base_scores(docs):
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {d: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(upper)), None] for d, t in docs}
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    count = Counter(w for d, t in tokens.items() if not held(d) for w in t)
    n, v = sum(count.values()), len(count)
    return {d: (held(d), len(t), sum(count[w] > 0 for w in t), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t)) for d, t in tokens.items()}


@pytest.mark.parametrize("frequent", [200_000, 60])
def test_scores(spark, monkeypatch, frequent):
    monkeypatch.setattr(scoring, "FREQUENT_TIMES", frequent)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{TEST_DATA}/documents.parquet").collect()] + [(10**6, None), (10**6 + 1, "")]
    df = spark.createDataFrame([(*d, 1.5) for d in docs], "doc_id long, text string, score double").repartition(5)
    rows = scoring.score(df).collect()
    want = base_scores(docs)
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert r.base_score == pytest.approx(want[r.doc_id][4], rel=1e-9)
        assert r.score < 0
    held = [r for r in rows if r.held_out and r.n_tokens > 1]
    spent = sum(r.bits_per_byte * len(dict(docs)[r.doc_id].encode()) for r in held) / sum(len(dict(docs)[r.doc_id].encode()) for r in held)
    assert spent < 3.0  # held-out text; eight bits without a model
    again = {r.doc_id: r.score for r in scoring.score(df.repartition(2)).collect()}
    assert all(again[r.doc_id] == pytest.approx(r.score, rel=0.02) for r in rows)
    noise = spark.createDataFrame([*docs, (2, None)][:0], "doc_id long, text string")
    assert scoring.score(noise).collect() == []


def test_bits_sum_to_one():
    import numpy as np

    tables = [np.random.default_rng(1).integers(0, 9, (1 << b, 2)).astype(np.uint16) for b in scoring.TABLE_BITS]
    model = scoring.Model(tables)
    model.set_maps(np.random.default_rng(2).integers(0, 9, 256 * (scoring.MAP_STEPS + 1) * 2).astype(float))
    before = np.uint64(int.from_bytes(b"abcde", "big") << 8)
    assert sum(2.0 ** -model.bits(before + np.arange(256, dtype=np.uint64))) == pytest.approx(1.0, abs=1e-9)


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{TEST_DATA}/documents.parquet")
    clean = docs.where("doc_id = 0").first()
    extra = [
        (10**6, None, "en", "s", 0),
        (10**6 + 1, (clean.text or "") + "\nOne more line at the end.", "en", "s", 1),
        (10**6 + 2, "Fresh words only. " + " ".join(f"new{i} item{i * i}." for i in range(80)) + ' token = "0123456789abcdef0123456789abcdef"', "en", "s", 2),
    ]
    given = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_duplicates", "decontamination", "secret_scans", "token_ids"]
    left = given
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id for r in left.select("doc_id").collect()}
        stage(spark, left, TEST_DATA).write.parquet(f"{tmp_path}/{name}")
        left = spark.read.parquet(f"{tmp_path}/{name}")
        after = {r.doc_id for r in left.select("doc_id").collect()}
        assert after <= before
        if name != "token_ids":
            assert left.columns == docs.columns
        if name == "quality_rules":
            assert 10**6 not in after and 10**6 + 2 in after
        if name == "near_duplicates":
            assert 0 in after and 10**6 + 1 not in after
        if name == "secret_scans":
            assert after == before
            text = left.where(f"doc_id = {10**6 + 2}").first()
            assert "0123456789abcdef" not in text.text and "[secret]" in text.text and text.n_chars == len(text.text)
    whole = corpus_pipeline.run(spark, TEST_DATA)
    assert {r.doc_id for r in whole.select("doc_id").collect()} == after - {10**6 + 2}


def test_registered_queries():
    found = queries.all_queries()
    numbers = [int(re.match(r"op(\d+)_", name).group(1)) for name in found if name.startswith("op")]
    assert sorted(numbers) == [*range(1, 14)] and "pipeline" in found
    assert set(queries.all_oracles()) <= set(found)
