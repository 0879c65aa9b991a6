"""Operators 5, 6 and 7 against brute force."""

import hashlib
import random
import re

from hearthmark.llm import jaccard, leaks, substrings


def repeats(docs, window=50):
    words = {d: (t or "").encode().split() for d, t in docs}
    owner, out = {}, {}
    for d in sorted(words):
        for i in range(len(words[d]) - window + 1):
            owner.setdefault(tuple(words[d][i : i + window]), d)
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if owner[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def passages(rng, n):
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(30, 140))) for _ in range(6)]
    own = lambda: " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 60)))
    return [" ".join(rng.choice(pool) if rng.random() < 0.5 else own() for _ in range(rng.randint(0, 5))) for _ in range(n)]


def test_repeated_passages(spark):
    rng = random.Random(3)
    docs = [*zip(rng.sample(range(10**6), 150), passages(rng, 150)), (5, None), (7, ""), (8, "tab\tand\x0bform\x0cfeed " * 30)]
    want = repeats(docs)
    df = spark.createDataFrame([(*d, 1) for d in docs + docs[:9]], "doc_id long, text string, starts int").repartition(5)
    rows = substrings.without_repeats(df).collect()
    assert len(rows) == len(docs) + 9
    assert sum(r.n_removed for r in rows) > 1000
    for r in rows:
        assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id]


def test_one_passage_in_all_documents(spark):
    line = " ".join(f"w{i}" for i in range(70))
    docs = [(i, f"a{i} {line} b{i}") for i in range(300)]
    rows = substrings.without_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), keep_text=True).collect()
    assert {r.doc_id: r.kept for r in rows} == {i: (t if i == 0 else f"a{i} b{i}") for i, t in docs}


def test_rows_without_id_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a " * 60), (None, "a " * 60), (2, "a " * 60)], "doc_id long, text string")
    assert [r.n_removed for r in substrings.without_repeats(df).collect()] == [0, 0, 0]
    assert substrings.without_repeats(df.where("false")).collect() == []
    assert jaccard.similar(df.where("false")).collect() == []
    found = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar(df).collect()}
    assert found == {(None, 1, None), (2, 1, 2)}


UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def groups(docs, size, least):
    sets = {}
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UPPER))
        sets[d] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= least * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def edited(rng, words, times):
    words = words[:]
    for _ in range(times):
        i, kind = rng.randrange(len(words)), rng.random()
        if kind < 0.4:
            words[i] = rng.choice("pqrstuv")
        elif kind < 0.7 and len(words) > 3:
            del words[i]
        else:
            words.insert(i, rng.choice("pqrstuv"))
    return words


def test_similar_documents(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(22):
        base = [rng.choice("abcdefghijklmno") for _ in range(rng.randint(1, 90))]
        texts += [" ".join(edited(rng, base, rng.randint(0, 3))) for _ in range(rng.randint(1, 12))]
    docs = [*zip(rng.sample(range(10**6), len(texts)), texts), (10**7, None), (10**7 + 1, " \n"), (10**7 + 2, texts[0].upper())]
    df = spark.createDataFrame([(*d, 0) for d in docs + docs[:5]], "doc_id long, text string, n int").repartition(4)
    rows = jaccard.similar(df).collect()
    want = groups(docs, 4, 85)
    assert len(rows) == len(docs) + 5
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    assert len({w[1] for w in want.values()}) < len(docs) - 20
    kept = jaccard.without_copies(df, 5, 80)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, w in groups(docs, 5, 80).items() if w[1] == d}


def words_of(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())


def distance(a, b):
    row = [*range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_leaked_items(spark):
    rng = random.Random(8)
    names = [*(f"w{i}" for i in range(12)), "é", "x-y"]
    items = [(i, " ".join(rng.choice(names) for _ in range(rng.choice([1, 3, 5, 8, 10, 15, 24])))) for i in range(12)] + [(50, ""), (51, None)]
    docs = []
    for d in range(90):
        w = [rng.choice(names) for _ in range(rng.randint(0, 15))]
        for _ in range(rng.randint(0, 2)):
            w += edited(rng, items[rng.randrange(12)][1].split(), rng.randint(0, 5)) + [rng.choice(names)] * rng.randint(0, 3)
        docs.append((d, " ".join(w).upper() if d % 3 == 0 else ", ".join(w)))
    docs.append((999, None))
    want = {}
    for d, text in docs:
        w = words_of(text)
        for i, item in items:
            y = words_of(item)
            if y and w:
                n = min(len(y), len(w))
                best = min((distance(y, w[s : s + n]), s) for s in range(len(w) - n + 1))
                if best[0] <= len(y) // 5:
                    want[d, i] = best
    df = spark.createDataFrame([(*d, "x") for d in docs + docs[:7]], "doc_id long, text string, item_id string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.edits, r.first_word) for r in leaks.matches(df, bench).collect()}
    assert set(got) <= set(want)
    assert len(got) >= 0.99 * len(want) > 50
    assert all(got[k] == want[k] for k in got)
    left = leaks.without_leaks(df, bench)
    assert left.columns == df.columns
    assert {r.doc_id for r in left.collect()} == {d for d, _ in docs} - {k[0] for k in got}
    assert leaks.matches(df.where("false"), bench).collect() == [] == leaks.matches(df, bench.where("false")).collect()
