"""Texts that a sum of powers modulo 2**64 cannot tell apart have to stay apart in every operator."""

import zlib

import numpy as np
import public_tokenizers
import pytest

from hearthmark.llm import jaccard, leaks, quality, scoring, substrings, textops, tokenfiles
from hearthmark.llm.queries import vocabulary_bytes


def thue_morse(n, a="a", b="b"):
    return "".join(b if i.bit_count() % 2 else a for i in range(n))


SIZES = [1024, 2048, 4096]


def hashes(texts, which=0):
    body = np.frombuffer("".join(texts).encode(), np.uint8)
    sizes = np.array([len(t.encode()) for t in texts])
    ends = np.cumsum(sizes)
    return textops.span_hashes(body, ends - sizes, ends, which).tolist()


@pytest.mark.parametrize("n", [8, 64, 256, 512, *SIZES])
def test_thue_morse_words_hash_apart(n):
    one, two = thue_morse(n), thue_morse(n, "b", "a")
    for which in (0, 1):
        a, b, again = hashes([one, two, one], which)
        assert a != b and a == again


def test_hash_of_bytes_is_of_the_bytes_alone():
    rng = np.random.default_rng(0)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 3, n)) for n in rng.integers(0, 40, 5000)] + ["x" * 600, "x" * 601, "\0", "\0\0", ""]
    first, again = hashes(words), hashes(words[::-1])[::-1]
    assert first == again
    assert len(set(first)) == len(set(words)) and len(set(hashes(words, 1))) == len(set(words))
    assert not set(first) & set(hashes(words, 1))


def docs(spark, texts):
    return spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")


@pytest.mark.parametrize("n", SIZES)
def test_lines_words_and_windows_stay_apart(spark, n):
    one, two = thue_morse(n), thue_morse(n, "b", "a")
    judged = {r.doc_id: r for r in quality.judge(docs(spark, [f"{one}\n{two}", f"{one}\n{one}", f"x y {one} x y {two}"])).collect()}
    assert [judged[i].n_dup_lines for i in range(3)] == [0, 1, 0] and judged[2].n_repeat_words == 0
    common = " ".join(f"w{i}" for i in range(49))
    texts = [f"{common} {one}", f"{common} {two}", f"{common} {one}"]
    removed = {r.doc_id: r.n_removed for r in substrings.without_repeats(docs(spark, texts)).collect()}
    assert removed == {0: 0, 1: 0, 2: 50}
    texts = [f"x y z {one}", f"x y z {two}", f"x y z {one}"]
    found = {r.doc_id: r.component_id for r in jaccard.similar(docs(spark, texts)).collect()}
    assert found == {0: 0, 1: 1, 2: 0}


@pytest.mark.parametrize("n", SIZES)
def test_token_ids_and_counts_stay_apart(spark, n, tmp_path):
    from tokenizers import Tokenizer

    one, two = thue_morse(n), thue_morse(n, "b", "a")
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in tokenfiles.round_trip(docs(spark, [one, two]), vocabulary_bytes("byte_bpe_50k.json"), added_tokens=True).collect()}
    for i, text in enumerate([one, two]):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert got[i].n_tokens == len(ids) and got[i].ids_crc32 == zlib.crc32(ids.tobytes())
    texts = [one] * 12 + [two]
    scored = {r.doc_id: r for r in scoring.score(docs(spark, texts)).collect()}
    learned = [i for i in range(13) if zlib.crc32(str(i).encode()) % 7 != 2]
    assert scored[12].n_known == 1 + (12 in learned) and scored[0].n_known == 2


@pytest.mark.parametrize("n", SIZES)
def test_windows_of_items_stay_apart(spark, n):
    one, two = thue_morse(n), thue_morse(n, "b", "a")
    item = " ".join([one, "b", *[f"w{i}" for i in range(20)]])
    other = " ".join([two, "a", *[f"v{i}" for i in range(20)]])
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = leaks.matches(docs(spark, [other, item]), items).collect()
    assert {r.doc_id for r in rows} == {1}
