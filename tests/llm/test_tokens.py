"""Operators 1 and 8: ids against the tokenizer libraries, round trips, coded blocks."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from hearthmark.llm import bpe, pretokens, rans, textops, tokenfiles
from hearthmark.llm.queries import op8_token_files, vocabulary_bytes

PARTS = [*"ab 1'!\n\t  ", "é", "'s", "'re", "'ll", "　", "٣", "\U0001f600", "\x1c", "\xa0", "漢", "I'd", "\r\n", "Ⅷ", "²"]


@pytest.fixture(scope="module")
def ranks():
    return vocabulary_bytes("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library(ranks):
    pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pairs, special_tokens={})


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    mixed = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    long = "".join(rng.choice("abcdefgh") for _ in range(4000))
    return [*mixed, "", "a" * 3000, "ab" * 900 + "c" * 99, long, "don't I'll 'sun ''s <|endoftext|>"]


def test_pieces_are_those_of_the_pattern(texts):
    body, offsets = textops.text_bytes(pa.array(texts))
    starts = pretokens.piece_starts(body, offsets)
    ends = np.append(starts[1:], len(body))
    pattern = regex.compile(public_tokenizers.PATTERN)
    got = [bytes(body[s:e]).decode() for s, e in zip(starts, ends)]
    assert got == [piece for text in texts for piece in pattern.findall(text)]


def test_ids_and_decoding(spark, ranks, library, texts):
    rows = [*enumerate(texts), (-1, None), (7, texts[7])]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string").repartition(3)
    want = {i: library.encode_ordinary(t or "") for i, t in rows}
    encoded = bpe.encode(df, ranks)
    assert encoded.columns == ["doc_id", "ids"]
    assert {r.doc_id: r.ids for r in encoded.collect()} == want
    decoded = {r.doc_id: bytes(r.decoded) for r in bpe.decode(encoded, ranks).collect()}
    assert decoded == {i: (t or "").encode() for i, t in rows}
    found = bpe.digests(df, ranks).collect()
    assert len(found) == len(rows)
    for row in found:
        ids = want[row.doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(decoded[row.doc_id]).hexdigest()
    assert bpe.digests(df.where("false"), ranks).collect() == []


def test_exact_pieces_are_the_fallback(ranks, library, texts, monkeypatch):
    monkeypatch.setattr(textops, "span_hashes", lambda body, starts, ends, which=0: np.zeros(len(starts), np.uint64))
    body, offsets = textops.text_bytes(pa.array(texts[:40]))
    found, _ = bpe.encode_chunk(bpe.Vocabulary.from_lines(ranks), body, offsets)
    for k, text in enumerate(texts[:40]):
        assert found.flat[found.offsets[k] : found.offsets[k + 1]].tolist() == library.encode_ordinary(text)


@pytest.mark.parametrize("n", [0, 1, 31, 33, rans.BLOCK - 1, rans.BLOCK, rans.BLOCK + 1, 5 * rans.BLOCK + 7])
def test_coded_blocks(n):
    values = np.random.default_rng(n).zipf(1.3, n) % 50_000
    table = rans.Table.of(values)
    coded = rans.encode(values, table)
    assert np.array_equal(rans.decode(coded, table), values)
    if n > 3 * rans.BLOCK:
        assert np.array_equal(rans.decode(coded, table, 1, 3), values[rans.BLOCK : 3 * rans.BLOCK])
        coded.words = coded.words.copy()
        coded.words[5] ^= 1
        with pytest.raises(ValueError, match="checksum"):
            rans.decode(coded, table)


def test_files_hold_all_ids_in_order(spark, texts, monkeypatch):
    monkeypatch.setattr(tokenfiles, "PARTITION_BYTES", 6_000)
    monkeypatch.setattr(tokenfiles, "SEGMENT", 2_000)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    rng = random.Random(5)
    rows = [(rng.randint(-(10**9), 10**9), t) for t in texts] + [(None, "x"), (3, None), (4, "twice"), (4, "twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(tokenfiles.round_trip(df, vocabulary_bytes("byte_bpe_50k.json")).collect(), key=lambda r: r.start)
    want, at = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert [tuple(r) for r in got] == want
    assert tokenfiles.round_trip(df.where("false"), vocabulary_bytes("byte_bpe_50k.json")).collect() == []


def test_files_match_added_tokens(spark, texts, tmp_path):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    marked = [f"a{end}b", end, end * 3, f"so  {end}  it 's{end}'s", f" {end}\n\n{end} ", f"<|endof{end}text|>", "<|endof", "text|>", f"é{end}漢"]
    rows = [*enumerate([*texts, *marked])]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in op8_token_files(spark, str(tmp_path)).collect()}
    for doc, text in rows:
        ids = [*plain.encode(text, add_special_tokens=False).ids, 2]
        assert found[doc] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), text


def test_added_tokens_are_matched_longest_first():
    import json

    changed = json.loads(vocabulary_bytes("byte_bpe_50k.json"))
    kind = changed["added_tokens"][0]
    changed["added_tokens"] += [{**kind, "id": 50257 + k, "content": c, "special": k > 0} for k, c in enumerate([" b a", "<|end", "é漢"])]
    library = Tokenizer.from_str(json.dumps(changed))
    mine = tokenfiles.LibraryPieces(json.dumps(changed).encode(), added_tokens=True)
    texts = ["<|endoftext|> x<|endless", "a b a b a b a", " b", " a b", "xé漢é", "<|en", "d b"]
    flat, at = mine.encode(*textops.text_bytes(pa.array(texts)))
    assert [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [library.encode(t, add_special_tokens=False).ids for t in texts]
