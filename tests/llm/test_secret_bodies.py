"""Compressed bodies of hostile texts: members, levels, bombs and bodies that contain themselves."""

import base64
import bz2
import gzip
import lzma
import random
import resource
import subprocess
import sys
import zlib

import pytest

from hearthmark.llm import secrets

SECRET = "password = abcdefghij123456"


def wrapped(data):
    return "text before " + base64.b64encode(data).decode() + " after"


def kinds(text):
    return {(k, text[s:e].startswith("text") or s) for k, s, e, nested in secrets.scan_text(text) if nested}


def by_hand(data):
    """Plain recursion over whole bodies, every member of every level."""
    for opener in (gzip.decompress, bz2.decompress, lzma.decompress, zlib.decompress):
        try:
            body = opener(data)
        except (OSError, zlib.error, lzma.LZMAError, EOFError, ValueError):
            continue
        return by_hand(body)
    return data


@pytest.mark.parametrize("seed", range(6))
def test_levels_and_members_against_plain_recursion(seed):
    rng = random.Random(seed)
    body = (" ".join(rng.choice(["word", SECRET, "AKIA" + "Q" * 16, "0123456789abcdef0123"]) for _ in range(rng.randint(1, 30)))).encode()
    for _ in range(rng.randint(1, 5)):
        cut = rng.randint(0, len(body))
        pack = rng.choice([lambda x: gzip.compress(x[:cut]) + gzip.compress(x[cut:]), bz2.compress, lzma.compress, zlib.compress])  # noqa: B023
        body = pack(body)
    text = wrapped(body)
    want = {k for k, _, _ in secrets.base_spans(by_hand(body).decode())}
    spans = secrets.scan_text(text)
    assert {k for k, _, _, nested in spans if nested} == want
    assert all((s, e) == (12, len(text) - 6) for _, s, e, nested in spans if nested)


def test_second_member_and_trailing_bytes():
    data = gzip.compress(b"nothing here at all ") + gzip.compress(SECRET.encode()) + b"\0\0rest"
    assert any(k == "assign" for k, _, _, nested in secrets.scan_text(wrapped(data)) if nested)


def test_a_body_that_contains_itself_ends(monkeypatch):
    """An unpacking that gives back its own input, as such a file would."""
    real = secrets._inflated
    quine = gzip.compress(b"x" * 50)

    def inflated(chunks):
        data = b"".join(chunks)
        return iter([data]) if data == quine else real(iter([data]))

    monkeypatch.setattr(secrets, "_inflated", inflated)
    assert secrets.scan_text(wrapped(quine)) is not None


def test_a_find_across_windows(monkeypatch):
    monkeypatch.setattr(secrets, "WINDOW", 4096)
    monkeypatch.setattr(secrets, "OVERLAP", 256)
    for shift in range(3900, 4200, 7):
        data = gzip.compress(b"y " * (shift // 2) + SECRET.encode() + b" z" * 3000)
        assert any(k == "assign" for k, _, _, nested in secrets.scan_text(wrapped(data)) if nested), shift


def test_bomb_within_bounded_memory():
    """200 MB of text with a secret at its end, in a process that may not take 600 MB in all."""
    code = """
import base64, gzip, io, resource, sys
from hearthmark.llm import secrets
buffer = io.BytesIO()
with gzip.GzipFile(fileobj=buffer, mode="wb") as out:
    for _ in range(200):
        out.write(b"plain words " * 87381)
    out.write(b"password = abcdefghij123456")
text = base64.b64encode(buffer.getvalue()).decode()
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
spans = secrets.scan_text(text)
grown = (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024
print(any(k == "assign" for k, *_ in spans), grown < 300, grown)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, cwd=str(__import__("pathlib").Path(__file__).parents[2]))
    assert done.stdout.startswith("True True"), done.stdout + done.stderr
    assert resource.getrusage(resource.RUSAGE_CHILDREN).ru_maxrss > 0
