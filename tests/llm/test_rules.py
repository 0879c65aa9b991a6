"""Operators 2, 3 and 4 against plain regular expressions."""

import base64
import gzip
import hashlib
import random
import re
import urllib.parse
from collections import Counter

import pytest

from hearthmark.llm import pii, quality, secrets

PERSONAL = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for place, digit in enumerate(map(int, reversed(digits))):
        twice = 2 * digit if place % 2 else digit
        total += twice - 9 if twice > 9 else twice
    return total % 10 == 0


def personal_spans(text):
    out = []
    for kind, pattern in PERSONAL.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")),
                "card": 16 <= len(digits) <= 19 and luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans_of_personal_data(spark):
    rng = random.Random(5)
    parts = ["a", "b@", ".c", "@", ".", "-", "_", "1", "23", "255", "256", "+", "(", ") ", " ", "\U0001f600", "é", "\n"]
    parts += ["4111 1111 1111 1111", "4111-1111-1111-1111", "1.2.3.4", "x@y.zz"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(800)]
    texts += ["9" * 5000, "a" * 20000, "1." * 5000, "+1" * 3000, "a@b.c_d@e.f.g", ""]
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "doc_id long, text string")
    found = {r.doc_id: r for r in pii.digests(df).collect()}
    assert len(found) == len(texts) + 1 and found[-1].spans == ""
    for i, text in enumerate(texts):
        want = personal_spans(text)
        assert found[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), text[:80]
        counts = Counter(x.split(":")[0] for x in want)
        assert tuple(found[i][f"n_{k}"] for k in PERSONAL) == tuple(counts[k] for k in PERSONAL)


def test_terms_that_disclose_an_entity(spark):
    rng = random.Random(1)
    common = "the of and to in".split()
    filler = [(100 + i, " ".join(rng.choice(common) for _ in range(8))) for i in range(60)]
    rows = [(1, "John Zyxwu mails q@w.ee the"), (2, "so Zyxwu of q@w.ee and"), (3, "to zyxwu in q@w.ee of"), (4, "only ZYXWU here, the end"), (5, None)]
    df = spark.createDataFrame([(*r, "kept") for r in rows + filler], "doc_id long, text string, spans string")
    found = {r.doc_id: r.spans for r in pii.digests(df).collect()}
    assert found[4] == "generalise:5:10"
    assert found[1] == "email:17:23,generalise:5:10"
    assert all(found[d] == "" for d, _ in filler)
    clean = {r.doc_id: r for r in pii.sanitise(df).collect()}
    assert clean[4].text == "only <term> here, the end" and clean[2].text == "so <term> of <email> and" and clean[5].text is None
    assert clean[4].spans == "kept" and len(clean) == len(rows) + len(filler)
    # more candidate terms than are sent to every executor: a shuffle gives the same
    shuffled = pii.digests(df, pii.Disclosure(broadcast_terms=0))
    assert {r.doc_id: r.spans for r in shuffled.collect()} == found
    assert pii.digests(df.where("false")).collect() == []


@pytest.mark.parametrize(
    "text",
    [
        # the same characters around the entity in every text
        "and the of to in the of to and in " * 3 + "Zyxwu q@w.ee " + "to the and of in to of the and in " * 3,
        "Zyxwu " + "and the of to in " * 20 + "q@w.ee to",
        "q@w.ee, Zyxwu",
        "Zyxwu: q@w.ee",
        "of q@w.ee and " * 3 + "zyxwu@mail.example q@w.ee",
    ],
)
def test_terms_disclose_from_anywhere_in_a_text(spark, text):
    words = [a + b for a in ("to ", "of ", "in ", "and ") for b in ("the", "and", "of", "to", "in")]
    rows = [(k, f"{words[k]} {text}") for k in range(4)] + [(9, "only ZYXWU here")] + [(100 + i, f"{a} {b}") for i, (a, b) in enumerate((a, b) for a in words for b in words)]
    # repeated rows count once
    found = {r.doc_id: r.spans for r in pii.digests(spark.createDataFrame([*rows, *rows[:5], *rows[:9]], "doc_id long, text string")).collect()}
    assert found[9] == "generalise:5:10"
    assert all(found[k] == "" for k in found if k >= 100)


def test_an_entity_is_not_disclosed_by_its_own_parts(spark):
    words = [f"{a} {b}" for a in ("the", "and", "of", "to", "in") for b in ("the", "and", "of", "to", "in")]
    rows = [(k, f"{words[k]} zyxwu@mail.example {words[k]}") for k in range(4)] + [(100 + k, w) for k, w in enumerate(words)]
    found = {r.doc_id: r.spans for r in pii.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, text in rows[:4]:
        assert found[k] == f"email:{text.index('zyxwu')}:{text.index('zyxwu') + 18}"


def line_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = [False] * len(words)
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] >= 2:
            covered[i : i + 3] = [True] * 3
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, sum(covered)


def test_quality_counts(spark):
    rng = random.Random(3)
    parts = ["a ", "b ", "c", "é ", "漢", "\n", "#", "|\t", "\x0b", "\x1c"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 200))) for _ in range(500)] + [""]
    df = spark.createDataFrame([*enumerate(texts), (-1, None), (0, texts[0])], "kept long, text string")
    rows = quality.judge(df.withColumnRenamed("kept", "doc_id"), cleaned="clean").collect()
    assert len(rows) == len(texts) + 2
    for row in rows:
        want = line_counts(row.text or "")
        assert tuple(row[c] for c in quality.COUNTS) == want
        assert row.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (row.base_failed and row.kept)
    assert quality.judge(df).columns == ["text", *quality.ADDED.names]
    assert quality.judge(df.where("false")).collect() == []


@pytest.mark.parametrize(
    ("line", "fails"),
    [
        ("A plain sentence that goes on for quite a few words and then it ends.", False),
        ("It ends with a quote “so they say”", False),
        ("short line", False),
        ("Home | News | Sport | Weather | Contact | About | Help | Login | Search | Terms", True),
        ("words and words that never come to an end but go on and on and on", True),
        ("a sentence. and then a rest that has no end but goes on and on and on", False),
        ("THIS IS ALL SHOUTED AT THE READER FROM THE START TO THE END!!", True),
        ("$$$ ### win &&& *** now %%% $$$ ### &&&", True),
        ("We use cookies on this site.", True),
        ("Alles wächst üppig, über Äcker und Öfen hinweg, bis es aufhört.", False),
    ],
)
def test_line_rules(line, fails):
    import pyarrow as pa

    from hearthmark.llm import textops

    body, offsets = textops.text_bytes(pa.array([f"First line here.\n{line}\nLast line here."]))
    found = quality.Measures(body, offsets, quality.Rules())
    assert found.line_failed.tolist() == [False, fails, False]
    assert (line in found.cleaned(0)) != fails


SECRET = 'password = "hunter2hunter2xyz"'


@pytest.mark.parametrize(
    "hidden",
    [
        urllib.parse.quote(SECRET, safe=""),
        urllib.parse.quote(urllib.parse.quote(SECRET, safe=""), safe=""),
        "".join(f"\\u{ord(c):04x}" for c in SECRET),
        "".join(f"&#{ord(c)};" for c in SECRET),
        base64.b64encode(SECRET.encode()).decode(),
        base64.urlsafe_b64encode(gzip.compress(SECRET.encode())).decode(),
        base64.b64encode(base64.b64encode(gzip.compress(urllib.parse.quote(SECRET).encode()))).decode(),
    ],
)
def test_secrets_in_layers(hidden):
    text = f"läuft {hidden} Ende"
    spans = secrets.scan_text(text)
    nested = [s for s in spans if s[3]]
    # escapes are mapped back one by one, so the closing quote may stay outside
    assert len(nested) == 1 and nested[0][:2] == ("assign", 6)
    assert 6 + len(hidden) - 6 <= nested[0][2] <= 6 + len(hidden)


@pytest.mark.parametrize(
    "hidden",
    [
        urllib.parse.quote(SECRET, safe=""),
        urllib.parse.quote(urllib.parse.quote(SECRET, safe=""), safe=""),
        "".join(f"\\u{ord(c):04x}" for c in SECRET),
        base64.b64encode(SECRET.encode()).decode(),
        base64.b64encode(base64.b64encode(gzip.compress(urllib.parse.quote(SECRET).encode()))).decode(),
    ],
)
def test_every_copy_of_a_hidden_secret_is_found(hidden):
    text = f"{hidden}\nbetween\n{hidden}\nand\n{hidden}"
    spans = secrets.scan_text(text)
    starts = [m.start() for m in re.finditer(re.escape(hidden), text)]
    assert [(kind, s, nested) for kind, s, _, nested in spans] == [("assign", s, True) for s in starts]
    assert hidden not in secrets._redacted(text, spans)


def test_layers_end():
    assert secrets.scan_text("%2525252525 " + "%25" * 500 + " \\u005cu005c") == []


def test_base_spans_of_secrets(spark):
    rng = random.Random(9)
    parts = ["password", "Api_Key", "token", "'", '"', " ", ":", "=", "abcdef", "0123456789", "AKIA", "ABCD1234", "ſ", "é", "\n", "-", "zz"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "doc_id long, text string")
    found = {r.doc_id: r for r in secrets.digests(df).collect()}
    assert len(found) == len(texts) + 1 and found[-1].spans == ""
    for i, text in enumerate(texts):
        want = [(m.start(), 0, m.end(), "assign") for m in re.finditer(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m.group(2)) >= 12]
        want += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
        want += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 16]
        joined = ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(want))
        assert found[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), text
    marked = spark.createDataFrame([(1, f"x {SECRET} y", 5), (2, None, 6)], "doc_id long, text string, spans int")
    clean = {r.doc_id: r for r in secrets.scan(marked, redacted="text").collect()}
    assert clean[1].text == 'x [secret]" y' and clean[2].text is None and clean[2].spans == []
    assert secrets.digests(df.where("false")).collect() == []
