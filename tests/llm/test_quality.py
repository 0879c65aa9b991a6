"""Line rules of operator 3 against a plain version that judges one line after the other."""

import random
import re

import pyarrow as pa
import pytest

from hearthmark.llm import quality, textops

BLANK = "\x20\t\n\x0b\x0c\r"
RULES = quality.Rules()


def plain_verdicts(text):
    """Which lines of a text fail, line by line."""
    lines = text.split("\n")
    words = [re.findall(r"[^\x20\x09-\x0D]+", line) for line in lines]

    def unended(i):
        line = lines[i].strip(BLANK)
        ends = quality.SENTENCE_ENDS.decode() + "".join(quality.SENTENCE_ENDS_WIDE)
        return bool(words[i]) and line[-1] not in ends and not re.search(r"[.!?][\x20\x09-\x0D]", lines[i])

    worded = [i for i in range(len(lines)) if words[i]]
    run_of, runs = {}, []
    for i in worded:
        if not unended(i):
            runs.append([])
        else:
            if not runs:
                runs.append([])
            runs[-1].append(i)
            run_of[i] = runs[-1]
    out = []
    for i, line in enumerate(lines):
        n, low = len(words[i]), re.sub("[A-Z]", lambda m: m.group().lower(), line)
        if not n:
            out.append(False)
            continue
        letters = [c for c in line if c.isascii() and c.isalpha() or not c.isascii()]
        titled = sum(bool(re.match("[A-ZÀ-Þ×]", w)) for w in words[i])
        parts = sum(line.count(c) for c in (*quality.SEPARATORS.decode(), *quality.SEPARATORS_WIDE))
        reasons = [
            unended(i) and n >= RULES.unended_words,
            i in run_of and len(run_of[i]) >= RULES.menu_run,
            unended(i) and n >= RULES.title_words and titled > RULES.max_title_share * n,
            parts > RULES.max_separator_share * n,
            sum(line.count(c) for c in quality.SYMBOLS.decode()) > RULES.max_symbol_share * len(line),
            len(letters) >= RULES.upper_letters and len(re.findall("[A-Z]", line)) > RULES.max_upper_share * len(letters),
            line in lines[:i],
            any(p.decode() in low for p in RULES.phrases),
            n <= RULES.control_words and any(low.lstrip(BLANK).startswith(p.decode()) for p in RULES.controls),
        ]
        out.append(any(reasons))
    return out


def verdicts(*texts):
    body, offsets = textops.text_bytes(pa.array(texts, pa.string()))
    return quality.Measures(body, offsets, RULES)


def test_line_verdicts_as_one_by_one():
    rng = random.Random(8)
    words = ["home", "News", "Über", "été", "a", "example.com", "end.", "Why?", "SHOUT", "LOUDLY", "|", "·", "›", "#", "read more", "Cookie policy", "”", "漢字"]
    texts = []
    for _ in range(3000):
        lines = [rng.choice(["", " ", "\t"]) + " ".join(rng.choices(words, k=rng.choice([0, 1, 2, 3, 6, 14]))) + rng.choice(["", "", ".", " ", "!"]) for _ in range(rng.randint(1, 9))]
        texts.append("\n".join(lines))
    found = verdicts(*texts)
    assert found.line_failed.tolist() == [v for t in texts for v in plain_verdicts(t)]
    assert 0.2 < found.line_failed.mean() < 0.95


MENU = [f"{a} {b}" for a in ("Products", "All services", "About our", "Company") for b in ("and offers", "for families", "near you", "in stock", "by region", "of the week")]
PROSE = [" ".join(f"harbour{9 * k + i}" for i in range(9)) + " wakes early." for k in range(12)]


@pytest.mark.parametrize(
    ("text", "kept"),
    [
        ("\n".join(["Home", *MENU]), False),
        ("\n".join(" ".join(f"entry{i}" for i in range(k, k + 40)) + " example.com more" for k in (0, 50)), False),
        ("\n".join(["A heading", *PROSE[:6], "Another heading", *PROSE[6:]]), True),
        ("\n".join([*MENU[:6], *PROSE]), True),
    ],
)
def test_menus_go_and_prose_stays(text, kept):
    found = verdicts(text)
    assert not found.base_failed[0] and bool(found.kept[0]) == kept
    if kept:
        assert all(line in found.cleaned(0) for line in PROSE) and "Products" not in found.cleaned(0)
        assert ("A heading" in text) == ("A heading" in found.cleaned(0))


def test_long_text_and_clashing_names(spark):
    long = "\n".join(f"Sentence number {i} of a very long text has its end here." for i in range(60_000))
    df = spark.createDataFrame([(1, long, "a", 5), (1, long, "a", 5), (None, None, "b", None)], "doc_id long, text string, _slot string, n_words int")
    rows = quality.judge(df, cleaned="clean").collect()
    assert sorted(r.n_words for r in rows) == [0, 720_000, 720_000]
    assert {(r._slot, r.kept) for r in rows} == {("a", False), ("b", False)}  # three words in a row repeat all over
    assert quality.judge(df).columns == ["doc_id", "text", "_slot", *quality.ADDED.names]
