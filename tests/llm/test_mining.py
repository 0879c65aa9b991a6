"""Operators 11 to 13: infilling, main text of pages, hard negatives."""

import hashlib
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthmark.llm import infill, mainhtml, negatives
from hearthmark.llm.mainhtml import Page

# ---- infilling ------------------------------------------------------------------------


@pytest.mark.parametrize("alphabet", ["abc", "aé", "a漢😀é", "😀"])
def test_rank_index_is_exact_and_small(alphabet):
    rng = random.Random(1)
    for n in (0, 1, 7, 3000, 120_000):
        body = np.frombuffer("".join(rng.choice(alphabet) for _ in range(n)).encode(), np.uint8)
        places = infill._starts(body)
        index = infill.RankIndex(places)
        assert (index.at(np.arange(len(places))) == places).all()
        assert np.abs(index.residuals).max(initial=0) <= infill.REACH + 1
        assert len(index.starts) <= 1 + n // 1000


def test_rank_index_follows_changes_of_alphabet():
    places = infill._starts(np.frombuffer((("a" * 3000 + "漢" * 3000) * 20).encode(), np.uint8))
    index = infill.RankIndex(places)
    assert (index.at(np.arange(len(places))) == places).all() and len(index.starts) <= 41


def infill_by_hand(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if text == "" or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_infilled_texts_against_plain_python(spark):
    rng = random.Random(2)
    texts = ["", None, "a", "é", "<P> mark", "x <S>", "\n", "<", "ab" * 200_000, "漢字😀" * 70_000]
    texts += ["".join(rng.choice("ab é漢😀<P>\n") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    rows = [(i % 290, t, "own", 7) for i, t in enumerate(texts)] + [(None, "no key", "own", 7), (None, "no key", "own", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string, row int").repartition(3)
    got = infill.infilled(df)
    assert set(got.columns) == {"doc_id", "text", "row", "n", "form", "prefix_chars", "middle_chars", "output"}
    got = got.withColumn("again", infill.restored(F.col("form"), F.col("output"))).collect()
    want = sorted(((d, t, *infill_by_hand(d, t)) for d, t, _, _ in rows), key=repr)
    assert sorted(((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=repr) == want
    assert all(r.again == (r.text or "") and r.row == 7 for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert infill.infilled(df.limit(0)).count() == 0


def test_infill_digests(spark):
    df = spark.createDataFrame([(5, "hello wörld"), (6, None)], "doc_id long, text string")
    for r in infill.digests(df).collect():
        n, form, a, m, output = infill_by_hand(r.doc_id, {5: "hello wörld", 6: ""}[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, a, m)
        assert r.output_sha256 == hashlib.sha256(output.encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256(("hello wörld" if r.doc_id == 5 else "").encode()).hexdigest()


# ---- main text ------------------------------------------------------------------------

PROSE = "The river ran low that summer, and the mill stood still for weeks. Nobody in the village could recall such heat."


def alone(source):
    return Page(source).text([])


@pytest.mark.parametrize(
    "around",
    [
        "<nav><ul><li><a href='/a'>Home</a></li></ul></nav>{}<footer>&copy; 2020</footer>",
        "<header><h1>Site name</h1></header>{}<aside>Other things to read here</aside>",
        "<div class='cookie-notice'>We use cookies. Please agree.</div>{}<div id=comments><p>First! I like it a lot.</p></div>",
        "<script>var a = '<article>no</article>';</script><style>p{{}}</style>{}<form><label>Name</label><input><textarea>x</textarea></form>",
        "<div class='ad'>Buy now, it is cheap.</div>{}<div class='sidebar-left'><div>Links of ours</div></div><!-- <p>gone</p> -->",
        "<div class=topbar role=banner>Brand</div>{}<div style='display: none'>hidden words</div><div hidden>more</div>",
        "<div class=header>Brand and claim</div>{}<section class='related-posts'><article><p>Another story.</p></article></section>",
    ],
)
@pytest.mark.parametrize("inside", ["<article><h1>Title</h1>{}</article>", "<div class='post-body p7'><h1>Title</h1>{}</div>", "<main><div>{}</div></main>"])
def test_parts_beside_the_article_go(around, inside):
    article = inside.format(f"<p>{PROSE}</p><p>A second <b>par</b>agraph &amp; more\n of  it&nbsp;.<br>Next</p><ul><li>one<li>two</ul>")
    want = ("" if "main" in inside else "Title ") + f"{PROSE} A second paragraph & more of it . Next one two"
    assert alone(f"<html><body class='with-sidebar'>{around.format(article)}</body></html>") == want


def test_parts_inside_the_article():
    page = (
        "<article class='post'><header><h1>Head</h1><p>by A</p></header><p>{0}</p><div class='ad-slot'>Ad text.</div><p>{0}</p>"
        "<aside>Note</aside><footer>Tags</footer><div class=share>Share it</div><section id=comments><p>Reader says so.</p></section></article>"
    ).format(PROSE)
    assert alone(page) == f"Head by A {PROSE} {PROSE}"


def test_broken_pages():
    assert alone("") == "" and alone("   ") == "" and alone("no markup at all") == "no markup at all"
    assert alone(f"<article><p>{PROSE}<p>and <b>bold<p>next &am") == f"{PROSE} and bold next &am"
    assert alone("<p>1 < 2 && 3 > 2 &lt;b&gt; &#x41;&#66; &copy 5</p>") == "1 < 2 && 3 > 2 <b> AB © 5"
    assert alone("<p>one</p></p></div>two<p title='a>b' class=\"x\">three</p") == "one two three"
    assert alone("<p>seen</p><script>never ended") == "seen" and alone("<p>seen</p><!-- never ended") == "seen"
    assert alone("<div>x <a href=\"never ended>y</a>") == "x"
    assert alone("<nav>only a menu</nav>") == ""


def test_reading_takes_linear_time():
    for part in ("<div>", "<p><b>", "<a \"", "<a href='", "</div>", "<ul><li>", "<", "&amp;", "<div class=a1><span class=ad>x", "<table><tr><td>"):
        started = time.perf_counter()
        alone(part * (400_000 // len(part)) + "end")
        assert time.perf_counter() - started < 6, part


def page_of(host, i, body):
    return (i, f"https://{host}/p/{i}", body)


def test_votes_of_a_host_decide(spark, monkeypatch):
    rng = random.Random(3)
    rows = []
    for i in range(20):  # the long remarks of two pages would win there alone
        remarks = f"<div class='talk n{i}'><p>{'Long remarks of a reader. ' * 60 if i < 2 else 'Fine.'}</p></div>"
        rows.append(page_of("a.example", i, f"<body><div class='text c{rng.randint(1, 9)}'><p>{PROSE} Page {i}.</p></div>{remarks}</body>"))
    rows += [(30, "https://b.example/x", f"<div class=q><p>{PROSE}</p></div>"), (31, None, f"<article>{PROSE}</article>"), (32, "odd url", None), (33, "", "")]
    rows.append(rows[0])
    df = spark.createDataFrame([(*r, "own", 1) for r in rows], "page_id long, url string, html string, text string, host int").repartition(3)
    got = mainhtml.main_text(df)
    assert got.columns == ["page_id", "url", "html", "host", "text"]
    results = got.collect()
    texts = {r.page_id: r.text for r in results}
    assert len(results) == len(rows)
    assert all(texts[i] == f"{PROSE} Page {i}." for i in range(20))
    assert texts[30] == texts[31] == PROSE and texts[32] == texts[33] == ""
    assert Page(rows[0][2]).text([]) != texts[0]
    # the other way to join gives the same rows
    monkeypatch.setattr(mainhtml, "BROADCAST_BYTES", -1)
    again = mainhtml.main_text(df).collect()
    assert sorted((tuple(r) for r in again), key=repr) == sorted((tuple(r) for r in results), key=repr)
    assert mainhtml.main_text(df.limit(0)).count() == 0


def test_votes_against_plain_counting(spark):
    rows = [(f"h{i % 3}", f"<div class=c{'x' if i % 4 else 'y'}><p>{PROSE}</p></div>") for i in range(60)] + [("h0", f"<div class=once><p>{PROSE}</p></div>"), ("h1", "")]
    got = {r.host: r.paths for r in mainhtml.consensus(spark.createDataFrame(rows, "host string, html string")).collect()}
    for host in ("h0", "h1", "h2"):
        votes = {}
        for h, page in rows:
            path = Page(page).vote()
            if h == host and path is not None:
                votes[path] = votes.get(path, 0) + 1
        winners = [p for p, v in votes.items() if v >= 2 and v * 100 >= 2 * sum(votes.values())]
        assert got[host] == sorted(winners, key=lambda p: (-votes[p], p))


# ---- hard negatives -------------------------------------------------------------------


def mined_by_hand(rows, anchors, positives, negatives, band):
    one = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        q = [int(x) for x in np.floor(256.0 * np.array(v, np.float64))]
        one[i] = min(one.get(i, (label, q)), (label, q))

    def score(a, b):
        return sum(x * y for x, y in zip(one[a][1], one[b][1], strict=False))

    out = []
    for a in (i for i in one if anchors(i)):
        others = sorted(((-score(a, b), b) for b in one if b != a))
        for s, p in [x for x in others if one[x[1]][0] == one[a][0]][:positives]:
            fitting = [x for x in others if one[x[1]][0] != one[a][0] and -band[0] * s <= -100 * x[0] <= -band[1] * s][:negatives]
            out += [(a, p, k + 1, b, -s, -t) for k, (t, b) in enumerate(fitting)]
    return sorted(out)


def vectors(spark, rows):
    schema = T.StructType(
        [T.StructField("vec_id", T.LongType()), T.StructField("label", T.StringType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("id", T.StringType())]
    )
    return spark.createDataFrame([(*r, "own") for r in rows], schema)


def test_negatives_against_brute_force(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(4, 24))
    rows = [(i, str(i % 3 if i % 5 else 0), [float(x) for x in centres[i % 4] + 0.6 * rng.normal(size=24)]) for i in range(420)]
    rows += [(1000 + i, "1", rows[7][2]) for i in range(40)]  # ties
    rows += [rows[5], (5, "2", [1.0] * 24), (2000, "0", []), (2001, "0", [1.0, 2.0]), (2002, "1", [0.5] * 70)]
    rows += [(None, "0", [1.0]), (2003, None, [1.0]), (2004, "0", None), (2005, "0", [float("nan")]), (2006, "1", [float("-inf")]), (2007, "1", [None, 1.0])]
    df = vectors(spark, rows).repartition(3)
    for sizes in ({"group_rows": 64, "block_anchors": 8}, {}):
        got = negatives.hard_negatives(df, anchor=F.col("id") % 20 == 0, **sizes)
        assert sorted(map(tuple, got.collect())) == mined_by_hand(rows, lambda i: i % 20 == 0, 5, 10, (30, 90))
    got = negatives.hard_negatives(df, anchor=F.col("id") % 50 == 0, positives=2, negatives=3, band=(10, 70))
    assert sorted(map(tuple, got.collect())) == mined_by_hand(rows, lambda i: i % 50 == 0, 2, 3, (10, 70))
    assert negatives.hard_negatives(df.limit(0)).count() == 0


@pytest.mark.parametrize("scale", [1e6, 1e9, 1e16])
def test_large_components_stay_exact(spark, scale):
    rng = np.random.default_rng(5)
    limit = (1 << 63) - 1
    rows = [(i, str(i % 2), [float(x) for x in scale * rng.normal(size=4)]) for i in range(40)]
    got = negatives.hard_negatives(vectors(spark, rows), anchor=F.col("id") < 4).collect()
    if scale < 1e9:
        assert sorted(map(tuple, got)) == mined_by_hand(rows, lambda i: i < 4, 5, 10, (30, 90))
    else:
        assert all(abs(r.positive_score) <= limit for r in got)


def test_bounds_hold_and_leave_pairs_out():
    rng = np.random.default_rng(6)
    centres = np.repeat(rng.normal(size=(10, 8)), 8, axis=1)  # near values lie side by side
    rows = centres[rng.integers(0, 10, 3000)] + 0.15 * rng.normal(size=(3000, 64))
    table = pa.table(
        {
            "id": np.arange(3000),
            "label": [str(i % 2) for i in range(3000)],
            "numbers": [negatives._packed(np.floor(256 * r)) for r in rows],
        }
    )
    held = negatives.Vectors(table)
    anchors, everything = np.arange(0, 3000, 100), np.arange(3000)
    exact = negatives.scores(held, anchors, held, everything)
    for level in range(len(negatives.WIDTHS)):
        low, high = negatives.bounds(held, anchors, held, everything, level)
        assert (low <= exact).all() and (exact <= high).all()
    counted = []
    asked = negatives.Vectors(table.take(pa.array(anchors)))
    found = negatives.positives_of_group(asked, held, 5, counted)
    assert found.num_rows == 5 * len(anchors)
    met, scored = counted[0]
    assert scored * 4 < met


def test_quantising_rounds_down(spark):
    rows = negatives.prepared(vectors(spark, [(1, "0", [0.1, -0.1, 0.0, 300.0, -1e9])]), "vec_id", "embedding", F.col("label")).collect()
    kind, numbers = rows[0].numbers[0], rows[0].numbers[1:]
    assert np.frombuffer(bytes(numbers), negatives._KINDS[kind]).tolist() == [25, -26, 0, 76800, -256_000_000_000]
