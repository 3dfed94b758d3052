"""Language, quality model, quality rules and page text."""

import math
import random
import re
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from tremorlake.llm import html_text, language, quality_model, quality_rules

EN, DE = "the of and that with this from have".split(), "der die und nicht mit ist auf für".split()


@pytest.fixture(scope="module")
def two(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, 40, EN if i % 2 else DE), "en" if i % 2 else "de") for i in range(60)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


@pytest.fixture(scope="module")
def model(two):
    return language.fit(two)


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(2)
    for _ in range(40):
        sizes = rng.integers(1, 6, 3)
        lane = np.repeat(np.arange(3), sizes)
        e = rng.normal(0, 3, (len(lane), 3)).astype(np.float32)
        path = language.viterbi(e, lane, 2.0)
        for k in range(3):
            own, got = e[lane == k].astype(float), path[lane == k]
            value = lambda p: sum(own[t, s] for t, s in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023, E731
            assert value(got) == pytest.approx(max(value(p) for p in product(range(3), repeat=len(own))))


def test_mixed_text_gets_spans(model):
    rng = random.Random(4)
    a, b = prose(rng, 60, EN), prose(rng, 30, DE)
    (name, score, spans), = language.label([f"{a} {b}"], model)
    assert name == "en" and 0 < score <= 1
    assert [s[0] for s in spans] == ["en", "de"]
    assert abs(spans[0][2] - len(a)) < 25 and spans[0][1] == 0 and spans[-1][2] == len(a) + 1 + len(b)


def test_scripts_narrow_the_candidates(spark):
    docs = spark.createDataFrame([(1, "кот сидит на окне и смотрит", "ru"), (2, "the cat sits at the window", "en")], "doc_id bigint, text string, lang string")
    got = language.label(["окно", "window", "漢字", "123 !!", None, ""], language.fit(docs))
    assert [g[0] for g in got[:2]] == ["ru", "en"]
    assert [g[0] for g in got[3:]] == ["und"] * 3


def test_language_of_odd_rows(odd, nothing, model):
    got = language.identify(odd, model, ["doc_id", "score", "_text", "c0"], ("l", "s", "p")).collect()
    assert len(got) == odd.count() and {r.score for r in got} == {"x"} and {r["_text"] for r in got} == {"c"}
    assert {r.l for r in got if r.doc_id in (2, 3, 4)} == {"und"}
    assert all(0 <= r.s <= 1 for r in got)
    assert language.identify(nothing, model, ["doc_id"]).collect() == []
    assert {r.lang_pred for r in language.identify(odd, language.fit(nothing), ["doc_id"]).collect()} == {"und"}
    language.fit(odd)


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    from tremorlake.llm.queries import QUERIES
    got = QUERIES["op2_language_id"](spark, sf).join(docs, "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() >= 0.98 * got.count()


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    from tremorlake.llm.queries import QUERIES
    got = QUERIES["op9_quality_model"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    rank = got.score.rank()
    ones = int(got.quality.sum())
    auc = (rank[got.quality == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(got) - ones))
    assert auc > 0.98 and (got.predicted == got.quality).mean() > 0.95
    assert abs(got.score.mean() - got.quality.mean()) < 0.05


def test_quality_of_odd_rows(odd, nothing, labels):
    model = quality_model.fit(odd, labels)
    got = quality_model.score(odd, model, name="q").collect()
    assert len(got) == odd.count() and all(0 <= r.q <= 1 for r in got) and {r["_text"] for r in got} == {"c"}
    assert len({r.q for r in got if r.doc_id in (2, 3)}) == 1
    assert quality_model.score(nothing, model).collect() == []
    assert all(r.q == 0.5 for r in quality_model.score(odd, quality_model.fit(nothing, labels), ["doc_id"], "q").collect())


def test_temperature_calibrates():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 5))
    y = (rng.random(4000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    net = quality_model.train(x, y, np.arange(4000) % 5 == 4)
    p = net.probability(x)
    for low in (0.1, 0.4, 0.7):
        part = (p >= low) & (p < low + 0.2)
        assert abs(p[part].mean() - y[part].mean()) < 0.1


def counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i:i + 3]), []).append(i)
    covered = {j for v in seen.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_rule_counts_equal_plain_python(spark, odd):
    rng = random.Random(6)
    some = [(i, "".join(rng.choices(["a", "b", " ", " ", "\n", "\t", "\x0b", "é", "#", "<", " ", "ab "], k=rng.randint(0, 80)))) for i in range(300)]
    docs = spark.createDataFrame(some, "doc_id bigint, text string").unionByName(odd.where("doc_id > 1").select("doc_id", "text"))
    got = quality_rules.measure(docs.withColumn("row", F.monotonically_increasing_id()), ["doc_id", "text"]).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(r.text), r.text


def test_binomial_tail(spark):
    rows = [(k, n) for n in (1, 5, 50, 1000, 200_000) for k in (0, 1, 3, 7, 40, 1900) if k < n * 0.01]
    got = spark.createDataFrame(rows, "k bigint, n bigint").select("k", "n", quality_rules.binomial_tail("k", "n", 0.01).alias("t")).collect()
    for r in got:
        true = math.fsum(math.exp(math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1) + i * math.log(0.01) + (r.n - i) * math.log1p(-0.01)) for i in range(r.k + 1))
        assert r.t == pytest.approx(true, rel=1e-8, abs=1e-300)


def test_cutoffs_are_certified(spark):
    """Against the rule in plain Python, on figures of which only one tells good from bad."""
    rng = random.Random(7)
    figures = {f"f_{name}": 0.0 for name in quality_rules.RULES}
    rows = [{"stratum": s, "good": good, **figures, "f_symbols": rng.random() * (0.12 if good else 2.5)} for s, n in (("a", 3000), ("b", 40)) for i in range(n) for good in [i % 4 > 0]]
    got = quality_rules.certify(spark.createDataFrame(rows)).collect()
    assert [(r.stratum, r.rule) for r in got] == [("a", "symbols")]
    assert got[0].cutoff == 0.15 and got[0].good_rejected == 0 and got[0].n_good == 2250
    assert got[0].tail <= quality_rules.DELTA / 12


def test_rules_on_odd_rows(odd, nothing, labels):
    got = quality_rules.judge(odd, labels).collect()
    assert len(got) == odd.count() and not any(r.kept and r.base_failed for r in got)
    assert quality_rules.judge(nothing, labels).collect() == []
    assert quality_rules.judge(odd, labels.limit(0)).where("kept = base_failed").count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>x</article>";</script></head><body>
<header><h2>Site of the best news and the rest</h2></header><nav><ul><li><a href=/>Home</a></li></ul></nav><!-- <article>no</article> -->
<div class="cookie-notice"><p>We use cookies to make the site better for all of the people who visit it and for the ads that it shows.</p></div>
<article><h1>The&nbsp;title &amp; more</h1><p>%s<br>next <b>line</b></p><p>Short one.</p><div class="ad">Buy this in the shop of the year, it is on sale for the rest of the week.</div>
<p>%s</p></article><div id="comments"><p>%s</p></div><form><label>Name</label></form><aside>%s</aside><footer>&copy; all of the rights</footer></body></html>"""


def test_main_text_of_a_page():
    long = "It is the end of the day and the people of the town are on the way to the river, for it is warm and the sun is out. "
    text = html_text.extract(PAGE % (long * 3, long * 3, long * 3, long * 3))
    body = (long * 3).strip()
    assert text == f"The title & more\n\n{body} next line\n\nShort one.\n\n{body}"


@pytest.mark.parametrize("html", ["", None, "<", "<p", "<!-- never closed", "<script>never closed", "</div></p>", "<p>a<p>b", "&#0;&bogus;", "<div " * 500, "<b>" * 3000 + "x"])
def test_broken_pages_do_not_crash(html):
    assert isinstance(html_text.extract(html), str)


def test_open_blocks_inherit():
    long = "It is the end of the day and the people of the town are on the way to the river, for it is warm and the sun is out. " * 3
    assert html_text.extract(f"<div><p>{long}</p><p>Yes.</p><p>{long}</p></div>").count("\n\n") == 2
    assert html_text.extract("<ul><li><a href=x>one</a></li><li>two</li><li><a href=y>three</a></li></ul>") == ""


def test_page_text_of_odd_tables(spark):
    pages = spark.createDataFrame([(1, "u", None, "x"), (2, None, "", "y"), (None, "u", "<article><p>Hi.</p></article>", None), (2, None, "", "y")], "page_id bigint, url string, html string, text string")
    got = sorted(html_text.main_text(pages).collect(), key=str)
    assert len(got) == 4 and {r.n_chars for r in got} == {0, 3}
    assert html_text.main_text(pages.limit(0)).collect() == []


def test_page_text_equals_the_articles_of_the_pages_table(spark):
    from html import unescape
    rows = html_text.main_text(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"), ["page_id", "html"]).collect()
    for r in rows:
        inner = re.split(r"</?(?:h1|p)>", re.sub(r"<br>", " ", re.search(r"<article>(.*?)</article>", r.html, re.S)[1]))
        assert r.text == "\n\n".join(x for x in (" ".join(unescape(re.sub(r"<[^>]+>", "", p)).split()) for p in inner) if x)
