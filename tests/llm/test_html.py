import itertools
import random

import pytest

from tesserae.llm import html as H


def cost(odds, edges, x):
    return -sum(o for o, v in zip(odds, x) if v) + sum(c for a, b, c in edges if x[a] != x[b])


def test_minimum_cut_is_minimal():
    rng = random.Random(1)
    for _ in range(400):
        n = rng.randrange(1, 9)
        odds = [rng.choice([rng.uniform(-2, 2), rng.uniform(-9, 9), 0.0]) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 2)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]
        got = cost(odds, edges, H.minimum_cut(odds, edges))
        best = min(cost(odds, edges, x) for x in itertools.product([False, True], repeat=n))
        assert abs(got - best) < 1e-6


PARA = "The river rose again, and by noon the lower road was gone; nobody had seen such water before."


def test_article():
    page = f"""<!DOCTYPE html><html><head><title>No</title><style>p{{x}}</style><script>var t="</p><p>no</p>";</script></head><body>
    <header><h1>Site name</h1></header><nav><ul><li><a href="/a">Menu one</a></li><li>Menu two</li></ul></nav><!-- <p>no</p> -->
    <div class="cookie-notice">We use cookies, and by staying here you agree to all of our many long and tedious terms of use.</div>
    <article><h1>Flood &amp; fire</h1><p><b>{PARA}<br><p>Second&nbsp;  line
    goes   on &lt;here&gt; &#233;.</p><div class="ad">Buy this now, it is good, cheap, and better than the rest of it.</div><p>{PARA}</p>
    <form><p>Your name</p></form><section id="comments"><p>{PARA}</p></section></article>
    <aside><p>{PARA}</p></aside><div class="sidebar"><p>{PARA}</p></div><footer>&copy; me. {PARA}</footer></body></html>"""
    assert H.main_text(page) == f"Flood & fire\n{PARA}\nSecond line goes on <here> é.\n{PARA}"


def test_without_article_tag():
    page = f'<body><div id="menu"><a href=x>Home</a> <a href=y>News</a></div><div><p>{PARA}</p><p>Short one.</p><p>{PARA}</p></div><div class="footer">All rights reserved.</div></body>'
    assert H.main_text(page) == f"{PARA}\nShort one.\n{PARA}"


def test_odd_pages():
    assert H.main_text(None) == H.main_text("") == H.main_text("<p>") == H.main_text("<script>x") == ""
    assert H.main_text(f"<article><p title=\"a>b\">{PARA}</p><p data-x='>'>{PARA}") == f"{PARA}\n{PARA}"
    assert H.main_text(f"<article><p title=\"unclosed>{PARA}</p>") == PARA
    deep = "<div>" * 3000 + f"<article><p>{PARA}</p></article>"
    assert H.main_text(deep) == PARA
    many = "<article>" + f"<p>{PARA}</p><div>x</div>" * 5000
    assert H.main_text(many).count(PARA) == 5000
    assert H.main_text("<article><p>" + "a < b, c > d. " * 500) == ("a < b, c > d. " * 500).strip()


def test_frame(spark):
    rows = [(1, "u", f"<article><p>{PARA}</p></article>"), (1, "u", f"<article><p>{PARA}</p></article>"), (2, None, None), (None, "v", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'t' as text", "1 as __x")
    got = sorted((r.page_id or 0, r.url or "", r.text) for r in H.extracted(df).collect())
    assert got == [(0, "v", ""), (1, "u", PARA), (1, "u", PARA), (2, "", "")]
    assert H.extracted(df.limit(0)).count() == 0


def test_hidden_by_attribute_name():
    shown = ["class='overflow-hidden'", 'aria-hidden="false"', 'data-state="hidden"', 'title="The hidden valley"', "data-hidden", 'hidden="until-found"', 'data-x="display:none"', 'style="x-display: none"', 'title="a> hidden"', "href=/hidden/display:none", "style='display:block' title=hidden"]
    for rest in shown:
        assert not H.hides(f" {rest} "), rest
        assert H.main_text(f"<body><div {rest}><article {rest}><p>{PARA}</p><p>{PARA}</p></article></div></body>") == f"{PARA}\n{PARA}", rest
    for rest in ("hidden", "HIDDEN=''", 'class=x hidden="hidden"', "aria-hidden=true", 'aria-hidden = "True"', "style='color:red; DISPLAY : none'", 'style="display:none!important"', "a=1 hidden/"):
        assert H.hides(f" {rest} "), rest
        assert H.main_text(f"<body><article><div {rest}><p>{PARA}</p></div><p>{PARA}</p></article></body>") == PARA, rest


ARTICLE = "<article><h1>A walk</h1><p>We walked, slowly, along the river; the day was long, and nobody spoke a word of the loss.</p></article>"


@pytest.mark.parametrize(
    "page",
    [
        f'<body class="has-sidebar">{ARTICLE}</body>',
        f'<body class="no-sidebar menu-open">{ARTICLE}</body>',
        f'<html class="social-media-theme"><body>{ARTICLE}</body></html>',
        ARTICLE.replace("<article>", '<article class="post comments-open">'),
        f'<div class="notice-of-death">{ARTICLE}</div>',
        f"<form>{ARTICLE}<input name=q></form>",
        f'<script src="x"/>var a = "shown";</script>{ARTICLE}',
        f'<div class="site-footer">All rights reserved, and so on, as ever.</div><div class="comment-list"><p>I liked this, it was good, thanks a lot.</p></div>{ARTICLE}',
        f"<form><p>Your name, please, and your letter, in full, below.</p></form>{ARTICLE}",
    ],
)
def test_names_and_wrappers(page):
    text = H.main_text(page)
    assert "along the river" in text
    assert not any(x in text for x in ("shown", "reserved", "liked", "Your name"))


@pytest.mark.parametrize("piece", ["<b>", '<a "', "<div>", "<p>x</i>", "<i><div>", "</b>", "<", "<!-", "<a '\"", "&amp"])
def test_hostile_pages_end(piece):
    import time

    began = time.perf_counter()
    H.main_text(piece * (1_000_000 // len(piece)))
    H.main_text("<i><div>" + "<b>" * 100_000 + "</i>" * 100_000)
    assert time.perf_counter() - began < 20
