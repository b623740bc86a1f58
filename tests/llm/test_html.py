"""The labeller against one worked out number by number, pages of any length and depth, and pages of many forms."""

import html
import math
import random
import re
import time

import numpy as np
import pytest

from quarrygraph.llm import html_extract as h


def plain_scores(net, x):
    """The two LSTMs with plain loops over numbers."""
    sig = lambda v: 1 / (1 + math.exp(-v))
    n, total = h.HIDDEN, [float(net.bo[0])] * len(x)
    for k, d in enumerate("fb"):
        w, u, b = (getattr(net, c + d).astype(float).tolist() for c in "wub")
        s, c = [0.0] * n, [0.0] * n
        for t in range(len(x)) if d == "f" else reversed(range(len(x))):
            some = [(i, v) for i, v in enumerate(x[t].tolist()) if v]
            a = [b[j] + sum(v * w[i][j] for i, v in some) + sum(s[i] * u[i][j] for i in range(n)) for j in range(4 * n)]
            c = [sig(a[n + j]) * c[j] + sig(a[j]) * math.tanh(a[3 * n + j]) for j in range(n)]
            s = [sig(a[2 * n + j]) * math.tanh(c[j]) for j in range(n)]
            total[t] += sum(s[j] * float(net.wo[k * n + j]) for j in range(n))
    return total


@pytest.fixture(scope="module")
def pages():
    return [p for p, _ in h.generated(12, 5)]


def test_scores_number_by_number(pages):
    net = h.model()
    xs = [h.vectors(h.leaves(p)) for p in pages]
    for x, got in zip(xs, net.scores(xs), strict=True):
        assert np.allclose(got, plain_scores(net, x), atol=1e-3)


def test_windows_give_the_same(pages, monkeypatch):
    net, found = h.model(), [h.leaves(p) for p in pages]
    whole = net.scores([h.vectors(f) for f in found])
    texts = h.extract(pages, net)
    monkeypatch.setattr(h, "WINDOW", 7)
    assert all(np.allclose(net.long_scores(f), w, atol=1e-4) for f, w in zip(found, whole, strict=True))
    assert h.extract(pages, net) == texts


def test_gradient_of_the_loss(pages):
    """A step of training lowers the loss that it is a step for."""
    xs = [h.vectors(h.leaves(p)) for p in pages]
    ys = [(np.arange(len(x)) % 2).astype(np.float32) for x in xs]
    loss = lambda net: sum(float(np.logaddexp(0, np.where(y > 0, -z, z)).sum()) for z, y in zip(net.scores(xs), ys, strict=True))
    assert loss(h.Labeller().fit(xs, ys, epochs=3, rate=0.003)) < loss(h.Labeller())


def test_paths_at_any_depth():
    a, b = h.leaves('<div class="x">one<div class="y z">two</div>three</div>four</p></b>')[:2]
    assert a.path != b.path and a.depth == 1 and b.depth == 2 and bin(b.path).count("1") >= 5
    found = h.leaves("<div>" * 20_000 + "x" + "</i></q></section>" * 20_000 + "</div>" * 20_000 + "<p>end")
    assert [f.text for f in found] == ["x", "end"]


@pytest.mark.parametrize("unit", ["<a", "<p>x", "<a href=\"", "<a href='x>", "<!-- ", "<script", "<div class=\"a", "</p>", "<div>x", "&amp", "<"])
def test_time_grows_with_the_page(unit):
    def seconds(n):
        began = time.process_time()
        h.leaves(unit * n)
        return time.process_time() - began

    assert seconds(60_000) < 30 * seconds(6_000) + 1


ARTICLE = ["The committee met on Tuesday to discuss the budget.", "Members agreed that the new library would open in spring, although costs have risen.", "A final vote is planned for May."]
FORMS = {
    "article": "<article><h1>Budget talks</h1>{}</article>",
    "main": "<main><h1>Budget talks</h1>{}</main>",
    "content": '<div id="content"><h1>Budget talks</h1>{}</div>',
    "story": '<div class="story article-body"><h1>Budget talks</h1>{}</div>',
}


@pytest.mark.parametrize("form", FORMS)
def test_forms_of_pages(form):
    net = h.model()
    body = FORMS[form].format("".join(f"<p>{x}</p>" for x in ARTICLE))
    page = f"""<html><head><title>Budget talks</title><style>p{{color:red}}</style></head><body><header><a href="/">Daily</a></header><nav><ul><li><a href="/a">home</a></li><li><a href="/b">sports</a></li></ul></nav>
      {body}<section class="comments"><h3>2 comments</h3><div class="comment"><p>anna says</p><p>I like libraries.</p></div></section>
      <aside class="sidebar"><h3>Most read</h3><ul><li><a href="/c">Rain ahead</a></li></ul></aside><div class="cookie-banner"><p>We use cookies to improve your experience</p></div>
      <div class="ad"><p>Buy shoes now</p></div><form action="/s"><label>Search</label><input name="q"></form><footer>&copy; Daily. All rights reserved</footer><script>var p = '<p>no</p>';</script></body></html>"""
    text = h.extract([page], net)[0]
    assert text.split("\n") == ["Budget talks", *ARTICLE]


def test_held_out_pages_and_columns(spark):
    """Generated pages that training never saw, through the operator: each block's label, and the columns that follow from the text."""
    made = list(h.generated(200, 9_000))
    extra = [(1_000, "u", None), (1_001, None, ""), (None, "u", "<p>x"), (1_002, "u", "<p>" + "word " * 300_000), (1_003, "u", "<article>" + "<p>One sentence here.</p>" * 9_000)]
    df = spark.createDataFrame([(i, f"u{i}", p, "clash") for i, (p, _) in enumerate(made)] + [(*x, None) for x in extra], "page_id long, url string, html string, text string").repartition(3)
    got = {r.page_id: r for r in h.main_text(spark, df).collect()}
    right = wrong = 0
    for i, (page, main) in enumerate(made):
        blocks = [leaf.text for leaf in h.leaves(page)]
        found = got[i].text.split("\n")
        wrong += len(set(found) ^ set(main))
        right += len(blocks)
        assert all(re.sub(r"\s+", " ", html.unescape(x)).strip() == x for x in found)
        assert got[i].n_chars == len(got[i].text) and got[i].url == f"u{i}"
    assert wrong <= 0.01 * right, (wrong, right)
    assert got[1_000].text == got[1_001].text == "" and len(got) == 205
    assert got[1_003].n_chars in (0, len("\n".join(["One sentence here."] * 9_000)))


def test_random_markup_never_fails():
    r = random.Random(4)
    parts = ["<p>", "</p>", "<div class='a'", ">", '"', "'", "<", "&lt;", "&#x41", "text ", "<script>", "</script>", "<!--", "-->", "<br/>", "</", "<a href=x>", "\x00", "é", "<td>", "<li>", "</ul>", "<svg/>", "<head>", "<body>"]
    for _ in range(2_000):
        found = h.leaves("".join(r.choice(parts) for _ in range(r.randint(0, 60))))
        assert h.vectors(found).shape == (len(found), h.SIZE)
