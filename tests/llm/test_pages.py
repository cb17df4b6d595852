from collections import Counter
from itertools import product

import numpy as np
import pytest

from flowloom.llm.pages import FEATURES, Model, Page, extract, features, fit, link_kind, parse, train


@pytest.fixture(scope="module")
def model():
    return train(Counter())


def brute(model: Model, page: Page):
    """Marginals by summing over all states of all nodes."""
    n = len(page.nodes)
    odds = [model.weights[list(features(x))].sum() for x in page.nodes]
    total, on = 0.0, np.zeros(n)
    for states in product((0, 1), repeat=n):
        p = np.prod([1 / (1 + np.exp(-o if s else o)) for s, o in zip(states, odds)])
        for i in range(1, n):
            p *= np.exp(model.pair[link_kind(page, i), states[page.nodes[i].parent], states[i]])
        total += p
        on += p * np.array(states)
    return on / total


def test_marginals(model):
    for source in ("<div class=content><p>Text, here.</p><ul><li>x</ul></div><nav><a>y</a></nav>", "plain", "<body><div><div><p>a<p>b</div></div><footer>f"):
        page = parse(source)
        assert np.allclose(model.marginals(page), brute(model, page), atol=1e-6)
    assert len(model.weights) == len(FEATURES)


PAGES = [
    ("<html><head><title>no</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><a>menu</a></nav><!-- c --><div class='ad'>Buy it.</div>"
     "<article><h1>T &amp; &#228;</h1><p><b>One.<br><p>Two   and\n\tmore.</p></article><footer>&copy; x</footer>", "T & ä\nOne.\nTwo and more."),
    ("<div class=header><p>Top, as ever.</p></div><div class='content'><h1>T</h1><p>Real text one, with words.</p><p>Real two.</p><div class=comments>"
     "<p>I think this is great, really.</p><p>Second, with text.</p></div></div><aside><p>Side text.</p></aside><div class=cookie-banner>We use cookies.</div>"
     "<form><p>Sign up</p><input></form>", "T\nReal text one, with words.\nReal two."),
    ("<main><p>Hello &lt;world&gt;.</p><aside>no</aside></main><section class=comments><p>a b c, d.</p></section>", "Hello <world>."),
    ("plain text only", "plain text only"), ("<p>a<p>b<br>c", "a\nb c"), ("<p>cut <a href='x", "cut"), ("", ""), (None, ""), ("<script>x", ""),
    ("<div id=sidebar><ul><li><a href=x>q</a></ul></div><div id=post><p>Yes, this is it.</p></div>", "Yes, this is it."),
    ("<article>" + "<div>" * 300 + "<p>deep</p>" + "</div>" * 300 + "</article>", "deep"),
]


def test_texts(spark, model):
    rows = [(i, f"u{i}", h) for i, (h, _) in enumerate(PAGES)] + [(0, "u0", PAGES[0][0]), (None, None, PAGES[2][0])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    from pyspark.sql import functions as F
    got = extract(df.withColumn("text", F.lit("x")).withColumn("n_chars", F.lit(1)), model).collect()
    want = {i: t for i, (_, t) in enumerate(PAGES)} | {None: PAGES[2][1]}
    assert len(got) == len(rows)
    for r in got:
        assert r.text == want[r.page_id] and r.n_chars == len(r.text)


def test_long_page(model):
    text = "word, " * 200_000
    assert model.text(f"<body><nav>x</nav><article><p>{text}</p></article>") == text.strip()


def test_fit(spark):
    df = spark.createDataFrame([(i, "u", h) for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string")
    fitted = fit(df)
    assert fitted.text(PAGES[0][0]) == PAGES[0][1]
    assert extract(df.filter("false"), fit(df.filter("false"))).collect() == []


def test_head_without_end_tag_and_fallback_content():
    body = "<article><p>Energy is <math><mi>E</mi><mo>=</mo><mi>m</mi></math> here.</p><object data=x><p>No plugin.</p></object><canvas>A chart.</canvas></article>"
    want = ["Energy is E=m here.", "No plugin.", "A chart."]
    for start in ("<html><head><title>T</title><meta charset=utf-8><style>p{}</style></head><body>", "<html><head><title>T</title><meta charset=utf-8><style>p{}</style><body>",
                  "<html><head><meta charset=utf-8><script>var a='<p>';</script>", "<head><title>T</title><noscript><p>Off</p></noscript>"):
        assert [t for _, t in parse(start + body).blocks] == want, start


HOSTILE = {"nested": "<div>" * 100_000, "unclosed": "<a " * 100_000, "quotes": '<a ">" ' * 100_000, "odd": '<a "' * 100_001 + ">",
           "scopes": "<p><button>" + "<span>" * 50_000 + "<div>" * 50_000, "ends": "<b>" * 50_000 + "</i>" * 50_000, "items": "<li><table>" * 50_000}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages_take_linear_time(name):
    from time import process_time
    start = process_time()
    parse("<article><p>Text.</p>" + HOSTILE[name])
    assert process_time() - start < 5  # minutes where each tag looks through the page or the stack


def test_open_quotes_and_tags():
    """A quote that never ends hides no later tags; a tag that never ends takes the rest."""
    assert [t for _, t in parse("<p>one</p><a title=\"x><p>two</p><p>three").blocks] == ["one", "two", "three"]
    assert [t for _, t in parse("<p>one</p><a title='>'>two</a><p>three <b class=").blocks] == ["one", "two", "three"]
    assert [t for _, t in parse("<p>1 < 2 and <3 > 2").blocks] == ["1 < 2 and <3 > 2"]


def test_labels_of_the_pages_are_not_read():
    source = "<div data-y=0><p>Text.</p></div>"
    assert [n.given for n in parse(source).nodes][:2] == [None, None]
    assert [n.given for n in parse(source, labelled=True).nodes][:2] == [None, 0]


def test_sample_counts_copies_once(spark):
    rows = [(i, "u", PAGES[0][0]) for i in range(300)] + [(i, "u", h) for i, (h, _) in enumerate(PAGES)]
    few = spark.createDataFrame(rows, "page_id long, url string, html string")
    once = spark.createDataFrame(rows[299:], "page_id long, url string, html string")
    assert np.allclose(fit(few).weights, fit(once).weights)
