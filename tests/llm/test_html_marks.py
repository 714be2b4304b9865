"""Boilerplate words on wrappers, and attributes inside other attributes' values."""

import time
import tracemalloc

import pytest

from tallybook.llm.html_extract import best_container, extract, inner_text, parse

BODY = "Long text of the article. " * 20
WANT = " ".join(("Head " + BODY).split())


def text_of(source):
    page = parse(source)
    return inner_text(page, {best_container(page)[0]})


@pytest.mark.parametrize("wrapper", ["main class='content has-sidebar'", "div class='page with-menu'", "article class='post related-3'"])
def test_marked_wrappers_keep_their_article(wrapper):
    source = f"<body><nav>Home</nav><{wrapper}><h1>Head</h1><p>{BODY}</p><div class='sidebar'><p>side</p></div></{wrapper.split()[0]}><div class='ad'>Buy</div></body>"
    assert text_of(source) == WANT


def test_comments_longer_than_the_article_go():
    source = f"<main><h1>Head</h1><p>{BODY}</p><section class='comments'><article class='comment'>{BODY * 3}</article></section></main>"
    assert text_of(source) == WANT


@pytest.mark.parametrize("attribute", ["title='The hidden cost'", "href='/hidden/gems'", "href='/item?id=search'", "data-id='related'", "data-class=menu"])
def test_values_of_other_attributes_are_no_marks(attribute):
    assert text_of(f"<main><p>One <a {attribute}>two</a> three {BODY}</p></main>") == " ".join(f"One two three {BODY}".split())
    assert text_of(f"<main><p>One <b hidden>no</b><b id='search'>no</b> {BODY}</p></main>") == " ".join(f"One {BODY}".split())


def test_short_article_on_a_marked_winning_path(spark):
    page = "<body><main class='content has-sidebar'><p>{}</p></main><div class='x'>{}</div></body>"
    rows = [(i, f"https://a.org/{i}", page.format(BODY, "")) for i in range(3)] + [(9, "https://a.org/9", page.format("short", BODY))]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == " ".join(BODY.split()) and got[9] == "short"


@pytest.mark.parametrize(
    "source, want",
    [
        ("<p data-n=don't>Two two.</p><p>It's three.</p>", "Two two. It's three."),
        ('<p>A <a href="x"">link</a> b</p>', "A link b"),
        ("<p>A <a href=/q?x='y>link</a> b's</p>", "A link b's"),
        ('<p>A <a title="1 > 0" href = \'x>y\'>link</a> b</p>', "A link b"),
        ('<p>A <b title="never closed>bold</b> c</p>', "A bold c"),
        ("<p>So <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x = 2</annotation></math> holds</p>", "So x=2 holds"),
        ("<p>A <script a='>' b>var x = '<p>';</script>b</p><scripted>c</scripted>", "A b c"),
    ],
)
def test_quotes_count_only_after_an_equals_sign(source, want):
    assert text_of(f"<main>{source}</main>") == want


def test_end_tags_without_a_start_take_linear_time():
    source = "<main><p>" + "<span>a</b></i></u>" * 40_000 + "</p></main>"  # 0.8 MB
    started = time.process_time()
    assert text_of(source) == "a" * 40_000
    assert time.process_time() - started < 20


def test_deep_nesting_takes_linear_room():
    source = "<main>" + "<div class='a'>x" * 20_000
    tracemalloc.start()
    page = parse(source)
    assert tracemalloc.get_traced_memory()[1] < 200 << 20  # the paths alone would be 1.2 GB
    tracemalloc.stop()
    assert page.path(3) == "/main/div.a/div.a" and " ".join(text for _, text in page.blocks) == " ".join("x" * 20_000)
