"""Main text of pages: what must stay, what must go, and templates against brute force."""

from __future__ import annotations

import pytest

from textmine.llm import html_text
from textmine.llm.html_text import main_text

P = "<p>Whole article.</p>"


@pytest.mark.parametrize(
    "page, want",
    [
        (f'<div class="content has-sidebar">{P}</div>', "Whole article."),
        (f'<article class="post related-none">{P}</article>', "Whole article."),
        (f'<div class="main-search">{P}</div>', "Whole article."),
        (f'<div class="related"><article>{P}</article></div>', "Whole article."),
        (f'<article>{P}</article><div class="related"><article>Other</article></div>', "Whole article."),
        (f"<head><title>x</title><body>{P}", "Whole article."),
        (f"<html><head><meta a=b><p>Whole article.</html>", "Whole article."),
        ("<article><p>One<script>for(i=0;i<n;i++){f(i)}</script><p>Two</article>", "One\nTwo"),
        ("<article><p>One<script>x='</p>'</script ><p>Two</article>", "One\nTwo"),
        ("<style>p{}<p>never closed", ""),
        ("<div class=content><p>A<p>B<ul><li>long list<li>more</ul></div>", "A\nB\nlong list\nmore"),
        ("<section class=s1><p>A</section><section class=s2><p>B</section>", "A\nB"),
        ("<main><h1>Heading</h1><article><p>Text</article></main>", "Heading\nText"),
        ("<main><p>Text<div class=comments><p>Reader</div></main>", "Text"),
        ('<article>A<div class="ad">Buy</div>B<form>mail</form></article>', "A\nB"),
        ('<body><div class="cookie-notice">We use</div><p>Text</body>', "Text"),
        ("<header><h1>Site</h1></header><article><header><h1>Title</h1></header>x</article>", "Title\nx"),
        ("<nav>a</nav>b<footer>c</footer>", "b"),
        ("&lt;b&gt; a&nbsp;b &amp;amp; &#233;<br>c", "<b> a b &amp; é c"),
        ("no tags at all", "no tags at all"),
        ("a < b and <c", "a < b and"),
        ("", ""),
    ],
)
def test_pages(page, want):
    assert main_text(page) == want


def page(i, extra=""):
    return (
        f"<div class=top><p>Welcome to the site<p>Login</div><div class=c><p>Story {i} begins"
        f"<p>Story {i} ends</div><div class=c2><p>More of {i}</div>{extra}<div class=end><p>Imprint</div>"
    )


SCHEMA = "page_id long, url string, html string"


def texts(spark, rows, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema).repartition(3)
    return {r.page_id: r.text for r in html_text.extract(df).collect()}


def test_repeated_texts_of_a_host_go_and_all_slots_stay(spark):
    rows = [(i, f"https://a.example/{i}", page(i)) for i in range(6)]
    rows += [(100, "https://b.example/1", page(100))]
    got = texts(spark, rows)
    for i in range(6):
        assert got[i] == f"Story {i} begins\nStory {i} ends\nMore of {i}"
    assert got[100].startswith("Welcome to the site\nLogin\nStory 100")


def test_copies_of_a_page_make_no_template(spark):
    rows = [(i, f"https://a.example/{i}", page(1)) for i in range(20)]
    assert set(texts(spark, rows).values()) == {main_text(page(1))}


def test_text_of_an_article_stays_where_it_repeats(spark):
    rows = [
        (i, f"https://a.example/{i}", f"<p>Site</p><article><p>Same<p>Own {i}</article>") for i in range(8)
    ]
    assert texts(spark, rows) == {i: f"Same\nOwn {i}" for i in range(8)}


def test_template_containers_without_slots_leave_the_article(spark):
    """Fixed texts go with a container that has no slot; beside a slot they stay."""
    rules = "<div class=x7><p>Read our rules<section><p>Ask us</section></div>"
    rows = [
        (i, f"https://a.example/{i}", f"<article><p>Own {i}{rules}<div class=y><p>Fixed<p>Data {i}</div>"
         f"<p>Same</article>")
        for i in range(8)
    ]
    rows.append((50, "https://a.example/50", f"<article>{rules}</article>"))
    got = texts(spark, rows)
    assert got.pop(50) == "Read our rules\nAsk us"
    assert got == {i: f"Own {i}\nFixed\nData {i}\nSame" for i in range(8)}
    assert texts(spark, rows[:3])[0] == main_text(rows[0][2])


def test_odd_rows(spark):
    schema = SCHEMA + ", text int, host string, template string, page int"
    rows = [(1, None, page(1), 5, "h", "t", 1), (2, "https://x", None, 5, "h", "t", 1), (3, "x", "", 1, "", "", 2)]
    rows += [(4, "https://x/y", "<article>" + "<p>word " * 20_000 + "</article>", 5, "h", "t", 1)]
    got = texts(spark, rows, schema)
    assert got[1] == main_text(page(1)) and got[2] == got[3] == ""
    assert got[4].count("\n") == 19_999
    assert texts(spark, []) == {}


def test_templates_equal_a_plain_count_of_vectors(spark):
    """Equal vectors over all pages of ten small hosts, compared as they are."""
    from collections import Counter, defaultdict

    from pyspark.sql import functions as F

    rows = []
    for host in range(10):
        for i in range(host + 1):
            extra = "<div class=n><p>Notice</div>" if i % 3 else ""
            rows.append((f"h{host}", i * 31 + host, page(i, extra * (1 + i % 2))))
    want = {}
    for host in {r[0] for r in rows}:
        mine = [(key, html_text._Page(p)) for h, key, p in rows if h == host]
        vectors = defaultdict(dict)
        for key, parsed in mine:
            counts = Counter(("t", html_text.text_token(b)) for b in parsed.blocks)
            counts.update(("c", tag) for tag in parsed.tags)
            for token, n in counts.items():
                vectors[token][key] = n
        classes = defaultdict(list)
        for token, vector in vectors.items():
            classes[tuple(sorted(vector.items()))].append(token)
        found = {
            token[1]
            for vector, members in classes.items()
            if len(mine) >= 4 and 2 * len(vector) >= len(mine) and len(members) > 1
            for token in members
            if token[0] == "t"
        }
        if found:
            want[host] = found
    df = spark.createDataFrame(rows, "host string, page long, html string")
    got = {r.host: set(r.template) for r in html_text.templates(df, html="html").collect()}
    assert got == want and len(want) == 7
