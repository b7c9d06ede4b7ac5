"""Main text of pages: the cut against all labellings, the reader against broken markup, whole pages."""

import html
import itertools
import random
import re

import pyarrow.parquet as pq
import pytest

from matchspark.llm import html_cut

LONG = "The river rose in the night, and by the morning the lower fields were under water. "
MORE = "Nobody in the village had seen anything like it, not even the oldest of them. "


def cost(score, edges, label):
    nodes = sum(s if s > 0 and not keep else -s if s < 0 and keep else 0 for s, keep in zip(score, label))
    return nodes + sum(w for a, b, w in edges if label[a] != label[b])


def test_cut_equals_the_best_of_all_labellings():
    rng = random.Random(4)
    for _ in range(1500):
        n = rng.randint(1, 9)
        score = [rng.randint(-12, 12) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.randint(0, 8)) for _ in range(rng.randint(0, 2 * n))]
        got = html_cut.smallest_cut(score, edges)
        best = min((cost(score, edges, x), sum(x)) for x in itertools.product([False, True], repeat=n))
        assert (cost(score, edges, got), sum(got)) == best


def test_cut_of_a_long_chain():
    n = 20_000
    label = html_cut.smallest_cut([10 if i % 3 else -15 for i in range(n)], [(i, i + 1, 8) for i in range(n - 1)])
    assert len(label) == n and any(label)


def texts(source):
    return [words for words, _, _ in html_cut.read_page(source).blocks]


@pytest.mark.parametrize(("source", "blocks"), [
    ("", []), ("plain &amp; simple", ["plain & simple"]), ("<p>a<b>b</b> c<p>d", ["ab c", "d"]),
    ("<script>var t='</p>';</script>x<style>p{}</style>", ["x"]), ("x<script>never closed <p>y</p>", ["x"]),
    ("<!-- <p>no</p> -->a<!---->b<!-- open <p>x", ["ab"]), ("<p title='a>b' x=\"<i>\">t</p>", ["t"]), ("<p title=it's>don't</p>", ["don't"]),
    ("a < b <c", ["a < b"]), ("1 &lt; 2 &am", ["1 < 2 &am"]), ("&#233;&eacute;&#x4e2d;&nbsp;x &notanentity;", ["éé中 x ¬anentity;"]),
    ("<ul><li>a<li>b</ul>c", ["a", "b", "c"]), ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
    ("<title>t</title><p>a<br>b</p>", ["a b"]), ("<head><title>t</title><p>x", ["x"]), ("<p>a</div></p></section>b", ["a", "b"]),
    ("<textarea><p>no</p></textarea><select><option>n</select>y", ["y"]), ("<P CLASS=x>Up</P>", ["Up"]), ("a \n\t b", ["a b"]),
    ("<div>" * 5000 + "deep", ["deep"]), ("<p x='" * 500, []),
])
def test_blocks(source, blocks):
    assert texts(source) == blocks


def test_entities_and_order_of_blocks():
    page = f"<article><h1>A &quot;B&quot;</h1><p>{LONG}&copy;</p><p>{MORE}</p></article>"
    assert html_cut.main_text(page) == f'A "B" {LONG}© {MORE}'.strip()


MENU = "<ul>" + "".join(f"<li><a href='/{i}'>Topic {i}</a></li>" for i in range(6)) + "</ul>"
BODY = f"<h1>Flood in the valley</h1><p>{LONG * 3}</p><p>Short.</p><h2>What came then</h2><p>{MORE * 4}</p><ul><li>{LONG}</li><li>{MORE}</li></ul>"
WANTED = " ".join(f"Flood in the valley {LONG * 3} Short. What came then {MORE * 4} {LONG} {MORE}".split())
CHAT = "<p>What a sad story, I hope that everyone is safe and well there.</p><p>We were there last year. Lovely people, all of them.</p>"

PAGES = {
    "elements": f"<body><header><a href='/'>The Post</a><p>News that matters to everyone here.</p></header><nav>{MENU}</nav><main><article>{BODY}"
                f"<aside><p>{MORE}</p></aside></article></main><aside><h3>Latest</h3>{MENU}</aside><form><label>Mail</label><p>{MORE}</p></form>"
                f"<section class='comments'><h2>2 comments</h2>{CHAT}</section><footer>&copy; The Post. All rights reserved.</footer>",
    "names": f"<body class='has-sidebar'><div id='page'><div class='site-header'><b>The Post</b></div><div class='main-menu'>{MENU}</div>"
             f"<div class='cookie-notice'><p>We use cookies to improve your stay. Read about them in our policy.</p></div>"
             f"<div class='post-content'>{BODY}<div class='ad-slot'><p>{MORE}</p></div></div><div class='sidebarRight'><p>{LONG}</p></div>"
             f"<div id='comments'>{CHAT}</div><div class='newsletter-signup'><p>{MORE}</p></div><div class='footer'><p>{LONG}</p></div></div>",
    "roles": f"<div role='banner'><p>{MORE}</p></div><div role=navigation>{MENU}</div><div role='main'>{BODY}</div><div role='complementary'><p>{LONG}</p></div>"
             f"<div role='contentinfo'><p>{MORE}</p></div>",
    "neither": f"<body>{MENU}<div>{BODY}</div><div>{MENU}</div><div><h3>Comments (2)</h3>{CHAT}</div><div>&copy; 2024 The Post</div>",
    "one form around all": f"<form id='aspnet'><div class='header'>The Post</div><article>{BODY}</article><div class='footer'>{MENU}</div></form>",
    "articles as comments": f"<main><article>{BODY}</article><section id='comments'><article class='comment'>{CHAT}</article><article class='comment'>{CHAT}</article></section></main>",
    "hidden parts": f"<article>{BODY}<div hidden><p>{LONG}</p></div><p style='display: none'>{MORE}</p></article>",
    "teasers": f"<main><article>{BODY}</article><div class='related-posts'><article><h3>Other</h3><p>{MORE}</p></article></div></main>",
    "broken": f"<body><nav>{MENU}<article>{BODY.replace('</p>', '').replace('</li>', '')}",
}


@pytest.mark.parametrize("name", sorted(set(PAGES) - {"broken"}))
def test_pages(name):
    assert html_cut.main_text(PAGES[name]) == WANTED


def test_headings_of_an_article_stay():
    page = f"<article><h1>On rivers</h1><p>{LONG * 2}</p><h2>Related work</h2><p>{MORE * 2}</p><h2>Comments on the method</h2><p>{LONG}</p></article>"
    assert html_cut.main_text(page).endswith(f"Related work {MORE * 2}Comments on the method {LONG}".strip())


def test_no_content_is_empty():
    for page in (None, "", " \n", f"<nav>{MENU}</nav><footer>&copy; x</footer>", "<html><head><title>t</title></head><body></body></html>"):
        assert html_cut.main_text(page or "") == ""


def plainly(source):
    """What stands in the marked article of the driver's pages."""
    found = re.search(r"<article>(.*?)(</article>|\Z)", source, re.S)
    spaced = re.sub(r"</?(p|h1|br)[^>]*>", " ", found.group(1) if found else "")
    return " ".join(html.unescape(re.sub(r"<[^>]*(>|\Z)", "", spaced)).split())


def test_whole_table(spark, folder):
    rows = pq.read_table(f"{folder}/pages.parquet").to_pylist()
    got = {r["page_id"]: r for r in html_cut.extracted(spark.read.parquet(f"{folder}/pages.parquet")).collect()}
    assert len(got) == len(rows)
    for r in rows:
        want = plainly(r["html"])
        assert (got[r["page_id"]]["url"], got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"]) == (r["url"], want, len(want))


def test_odd_rows(spark):
    rows = [(1, None, None, "x", 1), (None, "u", "", "y", 2), (3, "u", f"<article><p>{LONG * 20_000}</p></article>", "z", 3),
            (4, "v", f"<p>{LONG}</p>", "t", 4), (4, "v", f"<p>{LONG}</p>", "t", 4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, page string, c0 int")
    got = sorted(html_cut.extract(df).collect(), key=lambda r: (r["page_id"] is None, r["page_id"]))
    assert got[0].asDict() == {"page_id": 1, "url": None, "page": "x", "c0": 1, "text": ""}
    assert [len(r["text"]) for r in got] == [0, len(LONG) * 20_000 - 1, len(LONG) - 1, len(LONG) - 1, 0]
    assert html_cut.extracted(df.limit(0)).columns == ["page_id", "url", "text", "n_chars"]
    assert html_cut.extracted(df.limit(0)).count() == 0
