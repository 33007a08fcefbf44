import itertools
import random

from aulario.llm import min_cut_blocks as m

PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{margin:0}</style><script>var t="</p>";</script></head>
<body><header><h1>Site</h1></header><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
<!-- <p>no</p> --><div class="ad">Buy it now.</div><div id="cookie-notice"><p>We use cookies on this site, a lot of them.</p></div>
<article><h1>Head &amp;&#233; line</h1><p><b>First   par<br>agraph, with words.<p>Second
one: 1 &lt; 2.</p><p>Ok.</p><div class="comments"><p>I disagree with all of this, says a reader here.</p></div></article>
<aside><p>Related story, that is quite long and has many words in it.</p></aside>
<form><p>Your mail</p></form><footer>&copy; me</footer></body></html>"""


def brute_cut(costs, edges):
    def total(labels):
        own = sum(max(0, -c) if x else max(0, c) for c, x in zip(costs, labels))
        return own + sum(c for a, b, c in edges if labels[a] != labels[b])

    return min(total(x) for x in itertools.product([False, True], repeat=len(costs))), total


def test_cut_is_minimal():
    rnd = random.Random(7)
    for _ in range(300):
        n = rnd.randint(1, 8)
        costs = [rnd.uniform(-1, 1) for _ in range(n)]
        edges = [(a, b, rnd.uniform(0, 1)) for a in range(n) for b in range(a) if rnd.random() < 0.5]
        best, total = brute_cut(costs, edges)
        assert abs(total(m.minimum_cut(costs, edges)) - best) < 1e-9


def test_article_without_furniture():
    assert m.main_text(PAGE) == "Head &é line\nFirst par agraph, with words.\nSecond one: 1 < 2.\nOk."


def test_page_without_article_element():
    body = "".join(f"<p>Sentence number {i} of the text, which goes on for a while and then ends.</p>" for i in range(4))
    page = f"<body><ul class=menu><li><a href=x>Home</a></ul><div>{body}<p>Short.</p></div><div class='footer'>Imprint</div>"
    assert m.main_text(page).split("\n")[-1] == "Short." and m.main_text(page).startswith("Sentence number 0")
    assert "Home" not in m.main_text(page) and "Imprint" not in m.main_text(page)


def test_edge_pages(spark):
    pages = [None, "", "<", "a < b", "<p", "<script>x", "<p>" * 3000 + "Deep.", "<article><p>" + "word " * 50000 + "</article>"]
    rows = [(i, f"u{i}", p, "t", 1) for i, p in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, n_chars int")
    got = {r["page_id"]: r for r in m.extract(df).collect()}
    assert len(got) == len(pages) and got[0]["text"] == got[1]["text"] == "" and got[7]["n_chars"] == 50000 * 5 - 1
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert m.extract(df.limit(0)).count() == 0


LONG = "".join(f"<p>Sentence number {i} of the text, which goes on for a while and then ends.</p>" for i in range(5))
TEXT = "\n".join(f"Sentence number {i} of the text, which goes on for a while and then ends." for i in range(5))


def test_layout_words_around_the_article_do_not_lose_it():
    for page in (
        f'<div class="layout with-sidebar"><article>{LONG}</article><div class="sidebar"><p>Other things to read.</p></div></div>',
        f'<div class="post comments-open">{LONG}</div>',
        f'<div data-id="main-footer" data-class="ad">{LONG}</div>',
        f'<div class="no-sidebar"><main>{LONG}</main></div>',
        f'<div id="page" class="has-navbar"><div class="post">{LONG}</div><div class="footer"><p>Imprint and more.</p></div></div>',
    ):
        assert m.main_text(f"<body>{page}</body>") == TEXT, page


def test_furniture_stays_out_even_if_it_is_most_of_the_page():
    page = "<body><article><p>One sentence of the author, that is all there is to say.</p></article>{}</body>"
    for rest in (f'<div class="comments">{LONG}</div>', f'<div id="comments-area">{LONG}</div>', f'<div class="cookie-notice"><p>We use some.</p></div>'):
        assert m.main_text(page.format(rest)) == "One sentence of the author, that is all there is to say."
