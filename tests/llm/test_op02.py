"""HTML extraction: pages with every kind of boilerplate, the linear scan against all ranges, and odd markup."""

import random

from tillroll.llm import op02_html_extraction as op

PAGE = "page_id long, url string, html string, text string"
WORDS = "rain falls on the quiet hills while old trains carry letters past the river and people read them slowly by warm lamps".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def build(rng, wrap):
    paragraphs = [prose(rng, rng.choice([1, 2, 25, 60])) for _ in range(rng.randint(1, 6))]
    title = prose(rng, 5)
    inside = [f"<p>{p}</p>" for p in paragraphs]
    inside.insert(rng.randint(0, len(inside)), rng.choice([
        '<aside class="related"><ul><li><a href="/x">Read this too, dear reader</a></li></ul></aside>', '<div class="ad-slot">Buy shoes now with a big discount today</div>',
        '<form action="/s"><label>Your mail</label><input name="q"><button>Send it</button></form>', "<script>if (a < b) { p('</p>') }</script>", "<!-- <p>not shown</p> -->",
        '<div class="notice">We use cookies to make this page work for everybody who reads</div>']))
    body = f"<h1>{title}</h1>" + "".join(inside)
    links = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in rng.sample(WORDS, 6))
    page = (f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{margin:0}}</style></head><body><header><p>The daily paper of the river towns</p></header>"
            f"<nav><ul>{links}</ul></nav><div class='cookie-banner'>This site stores cookies on your machine, say yes</div>{wrap[0]}{body}{wrap[1]}"
            f"<div id='comments'><p>What a lovely story, I read it twice and then again to my children</p></div><div class='sidebar'><p>Most read stories of the week are here for you to see</p></div>"
            "<footer>&copy; 2024 the daily paper</footer></body></html>")
    return page, "\n".join([title, *paragraphs])


def test_content_of_pages(spark):
    rng = random.Random(1)
    pages = [build(rng, ("<article>", "</article>")) for _ in range(60)] + [build(rng, ('<div class="post-body">', "</div>")) for _ in range(30)]
    pages += [(None, ""), ("", ""), ("<html><body></body></html>", "")]
    rows = [(i, f"u{i}", h, "x") for i, (h, _) in enumerate(pages)] + [(None, None, pages[0][0], None), (0, "u0", pages[0][0], "x")]
    got = op.html_extraction(spark.createDataFrame(rows, PAGE)).collect()
    assert len(got) == len(rows)
    for r in got:
        want = pages[r.page_id or 0][1]
        assert r.text == want and r.n_chars == len(want)
    assert op.html_extraction(spark.createDataFrame([], PAGE)).collect() == []


def test_best_region_equals_all_ranges():
    rng = random.Random(2)
    for _ in range(300):
        s = [rng.choice([-3, -1, -0.5, 0.5, 1, 2]) for _ in range(rng.randint(0, 12))]
        i, j = op.best_region(s)
        best = max([0.0] + [sum(s[a:b]) for a in range(len(s)) for b in range(a + 1, len(s) + 1)])
        assert sum(s[i:j]) == best and (i < j) == (best > 0)


def text(page):
    return op.main_text(page, op.Weights({}))


def test_markup():
    assert text("<p>a <b>b</b>c &amp;lt; &eacute;&#233;&#x41;\n\t d</p>") == "a bc &lt; ééA d"
    assert text("<p>one<p>two<br>three<li>four") == "one\ntwo three\nfour"
    assert text("5 < 6 and 7 > 3 <p title='a > b' >x") == "5 < 6 and 7 > 3\nx"
    assert text("<p>kept</p><script>never closed <p>no") == "kept"
    assert text("<p>kept</p><!-- never closed <p>no") == "kept"
    assert text("<div class='article-header'><p>stays</p></div>") == "stays"
    assert text("<p>a</p><p class='ad'>bad words<p>b</p>") == "a\nb"
    assert text("<article><p>a</p><nav>x<nav>y</nav>z</nav><p>b</p></article>") == "a\nb"
    assert text("plain text only") == "plain text only"
    assert text("<<<>>><") == "<<<>>><"
    assert text("<p>" + "word " * 300_000).count(" ") == 299_999
    assert text("<div>" * 50_000 + "deep") == "deep"
    assert text("<a title=\"never closed " + "<b x='" * 2000) is not None


def test_wrappers_of_the_page_are_not_cut():
    body, aside = "word " * 40, "<div class='sidebar'><p>see this too</p></div>"
    for name in ("with-sidebar", "no-sidebar", "has-sidebar side-by-side", "search-results", "feedback-enabled"):
        for i in ("", " id='wrapper'"):
            assert text(f"<div class='{name}'{i}><article><p>{body}</p></article>{aside}</div>") == body.strip()
            assert text(f"<div class='{name}'{i}><main><p>{body}</p></main>{aside}</div>") == body.strip()
            assert text(f"<div class='{name}'{i}><div itemprop='articleBody'><p>{body}</p></div>{aside}</div>") == body.strip()
            assert text(f"<div class='{name}'{i}><p>{body}</p>{aside}</div>") == body.strip()
    assert text(f"<body><form action='/'><nav>a b c</nav><article><p>{body}</p></article></form></body>") == body.strip()
    assert text(f"<body><form action='/'><nav>a b c</nav><p>{body}</p><form>send</form></form></body>") == body.strip()
    assert text(f"<div class='no-sidebar'><div class='with-menu'><form><article><p>{body}</p></article></form></div></div>") == body.strip()
    # what is no wrapper stays cut
    assert text(f"<article><p>{body}</p><aside class='related'><article>a card</article></aside></article>") == body.strip()
    assert text(f"<article><p>{body}</p></article><div id='comments'><article class='comment'><p>{body * 5}</p></article></div>") == body.strip()
    assert text(f"<p>{body}</p><div id='comments'><p>{'reply ' * 90}</p></div>") == body.strip()
    assert text(f"<p>{body}</p><div hidden><article>{body}</article></div>") == body.strip()
    assert text("<div class='with-sidebar'>" * 50_000 + "deep") == "deep"


def test_long_attribute_values():
    long = '{"html":' + "<b class=ad>x</b> <p>no text</p> 1 > 0 hidden " * 2500 + "}"
    assert len(long) > 100_000
    for tag in ("p", "a", "div"):
        assert text(f"<p>a</p><{tag} class='x' data-state='{long}'>kept</{tag}><p>b</p>") == "a\nkept\nb"
        assert text(f"<p>a</p><{tag} data-state='{long}' class='ad'>gone</{tag}><p>b</p>") == "a\nb"
    assert text("<p>a</p><p title=it's>b</p><p>that's c</p>") == "a\nb\nthat's c"
    assert text("<p>a</p><p data-x='class=\"ad\" hidden'>b</p>") == "a\nb"
    assert text("<p>a</p><p title='never closed>b</p><p>c</p>") == "a\nb\nc"
    assert "end" in text("<a x='>' " * 50_000 + "y=\"> end")


def test_deep_markup_keeps_its_elements():
    """Text below any number of open elements belongs to the one it stands in, and closings find their element."""
    names = [f"x-{i}" for i in range(700)]
    page = "".join(f"<{x}>" for x in names) + "<section>deep words</section><p>after</p>" + "".join(f"</{x}>" for x in reversed(names)) + "<h2>end</h2>"
    got = [(x[0], x[1]) for x in op.read_page(page) if x[0] is not None]
    assert got == [("deep words", "section"), ("after", "p"), ("end", "h2")]
    stray = "<x-1>" * 30_000 + "</x-2>" * 30_000 + "text"
    assert [x[0] for x in op.read_page(stray) if x[0] is not None] == ["text"]


def test_weights_come_from_a_sample_by_rank(spark):
    """As many pages as asked for whatever the table's size; copies, null ids and rare elements count."""
    page = "<article><p>some words here</p><x-rare>one</x-rare></article><div>outside</div>"
    pages = spark.createDataFrame([(i, f"u{i}", page, "") for i in range(300)] + [(7, "u7", page, "")] * 50 + [(None, None, page, "")] * 50, PAGE)
    seen = []
    real = op.Weights
    try:
        op.Weights = lambda counts: seen.append(counts) or real(counts)
        for rows, want in ((40, 40), (1000, 301)):
            op.learn_weights(pages, rows)
            assert seen[-1]["word", "p", True] == 3 * want and seen[-1]["word", "x-rare", True] == want
        op.learn_weights(pages.limit(0))
        assert seen[-1] == {}
    finally:
        op.Weights = real
