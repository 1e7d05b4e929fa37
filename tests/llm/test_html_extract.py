import random
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from stacksift.llm import html_extract
from stacksift.llm.html_extract import PRIOR, extract, fit, graph, main_text, minimum_cut, parsed

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<div class="cookie-notice">We use cookies on this site, and we hope that you like them very much indeed.</div>
<article><h2>A title</h2><p>First &amp; <b>bold</b> paragraph, with
 white&nbsp;space.<br>Next line.<p>Second one is unclosed, and it is long enough to be read by anyone who likes to read.
<p>Short.</p><aside>Related: <a href="/c">other things to see</a></aside><form><label>Mail</label><input><button>Subscribe now</button></form></article>
<section id="comments"><p>I loved this piece of text so much that I wrote a long comment under it, sentence by sentence.</p></section>
<footer>&copy; 2024 All rights reserved.</footer></body></html>"""


def test_page():
    assert main_text(PAGE)[0] == "A title\nFirst & bold paragraph, with white space. Next line.\nSecond one is unclosed, and it is long enough to be read by anyone who likes to read.\nShort."


def test_page_without_article():
    text = "This is a long paragraph of plain text that nobody marked up, with commas, and a full stop at its end. " * 3
    page = f'<div id="menu"><a href="/">a</a> <a href="/b">b</a></div><div class="content"><p>{text}</p><p>{text}</p></div><div class="sidebar">{text}</div>'
    assert main_text(page)[0] == f"{text.strip()}\n{text.strip()}"


def test_broken_pages():
    for page in ("", "<", "<p", "<!-- x", "<script>a", "<a href='x", "</p></div>", "a < b", "&#x41;&bogus;&", "<div " * 2000, "<p>" * 5000 + "x", "<b>" * 3000 + "</b>" * 3000):
        main_text(page)
    assert main_text("<style>x</style><!-- y --><script>z")[0] == ""


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="<>/pdivarticle \"'=&;!-a", max_size=120))
def test_any_text(page):
    text, content, blocks = main_text(page)
    assert content <= blocks and "\n\n" not in text


def test_rows(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, None), (None, "v", "", "y"), (3, "w", "<article><p>" + "long words " * 50_000 + "</p></article>", "t")]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == 5 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert next(r for r in got if r["page_id"] == 2)["text"] == ""
    assert next(r for r in got if r["page_id"] == 3)["n_chars"] == len("long words ") * 50_000 - 1
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_articles_of_the_table(spark, data):
    import html

    for r in spark.read.parquet(f"{data}/pages.parquet").collect():
        inner = re.search("<article>(.*)</article>", r["html"], re.S)[1]
        parts = (" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner))
        assert main_text(r["html"])[0] == "\n".join(p for p in parts if p)


def cost(value, edges, side):
    return sum(max(-v, 0) if s else max(v, 0) for v, s in zip(value, side, strict=True)) + sum(c for a, b, c in edges if side[a] != side[b])


def test_cut_is_minimal():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(1, 9)
        value = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 1.5)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]
        best = min(cost(value, edges, [m >> i & 1 for i in range(n)]) for m in range(1 << n))
        assert abs(cost(value, edges, minimum_cut(value, edges)) - best) < 1e-9


def test_self_closed_foreign_elements():
    text = "A long paragraph of plain text, with commas, that anyone who likes to read would read to its end. " * 3
    page = f"<article><p>{text}</p><svg class='i' /><p>{text}</p><math/><p>{text}</p><svg><text>label</text></svg></article>"
    assert main_text(page)[0] == "\n".join([text.strip()] * 3)


def test_context_behind_deep_elements():
    text = "A long paragraph of plain text, with commas, that anyone who likes to read would read to its end. " * 3
    deep = "<div>" * 300 + "x" + "</div>" * 300
    page = f"<div><article><p>{text}</p></article></div><nav><div>{deep}<p>{text}</p></div></nav>"
    assert main_text(page)[0] == text.strip()
    hidden = f"<article><p>{text}</p><div hidden>{'<div>' * 300}<p>{text}</p>{'</div>' * 300}</div><p>{text}</p></article>"
    assert main_text(hidden)[0] == f"{text.strip()}\n{text.strip()}"
    assert main_text("<div>" * 300 + f"<div hidden><p>no {text}</p></div><p>{text}</p>" + "</div>" * 300)[0] == text.strip()


LONG = ("A long paragraph of plain text, with commas, that anyone who likes to read would read to its end. " * 3).strip()


def without_edges(page):
    value, _ = graph(parsed(page), PRIOR)
    return "\n".join(b.text for b, v in zip(parsed(page).blocks, value, strict=False) if v > 0)


def test_the_cut_decides():
    quiet = f"<div><p>{LONG}</p><div>ok so</div><p>{LONG}</p></div>"
    assert main_text(quiet)[0] == f"{LONG}\nok so\n{LONG}" and "ok so" not in without_edges(quiet)
    loud = f"<article><p>{LONG}</p></article><div class='comments'><p>{LONG}</p></div>"
    assert main_text(loud)[0] == LONG and without_edges(loud) == f"{LONG}\n{LONG}"


def test_flow_is_computed_and_moves_blocks_of_the_table(spark, data, monkeypatch):
    calls, flow = [], html_extract._max_flow
    monkeypatch.setattr(html_extract, "_max_flow", lambda *a: calls.append(1) or flow(*a))
    pages = [r["html"] for r in spark.read.parquet(f"{data}/pages.parquet").collect()]
    moved = 0
    for page in pages:
        value, edges = graph(parsed(page), PRIOR)
        moved += sum((v > 0) != side for v, side, _ in zip(value, minimum_cut(value, edges), parsed(page).blocks, strict=False))
    assert len(calls) == len(pages) and moved > len(pages) // 2


def test_names_of_layouts():
    side = f'<div class="sidebar"><p>{LONG}</p></div>'
    for page in (f'<body class="has-sidebar"><article><p>{LONG}</p></article>{side}</body>', f'<div class="sidebar-layout"><article><p>{LONG}</p></article>{side}</div>', f'<body class="no-sidebar nav-open"><div class="post"><p>{LONG}</p></div>{side}'):
        assert main_text(page)[0] == LONG
    form = f'<form id="search-form"><div><p>{LONG}</p><p>{LONG}</p></div><div class="footer"><p>{LONG[:90]}</p></div></form>'
    assert main_text(form)[0] == f"{LONG}\n{LONG}"
    post = f'<article class="post tag-social"><header class="entry-header"><h1>Head</h1></header><p>{LONG}</p></article><div id="comments"><article class="comment"><p>{LONG * 9}</p></article></div>'
    assert main_text(post)[0] == f"Head\n{LONG}"


def test_nesting_of_any_depth():
    for depth in (198, 205, 300, 5000):
        page = "<div>" * depth + f"<nav><ul><li><a href='/a'>Home and away, said the menu.</a></li></ul></nav><p>{LONG}</p><article><p>{LONG}</p></article>" + "</div>" * depth
        assert main_text(page)[0] == f"{LONG}\n{LONG}"
    inner = "<div>" * 300 + f"<nav><p>{LONG}</p></nav>" + "</div>" * 300
    assert main_text(f"<article><p>{LONG}</p>{inner}<p>{LONG}</p></article>")[0] == f"{LONG}\n{LONG}"
    assert main_text(f"<article><span class='ad'>{'<span>' * 90}x{'</span>' * 90} buy</span><p>{LONG}</p></article>")[0] == LONG


def test_large_pages_take_time_in_proportion():
    began = time.time()
    for page in (f"<article>{f'<p>{LONG}</p><p>No.</p>' * 5000}</article>", "<ul>" + "<li><a href=x>menu item</a>" * 10_000 + "</ul>", f"<p>{LONG}</p><ul><li><a href=x>menu</a><li>b</ul>" * 3000):
        main_text(page)
    assert time.time() - began < 20


def test_fit_learns_from_marked_pages():
    marked = [f"<article><h2>{LONG[:40]}</h2>{''.join(f'<p>{LONG[: 60 + n]}</p>' for n in range(9))}</article><div class='teaser'><a href=x>{LONG[:30]}</a></div><nav><li><a href=y>{n}</a></li></nav>" for n in range(30)]
    weights = fit(marked)
    named = dict(zip(html_extract.FEATURES, weights, strict=True))
    assert named["links"] < PRIOR[2] + 0.5 and named["paragraph"] > PRIOR[4]
    assert (fit([]) == PRIOR).all() and (fit(["<p>x</p>", "", "<article>"]) == PRIOR).all()
    assert (fit(marked) == fit(list(marked))).all()
