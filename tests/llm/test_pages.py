import html
import random
import re
import time

import pytest

from eventlens.llm import pages as P
from eventlens.llm import wrappers as W
from tests.llm.helpers import SF

SCHEMA = "page_id long, url string, html string"


def alone(source):
    page, texts = W.parse(source)
    W.judge(page)
    return W.main_text(page, texts)


def site(sources):
    """What one wrapper of all sources reads in each, aligned in order."""
    wrapper = None
    for s in sources:
        items = W.parse(s)[0]
        wrapper = items if wrapper is None else W.align(wrapper, items)
    W.judge(wrapper)
    wrapper, out = W.opened(W.compiled(wrapper)), []
    for s in sources:
        page, texts = W.parse(s)
        W.judge(page)
        W.read(page, wrapper)
        out.append(W.main_text(page, texts))
    return out


def words(rng, n):
    return " ".join(rng.choice("amber birch cedar delta ember fjord grove heron inlet".split()) + str(rng.randrange(99)) for _ in range(n))


def test_registered_query_against_plain_reading(spark):
    rows = {r["page_id"]: r for r in P.op13(spark, SF).collect()}
    source = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(rows) == len(source)
    for r in source:
        inside = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)>", " ", inside))).split())
        assert (rows[r["page_id"]]["text"], rows[r["page_id"]]["n_chars"], rows[r["page_id"]]["url"]) == (want, len(want), r["url"])


@pytest.mark.parametrize("source, text", [
    ("", ""), ("plain", "plain"), ("a &amp; b&nbsp;c &#x41;&eacute;", "a & b c Aé"), ("<p>a<p>b<b>c</b> d<br>e", "a bc d e"),
    ("<!-- x --><p>a</p><!-- <p>no</p> -->", "a"), ("<script>var t='<p>no</p>';</script><p>a</p><style>p{}</style>", "a"),
    ("<article><p>a</p><section class='comments'><article>no</article></section></article><p>no</p>", "a"),
    ("<article><p>a <span class='ad'>no <span>no</span> no</span> b</p></article>", "a b"),
    ("<main><h1>t</h1><form>no</form><aside>no</aside><p>a</p></main><footer>no</footer>", "t a"),
    ("<header>no</header><nav><a href=x>no</a></nav><article><header><h1>t</h1></header><p>a</p><footer>no</footer></article>", "t a"),
    ("<div class='cookie-notice'>no</div><div role=main>a<div class='shareButtons'>no</div></div>", "a"),
    ("<div class='page with-sidebar'><article>a<p>b</div>", "a b"),
    ("<form id=aspnet><nav>no</nav><article>a</article></form>", "a"), ("<article>a<table><tr><td>b<td>c<tr><td>d</table></article>", "a b c d"),
    ("<article>1 < 2 <3 <a title='>'>x</a></article>", "1 < 2 <3 x"), ("<article><p>a</article", "a"), ("<article>a<script>no", "a"), ("<p>a <b", "a"),
    ("<ARTICLE>A<LI>b<LI>c</ARTICLE>", "A b c"), ("<article><dl><dt>a<dd>b<dt>c</dl><ul><li>d<ul><li>e</ul><li>f</ul></article>", "a b c d e f"),
    ("<article>a<![CDATA[b<c]]></article>", "ab<c"), ("<article><custom-note>a</custom-note><o:p>b</o:p></article>", "a b"),
])
def test_one_page(source, text):
    assert alone(source) == text


def test_unmarked_site_by_its_wrapper():
    """Nothing is named: template text, menus of links and a short side column go, the varying main part stays."""
    rng, sources, wants = random.Random(4), [], []
    for i in range(30):
        title, parts = words(rng, 5), [words(rng, rng.randrange(20, 60)) for _ in range(rng.randrange(1, 7))]
        menu = "".join(f"<li><a href='/{j}'>{words(rng, 1)}</a></li>" for j in range(rng.randrange(3, 8)))
        extra = f"<div class=c9><p>Read our terms before you copy anything</p></div>" if rng.random() < 0.8 else ""
        body = "".join(f"<p>{p}</p>" + ("<h3>" + words(rng, 2) + "</h3>" if rng.random() < 0.3 else "") for p in parts)
        wants.append(" ".join([title, *re.sub(r"</?[ph]3?>", " ", body).split()]))
        sources.append(f"<body><div class=c1><div>Daily Heron</div><ul>{menu}</ul></div><h1>{title}</h1><div class=c2><div class=c3>{body}</div>"
                       f"<div class=c4>Liked this? Tell a friend</div>{extra}</div><div class=c5>{words(rng, 4)}</div></body>")
    got = site(sources)
    assert got == wants
    rng.shuffle(order := list(range(30)))
    assert site([sources[i] for i in order]) == [wants[i] for i in order]


def test_layout_of_bare_containers():
    rng, sources, wants = random.Random(14), [], []
    for _ in range(12):
        parts = [words(rng, rng.randrange(15, 50)) for _ in range(rng.randrange(2, 6))]
        menu = "".join(f"<li><a href=x>{words(rng, 1)}</a>" for _ in range(rng.randrange(2, 6)))
        wants.append(" ".join(parts))
        sources.append(f"<div><div><ul>{menu}</ul></div><div>{''.join('<p>' + p for p in parts)}</div><div><b>Daily Heron</b>, {rng.randrange(99)}</div></div>")
    assert site(sources) == wants


def test_template_inside_an_article_goes_unless_it_is_the_article():
    rng = random.Random(6)
    texts = [words(rng, 30) for _ in range(4)]
    assert site([f"<article><div class=x>Follow the Heron</div><p>{t}</p></article>" for t in texts]) == texts
    same = "<article><h1>One title</h1><p>The same words on every page</p></article><div class=ad>%d</div>"
    assert set(site([same % i for i in range(9)])) == {"One title The same words on every page"}


def test_pages_of_two_templates_on_one_host():
    rng = random.Random(8)
    a = [(f"<body><article><p>{(t := words(rng, 20))}</p></article></body>", t) for _ in range(5)]
    b = [(f"<body><div><div class=q><p>{(t := words(rng, 40))}</p><p>{(u := words(rng, 9))}</p></div><div><a href=x>{words(rng, 3)}</a></div></div></body>", f"{t} {u}") for _ in range(5)]
    both = [x for p in zip(a, b) for x in p]
    assert site([x for x, _ in both]) == [t for _, t in both]


def test_expressions_stay_small():
    rng = random.Random(1)
    sources = ["<article>" + "".join(f"<div class='{words(rng, 1)}x{rng.choice('abcdefghijkl')}'>{words(rng, 2)}</div>" for _ in range(200)) + "</article>" for _ in range(12)]
    wrapper = None
    for s in sources:
        items = W.parse(s)[0]
        wrapper = items if wrapper is None else W.align(wrapper, items)
    assert sum(1 for _ in W.slots(wrapper)) <= W.LIMIT + 1
    assert site(sources) == [" ".join(re.sub("<[^>]*>", " ", s).split()) for s in sources]


@pytest.mark.parametrize("unit, n", [("<div>", 100_000), ("<b><i>", 60_000), ("<p>x</p>", 100_000), ("<a ", 300_000), ("<!--", 200_000), ("<p>a</p><h2>b</h2>", 40_000),
                                     ("='", 400_000), ("<a b='c' d=\">", 50_000), ("</div>", 150_000), ("&amp", 200_000), ("<script>", 100_000), ("<li><p>", 60_000),
                                     ("<table><tr><td>", 30_000), ("<", 500_000), (" ", 1_000_000), ("<div class=ad><span>", 40_000), ("<x-y/>", 60_000)])
def test_long_pages_take_linear_time(unit, n):
    began = time.process_time()
    alone("<article>" + unit * n)
    assert time.process_time() - began < 12


def test_hot_host_and_input_order(spark):
    rng, rows = random.Random(2), []
    for i in range(400):
        host = "hot.example" if i % 3 else f"h{i % 7}.example"
        text = words(rng, rng.randrange(10, 40))
        rows.append((i, f"https://{host}/{i}", f"<body><div>Site {host}</div><div class=m>{'<p>' + text + '</p>'}{'<h4>' + words(rng, 1) + '</h4>' if rng.random() < .4 else ''}</div></body>"))
    df = spark.createDataFrame(rows, SCHEMA)
    one = sorted(map(tuple, P.extract_pages(df.coalesce(1)).collect()))
    many = sorted(map(tuple, P.extract_pages(df.repartition(13)).collect()))
    assert one == many and not any("Site" in r[2] for r in one if "hot" in r[1])


def test_awkward_rows(spark):
    page = "<article><p>a&amp;b</p></article>"
    rows = [(1, "http://x.example/1", page), (1, "http://x.example/1", page), (2, None, page), (3, "no host", page), (4, "http://y.example", None), (5, "http://Y.example:80/", ""),
            (None, "http://z.example?q", page), (6, "http://y.example/#", "<article>" + "<p>long text</p>" * 20_000), (7, "", "\0<p>�")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS text", "1 AS host", "2 AS bucket", "3 AS _column_9")
    out = P.extract_pages(df)
    assert out.columns == ["page_id", "url", "host", "bucket", "_column_9", "text", "n_chars"]
    got = sorted((tuple(r)[:2] + (r["text"], r["n_chars"]) for r in out.collect()), key=repr)
    want = [(i, u, {None: "", "": ""}.get(h, "a&b"), 0 if not h else 3) for i, u, h in rows[:7]]
    want += [(6, "http://y.example/#", " ".join(["long text"] * 20_000), 20_000 * 10 - 1), (7, "", "\0 �", 3)]
    assert got == sorted(want, key=repr)
    assert P.extract_pages(df.limit(0)).collect() == []
    assert P.extract_pages(df.where("page_id = 4"), keep=["page_id"]).collect() == [(4, "", 0)]
