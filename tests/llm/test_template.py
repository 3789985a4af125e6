from __future__ import annotations

import pytest

from stayline.llm import template

PAGE = """<!DOCTYPE html><html><head><title>T {n}</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul>{links}</ul></nav><div class="ad">Buy {n}</div><div id="cookie-notice">Cookies?</div>
<div id="content-{n}"><h1>Head &amp; {n}</h1><p>First   text number {n}&nbsp;is here.<br><p>Second <b>bold {n}</b> text.</p>
<p class="note">Read on.</p></div><div class="sidebar"><p>About us, a long story about us and about what we do here.</p></div>
<form><p>Name <input></form><section class="comments"><p>Nice {n}!</p></section><p>All rights kept by the owner.</p>
<footer>&copy; site {n}"""


def page(n):
    return PAGE.format(n=n, links="".join(f"<li><a href=/{i}>link {i}</a>" for i in range(n % 4 + 1)))


def text(n):
    return f"Head & {n}\nFirst text number {n} is here.\nSecond bold {n} text."


def test_template_of_a_host(spark):
    rows = [(n, f"https://Host.example/{n}", page(n)) for n in range(12)]
    rows += [(90, "http://alone.example:80/x", "<article><h1>A</h1><p>one &lt;two&gt;</p><aside>no</aside></article>"),
             (91, None, None), (92, "", ""), (93, "odd", "only text"), (94, "http://h", "<nav>menu</nav>"), (0, rows[0][1], rows[0][2]),
             (None, "http://cut.example", "<body><article><p>kept</p><p>half &am")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS host", "1 AS text", "2 AS n_chars")
    got = template.extract(df).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    found = {r.page_id: r.text for r in got}
    assert {n: found[n] for n in range(12)} == {n: text(n) for n in range(12)}
    assert (found[90], found[91], found[92], found[93], found[94], found[None]) == ("A\none <two>", "", "", "only text", "", "kept\nhalf &am")
    assert template.extract(df.where("false")).count() == 0


def test_classes_have_equal_vectors(spark):
    pages = spark.createDataFrame([("h", 7 * n + 1, page(n)) for n in range(8)], "host string, page_key long, html string")
    rows = {r.token: r for r in template.token_table(pages).where("kind = 'element'").collect()}
    article, nav, lists = (rows[f"html/body/{x}"] for x in ("div.content-#", "nav", "header"))
    assert article.vector == nav.vector == lists.vector == sum(7 * n + 1 for n in range(8))
    found = template.templates(pages).first()
    assert {e.token for e in found.elements} >= {"html/body/nav", "html/body/div.content-#", "html/body/footer"} and found.texts


def test_pages_in_parts_and_long_texts():
    long = "<p>" + "word " * 200_000 + "</p>"
    assert len(template.main_text(template.Page("<article>" + long + "</article>"), None, set())) == 999_999
    for source, expected in {"<p>a < b": "a < b", "<article><p>x<p y": "x", "a<!-- <p>no</p> -->b": "ab", "<div>a<div>b</div>c</div>": "a\nb\nc",
                             "<table><tr><td>1<td>2</table>": "1\n2", "<p>x<script>var a='<p>';": "x", "<ul><li>a<li>b</ul>": "a\nb"}.items():
        assert template.main_text(template.Page(source), None, set()) == expected


@pytest.mark.parametrize("name", ["<article><header><h1>T</h1></header><p>b</p></article>", "<main><p>T</p><div class='post-comments'>c</div><p>b</p></main>"])
def test_titles_stay_and_comments_go(name):
    assert template.main_text(template.Page(name), None, set()) == "T\nb"


def extracted(spark, sources):
    rows = [(n, f"http://divs.example/{n}", source) for n, source in enumerate(sources)]
    got = template.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return [r.text for r in sorted(got, key=lambda r: r.page_id)]


def test_copies_of_a_page_keep_their_text(spark):
    def source(n):
        return f"<body><div class=top><div>Site</div></div><div class=post><p>One of {n} here.</p><p>Two of {n} here.</p></div></body>"

    got = extracted(spark, [source("a")] * 8 + [source("b"), source("c")])
    assert got == [f"One of {n} here.\nTwo of {n} here." for n in "aaaaaaaabc"]
    page = template.Page(source("a"))
    tokens = {f"{template.xxhash.xxh64_intdigest(t.encode()):016x}" for kind, t, *_ in template.page_tokens(page) if kind == "text"}
    assert template.main_text(page, "body/div.post", tokens) == got[0]


def test_blocks_that_begin_alike_differ(spark):
    start = "The same opening words of every record. " * 8
    blocks = [[f"{start}Record {n}.", f"{n} has words of its own."] for n in range(5)]
    got = extracted(spark, ["<body><div class=top><div>Site</div></div><div class=post>" + "".join(f"<p>{b}</p>" for b in two) + "</div></body>"
                            for two in blocks])
    assert got == ["\n".join(two) for two in blocks]


def test_text_of_a_varying_number_of_elements_counts(spark):
    def inner(n):
        return [f"Part {k} of article {n} with a number of words." for k in range(n + 2)]

    got = extracted(spark, [f"<body><div class=byline>By {n}</div><div class=post>" + "".join(f"<div>{b}</div>" for b in inner(n))
                            + "</div></body>" for n in range(5)])
    assert got == ["\n".join(inner(n)) for n in range(5)]
