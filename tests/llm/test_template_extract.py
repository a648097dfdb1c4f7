"""Template deduction and extraction on hand-made pages."""

from sumveil.llm import template_extract as te

SCHEMA = "page_id long, url string, html string, text string, n_chars int, host string, token string"


def page(i, body):
    return (
        f'<!DOCTYPE html><html><head><title>T {i}</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="page">'
        f'<div class="top">Our Shop &amp; Friends</div><ul class="x1"><li><a href="/a{i}">go {i}</a></li><li><a href="/b">there</a></li></ul><!-- ad {i} -->'
        f'<div class="cookie-notice">We use {i} cookies</div><div class="ad-box">Buy {i}!</div><div class="c7">{body}</div>'
        f'<aside>Side {i}</aside><form><p>Search {i}</p></form><section id="comments"><p>First! {i}</p></section><div class="x9">All about us, always the same</div><footer>&copy; {i}</footer></body></html>'
    )


def test_template_of_a_host(spark):
    bodies = [f"<h1>Title {i}</h1><p>One {i}\n  <b>bo</b>ld &eacute;&nbsp;x &lt;tag&gt;<p>Two {i}<br>Three" for i in range(6)]
    bodies[3] = "<p>Our Shop &amp; Friends</p><p>" + "long " * 50_000 + "</p>"
    rows = [(i, f"https://u@Host.example:80/p{i}?q", page(i, b), None, 1, "h", "t") for i, b in enumerate(bodies)]
    rows += [(90, None, None, None, 1, "h", "t"), (91, "http://lone.example/", "", None, 1, "h", "t"), (92, "http://lone.example/2", "<p>Open <b>text", None, 1, "h", "t"), rows[0]]
    rows += [(93, "bad url", "<article><header><h1>Head</h1></header>A<div class='share'>no</div></article><p>outside</p>", "", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = te.extract(docs).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    for i in (0, 1, 2, 4, 5):
        assert text[i] == f"Title {i}\nOne {i} bold é x <tag>\nTwo {i}\nThree"
    assert text[3] == "Our Shop & Friends\n" + ("long " * 50_000).strip()
    assert (text[90], text[91], text[92], text[93]) == ("", "", "Open text", "Head\nA")
    model = {r.host: r for r in te.templates(docs).collect()}["host.example"]
    assert len(model.constants) == 3 and len(model.links) == 1
    assert te.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_line_that_many_pages_share_is_kept(spark):
    rows = [(i, f"http://h/{i}", f"<html><body><div><p>shared line of text</p><p>{i} own</p></div></body></html>" if i % 2 else f"<html><body><div><p>{i} only</p></div></body></html>", "", 1, "", "") for i in range(10)]
    got = {r.page_id: r.text for r in te.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1] == "shared line of text\n1 own" and got[2] == "2 only"


def test_copies_of_an_article_are_no_template(spark):
    article = "<article><h1>Head</h1><p>First part.</p><p>Second part.</p></article>"
    html = lambda body, i: f"<html><body><div><ul><li>about us</li></ul></div>{body}<footer>seen {i}</footer></body></html>"
    rows = [(i, f"http://same/a?ref={i}", html(article, i), "", 1, "", "") for i in range(5)]
    rows += [(10, "http://same/b", html(article, 0), "", 1, "", "")] * 3
    rows += [(20 + i, f"http://half/a?ref={i}", html(article, i), "", 1, "", "") for i in range(6)]
    rows += [(30 + i, f"http://half/{i}", html(f"<div><p>{i} own</p></div>", i), "", 1, "", "") for i in range(6)]
    found = te.extract(spark.createDataFrame(rows, SCHEMA)).collect()
    got = {r.page_id: r.text for r in found}
    assert len(found) == len(rows)
    assert {got[i] for i in (*range(5), 10, *range(20, 26))} == {"Head\nFirst part.\nSecond part."}
    assert [got[30 + i] for i in range(6)] == [f"{i} own" for i in range(6)]


def test_broken_markup():
    assert te.text_of("<p>a <!-- never closed") == "a"
    assert te.text_of("a < b <p title='x > y'>c</p></div></p> d & e &amp f") == "a < b\nc\nd & e & f"
    assert te.text_of("<ul><li>one<li>two</ul><table><tr><td>x<td>y</table>") == "one\ntwo\nx\ny"
    assert te.text_of("<script>if (a < b) '<p>'</script><p>x") == "x"


def test_names_do_not_drop_the_article():
    for name in ('class="content-with-comments"', 'class="has-sidebar content"', 'id="search-results-main"', "class=no-header"):
        assert te.text_of(f"<div {name}><p>x y</p></div>") == "x y"
    # A wrapper with the headline and most of the text; certain names stay noise.
    wrapped = '<div class="{}"><h1>H</h1><p>long text here</p><div class="sidebar"><p>no</p></div></div><div class="promo"><p>buy</p></div>'
    assert te.text_of(wrapped.format("layout-sidebar-right")) == "H\nlong text here"
    assert te.text_of(wrapped.format("comments")) == te.text_of(wrapped.format("main-nav")) == ""
    assert te.text_of('<div class="page-header"><h1>Site</h1></div><div><p>a longer text</p></div>') == "a longer text"
    assert te.text_of("<form class=search><main><p>in</p></main><p>out</p></form>") == "in"


def test_links_end_with_their_block():
    assert te.text_of("<h1>T</h1><p>see <a href=x>here</p><p>Second</p>") == "T\nsee here\nSecond"
    assert te.text_of("<div><a href=x>top<p>One</p><p>Two</p></div><div>Three</div>") == "One\nTwo\nThree"
    assert te.text_of("<div><a href=x><h3>t</h3><p>s</p></a></div><p>own</p>") == "own"
    assert te.text_of("<a name=top><p>one</p>") == "one"


def test_quotes_in_tags():
    assert te.text_of("<p data-x=it's>Hello</p><p>second don't</p>") == "Hello\nsecond don't"
    assert te.text_of('<p title="5" tall">x</p>') == "x"
    assert te.text_of('<p x="unclosed>Text</p><p>more</p>') == "Text\nmore"
    assert te.text_of("<p>a</p><p>b <b") == "a\nb"
    assert te.text_of("<p>1 <2 and 3> 2 </é> </> x</p><svg/><p>y") == "1 <2 and 3> 2 </é> x\ny"


def test_broken_pages_take_linear_time():
    import time

    start = time.perf_counter()
    for piece in ("<a ", '<x "', "<!", "</", '<a x="', "<a href='", "<script ", "<!--", "<div>", '<div class="sidebar">', "<p><div>", "<div></p>"):
        te.text_of(piece * (300_000 // len(piece)))
    assert time.perf_counter() - start < 12


def brute_force(rows):
    """host -> (texts of valid classes, slots of links), from whole occurrence vectors."""
    hosts = {}
    for url, html in rows:
        tags, blocks = te.parse(html)
        pages = hosts.setdefault(url.split("/")[2], {})
        pages.setdefault(tuple(b[1] for b in blocks if not b[3]), []).append((url, tags, blocks))
    out = {}
    for host, articles in hosts.items():
        n, vectors, slots = len(articles), {}, {}
        if n < te.FEWEST:
            continue
        for i, copies in enumerate(articles.values()):
            _, tags, blocks = copies[0]
            for token in [("tag", t) for t in tags] + [("text", b[0], b[1]) for b in blocks]:
                vectors.setdefault(token, [0] * n)[i] += 1
            for path, text, linked, _, _ in blocks:
                entry = slots.setdefault(path, [set(), 0, 0])
                entry[0].add(i)
                entry[1] += len(text)
                entry[2] += linked
        wide = lambda pages: pages >= max(te.FEWEST, te.SHARE * n)
        classes = {}
        for token, vector in vectors.items():
            if wide(sum(map(bool, vector))):
                classes.setdefault(tuple(vector), []).append(token)
        valid = [c for c in classes.values() if len(c) >= te.TOKENS and sum(t[0] == "tag" for t in c) >= te.TOKENS - 1]
        constants = {te._hash(*t[1:]) for c in valid for t in c if t[0] == "text"}
        links = {te._hash("slot", p) for p, (pages, chars, linked) in slots.items() if wide(len(pages)) and linked > te.LINKED * chars}
        if constants or links:
            out[host] = constants, links
    return out


def test_templates_equal_brute_force(spark):
    """Whole vectors gathered in plain Python, on made hosts and on the given pages."""
    rows = [(f"http://h{i % 3}/p{i}", page(i, f"<h1>Title {i % 7}</h1><p>Body {i % 7}</p>" + "<p>Shared</p>" * (i % 2))) for i in range(40)]
    # Copies differ in their markup here only where they are equal as articles, so any copy may stand for them.
    rows = [(u, h) for i, (u, h) in enumerate(rows) if i < 14]
    rows += [(r.url, r.html) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("url", "html").collect()]
    docs = spark.createDataFrame([(i, u, h, "", 1, "", "") for i, (u, h) in enumerate(rows)], SCHEMA)
    got = {r.host: (set(r.constants or ()), set(r.links or ())) for r in te.templates(docs).collect()}
    assert got == brute_force(rows)
