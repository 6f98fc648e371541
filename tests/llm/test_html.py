"""Main text on pages with every kind of furniture, and the choice of paths per host."""

from evalspark.llm import html

PROSE = "Some words of prose, long enough to count, and a few more of them. " * 3


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title>{head}</head><body>{body}</body></html>"


RICH = page(f"""
<header class="site-header"><h1>Site name</h1><a href="/">Home</a></header><nav><ul><li><a href=a>one</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><div id="sidebar-2"><p>{PROSE}sidebar</p></div>
<main><article class="post post-17"><header><h1>Head &amp; line</h1><span class=by>by me</span></header>
<p>First  para&nbsp;graph<br>goes on. {PROSE}<script>var x = "</p><p>no";</script><style>p{{}}</style>
<p>Second <b>bold <i>nested</b> text</i> &lt;tag&gt; &#233; &copy; {PROSE}
<div class="ad-box ad">Buy now</div><!-- <p>gone</p> --><form><p>Your mail</p><input name=q></form>
<ul><li>item one<li>item two</ul><table><tr><td>a<td>b</tr><tr><td>c</td></tr></table>
<aside>aside</aside><p hidden>unseen</p><p style="display: none">unseen</p><div class="share social">Share</div></article>
<section id="comments"><p>{PROSE}reader</p></section></main><footer>&copy; me</footer>""")


def test_furniture_is_left_out():
    got = html.main_text(RICH, [])
    clean = PROSE.strip()
    assert got.split("\n") == [
        "Head & line", f"First para graph goes on. {clean}", f"Second bold nested text <tag> é © {clean}", "item one", "item two", "a", "b", "c"]


def test_awkward_markup():
    assert html.main_text(None, []) == "" and html.main_text("", ["/body"]) == ""
    assert html.main_text("plain words", []) == "plain words"
    assert html.main_text("a < b and <3 &amp; c", []) == "a < b and <3 & c"
    assert html.main_text("<p>one</p", []) == "one"
    assert html.main_text("<div><p>one<div>two</div></p>three</div>", []).split("\n") == ["one", "two", "three"]
    assert html.main_text("<script>only code", []) == "" and html.main_text("<nav>menu</nav>", []) == ""
    assert html.main_text("<body><p title='a > b'>x</body>", []) == "x"
    assert len(html.main_text("<div>" * 3000 + "deep" + "</div>" * 3000, [])) == 4


def test_hosts_agree_on_a_path(spark):
    body = "<div class='wrap'><div class='content c{i}'><p>{prose}</p></div><div class='extra'>{extra}</div></div>"
    rows = [(i, f"http://H.example.com/{i}", page(body.format(i=i, prose=PROSE, extra="x" if i else f"<p>{PROSE * 4}</p>"))) for i in range(6)]
    rows += [(7, None, None), (8, "no url", "<p>alone</p>"), (9, "http://h.example.com/z", "<p>unlike the others</p>"), (9, "http://h.example.com/z", "<p>unlike the others</p>")]
    pages = spark.createDataFrame([(*r, "old", 1) for r in rows], "page_id long, url string, html string, text string, path int")
    winners = {r.host: r.paths for r in html.elect(html.vote(pages)).collect()}
    assert winners["h.example.com"][0].endswith("div.wrap/div.c#.content")
    out = html.extract(pages).collect()
    assert len(out) == len(rows)
    for r in out:
        want = {7: "", 8: "alone", 9: "unlike the others"}.get(r.page_id, PROSE.strip())
        assert r.text == want and r.n_chars == len(want) and r.path == 1
    assert html.extract(pages.limit(0)).count() == 0


def test_whole_article_is_kept(spark):
    """Title and lead outside the body, and sections of different classes, with and without an article element."""
    parts = {
        "a": "<h1>Title</h1><p>{p}lead</p><div class='entry-content'><p>{p}{p}{p}</p></div>",
        "b": "<div class='intro'><h2>One</h2><div class='x'><p>{p}</p></div></div><div class='more'><h2>Two</h2><div class='y'><p>{p}{p}</p></div></div>"}
    rows = []
    for k, part in parts.items():
        for tag in ("article", "div class='post'"):
            body = f"<{tag}>{part.format(p=PROSE)}</{tag.split()[0]}><div class='links'><a href=a>{PROSE}</a><a href=b>more</a></div>"
            rows += [(len(rows), f"http://{k}-{tag[:3]}.example.com/{i}", page(body)) for i in range(3)]
    prose = PROSE.strip()
    want = {"a": ["Title", f"{PROSE}lead", f"{PROSE * 3}".strip()], "b": ["One", prose, "Two", f"{PROSE * 2}".strip()]}
    for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        assert r.text.split("\n") == want[r.url[7]], r.url
