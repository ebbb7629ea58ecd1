import pytest

from duotide.llm import template


def text_of(*pages):
    parsed, places = [template.parse(p) for p in pages], template.Places()
    shape = template.deduce(parsed, places)
    return [template.extract(blocks, shape, places) for blocks, _ in parsed]


SITE = """<!DOCTYPE html><html><head><title>T {0}</title><style>p{{x}}</style><script>var a="</p><article>no";</script></head><body>
<header class="site"><a href="/">Home</a></header><div class="cookie-notice">We use cookies</div><nav><ul><li><a>One</a><li><a>Two</a></ul></nav>
<!-- ad {0} --><div class="ad">Buy {0}</div><main><article><h1>Title {0} &amp; more</h1><p><b>First {0}<br><p>Second&nbsp;&lt;p&gt; pa<em>rt</em>ed
<blockquote>Quote {0}</blockquote><aside>Beside</aside></article><section id="comments"><article class="comment">Reader {0}</article></section></main>
<form><label>Name</label><input></form><footer>&copy; site {0}</footer></body></html>"""


def test_article_only():
    got = text_of(*[SITE.format(w) for w in ("alpha", "beta", "gamma", "delta")])
    assert got[1] == "Title beta & more First beta Second <p> parted Quote beta"
    assert got == text_of(SITE.format("alpha")) + got[1:]


def test_same_article_on_every_page_stays():
    assert len(set(text_of(*[SITE.format("same")] * 5))) == 1 and "First same" in text_of(*[SITE.format("same")] * 5)[0]


def test_without_names_the_template_tells():
    page = "<html><body><div><a>Home</a> <a>News</a></div><div>Fixed words of the site</div><div><p>Own words of page {0}, many of them.</p></div></body></html>"
    assert text_of(*[page.format(i) for i in ("a", "b", "c", "d")])[2] == "Own words of page c, many of them."


def test_tokens_out_of_order_are_no_template():
    a, b = "<body><p class=x>1</p><div class=y>2</div></body>", "<body><div class=y>2</div><p class=x>1</p></body>"
    shape = template.deduce([template.parse(p) for p in (a, b, a, b)], template.Places())
    assert "/body" in shape.elements and not {"/body/p.x", "/body/div.y"} & shape.elements


@pytest.mark.parametrize("page, want", [("", ""), ("<", "<"), ("plain", "plain"), ("<p>a<p>b", "a b"), ("<!-- open", ""), ("<script>x", ""), ("<article>" + "<b>" * 3000 + "deep", "deep"), ("<div class='" + '"' * 2000, None), ("<article><p>" + "w " * 200_000, ("w " * 200_000).strip())])
def test_broken_pages(page, want):
    assert want is None or text_of(page) == [want]


def test_text_after_deep_nesting():
    page = "<div id=page><article>" + "<div>" * 500 + "deep" + "</div>" * 500 + "<p>rest</p></article></div>"
    assert text_of(page) == ["deep rest"]
    assert text_of("<article><p>in</p>" + "<b>" * 400 + "bold<aside>beside</aside><form>form</form></article>") == ["in bold"]
    assert text_of("<article>" + "<div>" * 20_000 + "deep<aside>beside</aside></article>" + "</i>" * 20_000) == ["deep"]


def test_a_surer_sign_inside_overrides_a_word_around_it():
    rest = "<nav>Nav</nav><article><p>Text {0}</p><div class='ad'>Buy</div></article>"
    wide = "<html><body class='has-sidebar'>" + rest + "</body></html>"
    wrapped = "<html><body><div class='content-sidebar-wrap'>" + rest + "</div></body></html>"
    for page in (wide, wrapped):
        assert text_of(*[page.format(i) for i in "abcd"]) == [f"Text {i}" for i in "abcd"]
    comments = "<html><body><article><p>Text {0}</p></article><div id='comments'><article>Reader {0}</article></div></body></html>"
    assert text_of(*[comments.format(i) for i in "abcd"]) == [f"Text {i}" for i in "abcd"]


def test_copies_on_a_host_without_names_stay():
    page = "<html><body><div><a>Home</a> <a>News</a></div><table><tr><td><p>Own words of page {0}.</p><p>More of {0}.</p></table></body></html>"
    want = "Own words of page {0}. More of {0}."
    got = text_of(*[page.format(i) for i in ["same"] * 8 + list("abcdefgh")])
    assert got == [want.format(i) for i in ["same"] * 8 + list("abcdefgh")]
    assert all(want.format(i) in x for i, x in zip(["same", "same", "a"], text_of(*[page.format(i) for i in ["same", "same", "a"]]), strict=True))


def test_links_are_judged_by_slot():
    page = "<html><body><div><p>Long text of {0} that tells what there is to tell.</p><p><a>Source of {0}</a></p><ul><li><a>Item {0}</a></ul></div><section><p><a>Elsewhere {0}</a></p></section></body></html>"
    assert text_of(*[page.format(i) for i in "abcd"])[1] == "Long text of b that tells what there is to tell. Source of b Item b"


@pytest.mark.parametrize("name", ["button", "svg", "canvas", "video", "select", "option", "noscript"])
def test_unclosed_element_ends_with_its_parent(name):
    assert text_of(f"<article><div><p>a</p><{name}>x</div><p>rest</p></article>") == ["a rest"]
    assert text_of(f"<article><p>a <{name}>x</{name}> b</p></article>") == ["a b"]


def test_formulas_and_objects_are_text():
    assert text_of("<article><p>a <math><mi>x</mi></math> <object>b</object></p></article>") == ["a x b"]


def test_pages(spark):
    rows = [(i, f"https://Host{i % 2}.example.org/{i}", SITE.format(f"w{i}"), "clash", 1) for i in range(40)]
    rows += [(40, None, None, "g", 1), (41, "no url", "", None, 1), (None, "http://host1.example.org", SITE.format("null"), "g", None), rows[3]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, id long")
    got = template.main_text(df).collect()
    assert len(got) == len(rows)
    by = {r["id"]: r for r in got}
    for i in range(40):
        assert by[i]["text"] == f"Title w{i} & more First w{i} Second <p> parted Quote w{i}" and by[i]["url"] == rows[i][1]
    assert by[40]["text"] == by[41]["text"] == "" and "null" in by[None]["text"]
    assert template.main_text(df.limit(0)).count() == 0


def test_large_host_is_split(spark, monkeypatch):
    monkeypatch.setattr(template, "GROUP", 8)
    df = spark.createDataFrame([(i, "http://one.example.org/", SITE.format(f"w{i}")) for i in range(100)], "page_id long, url string, html string")
    assert sorted(r["text"] for r in template.main_text(df).collect()) == sorted(text_of(*[SITE.format(f"w{i}") for i in range(100)]))
