from loomwright.llm.html import ExtractionParameters, align, extract, extract_pages, outcomes, parse

PAGE = '<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a>x</a></li></ul></nav><div class="ad">buy</div>%s<footer>&copy; f</footer></body></html>'


def test_blocks_entities_and_white_space():
    page = parse(PAGE % "<article><h1>A &amp;amp; B</h1><p>one\n two&nbsp;<b>three<br>four</b><p>five &quot;six&quot; &am<div class='comments'>no</div><aside>no</aside></article>")
    assert extract(page, set()) == 'A &amp; B\n\none two three four\n\nfive "six" &am'


def test_cut_off_and_odd_markup():
    assert extract(parse("<p>a<p>b <i>c</p> d"), set()) == "a\n\nb c\n\nd"
    assert extract(parse("<article><p>a</p><p>b<"), set()) == "a\n\nb<"
    assert extract(parse("<article><p>a</p><p class='x"), set()) == "a"
    assert extract(parse(""), set()) == "" and extract(parse("plain"), set()) == "plain"
    assert extract(parse("<div>" * 3000 + "deep"), set()) == "deep"
    assert extract(parse("<main><p>m</p></main><p>out</p>"), set()) == "m"


def test_alignment():
    a, b = parse("<div><p>x</p><p>same</p><ul><li>1</li></ul></div>"), parse("<div><p>same</p><ul><li>1</li><li>2</li></ul></div>")
    found = {}
    align(a, b, 64, found)
    texts = {n.number: n.text for n in _all(b) if n.tag == "#"}
    assert {texts[k]: found[k].text for k in texts if k in found} == {"same": "same", "1": "1"}
    assert outcomes(a, a, ExtractionParameters()) == []


def _all(node):
    yield node
    for c in node.children:
        yield from _all(c)


def test_template_of_a_host(spark):
    body = "<html><body><div><p>Welcome to our site, friend of words</p><p>story %d begins here with many different words %s</p></div></body></html>"
    rows = [(i, f"https://h.org/{i}", body % (i, "abcdefghijkl"[i] * 60), "x") for i in range(12)]
    rows += [(100, None, None, "x"), (101, "https://h.org/0", "", "x"), (102, "https://lone.org/", body % (1, "z"), "x"), (0, "https://h.org/0", rows[0][2], "x")]
    got = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows) and by[100].text == "" and by[101].n_chars == 0
    assert by[3].text == f"story 3 begins here with many different words {'d' * 60}"
    assert by[102].text.startswith("Welcome")
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
