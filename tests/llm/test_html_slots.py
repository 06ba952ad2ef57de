import itertools
import random
import re

from loomwright.llm.html import ExtractionParameters, Node, _score, extract_pages, parse

P = ExtractionParameters()


def _matching(x, y):
    """Most matched nodes of two ordered trees with equal roots, equal texts counted twice, over all order-keeping choices."""
    best = 0
    n, m = len(x.children), len(y.children)
    for k in range(min(n, m) + 1):
        for i in itertools.combinations(range(n), k):
            for j in itertools.combinations(range(m), k):
                total = 0
                for a, b in zip(i, j):
                    c, d = x.children[a], y.children[b]
                    if c.tag != d.tag or c.mark != d.mark:
                        break
                    total += (2 if c.text == d.text else 1) if c.tag == "#" else _matching(c, d)
                else:
                    best = max(best, total)
    return 1 + best


def _tree(rng, depth):
    tag = rng.choice("ab#") if depth else "r"
    node = Node(tag, text=rng.choice("xy") if tag == "#" else "")
    if tag != "#" and depth < 3:
        node.children = [_tree(rng, depth + 1) for _ in range(rng.randrange(4))]
    return node


def _number(root):
    todo, n = [root], 0
    while todo:
        node = todo.pop()
        node.number, n = n, n + 1
        todo.extend(node.children)
    return root


def test_alignment_against_exhaustive_matching():
    rng = random.Random(3)
    for _ in range(400):
        x, y = _number(_tree(rng, 0)), _number(_tree(rng, 0))
        assert _score(x, y, 64, {}) == _matching(x, y)


def _site(host, n, seed, wrap):
    rng = random.Random(seed)
    words = lambda k: " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(k))
    rows = []
    for i in range(n):
        parts = [words(6)] + [words(rng.randrange(15, 60)) for _ in range(rng.randrange(1, 8))]
        body = f"<h1>{parts[0]}</h1>" + "".join(f"<p>{x}</p>" for x in parts[1:])
        menu = "".join(f'<li><a href="/{k}">{words(1)}</a></li>' for k in range(5))
        rows.append((f"{host}-{i}", f"https://{host}/{i}", wrap % {"menu": menu, "body": body, "ad": words(5), "foot": words(4)}, "\n\n".join(parts)))
    return rows


def test_slots_without_tags_and_names(spark):
    """No article tag, no telling name: where the varying text stands decides."""
    plain = '<html><body><div class="k1"><ul>%(menu)s</ul></div><div class="k2">%(ad)s</div><div class="k3">%(body)s</div><div class="k4">(c) %(foot)s</div></body></html>'
    deep = '<html><body><div class="layout has-sidebar"><div class="sidebar"><ul>%(menu)s</ul></div><div class="promo-box"><div>%(ad)s</div><div>%(body)s</div></div></div><div>%(foot)s</div></body></html>'
    rows = _site("plain.org", 30, 1, plain) + _site("deep.org", 30, 2, deep)
    got = {r.page_id: r for r in extract_pages(spark.createDataFrame([r[:3] for r in rows], "page_id string, url string, html string").repartition(3)).collect()}
    for page_id, _, _, text in rows:
        assert got[page_id].by_slot and got[page_id].text == text


def test_pages_stripped_of_names(spark):
    """The tables' pages give the same text with article, nav and footer made into div and all names changed."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").where("page_id % 3 = 0")
    names = {}

    def strip(html):
        html = re.sub(r"<(/?)(article|nav|footer|header|main|aside)\b", r"<\1div", html or "")
        return re.sub(r'class="([^"]*)"', lambda m: f'class="q{names.setdefault(m.group(1), len(names))}"', html)

    rows = [(r.page_id, r.url, strip(r.html)) for r in pages.collect()]
    want = {r.page_id: r for r in extract_pages(pages).collect()}
    got = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()
    by_slot = [r for r in got if r.by_slot]
    assert len(by_slot) >= 0.8 * len(got)
    assert sum(r.text == want[r.page_id].text for r in by_slot) >= 0.99 * len(by_slot)


def test_odd_columns_long_page_and_ties(spark):
    long = "<html><body>" + "".join(f"<p>paragraph {i}</p>" for i in range(4000)) + "</body></html>"
    rows = [(1, "https://a.org/1", long, "h", "r", 0, 1), (2, "https://a.org/2", long, "h", "r", 0, 1), (None, None, "<p>x", "h", "r", 0, 1), (3, "https://a.org/3", None, "h", "r", 0, 1)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string, host string, reference string, n_chars int, mass int")
    got = {r.page_id: r.text for r in extract_pages(docs).collect()}
    assert got[1] == got[2] == "\n\n".join(f"paragraph {i}" for i in range(4000)) and got[None] == "x" and got[3] == ""
    assert parse("").children == []
