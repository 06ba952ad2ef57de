import random

from loomwright.llm.html import extract_pages


def _pages(host, copies, others, seed):
    """A host's longest page in near copies (one edited word in two of eight paragraphs), and other short pages."""
    rng = random.Random(seed)
    prose = lambda n: " ".join(rng.choice("abcdefghij") * rng.randrange(1, 4) + str(rng.randrange(500)) for _ in range(n))
    page = "<html><body><div><p>Welcome to our site, friend of words</p>%s</div></body></html>"
    story = [prose(30) for _ in range(8)]
    rows = []
    for k in range(copies + others):
        parts = list(story) if k < copies else [prose(30), prose(30)]
        if k < copies:
            for i in rng.sample(range(8), 2):
                words = parts[i].split()
                words[rng.randrange(30)] = f"edit{k}x{i}"
                parts[i] = " ".join(words)
        rows.append((f"{host}-{k}", f"https://{host}/{k}", page % "".join(f"<p>{x}</p>" for x in parts), "\n\n".join(parts)))
    return rows


def test_near_copies_are_no_template(spark):
    rows = [r for n in range(6) for r in _pages(f"five{n}.org", 5, 20, n)] + _pages("many.org", 1000, 20, 9) + _pages("only.org", 30, 0, 10)
    got = {r.page_id: r.text for r in extract_pages(spark.createDataFrame([r[:3] for r in rows], "page_id string, url string, html string").repartition(3)).collect()}
    welcome = "Welcome to our site, friend of words\n\n"
    for page_id, _, _, text in rows:
        # where all pages are copies of one another, nothing tells a template
        assert got[page_id] == (welcome if page_id.startswith("only") else "") + text
