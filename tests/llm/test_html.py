from tidemill.llm import html


def test_held_out_pages():
    model = html.trained()
    right = total = 0
    for source, labels in html.labelled_pages(150, 77):
        page = html.Page(source)
        assert len(page.tag) == len(labels)
        p, _ = html.marginals(page.parent, *model.potentials(page))
        for q, y, size in zip(p, labels, page.size, strict=True):
            if size:
                total += 1
                right += (q >= 0.5) == bool(y)
    assert right / total > 0.97


def test_marginals_against_enumeration():
    import itertools
    import math

    parent, own = [-1, 0, 0, 1, 1], [0.3, -1.0, 0.5, 2.0, -0.2]
    pair = [(1, 1, 1, 1), (2, 0.5, 0.3, 4), (1, 1, 0.2, 3), (3, 1, 1, 2), (1, 0.1, 0.7, 5)]
    mass = {}
    for ys in itertools.product((0, 1), repeat=5):
        w = math.exp(sum(o * y for o, y in zip(own, ys, strict=True)))
        for i in range(1, 5):
            w *= pair[i][2 * ys[parent[i]] + ys[i]]
        mass[ys] = w
    z = sum(mass.values())
    got, joint = html.marginals(parent, own, pair)
    for i in range(5):
        assert abs(got[i] - sum(w for ys, w in mass.items() if ys[i]) / z) < 1e-12
    for i in range(1, 5):
        for k in range(4):
            assert abs(joint[i][k] - sum(w for ys, w in mass.items() if 2 * ys[parent[i]] + ys[i] == k) / z) < 1e-12


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href=/>Home</a><li><a href=/x>X</a></ul></nav><!-- ad --><div class="ad">Buy now and save a lot of money today.</div>
<article><h1>A  title &amp; more</h1><p>First <b>bold</b>er para&shy;graph with enough words to be read by someone,&nbsp;truly.<br>Next line<p>Second paragraph is here as well, and it has words.
<table><tr><td>one<td>two</table></article><div class="comments"><p>I disagree with this article very much, said a reader.</div>
<form><label>Name</label><input><button>Send</button></form><footer>&copy; me</footer>"""


def test_a_page():
    assert html.trained().extract(PAGE) == "A title & more First bolder para\xadgraph with enough words to be read by someone, truly. Next line Second paragraph is here as well, and it has words. one two"


def test_odd_pages(spark):
    pages = [PAGE, None, "", "<", "<p", "plain text", "<div>" * 3000 + "x", "</p></div>", "<script>never ends", "<article>" + "word " * 50_000, "<!-- never", '<a href="x>y']
    df = spark.createDataFrame([(i, f"u{i}", p, "x") for i, p in enumerate([*pages, PAGE])], "page_id long, url string, html string, text string")
    rows = {r.page_id: r for r in html.extract(df).collect()}
    assert len(rows) == len(pages) + 1 and all(r.n_chars == len(r.text) for r in rows.values())
    assert rows[1].text == rows[2].text == "" and rows[0].text == rows[len(pages)].text and len(rows[9].text) == 249_999
    assert html.extract(df.limit(0)).count() == 0


def test_deep_pages_take_linear_time():
    import time

    def took(n):
        began = time.perf_counter()
        for page in ("<div>x" * n, "<span class=nav>x" * n, "<p>" + "<span class=nav>x" * n + "<div>" * n, "<li><ul>" + "<div>" * n + "</li>" * n):
            tree = html.Page(page)
            tree.text([True] * len(tree.tag))
        return time.perf_counter() - began

    took(500)
    assert took(16_000) < 40 * took(1_600) + 0.5  # ten times as much; a hundred times if quadratic
