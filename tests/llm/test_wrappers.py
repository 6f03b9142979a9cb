"""Main text of hand-made pages with known articles, and the alignment's rules."""

import html
import random

import cases
import pytest

from seqrec.llm import queries, wrappers


def page(rng, blocks, extras=True):
    nav = "<nav><ul>" + "".join(f"<li><a href='/{k}'>Section {k}</a></li>" for k in range(rng.randrange(3, 7))) + "</ul></nav>"
    body = "".join(f"<p>{html.escape(b)}</p>" if rng.random() < 0.7 else f"<p><b>{html.escape(b)}</b><br>" for b in blocks)
    around = ["<aside>Aside text</aside>", "<div class='sidebar'><p>Popular now</p></div>", "<div class=\"cookie-notice\">We use cookies</div>",
              "<form><label>Mail</label><input name=q></form>", "<div id=comments><div class='comment'><p>First!</p></div></div>", "<!-- <p>no</p> -->", "<div class='ad banner'>Buy</div>"]
    rng.shuffle(around)
    around = around[:rng.randrange(len(around))] if extras else []
    half = len(around) // 2
    return (f"<!DOCTYPE html><html><head><title>T</title><script>var a='</p><p>x</p>';</script><style>p{{}}</style></head><body><header>Site</header>{nav}{''.join(around[:half])}"
            f"<article>{body}<script>track('<p>y</p>')</script></article>{''.join(around[half:])}<footer>&copy; us</footer>" + ("</body></html>" if rng.random() < 0.8 else ""))


def test_articles_come_back_whole(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for k in range(120):
        blocks = [cases.prose(1000 * k + j, rng.randrange(1, 40)) + " <é> & \"q\"" for j in range(rng.randrange(1, 8))]
        rows.append((k, f"http://host{k % 4 if k % 3 else 0}.example/{k}", page(rng, blocks), "old", 1))
        want[k] = "\n\n".join(blocks)
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, wrapper int").repartition(5)
    got = wrappers.extract(df, wrappers.infer(df)).collect()
    assert {r["page_id"]: r["text"] for r in got} == want


def test_constant_text_of_a_host_is_template():
    def make(k):
        return f"<body><div class=content><h2>Daily reader</h2><p>{cases.prose(k, 12)}</p><p>{cases.prose(k + 50, 9)}</p><div>Reach us by post.</div></div></body>"
    whole = None
    for k in range(8):
        new = wrappers.wrapper_of(wrappers.parse(make(k)))
        whole = new if whole is None else wrappers.align(whole, new)
    assert wrappers.main_text(make(3), whole) == f"{cases.prose(3, 12)}\n\n{cases.prose(53, 9)}"
    assert "Daily reader" in wrappers.main_text(make(3))
    same = None
    for _ in range(8):  # copies of one page show no template
        new = wrappers.wrapper_of(wrappers.parse(make(3)))
        same = new if same is None else wrappers.align(same, new)
    assert wrappers.main_text(make(3), same) == wrappers.main_text(make(3))


def label(w):
    return w[0] + ("?" if w[1] else "") + ("+" if w[2] else "")


def test_alignment_makes_optional_and_repeated_groups():
    a = wrappers.wrapper_of(wrappers.parse("<div>x</div><p>1</p><p>2</p><dl><dt>a<dd>b<dt>c<dd>d</dl>"))
    b = wrappers.wrapper_of(wrappers.parse("<h1>t</h1><div>x</div><p>1</p>"))
    w = wrappers.align(a, b)
    assert [label(c) for c in w[5]] == ["h1?", "div", "p+", "dl?"]
    assert [label(c) for c in w[5][3][5]] == ["(dt dd)+"]
    assert w[5][1][5][0][4] and not w[5][2][5][0][4]  # the div's text stays constant, the paragraphs' is a slot


@pytest.mark.parametrize("text, want", [
    (None, ""), ("", ""), ("plain text", "plain text"), ("<p>a<p>b", "a\n\nb"), ("<p>a &amp; b&nbsp;&nbsp;c&#x41;", "a & b cA"), ("<p>one\n  two\t<i>three</i></p>", "one two three"),
    ("<p>cut <a href=\"x", "cut"), ("<p>1 < 2 <3</p>", "1 < 2 <3"), ("<script>x", ""), ("<ul><li><a>h</a><li><a>i</a><li><a>j</a></ul><p>t</p>", "t"), ("<div hidden>x</div>y", "y"),
    ("<main><p>m</p></main><p>n</p>", "m"), ("<article><header><h1>H</h1></header><p>t</p><section class=comments><p>c</p></section></article>", "H\n\nt"), ("<div>" * 5000 + "deep", "deep")])
def test_small_pages(text, want):
    assert wrappers.main_text(text or "") == want


def test_awkward_rows(spark):
    rows = [(1, None, "<p>x</p>"), (2, "no url", None), (None, "http://a.b/c", ""), (3, "http://A.B:8080/c", "<p>y</p>"), (3, "http://A.B:8080/c", "<p>y</p>")]
    df = spark.createDataFrame([(*r, "t", "h") for r in rows], "page_id bigint, url string, html string, text string, host string")
    got = wrappers.extract(df, wrappers.infer(df)).collect()
    assert sorted((r["page_id"] or 0, r["text"]) for r in got) == [(0, ""), (1, "x"), (2, ""), (3, "y"), (3, "y")]
    assert wrappers.extract(df.where("false"), wrappers.infer(df.where("false"))).count() == 0


def test_pages_table(spark):
    got = queries.op4_wrappers(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == spark.read.parquet("/root/testdata/sf0.001/pages.parquet").count()
    assert all(r["text"] and len(r["text"]) == r["n_chars"] for r in got)


def test_link_lists_and_all_parts_of_the_article_stay():
    links = "<ul>" + "".join(f"<li><a href=/r{k}>Reference number {k}</a></li>" for k in range(4)) + "</ul>"
    kept = "\n\n".join(f"Reference number {k}" for k in range(4))
    for open_, close in (("<article>", "</article>"), ("<main>", "</main>"), ("<div class=story>", "</div>")):
        assert wrappers.main_text(f"<body>{links}{open_}<p>Text of it.</p>{links}{close}</body>") == f"Text of it.\n\n{kept}"
    assert wrappers.main_text(f"<body><p>Text of it.</p>{links}</body>") == "Text of it."
    parts = "<div class=content><p>First part.</p></div><div class=menu>Menu</div><div class=content><p>The second, longer part.</p></div>"
    assert wrappers.main_text(f"<body><div>{parts}</div></body>") == "First part.\n\nThe second, longer part."


def test_copies_of_an_article_are_one_page(spark):
    """Elements that one article has alone stay, however often it was copied; so does what few pages share."""
    def make(k, extra="", mark=0):
        return f"<body><div class=nav>{mark}</div><div class=content><h2>Daily reader</h2><p>{cases.prose(k, 12)}</p>{extra}</div></body>"

    quote, few = "<blockquote>Said only here.</blockquote>", "<h3>Of six pages</h3>"
    rows = [(k, f"http://a.example/{k}", make(k)) for k in range(40)]
    rows += [(100 + k, f"http://a.example/copy{k}", make(900, quote, k)) for k in range(30)]
    rows += [(200 + k, f"http://a.example/few{k}", make(200 + k, few)) for k in range(6)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(4)
    got = {r["page_id"]: r["text"] for r in wrappers.extract(df, wrappers.infer(df)).collect()}
    assert all(got[k] == cases.prose(k, 12) for k in range(40))
    assert all(got[100 + k] == f"{cases.prose(900, 12)}\n\nSaid only here." for k in range(30))
    assert all(got[200 + k] == f"{cases.prose(200 + k, 12)}\n\nOf six pages" for k in range(6))


def test_repeats_within_a_page_are_one_page():
    page_ = lambda k: f"<body><p>{cases.prose(k, 9)}</p>" + ("<ul>" + "<li>Same item" * 6 + "</ul>" if k == 0 else "") + "</body>"
    whole = None
    for k in range(6):
        new = wrappers.wrapper_of(wrappers.parse(page_(k)))
        whole = new if whole is None else wrappers.align(whole, new)
    assert wrappers.main_text(page_(0), whole) == wrappers.main_text(page_(0))


def test_long_lists_align_as_short_ones_do():
    """Two lists of a product above 250,000 had the next equal label instead of a longest common subsequence."""
    draw = random.Random(4)
    left, right = ([str(draw.randrange(12)) for _ in range(n)] for n in (520, 500))
    best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i in range(len(left) - 1, -1, -1):
        for j in range(len(right) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if left[i] == right[j] else max(best[i + 1][j], best[i][j + 1])
    wanted, i, j = [], 0, 0
    while i < len(left) and j < len(right):
        if left[i] == right[j]:
            wanted.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    assert wrappers._partners(left, right) == wanted
    assert wrappers._partners([], right) == [] and wrappers._partners(left, []) == []
    # one label in front whose partner is far away must not use up the rest
    rest = [str(k) for k in range(600)]
    assert wrappers._partners(["z", *rest], [*rest, "z"]) == [(k + 1, k) for k in range(600)]
