"""HTML extraction: blocks on fixtures, gradients by differences, held-out pages, the table."""

import html
import random
import re

import numpy as np
import pytest

from causeway.llm import html_extract as hx


def texts(page):
    return [b.text for b in hx.blocks(page)]


def test_blocks():
    assert texts("") == [] and texts("plain  text\n") == ["plain text"]
    assert texts("<p>a<p>b <b>c<br>d</p>e &lt;f&gt; &amp") == ["a", "b c", "d", "e <f> &"]
    assert texts('<script>var t="</p>";</script>x<style>p{}</style><!-- <p>no</p> -->y<!-- open') == ["xy"]
    assert texts('<div title="a>b">x</div><di') == ["x"] and texts("1 < 2 <3 <b>x</b>") == ["1 < 2 <3 x"]
    [b] = hx.blocks('<nav class="mainMenu top-bar"><ul><li><a href=x>Go</a></ul></nav>')
    assert b.path == ["nav", ".main", ".menu", ".top", ".bar", "ul", "li"] or b.path[:5] == ["nav", ".main", ".menu", ".top", ".bar"]
    assert b.linked == 2
    inner = hx.blocks("<article><p><b>one<br><p>two</p></article><footer>f</footer>")
    assert [b.path for b in inner] == [["article", "p", "b"], ["article", "p"], ["footer"]]
    assert len(texts("<p>x</p>" * 5000)) == 5000 and texts("y" * 200_000) == ["y" * 200_000]


def test_self_closed_svg_and_stray_quotes():
    assert texts('<p>a</p><svg class="i"/><p>b</p><p>c</p>') == ["a", "b", "c"]
    assert texts("<p>a</p><svg/><p>b</p><svg class=i/>c<svg viewBox='0 0 1 1'><path d='M0'/><text>no</text></svg><p>d</p>") == ["a", "b", "c", "d"]
    assert texts('<svg class="a/"><text>no</text></svg>x<svg\n  role="img"\n/>y') == ["xy"]
    assert texts("<img alt=it's><p>one don't two</p>") == ["one don't two"]
    assert texts('<p title=5">a "quoted" line</p><p>b</p>') == ['a "quoted" line', "b"]
    assert texts('<div class="a"">x</div><p id=\'b\'\' class="c">y</p>') == ["x", "y"]
    assert [b.path for b in hx.blocks('<div class="a""><p id=\'b\'\' class="c">y</p></div>')] == [["div", ".a", "p", ".b", ".c"]]
    assert texts("<a href = \"x>y\" title='p>q' data-z>go</a><input value=>z<p \"'>w</p>") == ["go", "z", "w"]
    assert texts('<p class="open>a</p><p>b</p>') == ["a", "b"] and texts('x<div class="cut off') == ["x"]      # never closed
    assert texts("<title-bar>a</title-bar><svg-icon name=x></svg-icon><p>b</p>") == ["a", "b"]
    assert texts("<script src='a'/>no</script><SVG/><p>b</p>") == ["b"]
    assert len(texts("<p a='1\">x</p>" * 4001)) == 2001 and texts("<p " + "a=' " * 50_000 + ">x") == ["x"]


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    model = hx.Labeller(hidden=3)
    pages = [rng.normal(size=(n, hx.PATH_BINS + hx.WORD_BINS + 10)).astype(np.float32) for n in (1, 4, 6)]
    x, mask = model.padded(pages)
    y = (rng.random((6, 3, 1)) < 0.5).astype(np.float32)

    def loss():
        p = model.forward(x, mask)[0].astype(np.float64)
        return float(-(np.where(y > 0, np.log(p), np.log(1 - p)) * mask).sum() / mask.sum())
    for q, g in zip(model.parameters, model.gradients(x, mask, y)):
        for at in list(np.ndindex(*q.shape))[:: max(1, q.size // 5)][:5]:
            old, h = q[at], 1e-2
            q[at] = old + h
            up = loss()
            q[at] = old - h
            down = loss()
            q[at] = old
            assert abs((up - down) / (2 * h) - g[at]) < 2e-3


@pytest.fixture(scope="module")
def model():
    return hx.trained()


def test_label_does_not_depend_on_the_batch(model):
    pages = [b for b, _ in hx.training_pages(70, 3)]
    assert model.label(pages) == [model.label([p])[0] for p in pages]
    assert model.label([[], pages[0]]) == [[], model.label([pages[0]])[0]]


def test_held_out_pages(model):
    test = hx.training_pages(300, 99)
    got = model.label([b for b, _ in test])
    right = [a == (y > 0.5) for l, (_, ys) in zip(got, test) for a, y in zip(l, ys)]
    assert np.mean(right) >= 0.985


def truth(page):
    """The main text of the table's layout: the lines inside its article."""
    m = re.search(r"<article>(.*?)(</article>|$)", page, re.S)
    parts = re.split(r"</?(?:p|h1|br)\b[^>]*>", re.sub(r"</?b>", "", re.sub(r"<[^>]*$", "", m[1]))) if m else []
    return "\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)


def test_query_on_the_table(spark, sf_dir):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = hx.op4_html_extraction(spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == truth(pages[r.page_id].html) and r.url == pages[r.page_id].url and r.n_chars == len(r.text)


def test_other_layouts(model):
    rnd = random.Random(6)
    line = lambda: " ".join("".join(rnd.choice("abdeilmnorstu") for _ in range(rnd.randint(2, 9))) for _ in range(rnd.randint(6, 30))).capitalize() + "."
    good = 0
    for _ in range(60):
        main = [line() for _ in range(rnd.randint(3, 9))]
        page = ("<html><head><title>t</title></head><body><header class=masthead><a href=/>Site</a></header><div id=cookie-banner>We use cookies <button>OK</button></div>"
                "<nav><a href=1>Home</a> <a href=2>News</a></nav><div class='sidebar'><h3>Related</h3><ul><li><a href=3>" + line() + "</a></li></ul></div>"
                "<article>" + "".join(f"<p>{x}</p>" for x in main) + "</article><form><label>Name</label><input><button>Send</button></form>"
                "<section id='comments'><h3>Comments</h3>" + "".join(f"<div class=comment><p>{line()}</p></div>" for _ in range(3)) + "</section>"
                "<footer>&copy; 2024 All rights reserved</footer></body></html>")
        good += hx.extract([page], model)[0] == "\n".join(main)
    assert good >= 54


def test_edges(spark):
    df = spark.createDataFrame([(1, "u", None, "clash"), (None, None, "", "x"), (2, "u", "<article><h1>A b.</h1><p>C d e f.</p></article>", "x")] * 2,
                               "page_id long, url string, html string, text string")
    rows = hx.extract_text(df).collect()
    assert len(rows) == 6 and sum(r.text == "" and r.n_chars == 0 for r in rows) == 4
    assert hx.extract_text(df.limit(0)).count() == 0


def test_plain_layouts_keep_their_text():
    """No classes, ids or sectioning tags: bare blocks of prose stay, links and copyright go."""
    prose = ["The river runs down from the hills and passes the old mill, where the road turns to the village.", "In the spring the fields are green, and people walk along the water until late in the evening.",
             "Nobody knows who built the bridge, but it has stood there for as long as anyone can remember."]
    rnd = random.Random(1)
    longer = [" ".join(rnd.choice(prose) for _ in range(3)) for _ in range(3)]
    pages = [f"<html><body><h1>The river</h1><div>{longer[0]}</div><div>{longer[1]}</div></body></html>",
             f"<html><body><div><a href=/a>Home</a> <a href=/b>About</a> <a href=/c>Contact</a></div><h1>The river</h1><div>{longer[0]}</div><div>{longer[1]}</div></body></html>",
             f"<p>{longer[0]}</p>", f"<div>{longer[2]}</div>", f"<html><body><p>{longer[0]}</p><p>{longer[1]}</p></body></html>"]
    want = ["\n".join(["The river", longer[0], longer[1]])] * 2 + [longer[0], longer[2], "\n".join(longer[:2])]
    assert hx.extract(pages, hx.trained()) == want
