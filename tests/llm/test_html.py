"""HTML extraction: parser cases, gradients, held-out accuracy on pages and on other designs."""

import random

import numpy as np
import pytest

from parallax.llm import html_blocks as B, html_lstm as L
from parallax.llm.queries import QUERIES
from tests.conftest import SF_MID


def texts(html):
    return [b.text for b in B.read_blocks(html)]


def test_blocks():
    assert texts(None) == texts("") == texts("<p>  </p>") == []
    assert texts("<p>a <b>b</b>\n\t&amp;&nbsp;c<br>d</p><p>e") == ["a b & c d", "e"]
    assert texts('<script>var t="</p>";</script><style>p{}</style><!-- x --><p>a</p><noscript>n</noscript>') == ["a"]
    assert texts("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>") == ["a", "b", "c", "d", "e"]
    assert texts("x<div>y</div>z &lt;p&gt; &#233;") == ["x", "y", "z <p> é"]
    paths = {b.text: b.path for b in B.read_blocks('<nav class="top Menu"><a href="/x">l</a></nav><article><p><b>u<br><p>v</article><footer>w')}
    assert paths == {"l": ("nav", ".top", ".menu"), "u": ("article", "p"), "v": ("article", "p"), "w": ("footer",)}


def test_a_head_ends_without_its_end_tag():
    rest = "<article><p>x</p><p>y</p></article>"
    for start in ("<html><head><title>t</title><body>", "<html><head><title>t</title>", "<head><meta charset=u><link rel=x><body class=c>",
                  "<head><script>var a='<p>';</script><style>p{}</style>", "<head><noscript><img src=i></noscript><title>t</title><body>",
                  "<head><noscript><p>n</p><body>", "<head><template><p>n</p></template>", "<head><title>t</title></head><body>"):
        assert texts(start + rest) == ["x", "y"]
    assert texts("<head><title>t</title> \n said <b>so</b><p>x") == ["said so", "x"]
    assert texts("<head><title>t</title><br>said<p>x") == ["said", "x"]
    assert [b.path for b in B.read_blocks("<html><head><title>t</title><body><p>x")] == [("html", "body", "p")]


def test_drawings_and_formulas():
    assert texts("<article><p>a</p><svg/><p>b</p><svg viewBox=x /><p>c</p><math/><p>d</p></article>") == ["a", "b", "c", "d"]
    assert texts("<p>a</p><svg><g/><title>t</title><text>n</text><path d=x /></svg><p>b</p>") == ["a", "b"]
    assert texts("<p>let <math><mi>x</mi><mo>=</mo><mspace/><mn>1</mn></math> be</p><p>b") == ["let x=1 be", "b"]
    assert texts("<p><math><semantics><mi>x</mi><annotation encoding=tex>\\x</annotation></semantics></math>, y</p>") == ["x, y"]
    assert texts("<p><annotation>a</annotation> b</p>") == ["a b"]


def test_gradients():
    r = np.random.default_rng(1)
    model = L.Labeller(hidden=3)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    x = r.standard_normal((4, 2, B.DIM)) * 0.3
    mask = np.array([[1, 1], [1, 1], [1, 0], [1, 0]], float)
    y = (r.random((4, 2)) < 0.5).astype(float)
    _, grads = model.gradients(x, mask, y)
    for k, w in model.weights.items():
        for _ in range(3):
            at = tuple(r.integers(0, s) for s in w.shape)
            old, eps = w[at], 1e-3
            w[at] = old + eps
            up = model.gradients(x, mask, y)[0]
            w[at] = old - eps
            down = model.gradients(x, mask, y)[0]
            w[at] = old
            assert abs((up - down) / (2 * eps) - grads[k][at]) < 2e-3


def expected(html):
    """Text of the table's pages by their one design: all blocks of the article."""
    return "\n\n".join(b.text for b in B.read_blocks(html) if "article" in b.path)


@pytest.fixture(scope="module")
def model(spark):
    return L.train(L.sample(spark.read.parquet(f"{SF_MID}/pages.parquet"), "html", 100))


def test_other_designs(model):
    words = "the of and een und la con thing erst ander tion lore sit".split()
    rng = random.Random(77)
    lines = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    right = total = 0
    for _ in range(150):
        page = L._page_designs(lines, lines[:20], rng)
        got = model.label([[b for b, _ in page]])[0]
        right += sum(bool(g) == bool(y) for g, (_, y) in zip(got, page))
        total += len(page)
    assert right / total > 0.99


def test_page_with_everything(model):
    html = """<html><body><header class="site-header"><div>Site name</div></header><nav><ul><li><a href=/>Home</a></ul></nav>
    <div class="cookie-notice">We use cookies</div><main><article><h1>Title &amp; more</h1><p>First  paragraph of the text.</p>
    <div class="advert">Buy now</div><p>Second paragraph, <i>longer</i> than the first one was.</p></article>
    <section class="comments"><p>Great post, thanks a lot for writing it!</p></section></main>
    <aside class="sidebar"><p>Read also this</p></aside><form><label>Mail</label><button>Send</button></form><footer>All rights</footer></body></html>"""
    blocks = B.read_blocks(html)
    assert L.text_of(blocks, model.label([blocks])[0]) == (
        "Title & more\n\nFirst paragraph of the text.\n\nSecond paragraph, longer than the first one was.")


ART = "<h1>T of it</h1><p>Some first words.</p><p>And a longer second paragraph of words.</p><h2>Sub</h2><p>The end.</p>"
LAYOUTS = [
    "<article>{}</article>",
    "<div id='header'>x y</div><div id='content'><article>{}</article><div id='comments'><p>Nice one.</p><p>Thanks for this.</p></div></div>",
    "<main>{}</main><section class='user-comments'><article class='comment'><p>Nice one.</p></article></section>",
    "<div class='sidebar-widget'><p>Read this.</p></div><article>{}</article>",
    "<header><h2>Site</h2></header><article>{}<footer>Posted by x</footer></article>",
    "<div role='banner'>Site</div><div role='navigation'><a href=x>a</a></div><div role='main'>{}</div><div role='complementary'><p>More</p></div>",
    "<div class='top-menu'><ul><li><a>x</a></li></ul></div><div class='article-body'>{}</div><div class='promo-box'>Buy</div>",
    "<div id='cookie-banner'><p>We use them.</p></div><main><article>{}<aside class='advert'>Buy now</aside></article></main>",
    "<dialog>Sign up</dialog><article>{}<form><label>Your mail</label><input></form></article>",
    "<article>{}<div class='notice'>Take care of this.</div></article><div class='ad-slot'>Buy this thing today.</div>",
]


@pytest.mark.parametrize("layout", LAYOUTS)
def test_layouts(model, layout):
    blocks = B.read_blocks(f"<html><body>{layout.format(ART)}</body></html>")
    assert L.text_of(blocks, model.label([blocks])[0]) == "\n\n".join(
        ["T of it", "Some first words.", "And a longer second paragraph of words.", "Sub", "The end."])


def test_query(spark):
    pages = spark.read.parquet(f"{SF_MID}/pages.parquet").collect()
    got = {r["page_id"]: r for r in QUERIES["op2_html"](spark, SF_MID).collect()}
    assert len(got) == len(pages)
    assert sum(got[p["page_id"]]["text"] == expected(p["html"]) for p in pages) == len(pages)
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_edges(spark):
    rows = [(1, None, "u"), (1, None, "u"), (2, "", None), (None, "<article><p>x</article>", "u"), (3, "<p>" + "w " * 200_000, "u")]
    df = spark.createDataFrame([(i, h, u, "old") for i, h, u in rows], "page_id long, html string, url string, text string")
    out = L.extract(df).collect()
    assert len(out) == 5 and out[0].asDict().keys() == {"page_id", "html", "url", "text", "n_chars"}
    assert all(r["text"] == "" and r["n_chars"] == 0 for r in out if r["page_id"] in (1, 2))
    assert L.extract(df.limit(0)).count() == 0


def test_long_and_short_pages_agree(model):
    rng = random.Random(5)
    pages = [[b for b, _ in L._page_designs(["a b c", "d"], ["e"], rng)] for _ in range(20)] + [[]]
    together = model.label(pages)
    alone = [model.label([p])[0] for p in pages]
    assert all(np.array_equal(a, b) for a, b in zip(together, alone))


def test_training_sees_long_pages_to_their_end(monkeypatch):
    page = B.read_blocks("<article>" + "<p>text</p>" * 500 + "</article><footer>" + "<p>end</p>" * 100 + "</footer>")
    seen, padded = [], L._padded

    def spy(rows):
        seen.extend(rows[:L.BATCH // 2])
        return padded(rows)

    monkeypatch.setattr(L, "_padded", spy)
    L.train([page], steps=8)
    x = B.features(page)
    assert all(len(r) <= L.WINDOW for r in seen)
    own = slice(0, B.PATH_DIM + B.TAG_DIM + B.WORD_DIM)  # what follows also says where on the page a block stands
    assert any((r[-1] == x[-1]).all() for r in seen) and any((r[-1][own] == x[0][own]).all() for r in seen)


NEWS = """<html><body><div{0}><ul><li><a href=/a>Home</a></li><li><a href=/b>World</a></li><li><a href=/c>Sports</a></li></ul></div>
<div{1}><h1>River floods old town</h1><p>The river rose over night and flooded the old town, where many people had to leave their houses.</p>
<p>Firefighters worked until the morning, and the mayor thanked them for their help.</p>
<p>It is the third flood in ten years. The council has promised to build a higher wall.</p><p>Schools stay closed until Monday, said the mayor.</p></div>
<div{2}><h3>Most read</h3><ul><li><a href=/1>Ten ways to cook rice</a></li><li><a href=/2>Cup final moved</a></li></ul></div>
<div{3}><h3>2 responses</h3><div><b>Anna</b><p>So sad to see this again, I hope all are safe.</p></div><div><b>Tom</b><p>They promised that wall years ago!</p></div></div>
<div{4}><p>© 2024 The Daily News</p><p><a href=/p>Privacy</a></p></div></body></html>"""


@pytest.mark.parametrize("names", ["nav article sidebar comments footer", "c1 c2 c3 c4 c5", "", "top-bar page-content rail discussion bottom",
                                   "kopf artikel spalte kommentare fuss", "mw-panel mw-parser-output vector-toc talk printfooter"])
def test_names_do_not_decide(model, names):
    given = [f" class='{n}'" for n in names.split()] or [""] * 5
    blocks = B.read_blocks(NEWS.format(*given))
    got = [b.text for b, m in zip(blocks, model.label([blocks])[0]) if m]
    assert got == [b.text for b in blocks if b.path[-1] in ("h1", "p") and "promised that" not in b.text and "So sad" not in b.text][:5]


#: skeletons of pages that training does not draw, {t}: the article's text; marked ones must be kept, all other text must not
SKELETONS = [
    "<table><tr><td><a href=1>one</a><br><a href=2>two</a></td><td>{t}</td></tr></table><hr><p><a href=x>home</a> | <a href=y>mail</a></p>",
    "<div{0}><div{1}><a href=/>logo</a></div><div{2}><div{3}>{t}</div></div></div><div{4}><ul><li><a href=1>one more</a></li><li><a href=2>two more</a></li></ul></div>",
    "<div{0}><ol><li><a href=#1>part one</a></li><li><a href=#2>part two</a></li></ol></div><div{1}>{t}</div><div{2}><p>This page was last changed in May.</p><ul><li><a href=a>privacy</a></li><li><a href=b>about</a></li></ul></div>",
    "<div{0}>{t}</div><div{1}><h3>4 thoughts</h3><ol><li><div>Ann</div><p>I like it a lot.</p></li><li><div>Bob</div><p>Me too, thank you.</p></li></ol></div>",
    "<div{0}><p>We use small files to make the page work. <a href=z>more</a></p><button>ok</button></div><div{1}><div{2}>{t}</div><div{3}><a href=1>tweet</a> <a href=2>mail</a></div></div>",
    "<section{0}><h2><a href=/>The place</a></h2><p>words on things</p></section><section{1}>{t}</section><section{2}><h3>see too</h3><ul><li><a href=1>older text</a></li><li><a href=2>newer text</a></li></ul></section>",
    "<div{0}><div{1}><ul><li><a href=1>a1</a></li><li><a href=2>a2</a></li><li><a href=3>a3</a></li></ul></div>{t}</div><div{2}>© 2020 by them</div>",
]


def test_unseen_skeletons_and_names(model):
    rng = random.Random(31)
    words = "water house river stone when then there about people early never small after before they would could light night north".split()
    say = lambda n: (" ".join(rng.choice(words) for _ in range(n)) + ".").capitalize()
    right = total = 0
    for k in range(28):
        naming = k % 4
        names = ["", "", "", "", ""] if naming == 0 else [f" class='{''.join(rng.choice('qwrtzpsdfg') for _ in range(6))}'" for _ in range(5)] if naming == 1 \
            else [f" id='e{rng.randint(100, 999)}'" for _ in range(5)] if naming == 2 else [f" class='{n}'" for n in ("oben", "inhalt", "kasten", "zeug", "ende")]
        article = [f"<h1>{say(5)}</h1>", *[f"<p>{say(rng.randint(12, 40))}</p>" for _ in range(rng.randint(3, 9))]]
        html = SKELETONS[k % len(SKELETONS)].format(*names, t="".join(article))
        blocks = B.read_blocks(f"<html><body>{html}</body></html>")
        wanted = {b.text for b in B.read_blocks("".join(article))}
        got = model.label([blocks])[0]
        right += sum(bool(g) == (b.text in wanted) for b, g in zip(blocks, got))
        total += len(blocks)
    assert right / total >= 0.95, right / total


def test_made_up_designs_without_names(model):
    rng = random.Random(901)
    lines = [b.text for b in B.read_blocks(NEWS.format(*[""] * 5))] + ["a few words more", "and one that is rather longer than the others, to have some of both"]
    right = total = 0
    for _ in range(200):
        page = L._any_design(lines, lines[:4], rng)
        right += sum(bool(g) == bool(y) for g, (_, y) in zip(model.label([[b for b, _ in page]])[0], page))
        total += len(page)
    assert right / total > 0.95


@pytest.mark.parametrize("html,n", [("<div>x" * 100_000, 100_000), ("<p><button>" + "<div>x" * 30_000, 30_000), ("<div>" * 50_000 + "</b>" * 50_000 + "x", 1),
                                    ("<b>" * 30_000 + "<div>x" * 2_000, 2_000)])
def test_deep_pages_take_linear_time_and_memory(html, n):
    import time
    import tracemalloc
    start = time.perf_counter()
    tracemalloc.start()
    blocks = B.read_blocks(html)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(blocks) == n and most < 200e6
    assert time.perf_counter() - start < 20  # under 5 s on a quiet machine
