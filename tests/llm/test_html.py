import numpy as np
import pytest

from caselens.llm import block_labeller as labeller
from caselens.llm.block_templates import Templates
from caselens.llm.html_leaves import leaves

PAGES = "/root/testdata/sf0.001/pages.parquet"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet(PAGES)


@pytest.fixture(scope="module")
def fitted(pages):
    return labeller.trained(pages)


def texts(page):
    return [leaf.text for leaf in leaves(page)]


def test_leaves_are_visible_blocks():
    assert texts("<p>a&nbsp;b<br>c <b>d</b>e<p>f<script>x</script>g<table><tr><td>1<td>2</table>") == ["a b c de", "fg", "1", "2"]
    assert texts("<head><title>t</title><style>p{}</style></head><div> \n x\t y </div><!-- no -->z &lt;q&gt; &amp &am") == ["x y", "z <q> & &am"]
    assert texts('<div class="a>b" id=\'c\'>t</div> 1 < 2 <textarea>q</p></textarea><li>u<li>v') == ["t", "1 < 2", "u", "v"]
    assert texts('<script>var t="</p>";</script>k<div class="unclosed>w') == ["k", "w"]
    assert texts("<SCRİPT>m</SCRİPT><script>İİ</SCRIPT>n") == ["m", "n"] and texts("o<svg><text>no</text></svg>") == ["o"]
    assert texts(None) == texts("") == texts("<p> </p><script>never ends") == [] and texts("plain") == ["plain"]
    path = lambda page: set(leaves(page)[0].path)
    assert path('<div class="Ad-Slot">x</div>') == path("<div id=adSlot>x</div>") != path("<div>x</div>")
    assert leaves('<p>ab <a href="q">cd</a>')[0].linked == 0.5


def test_hostile_pages_take_linear_time():
    deep = texts("<div>" * 30000 + "x" + "<p>y" * 30000)
    assert deep == ["x"] + ["y"] * 30000
    for page in ('<a "' * 50000, "<a '\"b" * 50000, "</p>" * 100000, "<script>" * 100000, "<!--" * 100000, "<" * 100000, "<li>" * 50000):
        assert len(texts(page)) <= 1


def plain_chances(model, blocks):
    """Block by block, direction by direction."""
    w, k, out = model.w, labeller._HIDDEN, []
    x = [np.concatenate([
        sum(w["path"][i] for i in blocks.path[blocks.path_at[n] : blocks.path_at[n + 1]]) / np.sqrt(blocks.path_at[n + 1] - blocks.path_at[n]),
        np.mean([w["word"][i] for i in blocks.word[blocks.word_at[n] : blocks.word_at[n + 1]]], 0), blocks.measures[n],
    ]) for n in range(len(blocks.measures))]
    s = lambda v: 1 / (1 + np.exp(-v))
    for a, b in zip(blocks.pages[:-1], blocks.pages[1:], strict=True):
        states = {}
        for way, order in (("l", range(a, b)), ("r", range(b - 1, a - 1, -1))):
            h = c = np.zeros(k)
            for n in order:
                g = x[n] @ w[f"in_{way}"] + w[f"bias_{way}"] + h @ w[f"back_{way}"]
                c = s(g[k : 2 * k]) * c + s(g[:k]) * np.tanh(g[3 * k :])
                h = s(g[2 * k : 3 * k]) * np.tanh(c)
                states[way, n] = h
        out += [float(s(np.concatenate([states["l", n], states["r", n]]) @ w["out"] + w["out0"])[0]) for n in range(a, b)]
    return out


def test_network_equals_plain_steps_and_its_gradient_differences():
    rng = np.random.default_rng(3)
    made = [labeller.marked(Templates(rng, ["alpha", "beta.", "&amp;"]).page()) for _ in range(4)]
    blocks, labels = labeller.inputs([*(p for p, _ in made), []]), np.concatenate([y for _, y in made])
    model = labeller.Labeller()
    assert np.allclose(model.chances(blocks), plain_chances(model, blocks), atol=1e-5)
    model.w = {n: v.astype(np.float64) for n, v in model.w.items()}
    _, grad = model.gradients(blocks, labels)
    for name in model.w:
        at = tuple(a[0] for a in np.nonzero(np.abs(grad[name]) == np.abs(grad[name]).max()))
        step, losses = 1e-2, []
        for way in (1, -1):
            model.w[name][at] += way * step
            losses.append(model.gradients(blocks, labels)[0])
            model.w[name][at] -= way * step
        assert (losses[0] - losses[1]) / (2 * step) == pytest.approx(grad[name][at], rel=0.03, abs=2e-5), name


def test_layouts_not_trained_on(fitted):
    templates = Templates(np.random.default_rng(77), ["lorem", "ipsum", "dolor.", "sit,", "Amet"])
    made = [labeller.marked(templates.page()) for _ in range(300)]
    labels = np.concatenate([y for _, y in made]) > 0
    found = fitted.chances(labeller.inputs([p for p, _ in made])) >= 0.5
    assert (found == labels).mean() > 0.985 and 0.2 < labels.mean() < 0.5


PROSE = "The harbour was quiet that morning, and only a few boats had left before the fog came in from the sea."
LAYOUTS = [
    '<body><header><h1>Daily News</h1><nav><a href=1>Home</a> <a href=2>World</a></nav></header><main><article><h1>Fog at sea</h1><p>{0}</p><div class="advert">Buy now!</div><p>{0}</p></article></main><aside><h3>Most read</h3><ul><li><a href=3>One</a></li></ul></aside><footer>© 2024</footer></body>',
    '<body><div id="cookie-notice">We use cookies. <button>Accept</button></div><div class="menu"><ul><li><a href=1>Home</a><li><a href=2>About</a></ul></div><div class="content"><h1>Fog at sea</h1><p>{0}</p><p>{0}</p></div><div class="comments"><h3>Comments</h3><p>{0}</p><p>I was there too, it was very cold.</p></div><div class="footer">Imprint</div></body>',
    '<body><ul class="nav"><li><a href=1>Home</a></li><li><a href=2>More</a></li></ul><div class="post"><h2>Fog at sea</h2><p>{0}<p>{0}</div><form action=x><label>Your email</label><input><button>Send</button></form><div class="sidebar"><p>Related articles</p><a href=3>Old boats</a></div></body>',
]


@pytest.mark.parametrize("layout", LAYOUTS)
def test_real_layouts(fitted, layout):
    assert labeller.main_texts(fitted, [layout.format(PROSE)]) == [f"Fog at sea\n{PROSE}\n{PROSE}"]


def test_pages_with_their_article_marked(spark, pages):
    got = {r.page_id: r for r in labeller.extract(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows) == 50
    for r in rows:
        found = leaves(r.html)
        want = "\n".join(leaf.text for leaf, y in zip(found, labeller.self_labelled(found), strict=True) if y)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)


def test_odd_rows(spark):
    long = f"<article>{'<p>' + PROSE + '</p>'}" * 1 + f"<p>{PROSE}</p>" * 20000 + "</article><footer>end</footer>"
    rows = [(1, "u", None, 1, "x"), (None, None, "", 2, "x"), (3, "u", "<nav><a href=1>Home</a></nav>", 3, "x"), (4, "w", long, 4, "x"), (4, "w", long, 4, "x"), (5, "w", "퟿<p", 4, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int, text string").repartition(3)
    got = sorted((tuple(r) for r in labeller.extract(df).collect()), key=str)
    assert len(got) == 6 and [g[3] for g in got if g[0] == 4] == [20001 * (len(PROSE) + 1) - 1] * 2
    assert (1, "u", "", 0) in got and (None, None, "", 0) in got and (3, "u", "", 0) in got
    assert labeller.extract(df.where("page_id > 9"), layouts=20, rounds=2).count() == 0
