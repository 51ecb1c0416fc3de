"""Main text: exact pages, broken and hostile ones, held-out rebuilt pages, the decoding against all choices."""

import random
from itertools import product

import numpy as np
import pytest

pytest.importorskip("tallyloom.llm")
from tallyloom.llm import maintext  # noqa: E402


def prose(r, n):
    return " ".join(r.choice("the of and to river stone winter garden with from market paper light under".split()) for _ in range(n)).capitalize() + "."


def page(i, body):
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>T {i}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>{body}</body></html>'


@pytest.fixture(scope="module")
def site():
    """Pages of several shapes, each with its article's blocks."""
    r = random.Random(8)
    out = []
    for i in range(250):
        blocks = [f"Title {i} & more", *(prose(r, r.randrange(4, 60)) for _ in range(r.randrange(2, 9)))]
        inner = f"<h1>Title {i} &amp; more</h1>" + "".join(f"<p>{b[:5]}<em>{b[5:]}</em>\n</p>" if k % 3 == 0 else f"<p>{b}</p>" for k, b in enumerate(blocks[1:]))
        nav = "<nav><ul>" + "".join(f'<li><a href="/{k}">{prose(r, 1)}</a></li>' for k in range(6)) + "</ul></nav>"
        out.append((i, page(i, f'{nav}<!-- ad --><div class="ad">{prose(r, 8)}</div><article>{inner}</article><footer>&copy; {prose(r, 5)}</footer>'), "\n\n".join(blocks)))
    return out


SCHEMA = "page_id long, url string, html string, text string, n_chars string, label string, features string, x string, h string"


def table(spark, rows):
    return spark.createDataFrame([(i, f"http://e.org/{i}", h, *["x"] * 6) for i, h in rows], SCHEMA)


def test_pages(spark, site):
    odd = [(1100, None), (1101, ""), (1102, "no markup at all, only some text"), (1103, "<div>" * 3000 + "deep"), (1104, site[0][1]), (1104, site[0][1]), (None, site[1][1]), (1105, "<article><h1>A</h1>" + "<p>word word, word and more words here.</p>" * 20_000 + "</article>"), (1106, site[2][1][: site[2][1].index("</article>") - 30])]
    got = maintext.extract(table(spark, [(i, h) for i, h, _ in site] + odd))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    rows = got.collect()
    by = {}
    for x in rows:
        by.setdefault(x.page_id, []).append(x.text)
        assert x.n_chars == len(x.text)
    assert len(rows) == len(site) + len(odd) and all(by[i] == [t] for i, _, t in site)
    assert by[1100] == by[1101] == [""] and by[1104] == [site[0][2]] * 2 and by[None] == [site[1][2]]
    assert by[1105][0].count("more words here.") == 20_000
    assert site[2][2].startswith(by[1106][0][:50]) and len(by[1106][0]) > 0
    assert maintext.extract(table(spark, [])).count() == 0


def test_held_out(spark, site):
    """Pages with new words, in shapes drawn anew: with names that say what parts are, and with none."""
    trees = maintext.train(table(spark, [(i, h) for i, h, _ in site]))
    r = random.Random(77)
    for plain, least in ((False, 0.95), (True, 0.85)):
        right = wrong = missed = 0
        for i in range(150):
            inner = "".join(f"<p>{prose(r, r.randrange(5, 50))}</p>" for _ in range(r.randrange(3, 9)))
            source, gold = maintext.rebuilt(page(i, f"<article><h2>{prose(r, 4)}</h2>{inner}</article>"), 10**6 + i, plain)
            got = maintext.main_text(source, trees).split("\n\n")
            right += len(set(got) & set(gold))
            wrong += len(set(got) - set(gold))
            missed += len(set(gold) - set(got))
        assert right / (right + wrong) >= least and right / (right + missed) >= least, (plain, right, wrong, missed)
    body = f"<p>{prose(r, 40)}</p><p>{prose(r, 30)}</p><p>{prose(r, 50)}</p>"
    for junk in ('<aside class="sidebar"><p>SPAM and more SPAM here.</p></aside>', '<div class="cookie-notice">We use SPAM.</div>', '<form><label>SPAM</label><input><button>SPAM</button></form>', '<section id="comments"><h2>SPAM</h2><div class="comment"><p>I like SPAM a lot, it is good.</p></div></section>', '<header class="site-header"><a href="/">SPAM</a></header>', '<div class="advert"><p>Buy SPAM now.</p></div>', "<script>SPAM</script><style>SPAM</style><noscript>SPAM</noscript>"):
        for source in (f"{junk}<article>{body}</article>", f"<main>{body}</main>{junk}", f'<div class="post-content">{body}{junk}</div>'):
            text = maintext.main_text(page(1, source), trees)
            assert "SPAM" not in text and text == "\n\n".join(maintext.Page(body).blocks()), (junk, source[:60], text)


def test_copies_count_once(spark, site, monkeypatch):
    """A page that a third of the rows repeat is one page of the sample."""
    seen = []
    monkeypatch.setattr(maintext, "Trees", lambda model: seen.append(model.numFeatures) or "trees")
    rows = [(i, h) for i, h, _ in site[:12]]
    one = maintext.train(table(spark, rows + [(1000 + i, site[0][1]) for i in range(60)]), sample=10)
    assert one == "trees" and seen == [len(maintext.FEATURES)]
    made = []
    monkeypatch.setattr(maintext.Scratch, "save", lambda self, df, name: made.append(df.count()) or df)
    maintext.train(table(spark, rows), sample=10)
    maintext.train(table(spark, rows * 4), sample=10)
    assert made[0] == made[1] > 0


def test_examples(spark, site):
    """Pages without telling markup are learnt from given main texts."""
    blank = [(i, h.replace("article>", "div>").replace("<nav>", "<div>").replace("</nav>", "</div>").replace("footer>", "div>").replace(' class="ad"', ""), t) for i, h, t in site]
    examples = spark.createDataFrame([(h, t) for _, h, t in blank[:150]], "html string, text string")
    got = {x.page_id: x.text for x in maintext.extract(table(spark, [(i, h) for i, h, _ in blank]), examples).collect()}
    assert sum(got[i] == t for i, _, t in blank[150:]) >= 0.8 * len(blank[150:])


@pytest.mark.parametrize(("source", "blocks"), [
    ("<p>a &amp b&lt;c<br>d<p>e<script>var '</p>'</script>f<li>g<li>h", ["a & b<c d", "ef", "g", "h"]),
    ("<ul><li>a<ul><li>b</ul><li>c</ul>tail", ["a", "b", "c", "tail"]),
    ("x<![CDATA[y]]>z<?p q>w <!-- gone --> 1 < 2 <a href='>'>v</a>", ["xzw 1 < 2 v"]),
    ("<p>one<div>two</p>three</div><p>&nbsp; \t four\n five &#x41;&bogus;", ["one", "two", "three", "four five A&bogus;"]),
    ("<title>no</title><body>yes<select><option>no</select><textarea>no</textarea><!-- never ends", ["yes"]),
    ("<p class='a>b' data-x=\"</p>\">in</p><b>bold <i>both</b> rest</i>", ["in", "bold both rest"]),
    ("<p>cut off <a href='x", ["cut off"]), ("", []), ("<", ["<"]), ("</", []),
])
def test_reading(source, blocks):
    assert maintext.Page(source).blocks() == blocks


def test_decoding_is_the_best_choice():
    r = np.random.default_rng(3)
    for _ in range(60):
        source = "<div>" + "".join(r.choice(["<div>", "</div>", "<p>x"]) for _ in range(9))
        p = maintext.Page(source)
        n = len(p.tag)
        score = r.normal(size=n)
        lean = score + maintext.FOLLOW * np.where(np.array(p.parent) > 0, score[p.parent], 0.0)
        best = max(sum(s if k else -s for s, k in zip(lean[1:], keep, strict=True)) for keep in product([0, 1], repeat=n - 1) if all(not k or p.parent[i + 1] == 0 or keep[p.parent[i + 1] - 1] for i, k in enumerate(keep)))
        kept = maintext.decode(p, score)
        assert all(not kept[i] or kept[p.parent[i]] for i in range(1, n))
        assert abs(sum(s if k else -s for s, k in zip(lean[1:], kept[1:], strict=True)) - best) < 1e-9
