import random
import time
from collections import Counter

import numpy as np
import pytest

from gridweave.llm import pages as module
from gridweave.llm.pages import LEAST_PAGES, LINKED, LOOSE, RUN, SURE, blocks, covered, extract_pages, frequent_runs, run_hashes, token_hashes

PAGE = (
    "<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t='</p>';</script></head><body class='sidebar-on'><header>top</header><nav><ul><li>menu"
    "</ul></nav><div class=ad>buy</div><article><h1>Head &amp; line</h1><p>One  <b>bold\n<br>two<p>three &lt;3 &#233;&nbsp;x<aside>see also</aside><form>mail</form>"
    "<div class='comments'><p>first!</div><!-- gone --><p>last</article><footer>&copy; me</footer>"
)




def marked(html):
    """Texts by markup alone."""
    rest = [b for b in blocks(html) if not b[1]]
    return "\n".join(b[0] for b in ([b for b in rest if b[2]] or rest))


def plain_texts(htmls):
    """Main texts of one host's pages, with runs counted in a dictionary of word tuples."""
    chosen = []
    for html in htmls:
        rest = [b for b in blocks(html) if not b[1]]
        chosen.append([b for b in rest if b[2]] or rest)
    words = [[w for b in page for w in b[0].split(" ")] for page in chosen]
    different = {tuple(b[0] for b in page): w for page, w in zip(chosen, words) if page}
    had = Counter(r for w in different.values() for r in {tuple(w[i : i + RUN]) for i in range(len(w) - RUN + 1)})
    total = len(different)
    out = []
    for page, w in zip(chosen, words):
        share = [0.0] * len(w)
        for i in range(len(w) - RUN + 1):
            n = had[tuple(w[i : i + RUN])]
            for k in range(i, i + RUN):
                share[k] = max(share[k], n / total if n >= LEAST_PAGES and total >= LEAST_PAGES else 0)
        at, kept = 0, []
        for text, _, inside, links in page:
            block = text.split(" ")
            part = share[at : at + len(block)]
            at += len(block)
            if inside:
                kept += [text] if min(part) < SURE else []
            elif links < LINKED and (rest := " ".join(x for x, s in zip(block, part) if s < LOOSE)):
                kept.append(rest)
        out.append("\n".join(kept))
    return out


@pytest.fixture
def main_texts(spark):
    def run(htmls, host):
        df = spark.createDataFrame([(i, f"http://{host}/{i}" if host else None, h) for i, h in enumerate(htmls)], "page_id long, url string, html string")
        return [r["text"] for r in sorted(extract_pages(df).collect(), key=lambda r: r["page_id"])]

    return run


def test_article(main_texts):
    assert main_texts([PAGE], "h") == ["Head & line\nOne bold two\nthree <3 é x\nlast"]
    assert main_texts(["", "plain  text", "<p>a<p>b", "<script>never ended", "a < b &am", "<!-- open"], "") == ["", "plain text", "a\nb", "", "a < b &am", ""]


def test_void_and_unclosed():
    assert [b[0] for b in blocks("<ul><li>a<li>b<img src='x>y'>c</ul>d<br/>e</div>f<hr>g")] == ["a", "bc", "d e", "f", "g"]
    assert [b[0] for b in blocks("<article><header><h1>T</h1>by me</header><p>x") if not b[1]] == ["T", "x"]


def test_text_that_odd_markup_must_not_take():
    assert marked("<article><p title=it's>One two</p><p>don't stop</p><p>end</p></article>") == "One two\ndon't stop\nend"
    assert marked('<main class="content has-sidebar"><p>a</p></main>') == "a"
    assert marked('<article class="post no-comments"><p class="related">a</p><h2 class="section-header">b</h2></article>') == "a\nb"
    assert marked("<article><p>a<svg><path d='x'/><text>t</text><p>b</p><p>c</p></article>") == "a\nb\nc"
    assert marked("<article><p>a <math><mi>x</mi><mo>=</mo></math> b</p></article>") == "a x= b"
    assert marked('<div class="has promo"><article>in</article></div><div class="related"><article>teaser</article></div>') == "in"
    assert marked("<a href=\"x>text <b>more") == "text more"
    assert marked("&<b>amp;</b> &lt;") == "&amp; <"
    assert marked("<!-->a<!--->b<!--c-->d") == "abd"


def test_what_is_beside_within_an_article_goes():
    assert marked("<article>x<div id=comments><article class=comment>hi</article></div><div class='share-bar'>s</div></article>") == "x"
    assert marked("<article><p>x <span hidden>no</span>y <button>b</button> z<script>s</script></p><noscript><p>n</p></noscript></article>") == "x y z"


@pytest.mark.parametrize("broken", ["<a \"", "<a b='", "<div>", "<b>", "<!--", "<script>", "<", "&", "<svg>", "<p><div><b><hr>", "<li><span>"])
def test_long_pages_of_broken_tags_take_linear_time(broken):
    took = []
    for size in (100_000, 400_000):
        began = time.process_time()
        blocks(broken * (size // len(broken)))
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 0.2


def test_deep_lines_take_linear_time():
    began = time.process_time()
    blocks("<b>" * 30_000 + "x<hr>" * 30_000)
    assert time.process_time() - began < 5


def test_repeats_without_an_article(main_texts):
    head, foot = "home news about contact search the site now", "all rights reserved by the owner of this site"
    pages = [f"<div>{head}</div><div>{i}th story " + " ".join(f"w{i}x{j}" for j in range(30)) + f"</div><div>{foot}</div>" for i in range(6)]
    texts = main_texts(pages, "host")
    assert all(head not in t and foot not in t and f"{i}th story w{i}x0" in t for i, t in enumerate(texts))
    assert all(head in t for t in main_texts(pages, ""))


def test_shared_passages_stay_in_articles(main_texts):
    passage = " ".join(f"p{i}" for i in range(60))
    pages = [f"<article><p>{passage}</p><p>" + " ".join(f"w{i}x{j}" for j in range(30)) + "</p></article>" for i in range(4)]
    pages += ["<article><p>" + " ".join(f"v{i}x{j}" for j in range(30)) + "</p></article>" for i in range(6)] + [pages[0]] * 5
    assert all(passage in t for t in main_texts(pages, "host")[:4])


def test_repeated_runs_by_brute_force():
    pages = [("a b c d e f g h i j " * 2).split()[i : i + 14] for i in (0, 1, 3, 5)] + [[], ["x"], "a b c d e f g h".split()]
    streams = [token_hashes(p) for p in pages]
    had = Counter(r for p in pages for r in {tuple(p[i : i + 4]) for i in range(len(p) - 3)})
    for share in (0.2, 0.4, 0.6):
        runs, n = frequent_runs(streams, share, 4)
        want = {run_hashes(token_hashes(list(r)), 4)[0]: c for r, c in had.items() if c >= share * len(pages)}
        assert dict(zip(runs.tolist(), n.tolist())) == {int(k): c for k, c in want.items()}
        order = np.argsort(runs)
        for p, s in zip(pages, streams):
            cover = [0.0] * len(p)
            for i in range(len(p) - 3):
                c = had[tuple(p[i : i + 4])]
                for k in range(i, i + 4):
                    cover[k] = max(cover[k], c if c >= share * len(pages) else 0)
            assert covered(s, runs[order], n[order].astype(float), 4).tolist() == cover


@pytest.mark.parametrize("group", [256, 5])
def test_whole_extraction_by_brute_force(main_texts, monkeypatch, group):
    """Shares are of all pages of a host, however many groups its suffix arrays take."""
    monkeypatch.setattr(module, "GROUP", group)
    rng = random.Random(7)
    common = [" ".join(f"s{i}t{j}" for j in range(rng.randint(3, 14))) for i in range(6)]
    htmls = []
    for i in range(40):
        body = "".join(f"<p>{' '.join(rng.choice('abcdefgh') + str(rng.randint(0, 9)) for _ in range(12))}</p>" for _ in range(2))
        shown = "".join(f"<div>{c}</div>" for k, c in enumerate(common) if rng.random() < 0.15 * (k + 1))
        htmls.append(rng.choice([f"{shown}<article>{body}{shown}</article>", shown + body, body + shown + "<a>link</a>"]))
    htmls += htmls[:1] * 30 + ["", "<p>x"]
    want = plain_texts(htmls)
    assert main_texts(htmls, "host") == want
    assert want != [marked(h) for h in htmls]


def test_tables(spark):
    schema = "page_id long, url string, html string, id string, host string, part string, text string"
    rows = [(1, "http://A.example/x", PAGE), (1, "http://a.example/x", PAGE), (2, None, PAGE), (3, "no url", None), (None, "http://a.example", "<p>x")]
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], schema)
    got = extract_pages(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = sorted((tuple(r) for r in got.collect()), key=repr)
    text = "Head & line\nOne bold two\nthree <3 é x\nlast"
    want = [(1, rows[0][1], text, len(text)), (1, rows[1][1], text, len(text)), (2, None, text, len(text)), (3, "no url", "", 0), (None, "http://a.example", "x", 1)]
    assert found == sorted(want, key=repr)
    assert extract_pages(df.limit(0)).count() == 0
