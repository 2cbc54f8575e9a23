"""Main text of pages: written-out cases, repeats of a host, the given pages by their known template."""

import html
import re

import numpy as np
import pytest

from deltatree.llm import pages as P
from deltatree.llm.queries import op7_html_extraction

CASES = [
    (None, ""), ("", ""), ("   ", ""), ("plain &amp; text", "plain & text"),
    ("<html><head><title>t</title></head><body><nav><p>menu</p></nav><article><h1>A &lt;b&gt;</h1><p>one\n  two<br>three</p><p></p><p>four <b>f</b>ive</p></article><footer>f</footer>",
     "A <b>\none two three\nfour five"),
    ("<article><p>unclosed <i>tags<p>next</article><div>side</div>", "unclosed tags\nnext"),
    ("<div class='ad'>buy<article><p>kept</p></article></div>", "kept"),
    ("<article><p>a</p><div class=\"comments\"><article><p>reader</p></article></div><aside>x</aside><p>b</p></article>", "a\nb"),
    ("<main><header><h1>T</h1></header><form>f</form><p>x</p><script>var a='</p>';</script><style>p{}</style><p>y &#233;&nbsp;&copy z</p></main>", "T\nx\ny é © z"),
    ("<body><div class='cookie-notice'>c</div><div id=content><p>in</p><div>deep</div></div><div>out</div></body>", "in\ndeep"),
    ("<article><ul><li>a</li><li>b</li></ul><table><tr><td>c</td><td>d</td></tr></table></article>", "a\nb\nc\nd"),
    ("<article><p>1 < 2 and 3 > 2</p><!-- <p>no</p> --><p title='a>b'>x</p></article><p", "1 < 2 and 3 > 2\nx"),
    ("<article><p>cut off here &am", "cut off here &am"), ("<article><p>text</p><!-- never closed <p>x</p>", "text"),
    ("<p hidden>h</p><p style='display:none'>n</p><p>seen</p>", "seen"), ("<p>" + "w " * 30000 + "</p>", ("w " * 30000).strip()),
]


@pytest.mark.parametrize("page, want", CASES[1:])
def test_read_page(page, want):
    assert "\n".join(P.read_page(page)[0]) == want


def test_rows(spark):
    rows = [(i, None if i % 2 else f"http://h{i}.x/", p) for i, (p, _) in enumerate(CASES)]
    rows += [(None, "u", CASES[4][0]), (3, "http://h3.x/", CASES[4][0])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'t' as text", "1 as row", "'b' as blocks", "2 as host")
    got = P.main_text(pages).collect()
    assert sorted(((r.page_id, r.url, r.text) for r in got), key=str) == sorted(((i, u, dict(enumerate(t for _, t in CASES)).get(i) if h != CASES[4][0] else CASES[4][1]) for i, u, h in rows), key=str)
    assert all(r.n_chars == len(r.text) for r in got)
    assert P.main_text(pages.where("false")).collect() == []


def test_repeats_of_a_host(spark):
    top, legal = "Home News Sports Weather Contact", "All rights reserved by the owner of this site and its many partners"
    rows = [(i, f"http://a.x/{i}", f"<div>{top}</div><div>story number {i} has words of its own like w{i} and v{i}</div><div>{legal}</div>") for i in range(20)]
    rows += [(100, "http://b.x/", f"<div>{top}</div><div>{legal}</div>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r.text for r in P.main_text(pages, most=40).collect()}
    assert all(got[i] == f"story number {i} has words of its own like w{i} and v{i}" for i in range(20))
    assert got[100] == f"{top}\n{legal}"


def test_given_pages(spark, sf_dir, given):
    want = {}
    for r in given("pages").collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|li)>", body)]
        want[r.page_id] = "\n".join(b for b in blocks if b)
    got = op7_html_extraction(spark, sf_dir).collect()
    assert {r.page_id: r.text for r in got} == want


BODY = "the body of this page has words enough to be what the page is about"


@pytest.mark.parametrize("page, want", [
    (f"<div class='post-meta'>By X</div><p>{BODY}</p>", f"By X\n{BODY}"), (f"<div class='story-card'>teaser</div><p>{BODY}</p>", f"teaser\n{BODY}"),
    (f"<article><p>teaser</p></article><p>{BODY}</p>", f"teaser\n{BODY}"), (f"<div class='a post'>{BODY}</div><p>aside</p>", BODY),
    ("<article><h2 id='related-work'>a</h2><section id='search-algorithms'>b</section><div class='share-price'>c</div><section id='search'>d</section></article>", "a\nb\nc\nd"),
    ("<h2 id='comments'>a</h2><div class='x share'>b</div><div class='share-buttons'>c</div><div class='nav_menu'>d</div>", "a\nc"),
])
def test_names_are_whole(page, want):
    assert "\n".join(P.read_page(page)[0]) == want


@pytest.mark.parametrize("part, want", [
    ("<p title=\"a hidden gem\">x</p>", "x"), ("<div data-role=\"comment\">x</div>", "x"), ("<h2 class=\"share price\">x</h2>", "x"), ("<p>a <math><mi>x</mi></math> b</p>", "a x b"),
    ("<p alt='display:none'>x</p>", "x"), ("<p data-hidden=1>x</p>", "x"), ("<p title='class=ad'>x</p>", "x"), ("<p style='color:red;display: none'>x</p>", ""), ("<p HIDDEN>x</p>", ""),
    ("<div aria-hidden=\"true\">x</div>", ""), ("<div aria-hidden=\"false\">x</div>", "x"), ("<div class='ad'>x</div>", ""), ("<div class=one class=ad>x</div>", "x"),
])
def test_attributes_are_read_one_by_one(part, want):
    page = f"<article><p>{BODY}</p>{part}</article>"
    assert "\n".join(P.read_page(page)[0]) == "\n".join(x for x in (BODY, want) if x)


def test_copies_keep_their_text(spark):
    def words(n, i):
        return " ".join(f"w{i}x{k * k % 97}" for k in range(n))
    legal = "All rights reserved by the owner of this site and its many partners"
    html = {0: [words(60, 0), legal], 1: [words(60, 0), legal], 2: [words(60, 0) + " more", legal],  # a copy and a near-copy
            3: ["Summary", words(30, 3), legal], 4: ["Summary", words(30, 4), legal]}
    rows = [(i, f"http://a.x/{i}", "".join(f"<div>{b}</div>" for b in bs)) for i, bs in html.items()]
    pages = spark.createDataFrame(rows + rows[:1] + rows[3:4], "page_id long, url string, html string").repartition(3)
    got = sorted((r.page_id, r.text) for r in P.main_text(pages).collect())
    assert got == sorted((i, "\n".join(html[i][:-1])) for i in [*html, 0, 3])
    alone = P.main_text(pages.where("page_id < 3")).collect()
    assert sorted((r.page_id, r.text) for r in alone) == sorted((i, "\n".join(html[i])) for i in (0, 0, 1, 2))


def test_suffix_array_is_that_of_a_plain_sort():
    rng = np.random.default_rng(7)
    for depth in (1, 2, 3, 7, 8, 12):
        blocks = [list(rng.integers(0, 3, n)) for n in rng.integers(1, 30, 25)]
        host = np.sort(rng.integers(0, 3, len(blocks)))
        hashes, offsets = np.concatenate(blocks).astype(np.uint64), np.concatenate([[0], np.cumsum([len(b) for b in blocks])])
        suffixes = [(h, tuple(b[i:i + depth])) for h, b in zip(host, blocks) for i in range(len(b))]
        array, common = P.suffix_array(hashes, offsets, host, depth)
        assert sorted(array) == list(range(len(suffixes))) and [suffixes[i] for i in array] == sorted(suffixes)

        def shared(a, b):
            return -1 if a[0] != b[0] else next((i for i, (x, y) in enumerate(zip(a[1], b[1])) if x != y), min(len(a[1]), len(b[1])))
        assert list(common) == [-1] + [shared(suffixes[i], suffixes[j]) for i, j in zip(array, array[1:])]


def plain_texts(pages, match=8, covered=0.8, least=3, template=10):
    """Texts of pages ``(host, blocks, marked)`` by counting windows in a dictionary; without copies."""
    def windows(words):
        return [tuple(words[i:i + match]) for i in range(max(1, len(words) - match + 1))]
    seen, size = {}, {}
    for p, (host, blocks, _) in enumerate(pages):
        size[host] = size.get(host, 0) + 1
        for b in blocks:
            for w in windows(b.split()):
                seen.setdefault((host, w), set()).add(p)
    texts = []
    for host, blocks, marked in pages:
        out = []
        for b in blocks:
            words, gone = b.split(), set()
            for i, w in enumerate(windows(words)):
                n = len(seen[host, w])
                if n >= template and 2 * n >= size[host] if marked else n >= least:
                    gone |= set(range(i, min(len(words), i + match)))
            if len(gone) < covered * len(words):
                out.append(" ".join(w for i, w in enumerate(words) if i not in gone))
        texts.append("\n".join(out))
    return texts


def test_repeats_are_those_of_a_plain_finder(spark):
    rng = np.random.default_rng(3)
    quotes = [" ".join(f"q{k}x{j}" for j in range(n)) for k, n in enumerate((3, 8, 9, 14, 30, 7))]
    pages = []
    for i in range(60):
        host, marked, blocks = f"h{i % 3}.x", i % 3 != 1 and i % 2 == 0, []
        for b in range(4):
            own = [f"w{i}b{b}t{k}" for k in range(int(rng.integers(10, 30)))]
            at = int(rng.integers(0, len(own)))
            often = f"come to our shop today and see what is new {'for you' if b else ''}".strip()
            some = quotes[int(rng.integers(0, len(quotes)))] if rng.random() < 0.5 else ""
            blocks.append(" ".join([*own[:at], *some.split(), *own[at:], *(often.split() if b < 2 else ())]))
            if some and rng.random() < 0.3:
                blocks.append(some)
        pages.append((host, blocks, marked))
    rows = [(i, f"http://{h}/{i}", f"<{'article' if m else 'div'}>{''.join(f'<p>{b}</p>' for b in bs)}</{'article' if m else 'div'}>") for i, (h, bs, m) in enumerate(pages)]
    want = plain_texts(pages)
    whole = ["\n".join(bs) for _, bs, _ in pages]
    assert sum(m and w != t for (_, _, m), w, t in zip(pages, want, whole)) > 9 and sum("shop" in w for w in want) == 0
    assert any("q4x3" in w for (_, _, m), w in zip(pages, want) if m) and not any("q4x3" in w for (h, _, m), w in zip(pages, want) if h == "h1.x")
    frame = spark.createDataFrame(rows + rows[:7], "page_id long, url string, html string").repartition(4)
    for most in (150, 500_000):
        got = sorted((r.page_id, r.text) for r in P.main_text(frame, most=most).collect())
        assert got == sorted([(i, want[i]) for i in [*range(60), *range(7)]])
