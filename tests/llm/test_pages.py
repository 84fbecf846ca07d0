import time
import tracemalloc

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from weblake.llm import pages
from weblake.llm.pages import MARKED, PLAIN, TEXT, common_lines, extract_pages, page_lines

SCHEMA = "page_id bigint, url string, html string, text string, row string"


def extracted(spark, rows):
    frame = spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], SCHEMA)
    return {r["page_id"]: (r["text"], r["n_chars"]) for r in extract_pages(frame).collect()}


def page(article, extra=""):
    return (
        '<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head><body>'
        f'<nav><ul><li><a href="/a">A</a></li></ul></nav><!-- ad --><div class="ad">Buy</div><article>{article}</article>'
        f"{extra}<footer>&copy; x</footer></body></html>"
    )


def test_article_without_its_surroundings(spark):
    rows = [
        (0, "http://a.example/x/1", page("<h1>One  &amp;\n two</h1><p><b>Bold<br>line<p>Next&nbsp;<i>i</i>talic &lt;b&gt;</p>")),
        (1, "http://a.example/x/2", page("<p>Same</p><aside>side</aside><form><p>f</p></form>", '<div id="comments"><p>c</p></div>')),
        (2, "http://a.example/x/3", page("<p>Same</p>")),
        (3, None, None),
        (4, "http://a.example/x/4", ""),
        (5, "nonsense", page("<p>" + "long " * 100_000 + "</p>")),
        (6, "http://a.example/x/1", page("")),
    ]
    got = extracted(spark, rows)
    assert got[0] == ("One & two\nBold line\nNext italic <b>", 35)
    assert got[1][0] == got[2][0] == "Same"
    assert got[3] == got[4] == got[6] == ("", 0)
    assert got[5][0] == ("long " * 100_000).strip()


def bare(lines):
    return "<html><body>" + "".join(f"<div>{x}</div>" for x in lines) + "</body></html>"


@pytest.mark.parametrize("group", [64, 2])
def test_differencing_deletes_what_the_nearest_page_shares(spark, monkeypatch, group):
    monkeypatch.setattr(pages, "GROUP_PAGES", group)
    site = [(i, f"http://h.example/news/{i:03d}", bare(["Home", "About", f"Story {i}", f"More of {i}", f"End of {i}", "Imprint"])) for i in range(9)]
    other = [(20, "http://lonely.example/", bare(["Home", "Own"])), (21, "http://copy.example/a", bare(["Twin"])), (22, "http://copy.example/b", bare(["Twin"]))]
    got = extracted(spark, site + other)
    for i in range(9):
        assert got[i][0] == f"Story {i}\nMore of {i}\nEnd of {i}"
    assert got[20][0] == "Home\nOwn"
    assert got[21][0] == got[22][0] == "Twin"  # copies, not a template


@pytest.mark.parametrize("group", [64, 2])
def test_short_texts_in_long_templates_and_copies(spark, monkeypatch, group):
    monkeypatch.setattr(pages, "GROUP_PAGES", group)

    def site(host, n, own):
        return [(f"http://{host}/p/{i:03d}", bare([*(f"Menu {k}" for k in range(10)), *own(i), *(f"Foot {k}" for k in range(10))])) for i in range(n)]

    long = site("long.example", 7, lambda i: [f"Own {i} {k}" for k in range(5)])
    two = site("two.example", 2, lambda i: [f"Own {i}"])
    # The same URL again, and a group of copies that sorts together.
    same = site("copied.example", 3, lambda i: [f"Story {i}"])
    copied = [*same, same[1], *[(f"http://copied.example/p/001-{i:03d}", same[1][1]) for i in range(150)]]
    # Two near copies with a passage of their own on a host with other pages.
    near = site("near.example", 4, lambda i: [*(f"Passage {k}" for k in range(30)), f"Version {i}"] if i in (1, 2) else [f"Other {i}"])
    got = extracted(spark, [(i, u, h) for i, (u, h) in enumerate([*long, *two, *copied, *near])])
    texts = [got[i][0] for i in range(len(got))]
    assert texts[:7] == ["\n".join(f"Own {i} {k}" for k in range(5)) for i in range(7)]
    assert texts[7:9] == ["Own 0", "Own 1"]
    assert texts[9:-4] == ["Story 0", "Story 1", "Story 2", *["Story 1"] * 151]
    passage = "\n".join(f"Passage {k}" for k in range(30))
    assert texts[-4:] == ["Other 0", f"{passage}\nVersion 1", f"{passage}\nVersion 2", "Other 3"]


def test_a_body_beside_an_article_is_kept(spark):
    def teased(i):
        return f"<div>Home</div><article>Teaser {i}</article><div>Story {i}</div><div>End of {i}</div><div>Imprint</div>"

    # The last page is all article, and another page of its host has its text as plain lines.
    rows = [*[(i, f"http://h.example/{i}", teased(i)) for i in range(5)], (5, "http://h.example/5", "<article><p>Home<p>Own</article>")]
    got = extracted(spark, rows)
    assert [got[i][0] for i in range(6)] == [*[f"Teaser {i}\nStory {i}\nEnd of {i}" for i in range(5)], "Home\nOwn"]


def test_kinds_of_lines():
    html = '<div class="top-menu">M</div>loose<div class="additional">kept</div><main><header><h1>H</h1></header>t</main><p class="share">S</p>'
    assert page_lines(html) == [(MARKED, "M"), (PLAIN, "loose"), (PLAIN, "kept"), (TEXT, "H"), (TEXT, "t"), (MARKED, "S")]
    assert page_lines("a < b & c <unclosed") == [(PLAIN, "a < b & c <unclosed")]
    assert page_lines("<nav>never closed<p>x") == [(MARKED, "never closed"), (MARKED, "x")]


def test_frames_and_comments_that_are_articles():
    html = (
        '<div class="page with-sidebar"><div class="left menu">M</div><main class="has-sidebar"><header class="entry-header"><h1>H</h1></header>'
        '<article class="post"><p>t</p><div class="post-footer">f</div></article>'
        '<div id="comments"><article class="comment-body">c</article></div><article class="comment">d</article></main></div>'
    )
    assert [text for kind, text in page_lines(html) if kind == TEXT] == ["H", "t"]
    assert {text for kind, text in page_lines(html) if kind == MARKED} == {"M", "f", "c", "d"}


@pytest.mark.parametrize(
    "html, text",
    [
        ("<p class='share'>x<p>real one<p>real two", ["real one", "real two"]),
        ("<ul><li class=social>s<li>kept</ul><p>body text", ["kept", "body text"]),
        ("<dl><dt>a<dd class=ad>b<dt>c<dd>d</dl>", ["a", "c", "d"]),
        ("<table><tr><td class=ad>x<td>y<tr><th>z</table>", ["y", "z"]),
        ("<head><title>t</title><p>no end of head", ["no end of head"]),
        ("<article class='post related-posts-enabled'><p>x</article>", ["x"]),
        ("<main><section id='comments-policy'>policy</section><p>y</main>", ["policy", "y"]),
        ("<main><div class='related-reading'><a href=x>linked</a></div><p>y</main>", ["y"]),
        ("<main><div class='post social'>own</div><div class='social-links'>s</div></main>", ["own"]),
        ("<article><p>The <span class='alert'>big</span> one</p><p><span class=ad>Buy</span></p></article>", ["The big one"]),
        ("<article>a <button>b</button>c <svg><title>i</title><path/></svg>d</article>", ["a c d"]),
        ("<form><nav>n</nav><article>t</article><p>field</form>", ["t"]),
        ("<article><div class=ad>never closed<p>x</article><p>y", ["y"]),
        ("<p>one</div></b><p>two</i> and</p></p>", ["one", "two and"]),
        ('<p a="x>y">z<p b="open>w', ["z", "w"]),
        ("<p a='>'>z<p b='>", ["z"]),
    ],
)
def test_ends_left_out_and_names_that_say_little(html, text):
    assert [line for kind, line in page_lines(html) if kind != MARKED] == text


@pytest.mark.parametrize(
    "html",
    [
        '<a title="x ' * 8_000,
        "<a x='>'" * 12_000,
        "<title>" * 14_000,
        "</script" * 12_000,
        '<div class="x-ad">' * 5_000 + "t</div>" * 5_000,
        "<ul><li><ul>" + "<div>" * 9_000 + "<li></li>" * 5_000,
        "<b>" * 30_000 + "</i></p>" * 1_000,
        "<p " + ' class="' * 12_000 + ">",
    ],
    ids=range(8),
)
def test_hostile_pages_take_linear_time(html):
    def seconds(text):
        start = time.perf_counter()
        page_lines(text)
        return time.perf_counter() - start

    # A tenth of a second a 100 kB is usual; quadratic ones took 17.
    assert min(seconds(html), seconds(html)) < 4


def test_long_pages_are_aligned_in_linear_space():
    draw = np.random.default_rng(5)
    same = draw.permutation(12_000)
    one, two = np.insert(same, 0, -1), np.insert(same[draw.random(len(same)) < 0.5], 0, -2)
    one, two = np.append(one, -3), np.append(two, -4)
    tracemalloc.start()
    found = common_lines(one, two)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == len(two) - 2 and (one[found] == two[1:-1]).all()
    assert peak < 50 << 20  # one table would take 144 MB


@pytest.mark.parametrize("cells", [1 << 22, 4])
@settings(max_examples=200, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(one=st.lists(st.integers(0, 4), max_size=9), two=st.lists(st.integers(0, 4), max_size=9))
def test_longest_common_subsequence(monkeypatch, cells, one, two):
    monkeypatch.setattr(pages, "LCS_CELLS", cells)
    length = np.zeros((len(one) + 1, len(two) + 1), dtype=int)
    for i in range(len(one)):
        for j in range(len(two)):
            length[i + 1, j + 1] = length[i, j] + 1 if one[i] == two[j] else max(length[i, j + 1], length[i + 1, j])
    found = common_lines(np.array(one, dtype=np.uint64), np.array(two, dtype=np.uint64))
    assert len(found) == length[-1, -1] and found == sorted(found)
    rest = iter(two)
    assert all(one[i] in rest for i in found)


def test_empty_table(spark):
    assert extracted(spark, []) == {}
