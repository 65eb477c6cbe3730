"""Main text: markup errors, the minimum cut against every labelling, what the cut mends, and odd tables."""

import itertools
import re

import numpy as np
import pytest

from larkspur.llm import html_text as H


def cost(side, source, sink, edges):
    return sum(sink[i] if x else source[i] for i, x in enumerate(side)) + sum(c for a, b, c in edges if side[a] != side[b])


def test_cut_is_the_least_of_all():
    rng = np.random.default_rng(4)
    for n in range(1, 11):
        for _ in range(6):
            z = rng.normal(size=n) * 2
            source, sink = np.maximum(z, 0).tolist(), np.maximum(-z, 0).tolist()
            edges = [(i, i + 1, float(rng.random() * 2)) for i in range(n - 1)] + [(int(a), int(b), float(rng.random())) for a, b in rng.integers(0, n, (n, 2)) if a != b]
            least = min(cost(s, source, sink, edges) for s in itertools.product([False, True], repeat=n))
            assert abs(cost(H.max_flow_side(n, source, sink, edges), source, sink, edges) - least) < 1e-6


def test_labels_are_a_least_cut_of_the_page():
    """label() fixes blocks whose odds outweigh their edges: the rest must still be the least of all labellings."""
    page = "<body><div><a href=x>Menu</a></div><div><p>A first sentence, long enough to be read as text by anyone.</p><p>Short</p><p>Another sentence, of some length, that ends here.</p></div><div><a href=y>More</a> <a href=z>links</a></div>"
    found = H.blocks(page)
    assert [b.text for b, keep in zip(found, H.label(found)) if keep] == ["A first sentence, long enough to be read as text by anyone.", "Short", "Another sentence, of some length, that ends here."]
    assert H.evidence(found[2], False) < 0  # its own odds are against it: the cut mends that


def test_cut_mends_errors_of_odds(spark):
    """Pages whose tags say nothing: the cut changes labels, and more of them to right ones than to wrong ones."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghij"), rng.integers(2, 9)))
    say = lambda n: " ".join(word() for _ in range(n)).capitalize()
    by_odds = by_cut = changed = 0
    for _ in range(60):
        lines = [say(int(n)) + "." * int(n > 3) for n in rng.choice([1, 2, 3, 20, 30, 40], 9)]
        page = "<body><nav>" + "".join(f"<li><a href=x>{say(2)}</a></li>" for _ in range(5)) + "</nav><article>" + "".join(f"<p>{x}</p>" for x in lines) + "</article><footer>" + say(3) + "</footer>"
        truth = H.label(H.blocks(page))
        plain = H.blocks(re.sub(r"(</?)(nav|article|footer)", r"\1div", page))
        odds, cut = [H.evidence(b, False) > 0 for b in plain], H.label(plain)
        by_odds += sum(a != b for a, b in zip(odds, truth))
        by_cut += sum(a != b for a, b in zip(cut, truth))
        changed += sum(a != b for a, b in zip(odds, cut))
    assert changed > 20 and by_cut < by_odds


def test_weights_are_learned_from_marked_pages(spark):
    marked = "<nav><a href=x>{0}</a></nav><article><p>{0} is a sentence, and it goes on for some time.</p></article>"
    pages = spark.createDataFrame([(i, marked.format(f"word{i}")) for i in range(30)] + [(99, None)], "page_id long, html string")
    weights = H.fit(pages)
    assert weights != H.UNTAUGHT and weights == H.fit(pages.orderBy("page_id")) and weights[2] < 0
    assert H.fit(pages.limit(0)) == H.UNTAUGHT == H.learn([], [])


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article><p>Before words here.</p><button>x<p>After words too.</p></article>", "Before words here. x After words too."),
        ("<article><p>Before words.</p><svg><title>t</title><svg></svg></svg><p>After.</p></article>", "Before words. After."),
        ("<article><p>One <math><mi>x</mi></math> two.</p></article><button>late</button>", "One x two."),
        ("<article><p>Seen.</p><select><option>no</select><p hidden>Said.</p></article>", "Seen. Said."),
        ("<article><p>a<script>var x = '<p>no</p>'</script>b &lt;c&#62;</p><div class='ad'>Buy, buy now, it is the best.</div></article>", "ab <c>"),
        ("<article><p>only</p></article>", "only"),
    ],
)
def test_markup(page, text):
    assert H.main_text(page) == text


def test_tables(spark):
    long = "<article>" + "<p>Some words, said again.</p>" * 20_000 + "</article>"
    pages = spark.createDataFrame([(1, "u", None, "x"), (1, None, "", "x"), (None, "u", long, "x")], "page_id long, url string, html string, text string")
    got = H.extract(pages).collect()
    assert sorted(r["n_chars"] for r in got) == [0, 0, 20_000 * 24 - 1] and H.extract(pages.limit(0)).count() == 0
    with pytest.raises(ValueError):
        H.extract(pages, keep=["page_id", "text"])
