import html
import random
import re

from tests.compare import SMALL
from tests.llm.hand_pages import NOISE, PAGES
from tests.llm.helpers import empty
from tidewell.llm import main_text

SCHEMA = "page_id long, url string, html string, text string, n int"


def truth(page):
    dom = main_text._Labelled(page)
    return main_text.joined_text(dom, dom.labels)


def bag_f1(a, b):
    from collections import Counter

    x, y = Counter(a.split()), Counter(b.split())
    same = sum((x & y).values())
    return 1.0 if not x and not y else 2 * same / max(1, sum(x.values()) + sum(y.values()))


def test_held_out_pages(spark):
    rng = random.Random(99)
    pages = [main_text.generated_page(rng) for _ in range(150)]
    wanted = [truth(p) for p in pages]
    found = main_text.extract([p.replace(" data-main", "").replace(" data-not", "") for p in pages], main_text.train())
    scores = [bag_f1(a, b) for a, b in zip(wanted, found, strict=True)]
    assert sum(scores) / len(scores) > 0.95
    assert sum(a == b for a, b in zip(wanted, found, strict=True)) > 0.75 * len(pages)


def test_labels_never_rise_along_a_path():
    rng = random.Random(3)
    model = main_text.train()
    for _ in range(30):
        dom = main_text.Dom(main_text.generated_page(rng))
        states = main_text.decode_states(dom, model.trees.margin(main_text.node_features(dom, model.odds)))
        assert all(states[x.parent] <= s or states[x.parent] == 0 for x, s in zip(dom.nodes[1:], states[1:], strict=True))


def test_decoding_is_the_best_labelling():
    import itertools

    import numpy as np

    page = "<div><p>a</p><div><b>c</b><p>d</p></div></div>"
    dom = main_text.Dom(page)
    n = len(dom.nodes)
    rng = np.random.default_rng(1)
    for _ in range(60):
        margin = rng.normal(0, 3, n)
        main, other = -np.logaddexp(0, -margin), -np.logaddexp(0, margin)

        def value(states):
            total = 0.0
            for k in range(1, n):
                s, p = states[k], states[dom.nodes[k].parent]
                if s < p:
                    return -np.inf
                total += main[k] if s == 1 else other[k]
                total -= main_text.TURN_COST * ((p == 0 and s == 1) + (p == 1 and s == 2))
            return total

        best = max(value((0, *rest)) for rest in itertools.product(range(3), repeat=n - 1))
        assert abs(value(tuple(main_text.decode_states(dom, margin))) - best) < 1e-9


def test_blocks_references_and_white_space():
    page = "<html><body><nav><a href=x>Menu</a></nav><article><h1>A &amp;  B</h1><p>one\n two&nbsp;&eacute; <b>three</b>four<br>five</p><script>no()</script><ul><li>x<li>y</ul></article><footer>&copy; all</footer></body></html>"
    assert main_text.extract([page], main_text.train()) == ["A & B\none two é threefour five\nx\ny"]


def test_pages_of_the_table(spark):
    rows = main_text.op8_html(spark, SMALL).collect()
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        assert r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]
        assert "track(" not in r["text"]
        article = re.search(r"<article[^>]*>(.*?)</article>", pages[r["page_id"]]["html"] or "", re.S)
        if article:  # its words, by a plain rule: without scripts, tags and what is nested as an aside
            words = html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"(?s)<(script|style|aside|form|section)\b.*?</\1>", " ", article[1]))).split()
            assert bag_f1(r["text"], " ".join(words)) > 0.9


PROSE = "alpha beta gamma delta omega, some longer words of plain prose that go on. "
UNLIKE = [  # pages by hand, and their main text
    ("<html><body><h1>A title here</h1><p>" + PROSE * 8 + "</p></body></html>", "A title here\n" + PROSE * 8),
    ("<html><body><table><tr><td><a href=/1>Home</a><br><a href=/2>News</a></td><td><h2>Head</h2>" + PROSE * 12 + "</td></tr></table></body></html>", "Head\n" + PROSE * 12),
    ("<p>a <svg/> b " + PROSE * 2 + "</p><p>" + PROSE * 6 + "</p>", "a b " + PROSE * 2 + "\n" + PROSE * 6),
    (PROSE * 6, PROSE * 6),
    ("<div><div><div><p>" + PROSE * 3 + "</p><p>" + PROSE * 4 + "</p></div></div><div><a href=x>one</a> <a href=y>two</a></div></div>", PROSE * 3 + "\n" + PROSE * 4),
    ("<article>" + f"<p>{PROSE}</p>" * 3000 + "</article>", "\n".join([PROSE.strip()] * 3000)),
    ("<body>" + PROSE * 5 + "<br><br>" + PROSE * 5 + "</body>", PROSE * 10),
    ("<body><div id=x1><div>" + f"<div>{PROSE * 3}</div>" * 4 + "</div></div><footer>all rights kept</footer></body>", "\n".join([(PROSE * 3).strip()] * 4)),
]


def test_pages_that_look_unlike_the_table():
    found = main_text.extract([h for h, _ in UNLIKE], main_text.train())
    assert all(found)
    scores = [bag_f1(a, b) for a, (_, b) in zip(found, UNLIKE, strict=True)]
    assert min(scores) > 0.7 and sum(scores) / len(scores) > 0.95
    assert main_text.extract(["<body><nav>" + PROSE * 9 + "</nav><footer>" + PROSE * 9 + "</footer></body>"], main_text.train()) == [""]


def test_pages_by_hand():
    """Usual themes and wrappers, short texts, scripts without spaces."""
    found = main_text.extract([h for h, _ in PAGES.values()], main_text.train())
    for name, text, (_, blocks) in zip(PAGES, found, PAGES.values(), strict=True):
        assert bag_f1(text, "\n".join(blocks)) > 0.9, (name, text)
        assert not any(x in text for x in NOISE), (name, text)


def test_what_tokens_say():
    """Noise words count against an element, unknown ones say nothing."""
    odds = main_text.train().odds
    say = lambda name: [odds.get(b, 0) for b in main_text.token_buckets([name])]
    assert max(say("cookie-notice")) < -1 and max(say("comments")) < -1 and max(say("content")) > 0.5 and max(say("has-sidebar")) > 0.5
    assert sum(x != 0 for name in (f"qq{k}zz" for k in range(200)) for x in say(name)[:1]) < 10


def test_odd_pages(spark):
    rows = [(1, None, None, "kept", 1), (2, "u", "", "kept", 1), (2, "u", "", "kept", 1), (None, "u", "<p>unclosed <b>text", "kept", 1), (3, "u", "no markup at all", "kept", 1), (4, "u", "<article>" + "<div>" * 3000 + "<p>deep text here.</p>" + "</article>", "kept", 1), (5, "u", "<article><p>" + "long words. " * 100_000 + "</p></article>", "kept", 1)]
    found = main_text.extract_pages(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == len(rows)
    assert [r["text"] for r in found if r["page_id"] in (1, 2)] == ["", "", ""]
    assert [r["n_chars"] for r in found if r["page_id"] == 5] == [len("long words. " * 100_000) - 1]
    assert main_text.extract_pages(empty(spark, SCHEMA)).count() == 0
