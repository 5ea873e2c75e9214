import html as entities
import re
import time
from math import e, log

import pytest

from tidemark.llm import main_text as mt
from tests.llm.test_periodic_runs import duck

FOLDER = "/root/testdata/sf0.001"


def page(body, head="<title>T</title><style>p{}</style>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


PROSE = "Long words of an article that goes on for quite some time, with commas. "
CASES = {
    "article": (page("<nav><a href=/a>Home</a></nav><div class=ad>Buy this now please it is great.</div><article><h1>Title</h1><p><b>Lead<br><p>Be.</p></article><footer>&copy; me</footer>"), "Title Lead Be."),
    "inner parts": (page(f"<main><article><header><h1>A &amp; B</h1></header><p>{PROSE}</p><aside>side</aside><div class='ad-slot'>advert</div><form>Mail <input><button>go</button></form><p>x<script>var t='</p>';</script>y</p><section id=comments><article class=comment><p>{PROSE * 9}</p></article></section></article></main>"), f"A & B {PROSE.strip()} xy"),
    "no article element": (page(f"<div id=top>Small slogan</div><div class='menu-left'><ul><li><a href=x>one</a><li><a href=y>two</a></ul></div><div id=c><h2>Head</h2><p>{PROSE * 3}</p><p>{PROSE * 2}<a href=z>link</a></p></div><div class='cookie-notice'>{PROSE}</div>"), f"Head {PROSE * 3}{PROSE * 2}link"),
    "two parts": (page(f"<div><p>{PROSE * 4}</p><p>{PROSE * 4}</p></div><div><p>{PROSE * 4}</p><p>{PROSE * 3}</p></div>"), (PROSE * 15).strip()),
    "links only": (page(f"<div><p>{PROSE * 4}</p><p>{PROSE * 4}</p></div><div>{'<a href=q>some other page</a> ' * 9}</div>"), (PROSE * 8).strip()),
    "text with breaks": (page(f"<div>{PROSE}<br>{PROSE}<br/>end</div>"), f"{PROSE}{PROSE}end"),
    "inline": ("<article>a<b>b</b>c <i>d</i>\n\t e&nbsp;f&#8364;&lt;p&gt;<p>g<div>h</div></article>", "abc d e f€<p> g h"),
    "wrapper with a dropped name": (page(f"<div class='page-sidebar'><article><p>{PROSE}</p></article></div>"), PROSE.strip()),
    "site header": (page(f"<header><h1>Site</h1></header><div class=header>More</div><article><p>{PROSE}</article>"), PROSE.strip()),
    "no tags": ("just text & more", "just text & more"),
    "comment in page": (page("<article>a<!-- <p>no</p> -->b</article>"), "ab"),
    "quoted end": (page('<article><a title="a > b" href=\'c>d\'>link</a> x</article>'), "link x"),
    "cut off": ("<html><body><article><p>Some text <b>bold</b> and <a hre", "Some text bold and"),
    "unclosed script": ("<article>a <script>if (a < b)", "a"),
    "lone signs": ("<article>1 < 2 & 3 > 2 <3 &am; &quo</article>", "1 < 2 & 3 > 2 <3 &am; &quo"),
    "no head end": ("<head><title>t</title><p>text", "text"),
    "table": (page("<article><table><tr><td>a<td>b<tr><td>c</table></article>"), "a b c"),
    "hidden": (page("<article><p hidden>x</p><p style='display: none'>y</p><p>z</p></article>"), "z"),
    "notices": (page(f"<article><p class='notice'>x</p><p>{PROSE}</p><div role=alert>y</div></article>"), PROSE.strip()),
    "nothing": ("", ""),
    "null": (None, ""),
    "blank article": (page("<article><h1></h1></article><footer>f</footer>"), ""),
}


@pytest.mark.parametrize("name", CASES)
def test_case(name):
    assert mt.main_text(CASES[name][0]) == CASES[name][1].strip()


def brute_densities(tree, gone, body):
    """Each node's numbers from its own subtree, by recursion."""
    n = len(tree.name)
    below = {i: [j for j in range(1, n) if tree.parent[j] == i and not gone[j]] for i in range(n)}

    def inside(i):
        return [i] + [k for j in below[i] for k in inside(j)]

    def numbers(i):
        nodes = set(inside(i))
        in_links = {k for j in nodes if tree.name[j] == "a" for k in inside(j)}
        held = [(k, re.sub(r"\s", "", t)) for k, t in tree.pieces if t]
        return (
            sum(len(t) for k, t in held if k in nodes), len(nodes) - 1,
            sum(len(t) for k, t in held if k in in_links), sum(tree.name[k] == "a" for k in nodes),
        )

    def density(c, t, lc, lt):
        cb, _, lcb, _ = numbers(body)
        if not c:
            return 0.0
        one = lambda x: max(1, x)
        inner = c / one(c - lc) * lc + lcb / one(cb) * c + e**e
        return c / one(t) * log(c / one(lc) * one(t) / one(lt)) / log(log(inner))

    dense = [0.0 if gone[i] else density(*numbers(i)) for i in range(n)]
    own = [sum(len(re.sub(r"\s", "", t)) for k, t in tree.pieces if t and k == i and not gone[i]) for i in range(n)]
    sums = [sum(dense[j] for j in below[i]) + density(own[i], 1, own[i] if tree.name[i] == "a" else 0, 0) for i in range(n)]
    return dense, sums


@pytest.mark.parametrize("name", [k for k, v in CASES.items() if v[0]])
def test_densities_as_brute_force(name):
    tree = mt.parse(CASES[name][0])
    gone = mt._dropped(tree)
    body = tree.name.index("body") if "body" in tree.name else 0
    dense, sums = mt.densities(tree, gone, body)
    other_dense, other_sums = brute_densities(tree, gone, body)
    assert dense == pytest.approx(other_dense)
    assert [s for s, g in zip(sums, gone) if not g] == pytest.approx([s for s, g in zip(other_sums, gone) if not g])


def test_deep_long_and_broken_pages_take_linear_time():
    start = time.time()
    assert mt.main_text("<b>" * 100_000 + "x") == "x"
    assert mt.main_text("<div>" * 100_000 + "x") == "x"
    assert mt.main_text("<article>" + "<p>word " * 100_000) == " ".join(["word"] * 100_000)
    assert mt.main_text('<a href="' * 50_000 + "x") == ""
    assert mt.main_text("<i><div>" + "<b>" * 50_000 + "</i>" * 50_000 + "x") == "x"
    assert mt.main_text("< " * 200_000).startswith("< <")
    assert mt.main_text("<article>" + "a < b &lt; " * 100_000).endswith("b <")
    assert time.time() - start < 30


def simple(source):
    """The template of the given tables, read by patterns."""
    body = re.search(r"<article>(.*)</article>", source, re.S).group(1)
    blocks = re.sub(r"</?(?:h1|p)>|<br>", " ", re.sub(r"</?b>", "", body))
    return " ".join(entities.unescape(blocks).split())


def test_whole_table_as_brute_force(spark):
    from tidemark.llm.queries import ENTRIES

    rows = duck(FOLDER).execute("select page_id, url, html from pages").fetchall()
    got = {r.page_id: tuple(r) for r in ENTRIES["op11_html_extraction"][0](spark, FOLDER).collect()}
    expected = {i: (i, u, simple(h), len(simple(h))) for i, u, h in rows}
    assert got == expected


def test_odd_rows(spark):
    rows = [(1, "u", None, "x", "r"), (None, None, "<p>a", "y", "r"), (2, "u", "", "z", "r"), (2, "u", "", "z", "r"), (3, "v", "<article><p>w" + " w" * 200_000, "z", "r")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, row string")
    got = mt.extracted(pages)
    assert got.columns == ["row", "text", "n_chars"] and got.select("row.*").columns == ["page_id", "url", "text", "row"]
    assert sorted((r.row.page_id or 0, r.row.text, r.text[:3], r.n_chars) for r in got.collect()) == [
        (0, "y", "a", 1), (1, "x", "", 0), (2, "z", "", 0), (2, "z", "", 0), (3, "z", "w w", 400_001),
    ]
    assert mt.extracted(pages.where("false")).isEmpty()
