"""Wrapper induction: alignment against brute force, templates of hosts with several layouts, and what is left out by them."""

import json
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from weftgraph.llm import html_extract

WORDS = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in "lmnrst"]


def _sentence(rng, n=14):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


class _Tree:
    def __init__(self, label, kids):
        self.label, self.kids = label, kids


def _random_tree(rng, depth=0):
    return _Tree(rng.choice("ab") if depth else "r", [_random_tree(rng, depth + 1) for _ in range(rng.randrange(4) if depth < 3 else 0)])


def _brute(a, b):
    """The size of the largest order-keeping alignment, by trying every pair of equally long choices of children."""
    if a.label != b.label:
        return 0
    best = 0
    for n in range(1, min(len(a.kids), len(b.kids)) + 1):
        for xs in combinations(a.kids, n):
            for ys in combinations(b.kids, n):
                best = max(best, sum(_brute(x, y) for x, y in zip(xs, ys, strict=True)))
    return 1 + best


def test_matching_equals_brute_force():
    rng = random.Random(11)
    for _ in range(150):
        a, b = _random_tree(rng), _random_tree(rng)
        size, pairs = html_extract.match_trees(a, b)
        assert size == len(pairs) == _brute(a, b)
        assert all(x.label == y.label for x, y in pairs) and len({id(x) for x, _ in pairs}) == size == len({id(y) for _, y in pairs})


def _plain(rng, k):
    """No names at all: a menu, an offer, the text and a foot are boxes of one kind."""
    links = "".join(f"<div><a href=/{x}>{rng.choice(WORDS)} {k}</a></div>" for x in range(5))
    text = [_sentence(rng) for _ in range(rng.randrange(2, 9))]
    page = f"<html><body><div>{links}</div><div>Offers of the week are here</div><div><p>{'<p>'.join(text)}</div><div>All at one place</div></body></html>"
    return page, "\n".join(text)


def _classed(rng, k):
    text = [_sentence(rng) for _ in range(rng.randrange(3, 6))]
    page = f"<body><div class=x1><p>Same on all pages</p></div><div class=x2><h1>Title {k}</h1><section><p>{text[0]}</p></section><section><h2>More {k}</h2><p>{'</p><p>'.join(text[1:])}</p></section><p>Read on</p></div>"
    return page, "\n".join([f"Title {k}", text[0], f"More {k}", *text[1:]])


@pytest.fixture(scope="module")
def read(spark):
    """The texts of pages by their names, all induced and read together; and what they should be."""
    rng, rows, want = random.Random(4), [], {}

    def add(host, name, html, text):
        rows.append((f"http://{host}/{name}", html))
        want[f"http://{host}/{name}"] = text

    for k in range(12):
        add("plain.example.com", f"p{k}", *_plain(rng, k))
        add("two.example.net", f"p{k}", *_plain(rng, k))
        add("two.example.net", f"q{k}", *_classed(rng, k))
    add("two.example.net", "empty", "<body><div class=x1><p>Same on all pages</p></div><div class=x2><p>Read on</p></div>", "")
    for k in range(8):
        text = [_sentence(rng) for _ in range(4)]
        sources = "<ul>" + "".join(f"<li><a href=/{x}>{_sentence(rng, 4)}</a>" for x in range(3)) + "</ul>"
        found = f'<p class="search-results">{text[2]}</p>'
        comments = f"<div class=comments><p>{'<p>'.join(_sentence(rng, 30) for _ in range(3))}</div>"
        html = f"<body><article><h1>T {k}</h1><p>{text[0]}<p>{text[1]}{found}{sources}<p>{text[3]}{comments}</article><footer>{_sentence(rng)}</footer>"
        links = [x.split("</a>")[0].split(">")[-1] for x in sources.split("<li>")[1:]]
        add("lists.example.org", f"p{k}", html, "\n".join([f"T {k}", text[0], text[1], text[2], *links, text[3]]))
    add("alone.other.test", "p", "<body><nav><a href=/>Home</a></nav><article><p>One<p>Two</article><div>Foot</div>", "One\nTwo")
    copy = _plain(rng, 99)
    for k in range(40):  # copies count once, and so don't make their text a template
        add("copies.example.com", f"c{k}", *copy)
    for k in range(6):
        add("copies.example.com", f"p{k}", *_plain(rng, k))
    got = html_extract.extract_pages(spark.createDataFrame(list(enumerate(u for u, _ in rows)), "page_id long, url string").join(spark.createDataFrame(rows, "url string, html string"), "url"))
    return {r.url: r.text for r in got.collect()}, want


@pytest.mark.parametrize("host", ["plain.example.com", "two.example.net", "lists.example.org", "alone.other.test", "copies.example.com"])
def test_pages_are_read(read, host):
    got, want = read
    for url in (u for u in want if f"/{host}/" in u):
        assert got[url] == want[url], url


def test_names_are_not_needed(spark):
    """The test tables' pages with every element of theirs a plain box, as if no name were known: the templates do it."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    soup = pages.withColumn("html", F.expr("replace(regexp_replace(html, '(</?)(article|nav|footer)', '$1div'), ' class=\"ad\"', '')"))
    named, bare = ({r.page_id: r.text for r in html_extract.extract_pages(p).collect()} for p in (pages, soup))
    assert sum(named[k] != bare[k] for k in named) <= len(named) // 50
    alone = {r.page_id: html_extract.main_text(r.html, None) for r in soup.collect()}
    assert sum(named[k] != alone[k] for k in named) > len(named) // 20


def test_layouts_merge_alike_in_any_order_of_rows(spark):
    rng = random.Random(8)
    rows = [(f"http://a.example.com/{k}", (_plain if k % 3 else _classed)(rng, k)[0]) for k in range(30)]
    rows.append(("http://b.example.com/", _plain(rng, 0)[0]))  # a small host, which has its domain's template
    one, two = (sorted(map(tuple, html_extract.induce_templates(spark.createDataFrame(x, "url string, html string").repartition(n)).collect())) for x, n in ((rows, 1), (rows[::-1], 7)))
    assert one == two and len(one) == 2


def _article(rng, shared, k):
    text = [_sentence(rng, 40), shared, _sentence(rng, 40)]
    page = f"<html><body><ul><li><a href=/>Home</a><li><a href=/a>About</a><li><a href=/b>Contact</a></ul><article><h1>Dish {k}</h1><p>{'</p><p>'.join(text)}</p></article><div>All rights reserved</div></body></html>"
    return page, "\n".join([f"Dish {k}", *text])


def test_shared_paragraphs_are_text(spark):
    """A paragraph that articles share stays, on one host, on hosts of one registry, and on many pages of a host with others."""
    rng, shared, rows, want = random.Random(2), "Whisk the eggs with the sugar until they are pale and thick.", [], {}
    hosts = ["www.cook.com"] * 3 + ["h3.co.uk", "h4.co.uk", "h5.co.uk"] + ["big.cook.test"] * 30
    for k, host in enumerate(hosts):
        html, want[f"http://{host}/{k}"] = _article(rng, shared, k)
        rows.append((f"http://{host}/{k}", html))
    for k in range(10):
        html, want[f"http://big.cook.test/o{k}"] = _article(rng, _sentence(rng, 12), k)
        rows.append((f"http://big.cook.test/o{k}", html))
    pages = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "page_id long, url string, html string")
    assert {r.url: r.text for r in html_extract.extract_pages(pages).collect()} == want


def test_domains_of_hosts(spark):
    hosts = {"a.b.example.com": "example.com", "h3.co.uk": "h3.co.uk", "x.h3.co.uk": "h3.co.uk", "me.github.io": "me.github.io", "example.de": "example.de", "10.0.0.1": "10.0.0.1", "co.example.org": "example.org", "localhost": "localhost"}
    got = spark.createDataFrame([(h,) for h in hosts], "host string").select("host", html_extract.site_of_domain(F.col("host")).alias("site")).collect()
    assert {r.host: r.site for r in got} == {h: f"*.{d}" for h, d in hosts.items()}


def test_layouts_merged_in_parts(spark):
    """Any number of parts gives the sums of one; pages and characters are not lost or counted twice."""
    rng = random.Random(5)
    rows = [(f"http://a.example.com/{k}", (_plain if k % 3 else _classed)(rng, k)[0]) for k in range(40)]
    rows += [(f"http://a.example.com/x{k}", f"<body><div class=k{k}><h1>{_sentence(rng)}</h1><p>{_sentence(rng)}</p></div></body>") for k in range(20)]
    pages = spark.createDataFrame(rows, "url string, html string")

    def sums(merged):
        (row,) = html_extract.induce_templates(pages, merged=merged).collect()
        made, total, stack = json.loads(row.template), [0, 0, 0], []
        stack.append(json.loads(made["tree"]))
        while stack:
            _, n, *held, kids = stack.pop()
            total = [a + b for a, b in zip(total, held, strict=True)]
            stack += kids
        return row.pages, total, made["constant"], made["fixed"], made.get("recycled")

    assert sums(1000) == sums(7) == sums(1) and sums(1000)[0] == 60


def test_large_hosts_have_seats(spark, monkeypatch):
    """A host whose pages are read at many seats has its template at each, null and repeated keys included."""
    rng = random.Random(6)
    made = [_plain(rng, k) for k in range(30)]
    rows = [(k if k % 4 else None, f"http://large.example.com/{k}", made[k][0]) for k in range(30)] + [(7, None, made[0][0]), (7, "http://alone.test/", "<p>One"), (7, "http://large.example.com/x", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("template", F.lit("other")).withColumn("host", F.lit(1))
    whole = sorted(map(str, html_extract.extract_pages(pages).collect()))
    for name, value in (("SHARED_CHARS", 0), ("SEAT_PAGES", 3)):  # no template is shared; nor has a host one seat only
        monkeypatch.setattr(html_extract, name, value)
        assert sorted(map(str, html_extract.extract_pages(pages).collect())) == whole and len(whole) == 33
    texts = {r.url: r.text for r in html_extract.extract_pages(pages).collect()}
    assert all(texts[f"http://large.example.com/{k}"] == made[k][1] for k in range(30)) and texts["http://alone.test/"] == "One" and texts["http://large.example.com/x"] == ""


def test_wide_and_deep_pages_are_read_whole():
    text = [f"w{k} and more" for k in range(3000)]
    wide = "<body>" + "".join(f'<div class="c{"x" * (k % 9)}{chr(97 + k % 26)}"><p>{t}</div>' for k, t in enumerate(text))
    assert html_extract.main_text("<article>" + wide, None).split("\n") == text
    deep = "<article>" + "<div>" * 3000 + "deep text" + "</div>" * 3000
    assert html_extract.main_text(deep, None) == "deep text"
