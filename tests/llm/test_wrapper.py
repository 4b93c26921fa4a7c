"""Templates within runs of siblings."""

import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelspark.llm import html


def test_constant_member_of_a_run_goes():
    page = lambda k: f"<body><div id=wrap><h2>Title {k}</h2><p>Story number {k}</p><p>Share this story with all your friends</p><p>End of {k}</p></div></body>"
    trees = [html.parse(page(k)) for k in range(12)]
    assert html.Wrapper(trees).text(trees[3]) == "Title 3 Story number 3 End of 3"


def test_a_host_is_cut_by_its_own_size(spark):
    bucket = lambda h: F.pmod(F.xxhash64(h), F.lit(1 << 16))
    names = spark.range(400_000).select(F.concat(F.lit("h"), "id").alias("h"))
    small = names.where(bucket(F.col("h")) == bucket(F.lit("hot.example"))).first().h
    body = lambda k: f"<main><h2>Title {k}</h2><p>Story {k}</p><div>Same on all</div></main>"
    rows = [(k, f"http://{small if k < 10 else 'hot.example'}/{k}", body(k)) for k in range(2000)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).where("page_id < 10").collect()
    assert {r.page_id: r.text for r in got} == {k: f"Title {k} Story {k}" for k in range(10)}


def test_long_lists_match_as_short_ones_do():
    rng = np.random.default_rng(3)
    kinds = [("p", ()), ("div", (("p", ()),)), ("ul", (("li", ()), ("p", ()))), ("hr", ())]

    def slow(x, y):
        best = np.zeros((len(x) + 1, len(y) + 1), int)
        for i, p in enumerate(x):
            for j, q in enumerate(y):
                best[i + 1, j + 1] = max(best[i, j + 1], best[i + 1, j], best[i, j] + html.match(p, q)[0])
        return best[-1, -1]

    for m, n in ((0, 3), (5, 4), (40, 17), (300, 220)):
        x, y = (tuple(kinds[k] for k in rng.integers(0, 4, size)) for size in (m, n))
        pairs = html._aligned(x, y)
        assert sum(html.match(x[i], y[j])[0] for i, j in pairs) == slow(x, y)
        assert all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:], strict=False))
        assert html.match(("html", x), ("html", y))[0] == 1 + slow(x, y)


@pytest.mark.parametrize("blocks", [20, 500])
def test_a_note_goes_beside_few_blocks_and_many(blocks):
    page = lambda k: html.parse("<body><div>" + "".join(f"<p>own {k} {j}</p><div><p>more {k} {j}</p></div>" for j in range(blocks + k % 3)) + "<ul><li>Share this story</li></ul></div></body>")
    pages = [page(k) for k in range(12)]
    own = html.Wrapper(pages)
    for k, p in enumerate(pages):
        text = own.text(p)
        assert "Share this" not in text and text.startswith(f"own {k} 0 more {k} 0 own {k} 1")


def test_closed_images_and_deep_elements():
    sys.setrecursionlimit(20 * html.DEPTH)  # as the operator does
    page = html.parse('<article><p>one</p><svg class="i"/><p>two</p>' + "<div>" * 400 + "<nav>menu</nav>three</article>")
    assert html.Wrapper([page]).text(page) == "one two three"


def test_alignment_decides_where_no_name_does():
    rng = np.random.default_rng(9)
    story = lambda k: [" ".join(rng.choice(["sea", "hill", "road", "wind", "lamp"], 30)) + f" {k} {j}" for j in range(3)]
    stories = [story(k) for k in range(12)]
    box = "".join(f"<li>Link {j} of a long list of links that every page shows</li>" for j in range(9))

    def page(own):
        return html.parse(f"<body><div class=a1><ul>{box}</ul></div><div class=a2><p>All of our offers</p>" + "".join(f"<p>{t}</p>" for t in own) + "<p>Read us daily</p></div><div class=a3><p>Imprint</p></div></body>")

    trees = [page(s) for s in stories]
    own = html.Wrapper(trees)
    for s, t in zip(stories, trees, strict=True):
        assert own.text(t) == " ".join(s)
        # Without other pages to align with nothing tells the links from the story.
        assert html.Wrapper([t]).text(t) != " ".join(s)


def test_a_constant_article_is_not_the_content():
    page = lambda k: html.parse("<body><article><p>" + "About this paper, as on every page. " * 20 + f"</p></article><div class=a2><p>Story {k} of its own</p><p>It ends with {k}</p></div></body>")
    trees = [page(k) for k in range(12)]
    assert html.Wrapper(trees).text(trees[4]) == "Story 4 of its own It ends with 4"


def test_all_articles_of_a_page():
    page = lambda k: html.parse(f"<body><div>Top</div><article><p>First part {k}</p></article><div>Between</div><article><p>Second part {k}</p></article></body>")
    trees = [page(k) for k in range(12)]
    assert html.Wrapper(trees).text(trees[5]) == "First part 5 Second part 5"


def test_short_blocks_beside_a_long_one_stay():
    page = lambda k: f"<body><div><h1>Title {k}</h1><p>Lead of {k}</p><p>{'long paragraph ' * 80}{k}</p><p>Closing line {k}</p></div><p>Imprint</p></body>"
    trees = [html.parse(page(k)) for k in range(12)]
    text = html.Wrapper(trees).text(trees[5])
    assert text.startswith("Title 5 Lead of 5 long") and text.endswith("5 Closing line 5")


@pytest.mark.parametrize("depth", [100, 505, 510, 600, 3000])
def test_a_menu_goes_at_any_depth(depth):
    sys.setrecursionlimit(20 * html.DEPTH)
    page = html.parse("<article>" + "<div>" * depth + "<nav>menu <div>more</div></nav>story" + "</div>" * depth + "</article>")
    assert html.Wrapper([page]).text(page) == "story"


def test_an_article_outranks_a_named_container():
    page = lambda k: html.parse(f"<body><div class=content><article><p>Story {k} of its own</p></article><div>See also {k}</div></div></body>")
    trees = [page(k) for k in range(12)]
    assert {html.Wrapper(t).text(t[0]) for t in (trees, trees[:1])} == {"Story 0 of its own"}
    lone = html.parse("<body><div>Top</div><div class=story><p>A page with no other of its host</p></div></body>")
    assert html.Wrapper([lone]).text(lone) == "A page with no other of its host"


def test_given_pages_need_no_article():
    import duckdb

    rows = duckdb.sql("select lower(regexp_extract(url, '://([^/:]+)', 1)) h, list(html) from '/root/testdata/sf0.1/pages.parquet' group by 1 having count(*) >= 20 order by 1 limit 12").fetchall()
    for _, pages in rows:
        trees = [[html.parse(p.replace("article>", f"{tag}>")) for p in pages] for tag in ("article", "div")]
        with_tag, without = ([own.text(t) for t in ts] for ts in trees for own in [html.Wrapper(ts)])
        assert with_tag == without and all(with_tag)
