"""Pages and URLs that the modules' own generators did not make: hand-written markup with its main text, hosts with hyphens, held-out labels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ctxloom.llm import html_extract, url_filter

STORY = "The city council has agreed on plans for a new bridge over the river, which will open next year."
MENU = "<nav><ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li><li><a href='/s'>Sport</a></li></ul></nav>"
#: Fixed values: (page, main text), labelled by hand.
PAGES = [
    (f"{MENU}<article><h1>Bridge plans</h1><p>{STORY}</p></article>", f"Bridge plans {STORY}"),
    (f"{MENU}<article><h1>Baking</h1><p>{STORY}</p></article>", f"Baking {STORY}"),
    (f"{MENU}<article><header><h1>A title of some length for the story</h1></header><p>{STORY}</p></article>", f"A title of some length for the story {STORY}"),
    (f"<article><h1>Reports</h1><p>See <a href=1>the first report</a> and <a href=2>the second report</a> for more.</p><p>{STORY}</p></article>", f"Reports See the first report and the second report for more. {STORY}"),
    (f"<div class='main-menu'><ul><li><a href=1>One</a></li><li><a href=2>Two words</a></li></ul></div><article><p>{STORY}</p></article>", STORY),
    (f"<div class='post'><p>{STORY}</p><div class='post-navigation'><a href=1>Older: a walk in the woods</a></div></div>", STORY),
    (f"<div class='post'><p>{STORY}</p><div class='content-ads'><p>Buy one of these and get another for nothing at all</p></div></div>", STORY),
    (f"<div class='content'><p>{STORY}</p><div class='main-sidebar'><p>Other things stand here that are of no use to any reader</p></div></div>", STORY),
    (f"<article><p>{STORY}</p></article><div class='discussion'><p>I think that this is quite wrong, and so do many others who live here by the river.</p></div>", STORY),
    (f"<article><p>{STORY}</p></article><div class='user-feedback'><p>Nice one, I liked it very much, and thanks for all the work on the text.</p></div>", STORY),
    (f"<main><p>{STORY}</p><aside><p>{STORY} And more.</p></aside></main><footer><p>&copy; The Paper, all rights reserved, since the year it was founded</p></footer>", STORY),
    (f"<article class='entry with-sidebar'><div class='entry-header'><h1>Of bridges</h1></div><p>{STORY}</p><form><label>Your name</label><input></form></article>", f"Of bridges {STORY}"),
    ("<script>var x = '<p>no</p>';</script><style>p{}</style>", ""),
]


@pytest.mark.parametrize("k", range(len(PAGES)))
def test_pages_by_hand(k):
    page, want = PAGES[k]
    assert html_extract.main_text(f"<html><head><title>T</title></head><body>{page}</body></html>", html_extract.train()) == want


def test_blocks_of_pages_not_seen():
    right = []
    for seed in range(3000, 3200):
        page, content = html_extract.made_up_page(seed)
        found = html_extract.blocks(page)
        right += [got == (b.text in content) for b, got in zip(found, html_extract.classify(found, html_extract.train()), strict=True)]
    assert np.mean(right) > 0.99


GOOD = "https://www.san-francisco.gov/services/12 https://www.new-york-herald.com/world/2020 https://st-johns-college.edu/physics https://farmers-market.example.org/fr/3 https://blog.mountain-trail.net/de/winter http://open-source-wiki.org/en/git.html https://m.coffee-house.example.com/es/7".split()
BAD = "https://www.casino-bonus.example.net/en/3 http://cheap-pills.biz/buy?id=123&aff=9 https://m.ads-track.example.com/en/4033.html https://free-bets.example.org/en/5462#top http://x7k2q9w4z1.top/q/1?clickid=8&sub=7".split()


def test_hyphens_do_not_decide():
    model = url_filter.default_model()
    assert (model.score(GOOD) < 0.5).all() and (model.score(BAD) >= 0.5).all()


def test_urls_held_out():
    """Fitted on one list, held against another seed's."""
    allowed, blocked = url_filter.labelled_urls()
    model = url_filter.train([*url_filter.ALLOWED, *allowed], [*url_filter.BLOCKED, *blocked])
    fine, foul = url_filter.labelled_urls(600, seed=12)
    assert not set(fine) & set(allowed)
    assert ((model.score(fine) < 0.5).mean() + (model.score(foul) >= 0.5).mean()) / 2 > 0.93
    hyphens = [u for u in fine if "-" in url_filter.split_url(u)[0]]
    assert len(hyphens) > 40 and (model.score(hyphens) < 0.5).mean() > 0.93


def test_names_with_dots(spark):
    rows = spark.createDataFrame([(1, "http://a.com/en/1", "<p>x</p>", 5)], "page_id long, url string, html string, n int").withColumn("a.b", F.lit("own")).withColumn("c d", F.lit(1))
    for out in (html_extract.extract(rows), url_filter.judge(rows)):
        row = out.first()
        assert row["a.b"] == "own" and row["c d"] == 1 and row["n"] == 5
    assert html_extract.extract(rows.limit(0)).count() == 0 and url_filter.judge(rows.limit(0)).count() == 0
