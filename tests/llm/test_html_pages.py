"""Templates of hosts whose pages were fetched several times, and headings that all articles share."""

import pytest

from tillwise.llm import html_text

PAGE = (
    "<html><body><nav><a href='/'>Home</a></nav><article><h1>Soup {0}</h1><h2>Ingredients</h2><p>Take {0} leeks"
    " and some salt.</p><p>Rate this recipe</p><h2>Method</h2><p>Boil it {0} times.</p></article></body></html>"
)
#: No element, class or id tells article and frame apart here.
BARE = "<body><div><p>Weather and more</p></div><div><p>{1} news of day {0}.</p><p>Nothing {0} else.</p></div><div><p>All rights</p></div></body>"


def _texts(spark, rows):
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    return sorted((r.page_id, r.text) for r in html_text.main_text(df).collect())


def _whole(k):
    return f"Soup {k}\n\nIngredients\n\nTake {k} leeks and some salt.\n\nRate this recipe\n\nMethod\n\nBoil it {k} times."


@pytest.mark.parametrize("ids", [range(5), [7] * 5])
def test_a_page_fetched_five_times_keeps_its_text(spark, ids):
    rows = [(i, f"http://one.example/{k}", PAGE.format(3)) for k, i in enumerate(ids)]
    assert _texts(spark, rows) == [(i, _whole(3)) for i in ids]


def test_rows_that_stand_twice_change_nothing(spark):
    rows = [(i, f"http://two.example/{i}", PAGE.format(i)) for i in range(6)]
    once = _texts(spark, rows)
    assert _texts(spark, rows * 2) == sorted(once * 2)
    # The line of the template goes, the shared headings of the articles stay.
    assert once == [(i, _whole(i).replace("Rate this recipe\n\n", "")) for i in range(6)]


def test_copies_on_other_hosts_are_pages_of_their_own(spark):
    rows = [(k * 10 + i, f"http://h{k}.example/", PAGE.format(i)) for k in range(3) for i in range(6)]
    assert _texts(spark, rows) == [(k * 10 + i, _whole(i).replace("Rate this recipe\n\n", "")) for k in range(3) for i in range(6)]


def test_only_the_template_tells_frame_from_article(spark):
    rows = [(i, f"http://bare.example/{i}", BARE.format(i, "Good" if i % 2 else "Bad")) for i in range(9)]
    rows += [(100 + i, "http://few.example/", BARE.format(i, "No")) for i in range(2)]
    got = dict(_texts(spark, rows))
    for i in range(9):
        assert got[i] == f"{'Good' if i % 2 else 'Bad'} news of day {i}.\n\nNothing {i} else."
    # Two pages make no template: nothing tells what to leave out.
    assert got[100] == "Weather and more\n\nNo news of day 0.\n\nNothing 0 else.\n\nAll rights"


def test_texts_that_the_template_changes(spark):
    """On the fixture the element rules suffice: the template takes nothing from an article."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    with_template = {r.page_id: r.text for r in html_text.main_text(pages).collect()}
    without = {r.page_id: html_text.extract(r.html) for r in pages.collect()}
    assert with_template == without
