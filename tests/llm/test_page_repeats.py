"""What counts as repeated on a host: distinct pages only, wherever they lie, and in proportion to the host."""

from __future__ import annotations

import time

from intake.llm import pages

MENU = "<div>Home News Sport Weather Contact us</div>"


def texts(spark, bodies, parts):
    df = spark.createDataFrame([(i, f"http://a/{i}", f"<body>{MENU}<div>{b}</div>") for i, b in enumerate(bodies)], "page_id long, url string, html string")
    return {r.page_id: r.text for r in pages.main_text(df.repartition(parts)).collect()}


def test_copies_in_several_batches_count_once(spark):
    """Four copies of a page, each read in a batch of its own."""
    own = ["one story that stands on four pages of the host"] * 4
    assert texts(spark, own, 1) == texts(spark, own, 4)
    assert set(texts(spark, own, 4).values()) == {f"Home News Sport Weather Contact us\n{own[0]}"}


def test_phrases_of_a_large_host_stay(spark):
    bodies = [f"story{i} " + " ".join(f"w{i}x{j}" for j in range(20)) for i in range(60)]
    for i in (3, 17, 40):
        bodies[i] = "at the end of the day"
    bodies[40] += " again"
    bodies[17] += " then"
    got = texts(spark, bodies, 3)
    assert got == dict(enumerate(bodies))


def test_broken_pages_take_linear_time():
    """Quotes and comments that never close, stray end tags and deep nesting: megabytes in seconds."""
    for piece in ('<a "', "</b>", "<article><div>", "<p a='", "<!x", "<"):
        began = time.time()
        pages.blocks(f"<article><p>kept text</p></article>{piece * (1_000_000 // len(piece))}")
        assert time.time() - began < 30, piece


def test_quotes_that_never_close():
    assert pages.blocks('<article><p title="a > b">one</p><p x="y>two</p><p>three</p></article>') == [("one", pages.ARTICLE), ("two", pages.ARTICLE), ("three", pages.ARTICLE)]
