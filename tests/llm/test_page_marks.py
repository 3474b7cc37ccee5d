"""Class words inside the article: parts of the page go, texts that only share a word with them stay."""

from __future__ import annotations

import pytest

from intake.llm import pages

PAGE = "<html><body><nav>Menu</nav><article><h1>Title</h1>{}<p>End of text.</p></article><footer>Foot</footer></body></html>"


def text(spark, inner):
    df = spark.createDataFrame([(1, "http://a.example/x", PAGE.format(inner))], "page_id long, url string, html string")
    return pages.main_text(df).first().text.split("\n")[1:-1]


@pytest.mark.parametrize(
    ("inner", "kept"),
    [
        ('<p class="side effects">It may tire you.</p>', ["It may tire you."]),
        ('<div class="share-price">Up by 3 %.</div>', ["Up by 3 %."]),
        ("<p>The sum <math><mi>x</mi><mo>+</mo><mi>y</mi></math> holds.</p>", ["The sum x+y holds."]),
        ("<p>A <svg><text>chart label</text></svg> here.</p>", ["A chart label here."]),
        ('<div class="social-share-buttons">Share</div>', []),
        ('<p class="advert">Buy now</p>', []),
        ('<div id="comments"><p>First!</p></div>', []),
        ('<ul class="related links"><li>More</li></ul>', []),
        ('<aside>By the way</aside><div class="ad">Ad</div>', []),
        ('<h2 class="headline notice-title">Notice of change</h2>', ["Notice of change"]),
    ],
)
def test_article(spark, inner, kept):
    assert text(spark, inner) == kept
