from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def odd_rows(spark):
    """Every dealt operator must stand nulls in any column, empty and long texts, repeated rows and clashing names."""
    rows = [
        (1, None, None, None, "x", 1),
        (2, "", "", "s", None, 2),
        (2, "", "", "s", None, 2),
        (3, "Capítulo 1: A", "<p>uno</p>\n<p>dos</p>", None, "x", None),
        (4, "Capítulo 2: B", "<p>" + "palabra larga " * 20_000 + "</p>", "s", "x", 3),
        (None, "t", "\n\n\n", "s", "x", 4),
        (5, "\x00\ud7ff", "<<<>>> & &amp &#xZ; </p></p>", "s", "x", 5),
    ]
    return spark.createDataFrame(rows, "chapter_id long, title string, content_html string, site string, field string, id int")
