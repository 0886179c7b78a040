"""Plain and XML sinks and selections by place."""

import pytest
from pyspark.sql import functions as F

from lexigrain.operators import rendering, search, selection, windows


def test_plain_check():
    assert rendering.check_plain("a=1 b=2\n<page=1>\nx\n<page=3>\ny") == [1, 3]
    for bad in ("b=1 a=2\n<page=1>", "none\n<page=1>", "a=1\n<page=2>\n<page=2>"):
        with pytest.raises(ValueError):
            rendering.check_plain(bad)


def test_markers_in_the_text_are_escaped(spark):
    rows = spark.createDataFrame([(1, 1, 0, "x\n<page=7>\ny"), (1, 2, 0, "z")], "d int, page int, ord int, text string")
    text = rendering.marked_pages(rows, ["d"], "page", ["ord"], "text", {"format": F.lit("dtp")}).first()["rendered"]
    assert rendering.check_plain(text) == [1, 2] and "\\<page=7>" in text


def test_elements(spark):
    row = spark.createDataFrame([('a"<\r\n', True, None)], "t string, b boolean, n string")
    made = rendering.element("x", {"z_z": F.col("t"), "a": F.col("b"), "n": F.col("n")}, rendering.xml_text(F.col("t")))
    assert row.select(made).first()[0] == '<x a="true" z-z="a&quot;&lt;&#13;&#10;">a"&lt;&#13;\n</x>'


def test_row_spans():
    assert selection.rows_spec("2-5") == (2, 5) and selection.rows_spec("3") == (3, 3)
    for bad in ("0", "5-2", "x", "-1"):
        with pytest.raises(ValueError):
            selection.rows_spec(bad)


def test_slides(spark):
    numbers = spark.createDataFrame([("a", k) for k in (1, 2, 3)] + [("b", 1)], "d string, n int")
    got = lambda *a: sorted(map(tuple, selection.slide_span(numbers, ["d"], "n", *a).collect()))
    assert got(-1) == [("a", 3), ("b", 1)] and got(2, 5) == [("a", 2), ("a", 3)] and got(9) == []
    with pytest.raises(ValueError):
        got(0)


def test_page_windows_stop_at_holes(spark):
    numbers = spark.createDataFrame([("a", k) for k in (1, 2, 4, 5)] + [("b", 2)], "d string, p int")
    got = lambda *a: sorted(map(tuple, windows.page_window(numbers, ["d"], "p", *a).collect()))
    assert got(1, 9) == [("a", 1), ("a", 2)] and got(2, 1) == [("a", 2), ("b", 2)] and got(3, 2) == []


def test_excerpts_and_pages(spark):
    units = spark.createDataFrame([(k, "x" * k + "needle" + "y" * 5) for k in range(8)] + [(99, None)], "k int, text string")
    rows = search.find_text(units, "NEEDLE", ignore_case=True, context=3, order=["k"], offset=2, limit=4).collect()
    assert [(r["k"], r["excerpt"], r["has_more"]) for r in rows] == [(2, "xxneedleyyy…", True), (3, "xxxneedleyyy…", True), (4, "…xxxneedleyyy…", True), (5, "…xxxneedleyyy…", True)]
    assert [r["has_more"] for r in search.find_text(units, "needle", order=["k"], offset=6, limit=4).collect()] == [False, False]
    for bad in ({"query": ""}, {"query": "a", "limit": 0}, {"query": "a", "context": 5000}):
        with pytest.raises(ValueError):
            search.find_text(units, **bad)
