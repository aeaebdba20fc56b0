import pytest

from quernstone.operators import regions

TEXTS = [
    (1, "# A\nx\n## Sub ##\nb\n### deep\nc\n## Next\nd"), (2, "## sub\nx\n## SUB\ny"), (3, "# A\nno"), (4, None), (5, "a\r\n### Sub\r\nlast"), (6, "# Sub\nx\n## other\ny\n# B"),
    (None, "## Sub\nz"), (7, "y end\nbegin 1\nr\nbegin 2\nq\nend\nend"), (8, "begin\nopen"), (9, "begin end\nk\nend"), (10, "begin\nend"), (None, "begin\nz\nend"),
]


@pytest.mark.parametrize(("cut", "name", "want"), [
    (lambda rows: regions.sections(rows, "k", "SUB"), "section", {1: "## Sub ##\nb\n### deep\nc", 5: "### Sub\nlast", 6: "# Sub\nx\n## other\ny"}),
    (lambda rows: regions.marked(rows, "k", "begin", "end"), "region", {7: "r\nbegin 2\nq", 9: "k"}),
])
def test_bounds_of_regions_are_not_a_table_of_their_own(spark, cut, name, want):
    got = cut(regions.lines(spark.createDataFrame(TEXTS, "k int, text string"), "k", "text"))
    assert {r.k: r[name] for r in got.collect()} == want
    assert "Join" not in got._jdf.queryExecution().toString()
