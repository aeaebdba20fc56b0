import pytest

from quernstone.sources import extract as x

PAGE = """<main><ul><li>One</li><li id="two">Two</li></ul>
<table id="prices"><tr><td>7</td></tr></table>
<p>Some <a href="/more">more</a></p><div><span>plain</span></div></main>
"""
SHEET = """a:hover { top: 1px; }
a:hover { top: 2px; }
@supports (display: grid) { main { display: grid; } }
@keyframes fade { 0% { left: 0; } 100% { left: 9px; } }
"""


def test_kept_elements_have_the_symbols_of_the_full_profile():
    full, kept = {u[1]: u for u in x.html_units(PAGE)}, x.html_units(PAGE, meaningful=True)
    top = "main[1]"
    assert [u[1] for u in kept] == [top, f"{top}/ul[1]/li#two", f"{top}/table#prices", f"{top}/p[1]/a[1]"]
    assert [u[3] for u in kept] == [None, 0, 0, 0] and len(full) == 11
    assert all(full[u[1]][6] == u[6] for u in kept)
    assert [u[4] for u in kept] == [1, 1, 2, 3] and kept[3][5] == '<a href="/more">'


@pytest.mark.parametrize(("text", "masked"), [
    ("a {{ b }} c", "a _______ c"), ("{% if x %}\r\ny", "          \r\ny"), ("{# n\n #}z", "    \n   z"), ("{{ open", "{{ open"), ("{% open {{ x }}", "{% open _______"),
    ("{% comment %}<i>{{ q }}{% endcomment %}!", " " * 39 + "!"), ("{% comment %}<i>", " " * 13 + "<i>"), ("{% comments %}<i>{% endcomment %}", " " * 14 + "<i>" + " " * 16),
])
def test_template_parts_are_blanked_in_place(text, masked):
    assert x.mask_templates(text) == masked


def test_templates_do_not_make_elements_but_change_hashes():
    assert [u[1] for u in x.html_units("{% for i in list %}<li>{{ i }}</li>{% endfor %}{# <b> #}")] == ["li[1]"]
    assert x.html_units("<li>{{ i }}</li>")[0][6] != x.html_units("<li>{{ j }}</li>")[0][6]
    assert x.html_units("<ul></ol>")[0][-1] and not x.html_units(PAGE)[0][-1]


def test_style_statements_are_numbered_by_label():
    assert [u[1] for u in x.css_units(SHEET, meaningful=True)] == ["a:hover[1]", "a:hover[2]", "@supports (display: grid)[1]", "@keyframes fade[1]"]
    nested = {u[1]: u[2] for u in x.css_units(SHEET)}
    assert nested["@supports (display: grid)[1] / main[1]"] == "css_rule" and nested["@keyframes fade[1] / 100%[1]"] == "css_keyframe"
    assert x.css_units("b { left: 0; ")[0][-1] and not x.css_units(SHEET)[0][-1]


SOURCE = """
class Point:
    x = 0

class Engine:
    def start(self):
        speed = 0
        speed += 1
        return speed
    def tiny(self):
        return 0
    def __len__(self):
        n = 0
        n += 1
        return n

def _hidden():
    pass

def shown():
    return 2
"""


def test_public_python_units():
    assert [(u[1], u[2]) for u in x.python_units(SOURCE)] == [("Engine", "class"), ("Engine.start", "method"), ("shown", "function")]
    assert x.python_units("class (")[0][-1]


def test_rows_of_a_table(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "page_id long, html string")
    got = x.units(df, "page_id", "html", lambda t: x.html_units(t, meaningful=True))
    assert {r.page_id for r in got.collect()} == {1} and x.summary(got).first().n == 4
