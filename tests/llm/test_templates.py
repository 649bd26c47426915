from codelattice.llm import markup
from codelattice.llm import templates as T

NODES = "ord long, file string, doc string, host string, page string"


def test_classes_and_slots_of_pages_made_from_a_template(spark):
    page = lambda a, b: f"<h1>{a}</h1>\n<ul><li>{b}</li></ul>"
    rows = [(k, "/ws/one/a.ts", page(a, b), "x", "y") for k, (a, b) in enumerate([("red", "fox"), ("blue", "cat"), ("pink", "dog"), ("grey", "owl")])]
    rows += [(9, "/ws/two/a.ts", "a word", None, None), (10, None, None, None, None), (11, "/ws/two/b.ts", "", None, None)]
    got = T.template_slots(spark.createDataFrame(rows, NODES)).collect()
    assert {r["page"] for r in got} == {0, 1, 2, 3} and {r["host"] for r in got} == {"one"}
    assert any({"^<h1", "</h1", "<li", "</li"} <= set(r["template"]) for r in got) and not any({"red", "fox"} & set(r["template"]) for r in got)
    assert T.template_slots(spark.createDataFrame([], NODES)).count() == 0


def test_why_markup_needs_a_grammar(spark):
    """The figures of the README: what recurs is not what marks up."""
    nodes = spark.read.parquet("/root/testdata/sf0.01/nodes.parquet")
    deduced = {r["ord"] for r in T.deduced_markup(nodes).collect()}
    marked = {r["ord"] for r in markup.clean_docs(nodes).where("size(elements) > 0").collect()}
    both = len(deduced & marked)
    assert 0.3 < both / len(marked) < 0.8 and 0.5 < both / len(deduced) < 0.9
