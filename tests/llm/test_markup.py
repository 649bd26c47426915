import pytest

from codelattice.llm.comments import strip_marks
from codelattice.llm.markup import clean_docs, convert

PLAIN = [
    "Holds when a < b && b > c, else the field is kept.", "Expects std::vector<int> or a slice &mut [u8].", "Accepts a List<String> or a Map<K, V>, never null.",
    "Format is {0}: {1} with one voucher per line.", "Speed is about 2^278 ops, i.e. fine for a cell.", "The # of routes may exceed 82; item #82 is special.",
    "Same as passing --no-cache and -j 455 on the command line.", r"Uses the regular expression \d+\s*[a-z]_ to find the path.", "Environment variables such as $HOME and $TMP are left alone.",
    "Fees between $5 and $10 are charged per slot.", r"True if a == b or the histogram holds C:\temp\new.", "Calls handlers[i](event) for each author in turn.",
    "Reads snake_case_field_names and kebab-case keys as they are.", "Computes x * y * z with at most 64 bits.", "Shifts by 3 << 2 and masks with 0xff & ~mask.", "+-+-+-+-+-+-+", "; ; ; ; ;",
    "@param x the one to use\n:param y: another\n@returns {@link Foo}", "::::::::::\n::::::::::", "Args:\n    x: the x\nReturns:\n    y",
]
MARKED = {
    "# Top": {"heading"}, "Top\n===": {"heading"}, "== Top ==": {"heading"}, "<h2 class='x'>Top</h2>": {"heading"}, r"\subsection*{Top}": {"heading"}, "### Top ###": {"heading"},
    "* one": {"list"}, "1. one\n2. two": {"list"}, "<ul><li>a</li></ul>": {"list"}, "<OL>\n<LI>a\n<LI>b\n</OL>": {"list"}, "\\begin{itemize}\n\\item a\n\\end{itemize}": {"list"}, "- [x] done": {"list"}, "** deep": {"list"},
    "```c\n# not *a* heading\n```": {"code"}, "~~~\nx\n~~~": {"code"}, "<pre><code>a < b\n</code></pre>": {"code"}, "{{{\n'''x'''\n}}}": {"code"}, "\\begin{lstlisting}\nx_1\n\\end{lstlisting}": {"code"}, '<syntaxhighlight lang="c">\n<b>\n</syntaxhighlight>': {"code"},
    "$$ x_i^2 $$": {"formula"}, r"so \(k^{2}\) it is": {"formula"}, r"\[ d \leq 4 \]": {"formula"}, r"Cost: $O(n \log n)$ per path.": {"formula"}, "<math><mi>x</mi></math>": {"formula"}, "\\begin{equation}\nq\n\\end{equation}": {"formula"},
    "a **b** c": {"other"}, "a _b_ c": {"other"}, "See [x](y.md) now": {"other"}, "[[a|b]]": {"other"}, "`x` it": {"other"}, "a &amp; b": {"other"}, "<b>x</b>": {"other"}, "<br/>": {"other"}, "> quote": {"other"}, "|a|b|\n|---|---|\n|1|2|": {"other"},
    "'''x''' y": {"other"}, r"\emph{x} y": {"other"}, r"About 5\% of it": {"other"}, "{{warning|slow}}": {"other"}, "~~x~~ y": {"other"}, "<!-- x -->y": {"other"}, "![a](b.png)": {"other"}, '{| class="g"\n| a || b\n|}': {"other"},
    "# A\n\n* `b`\n\n$x_1$\n\n```\nc\n```": {"heading", "list", "other", "formula", "code"},
}


@pytest.mark.parametrize("doc", PLAIN)
def test_look_alikes(doc):
    assert convert(doc)[1] == []
    assert convert(doc)[0].split() == doc.split()


@pytest.mark.parametrize("doc", MARKED)
def test_kinds(doc):
    assert set(convert(doc)[1]) == MARKED[doc]
    raw = "/**\n" + "\n".join(f" * {x}" for x in doc.split("\n")) + "\n */"
    assert set(convert(raw)[1]) == MARKED[doc], raw


def test_plain_text():
    got = convert("Top\n===\n\n* <b>one</b> &lt;x&gt;\n* [two](a.md)\n\n<pre>\nif (a*b) x\n</pre>\n\nSo \\(k^2\\).")[0]
    assert got == "# Top\n\n- one <x>\n- two\n\n```\nif (a*b) x\n```\n\nSo $k^2$."
    assert convert(got)[0] == got  # a second pass changes nothing


def test_marks_of_comments():
    assert strip_marks("/**\n * a\n *\n * * b\n */") == "a\n\n* b" and strip_marks("/// a\n/// b") == "a\nb" and strip_marks("* a\n* b") == "* a\n* b" and strip_marks("/* a */") == "a"


def test_table(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "  \n ", "x"), (4, "# A", "x"), (4, "# A", "x"), (5, "*x* " * 100_000, "x"), (6, "<" * 50_000, "x"), (7, "$" * 20_000 + "`" * 20_001, "x")]
    df = spark.createDataFrame(rows, "ord long, doc string, text string")  # "text" is also a column of the result
    got = [(r["ord"], tuple(r["elements"])) for r in clean_docs(df).collect()]
    assert sorted(got)[:4] == [(2, ()), (3, ()), (4, ("heading",)), (4, ("heading",))] and (5, ("other",)) in got and (6, ()) in got
    assert clean_docs(df.limit(0)).count() == 0
