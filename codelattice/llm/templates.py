"""Template deduction over the docs of one host: tokens with equal occurrence vectors form classes, nested classes a template.

Here a page is one record's doc and a host the repository its file lies in. A token is a tag, a
command, a run of signs (those that begin a line apart) or a word. The occurrence vector of a
token has an entry for each page; two tokens of a host have the same vector if the exclusive or
of hash(page, occurrences) over their pages is the same, so vectors are never collected: one
map-side combined aggregation makes their fingerprints. A class is valid if its tokens come in
one order, repeated as often as they occur, on each of its pages. The template of a page are the
tokens of valid classes whose spans nest, and what lies between them are slots.

Measured against the grammar of ``markup`` in the README: the deduction finds what recurs on the
pages of a host, which is not what marks text up.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelattice.llm.batches import map_rows
from codelattice.llm.comments import strip_marks
from codelattice.model import norm_id

SUPPORT = 3  # pages that a class has to be on
_TOKEN = re.compile(r"</?[A-Za-z][\w-]*|\\[A-Za-z]+(?:\{[A-Za-z]+\*?\})?|[^\w\s<\\]+|[<\\]|\w+")


def tokens(text: str) -> list[str]:
    """The tokens of a page in order; signs that begin a line are marked with ``^``."""
    out = []
    for line in text.split("\n"):
        for k, t in enumerate(_TOKEN.findall(line)):
            out.append("^" + t if k == 0 and not t[0].isalnum() and t[0] != "_" else t)
    return out


def host_of(file: Column) -> Column:
    """The repository of a file: the folder below the root folder."""
    return F.coalesce(F.element_at(F.filter(F.split(file, "/"), lambda x: x != ""), 2), F.lit(""))


def page_tokens(nodes: DataFrame) -> DataFrame:
    """``host, page, token, n, at``: the distinct tokens of each doc, how often and where they stand."""

    def make():
        def run(hosts, pages, docs):
            out = []
            for h, p, d in zip(hosts, pages, docs):
                where: dict[str, list[int]] = {}
                for k, t in enumerate(tokens(strip_marks(d))):
                    where.setdefault(t, []).append(k)
                out += [(h, p, t, len(at), at) for t, at in where.items()]
            return list(map(list, zip(*out))) if out else [[] for _ in range(5)]

        return run

    rows = nodes.where("doc is not null").select(host_of(norm_id("file")).alias("host"), F.col("ord").alias("page"), "doc")
    return map_rows(rows, make, "host string, page bigint, token string, n int, at array<int>")


def equivalence_classes(pages: DataFrame) -> DataFrame:
    """``host, vector, token``: the tokens of the classes of two or more on SUPPORT pages or more."""
    vectors = pages.groupBy("host", "token").agg(F.bit_xor(F.xxhash64("page", "n")).alias("vector"), F.count("*").alias("pages"))
    vectors = vectors.where(F.col("pages") >= SUPPORT)
    many = vectors.groupBy("host", "vector").agg(F.count("*").alias("size")).where("size > 1")
    return vectors.join(many, ["host", "vector"]).select("host", "vector", "token", "pages")


def template_slots(nodes: DataFrame) -> DataFrame:
    """``host, page, vector, template, first, last``: the valid classes on each page, their tokens in order and the span they take.

    A class is valid if on all its pages its tokens, put in order of place, repeat one and the same
    sequence. Classes of a page are few: no more than its tokens.
    """
    pages = page_tokens(nodes)
    classes = equivalence_classes(pages).drop("pages")
    met = pages.join(classes, ["host", "token"]).select("host", "page", "vector", F.explode("at").alias("k"), "token", "n")
    one = met.groupBy("host", "vector", "page").agg(F.array_sort(F.collect_list(F.struct("k", "token"))).alias("seq"), F.first("n").alias("n"))  # of one page
    size = (F.size("seq") / F.col("n")).cast("int")
    head = F.slice(F.col("seq.token"), F.lit(1), size)
    one = one.select("host", "vector", "page", head.alias("template"), (F.col("seq.token") == F.flatten(F.array_repeat(head, F.col("n")))).alias("ordered"), F.element_at("seq.k", 1).alias("first"), F.element_at("seq.k", -1).alias("last"))
    kinds = one.groupBy("host", "vector").agg(F.min("ordered").alias("ordered"), F.count_distinct("template").alias("ways"))
    return one.join(kinds.where("ordered and ways = 1").select("host", "vector"), ["host", "vector"], "left_semi").drop("ordered")


def deduced_markup(nodes: DataFrame) -> DataFrame:
    """``ord`` of the docs whose template holds a sign, tag or command: what the deduction takes for marked up."""
    signs = F.exists("template", lambda t: ~t.rlike(r"^\w+$"))
    return template_slots(nodes).where(signs).select(F.col("page").alias("ord")).distinct()
