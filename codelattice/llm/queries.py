"""Queries of the text problems and, where SQL can express them, their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.llm import docpairs, leaks, markup, mixing, nonhuman, reading, templates
from codelattice.model import current_rows
from codelattice.session import table


def tokenizer() -> str:
    """The vocabulary file that sizes are counted with: TOKENIZER_PATH, or the one of the box."""
    return os.environ.get("TOKENIZER_PATH", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of markup in each node's doc."""
    return markup.clean_docs(table(spark, d, "nodes")).select("ord", F.explode("elements").alias("element"))


def p3_text(spark: SparkSession, d: str) -> DataFrame:
    """Plain text of each node's doc, with headings, lists, code blocks and formulas told apart."""
    return markup.clean_docs(table(spark, d, "nodes")).select("ord", "text")


def p3_templates(spark: SparkSession, d: str) -> DataFrame:
    """The templates deduced per repository and how many docs have them."""
    slots = templates.template_slots(table(spark, d, "nodes"))
    return slots.groupBy("host", F.array_join("template", " ").alias("template")).agg(F.count("*").alias("docs"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Paths of files that are not hand-written."""
    return nonhuman.nonhuman_files(table(spark, d, "source_files"), table(spark, d, "upstream_files")).select("path")


def p4_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Paths of files that are not hand-written, with the reason."""
    return nonhuman.nonhuman_files(table(spark, d, "source_files"), table(spark, d, "upstream_files"))


def p4_layout(spark: SparkSession, d: str) -> DataFrame:
    """The layout statistics that files are judged by, of each version."""
    return nonhuman.layout_statistics(table(spark, d, "source_files")).select("path", "mtime_ms", *nonhuman.LAYOUT_SQL)


def p5_current(spark: SparkSession, d: str) -> DataFrame:
    """The functions whose current row has a doc."""
    rows = current_rows(table(spark, d, "nodes"), "type", "name", "doc")
    return rows.where("type = 'function' and doc is not null").select("id", "name", F.length("doc").alias("n"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Functions whose doc tells something beyond their name."""
    return docpairs.documented_functions(table(spark, d, "nodes"), table(spark, d, "source_files"))


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Documented functions with their description and code."""
    return docpairs.function_pairs(table(spark, d, "nodes"), table(spark, d, "source_files"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the evaluation items that they give away."""
    return leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_reparameterised(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold an evaluation item with other values in its slots."""
    return leaks.reparameterised_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources that fall short of their share."""
    return mixing.short_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"), tokenizer())


def p8_rows(spark: SparkSession, d: str) -> DataFrame:
    """The chosen documents and how often each is used."""
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"), tokenizer())[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares reached per source."""
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"), tokenizer())[1]


def p8_given_sizes(spark: SparkSession, d: str) -> DataFrame:
    """The plan of the mixture with the given sizes in characters."""
    docs = table(spark, d, "documents").select("doc_id", mixing.folded("source").alias("src"), F.col("n_chars").alias("tokens"))
    plan = mixing.planned(mixing.hashed(docs), table(spark, d, "mix_targets"))[0]
    return plan.select("source", "tokens", F.round("wanted", 3).alias("wanted"), "whole", "rest", "short")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """English documents whose prose is demanding."""
    return reading.demanding_documents(table(spark, d, "documents"), table(spark, d, "reading_labels"))


def p9_levels(spark: SparkSession, d: str) -> DataFrame:
    """The reading level of each document."""
    return reading.reading_levels(table(spark, d, "documents"), table(spark, d, "reading_labels"))


QUERIES = {
    "p3_found": p3_found, "p3_text": p3_text, "p3_templates": p3_templates, "p4_found": p4_found, "p4_kinds": p4_kinds, "p4_layout": p4_layout, "p5_found": p5_found, "p5_pairs": p5_pairs, "p5_current": p5_current,
    "p7_found": p7_found, "p7_reparameterised": p7_reparameterised, "p8_found": p8_found, "p8_rows": p8_rows, "p8_shares": p8_shares, "p8_given_sizes": p8_given_sizes, "p9_found": p9_found, "p9_levels": p9_levels,
}
#: The others parse, tokenize, align or fit, which SQL cannot say; tests/llm holds their brute-force and round-trip tests.
SQL: dict[str, str] = {
    "p4_layout": r"""SELECT path, mtime_ms, length(content)::INT AS n, CASE WHEN content IS NOT NULL THEN coalesce(len(l), 0)::INT END AS n_lines, CASE WHEN content IS NOT NULL THEN coalesce(list_sum(list_transform(l, lambda x: length(x))), 0)::INT END AS line_chars,
  CASE WHEN content IS NOT NULL THEN coalesce(list_max(list_transform(l, lambda x: length(x))), 0)::INT END AS max_line,
  length(regexp_replace(content, '[^ \n\t\r]', '', 'g'))::INT AS space, length(regexp_replace(content, '[^0-9]', '', 'g'))::INT AS digits
FROM (SELECT *, list_filter(string_split(content, chr(10)), lambda x: regexp_matches(x, '\S')) AS l FROM source_files)""",
    "p5_current": r"""SELECT id, name, length(doc)::INT AS n FROM (SELECT replace(id, '\', '/') AS id, type, name, doc, row_number() OVER (PARTITION BY replace(id, '\', '/') ORDER BY scanned_at DESC, ord DESC) AS rn FROM nodes WHERE id IS NOT NULL)
WHERE rn = 1 AND type = 'function' AND doc IS NOT NULL""",
    "p8_given_sizes": """WITH d AS (SELECT lower(trim(source, E' \\t\\n\\r')) AS src, n_chars FROM documents),
t AS (SELECT source, lower(trim(source, E' \\t\\n\\r')) AS src, target_share, max_repeats FROM mix_targets WHERE source IS NOT NULL),
h AS (SELECT t.source, target_share, max_repeats, coalesce(sum(n_chars), 0)::BIGINT AS tokens FROM t LEFT JOIN d USING (src) GROUP BY ALL),
w AS (SELECT *, target_share * sum(tokens) OVER () AS wanted FROM h),
f AS (SELECT *, least(CASE WHEN tokens > 0 THEN floor(wanted / tokens) ELSE 0 END, max_repeats)::INT AS whole FROM w)
SELECT source, tokens, round(wanted, 3) AS wanted, whole, (CASE WHEN whole < max_repeats THEN floor(wanted - whole * tokens) ELSE 0 END)::BIGINT AS rest, max_repeats * tokens < wanted AS short FROM f""",
}
