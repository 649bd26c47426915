"""Queries of the sources: file versions, texts and parsed code, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.operators.merge import keep_sound_edges, merge_edges, merge_nodes, resolve_ghosts
from codelattice.scan import linked
from codelattice.session import cut, table
from codelattice.sources import code, files, texts
from codelattice.streaming.incremental import newest_versions


def _newest(s: SparkSession, d: str) -> DataFrame:
    return newest_versions(table(s, d, "source_files"))


def _state(s: SparkSession, d: str) -> DataFrame:
    """What a scan before August 2024 would have kept."""
    return newest_versions(table(s, d, "source_files").where("mtime_ms < 1722470400000")).withColumn("version", F.lit("1"))


def _markdown(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "documents")
    return t.select("doc_id", texts.word_count(F.col("text")).alias("words"), F.size(texts.markdown_refs(F.col("text"))).alias("refs"))


def _fragments(s: SparkSession, d: str) -> DataFrame:
    return cut(code.fragments(_newest(s, d)))


def _extracted(s: SparkSession, d: str, link: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the newest files; with ``link`` imports are led to the files they name."""
    f = _fragments(s, d)
    nodes, edges = linked(f, _newest(s, d).select("path"), []) if link else (code.fragment_nodes(f), code.fragment_edges(f))
    nodes = merge_nodes(nodes)
    return nodes, keep_sound_edges(merge_edges(edges), nodes)


def _definition_lines(s: SparkSession, d: str) -> DataFrame:
    """Symbols that the parser and the stored nodes agree on: same file, name and line."""
    f = code.fragment_nodes(code.fragments(_newest(s, d))).where("start_line > 0").select("file", "name", "start_line", F.col("type").alias("parsed")).distinct()
    n = table(s, d, "nodes").where("start_line > 0 and removed_at is null and name is not null")
    n = n.select(F.translate("file", "\\", "/").alias("file"), "name", "start_line", F.col("type").alias("stored")).distinct()
    return n.join(f, ["file", "name", "start_line"], "left").groupBy("stored", "parsed").agg(F.count("*").alias("n"))


QUERIES = {
    "files_newest": lambda s, d: _newest(s, d).select("path", "size", "mtime_ms", "hash"),
    "files_changed": lambda s, d: files.changed_files(_newest(s, d), _state(s, d)).select("path", "size", "mtime_ms"),
    "files_nodes": lambda s, d: files.file_nodes(_newest(s, d)),
    "markdown_stats": _markdown,
    "json_keys": lambda s, d: table(s, d, "events").select("event_id", texts.json_key_count(F.col("props")).alias("keys")),
    "extract_nodes": lambda s, d: _extracted(s, d)[0].select("id", "type", "name", "file", "start_line", "end_line"),
    "extract_edges": lambda s, d: _extracted(s, d)[1].select("src", "dst", "relation", "confidence"),
    "extract_resolved": lambda s, d: resolve_ghosts(*(cut(x) for x in _extracted(s, d, True)))[1].select("src", "dst", "relation", "confidence"),
    "extract_agreement": _definition_lines,
}

_NEW = r"""
WITH v AS (SELECT replace(path, '\', '/') AS path, size, mtime_ms, hash, row_number() OVER (PARTITION BY replace(path, '\', '/') ORDER BY coalesce(mtime_ms, '-inf'::DOUBLE) DESC, coalesce(size, -1) DESC, coalesce(hash, '') DESC) AS rn FROM source_files WHERE path IS NOT NULL),
new AS (SELECT path, size, mtime_ms, hash FROM v WHERE rn = 1),
o AS (SELECT replace(path, '\', '/') AS path, size, mtime_ms, row_number() OVER (PARTITION BY replace(path, '\', '/') ORDER BY mtime_ms DESC, coalesce(size, -1) DESC, coalesce(hash, '') DESC) AS rn FROM source_files WHERE path IS NOT NULL AND mtime_ms < 1722470400000)
"""
SQL = {
    "files_newest": _NEW + "SELECT * FROM new",
    "files_changed": _NEW + "SELECT path, size, mtime_ms FROM new n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.rn = 1 AND o.path = n.path AND o.size = n.size AND o.mtime_ms = n.mtime_ms)",
    "files_nodes": _NEW + r"SELECT path AS id, 'file' AS type, split_part(path, '/', -1) AS name, path AS file, 0 AS start_line, '.' || regexp_extract(path, '\.([^./]+)$', 1) AS extension FROM new",
    "markdown_stats": r"""SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> ''))::INT AS words,
  len(list_distinct(list_concat(regexp_extract_all(coalesce(text, ''), '\[.*?\]\(([^)]+)\)', 1), list_filter(regexp_extract_all(coalesce(text, ''), '`([^`]+)`', 1), lambda s: contains(s, '.') AND NOT contains(s, ' ')))))::INT AS refs FROM documents""",
    "json_keys": "SELECT event_id, len(json_keys(props))::INT AS keys FROM events",
}
