"""Markdown, JSON and media files, and stored graphs, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.sources.files import _normal


def word_count(text: Column) -> Column:
    """Non-empty parts between white space; 0 for null."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))


def markdown_refs(text: Column) -> Column:
    """Distinct link targets, and code spans that hold a dot and no space.

    A link's label ends at the first ``](`` of its line, whatever brackets it holds; targets and
    spans may go over line ends.
    """
    t = F.coalesce(text, F.lit(""))
    links = F.regexp_extract_all(t, F.lit(r"(?d)\[.*?\]\(([^)]+)\)"), 1)
    spans = F.filter(F.regexp_extract_all(t, F.lit(r"`([^`]+)`"), 1), lambda s: s.contains(".") & ~s.contains(" "))
    return F.array_union(links, spans)


def reference_paths(path: Column, text: Column, root: str) -> Column:
    """What the references of a Markdown file stand for: those that start with ``./`` or ``../`` from its folder, others from ``root``."""
    folder = F.regexp_replace(path, "/[^/]*$", "")
    base = lambda r: F.when(r.rlike(r"^\.{1,2}/"), folder).otherwise(F.lit(root))
    return F.array_remove(F.array_distinct(F.transform(markdown_refs(text), lambda r: _normal(F.concat(base(r), F.lit("/"), r)))), path)


def markdown_links(docs: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """``src, dst``: ``explains`` pairs from Markdown files ``(path, text)`` to existing files ``(path)``; self-references are dropped."""
    refs = docs.select(F.col("path").alias("src"), F.explode(reference_paths(F.col("path"), F.col("text"), root)).alias("dst"))
    return refs.join(files.select(F.col("path").alias("dst")), "dst", "left_semi").select("src", "dst").distinct()


def json_key_count(text: Column) -> Column:
    """Keys of the top-level object, or elements of the top-level array; null for bad JSON and plain values."""
    t = F.trim(text)
    return F.when(t.startswith("["), F.json_array_length(t)).otherwise(F.size(F.json_object_keys(t)))


def package_names(path: Column, text: Column) -> Column:
    """Names of the dependencies of a manifest named package.json, for development, too; none of other files and bad JSON."""
    m = F.from_json(text, "dependencies map<string,string>, devDependencies map<string,string>")
    empty = F.array().cast("array<string>")
    names = F.array_union(F.coalesce(F.map_keys(m["dependencies"]), empty), F.coalesce(F.map_keys(m["devDependencies"]), empty))
    return F.when(path.rlike(r"(^|/)package\.json$"), names).otherwise(empty)


def package_imports(files: DataFrame) -> DataFrame:
    """``src, dst``: ``imports`` pairs from manifests ``(path, text)`` to ``import::<name>``."""
    rows = files.select(F.col("path").alias("src"), F.explode(package_names(F.col("path"), F.col("text"))).alias("n"))
    return rows.select("src", F.concat(F.lit("import::"), "n").alias("dst"))


COMMUNITY_SCHEMA = "struct<communities:array<struct<id:int,members:array<string>,nodes:array<string>>>>"
_NODE_KEYS = {"id": "id", "type": "type", "name": "name", "file": "file", "startLine": "start_line", "endLine": "end_line", "external": "external", "unresolved": "unresolved", "placeholder": "placeholder", "deprecated": "deprecated", "doc": "doc", "message": "message", "author": "author", "date": "commit_date"}
_NODE_TYPES = {"startLine": "int", "endLine": "int", "external": "boolean", "unresolved": "boolean", "placeholder": "boolean", "deprecated": "boolean"}


def load_graph_json(spark: SparkSession, path: str):
    """A stored graph document as ``(Graph, memberships(id, community))``.

    The first node row of an id counts; edges need both ends and differ in them; repeated edges
    stay, ``relation`` falls back to ``type``. Whatever else nodes and edges say is in ``meta``, as
    text. A node listed in several communities is in the last.
    """
    from codelattice.model import Graph, norm_id
    from codelattice.operators.merge import keep_sound_edges

    raw = spark.read.schema(f"version string, nodes array<map<string,string>>, edges array<map<string,string>>, analysis {COMMUNITY_SCHEMA}").json(path, multiLine=True)
    rest = lambda m, known: F.map_filter(m, lambda k, v: ~k.isin(*known) & v.isNotNull())
    get = lambda m, k: F.try_element_at(m, F.lit(k))
    n = raw.select(F.posexplode("nodes").alias("ord", "n")).where(get("n", "id").isNotNull())
    ids = {"id", "file"}
    cols = [(norm_id(get("n", k)) if k in ids else get("n", k).cast(_NODE_TYPES.get(k, "string"))).alias(v) for k, v in _NODE_KEYS.items()]
    n = n.select(F.col("ord").cast("long"), *cols, rest(F.col("n"), _NODE_KEYS).alias("meta"))
    n = n.groupBy("id").agg(F.min_by(F.struct(*[c for c in n.columns if c != "id"]), "ord").alias("_n")).select("id", "_n.*")
    e = raw.select(F.posexplode("edges").alias("ord", "e"))
    e = e.select(
        norm_id(get("e", "source")).alias("src"), norm_id(get("e", "target")).alias("dst"), F.coalesce(get("e", "relation"), get("e", "type")).alias("relation"), get("e", "confidence").alias("confidence"),
        rest(F.col("e"), ("source", "target", "relation", "type", "confidence")).alias("meta"), F.col("ord").cast("long"),
    )
    c = raw.select(F.posexplode("analysis.communities").alias("k", "c")).select("k", F.col("c.id").alias("community"), F.explode(F.coalesce("c.members", "c.nodes")).alias("id"))
    part = c.groupBy(norm_id("id").alias("id")).agg(F.max_by("community", "k").alias("community"))
    return Graph(n, keep_sound_edges(e.where("src <> dst"), n)), part


def save_graph(g, path: str) -> None:
    """The graph as two Parquet tables, which is the store; the commit protocol makes it all or nothing per table.

    Nodes get their degrees, so reads need not count edges; both tables are sorted by id, so that
    the statistics of a file's parts keep lookups from reading all of them.
    """
    from codelattice.model import Graph
    from codelattice.operators.measure import in_out_degrees

    nodes = g.nodes.drop("indeg", "outdeg", "degree")
    nodes = nodes.join(in_out_degrees(Graph(nodes, g.edges)), "id", "left").withColumn("degree", F.col("indeg") + F.col("outdeg"))
    nodes.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(f"{path}/nodes")
    g.edges.repartitionByRange("dst", "src").sortWithinPartitions("dst", "src").write.mode("overwrite").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str):
    from codelattice.model import Graph

    return Graph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))


def export_graph_json(g, path: str) -> None:
    """The graph as lines of JSON in two folders, written where the rows are; any reader of JSON lines can take them."""
    g.nodes.write.mode("overwrite").json(f"{path}/nodes", ignoreNullFields=True)
    g.edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), "relation", "confidence").write.mode("overwrite").json(f"{path}/edges")


def export_graph_document(g, path: str, part: DataFrame | None = None, version: str = "1.0.0") -> None:
    """The graph as one JSON document in the folder ``path``, readable by ``load_graph_json``: nodes, edges and, with ``part``, communities.

    One task writes it, row after row, since it is one file; for large graphs ``save_graph`` is the store.
    """
    import pyarrow as pa

    from codelattice.operators.measure import numbered

    keys = [(k, v) for k, v in _NODE_KEYS.items() if v in g.nodes.columns]
    line = lambda *cols: F.to_json(F.struct(*cols))
    nodes = numbered(g.nodes, "ord", "id").select(F.lit(0).alias("k"), F.col("pos").alias("i"), line(*[F.col(v).alias(k) for k, v in keys]).alias("t"))
    edges = numbered(g.edges, "ord", "src", "dst").select(F.lit(1).alias("k"), F.col("pos").alias("i"), line(F.col("src").alias("source"), F.col("dst").alias("target"), "relation", "confidence").alias("t"))
    rows = nodes.unionByName(edges)
    if part is not None:
        from codelattice.operators.community import cohesion

        members = part.groupBy("community").agg(F.sort_array(F.collect_list("id")).alias("members"))
        c = numbered(cohesion(g, part).join(members, "community"), F.desc("n"), "community")
        rows = rows.unionByName(c.select(F.lit(2).alias("k"), F.col("pos").alias("i"), line(F.col("pos").alias("id"), F.col("n").alias("nodeCount"), "cohesion", "members").alias("t")))
    heads = ['{"version": "' + version + '", "nodes": [', '], "edges": [', '], "analysis": {"communities": [']

    def write(batches):
        at, first = -1, True
        for b in batches:
            out = []
            for k, t in zip(b.column("k").to_pylist(), b.column("t").to_pylist()):
                while at < k:
                    at += 1
                    out.append(heads[at])
                    first = True
                out.append(("" if first else ",") + t)
                first = False
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
        rest = heads[at + 1 : 2] + (["]}"] if at < 2 else ["]}}"])
        yield pa.RecordBatch.from_arrays([pa.array(rest, pa.string())], ["value"])

    rows.repartition(1).sortWithinPartitions("k", "i").mapInArrow(write, "value string").write.mode("overwrite").text(path)

