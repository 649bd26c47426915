"""From a folder to a stored graph: list, parse what changed, link, merge, resolve, add history, store.

Parsed fragments are kept in the store under the hash of what they were made from, commits of
lines under the state of their file; a second scan parses and joins only what is new.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.model import Graph, norm_id
from codelattice.operators import history as H
from codelattice.operators import merge as W
from codelattice.session import cut
from codelattice.sources import code, files, texts

VERSION = "1"  # of parsers; another one parses everything anew
STORE = ".codelattice"
IGNORE_FILES = (".gitignore", ".codelatticeignore")
CONFIGS = ("tsconfig.json", "jsconfig.json")
_FRAGMENT = f"key string, {code.FRAGMENT_SCHEMA}, meta map<string,string>"



@dataclass(frozen=True)
class History:
    """What version control knows: ``blame(file, line, hash)``, ``commits(hash, author, commit_date, message)`` and, if known, ``tracked(file)``."""

    blame: DataFrame
    commits: DataFrame
    tracked: DataFrame | None = None


def table_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at ``path``, None if there is none."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    at = hadoop.Path(path)
    return spark.read.parquet(path) if at.getFileSystem(conf).exists(at) else None


def ignore_patterns(spark: SparkSession, root: str) -> list[str]:
    """The lines of the root folder's ignore files, in order."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for name in IGNORE_FILES:
        at = hadoop.Path(f"{root}/{name}")
        fs = at.getFileSystem(conf)
        if fs.exists(at):
            stream = fs.open(at)
            out += spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()
            stream.close()
    return out


def list_texts(spark: SparkSession, root: str, patterns: list[str] | None = None) -> DataFrame:
    """``path, relative, size, mtime_ms, content`` of the files to scan, ``content`` null for media."""
    rows = files.scan_directory(spark, root, ignore_patterns(spark, root) if patterns is None else patterns)
    media = F.lower(files.extension(F.col("path"))).isin(*files.MEDIA)
    return rows.select("path", "relative", "size", "mtime_ms", F.when(~media, files.decode(F.col("bytes"))).alias("content"))


def aliases_of(listing: DataFrame) -> list[tuple[str, str, int, str]]:
    """The path aliases of all configs below the root; the few config files are read on the driver."""
    named = F.element_at(F.split("path", "/"), -1)
    rows = listing.where(named.isin(*CONFIGS)).select("path", "content").collect()
    return files.alias_table({r["path"]: r["content"] for r in rows})


def parse_files(listing: DataFrame, root: str) -> DataFrame:
    """``key, path, nodes, edges, meta``: each file by the parser of its extension, in any letter case.

    Code goes to the extractors, JSON and Markdown to expressions, media keep their size and time;
    other files have no fragment but their node. ``meta`` has what a parser counts.
    """
    ext = F.lower(files.extension(F.col("path")))
    counts = lambda names, values: F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*values))
    none = F.lit(None).cast("map<string,string>")
    parsed = code.fragments(listing.where(ext.isin(*code.LANGUAGES)), keep=("key",)).withColumn("meta", none)
    base = F.element_at(F.split("path", "/"), -1)
    node = lambda i, name, file, external: F.struct(
        i.alias("id"), F.lit("file").alias("type"), name.alias("name"), file.alias("file"), F.lit(0).alias("start_line"), F.lit(None).cast("int").alias("end_line"),
        F.lit(external).alias("external"), F.lit(None).cast("string").alias("doc"), F.lit(None).cast("boolean").alias("deprecated"),
    )
    edge = lambda target, kind: F.struct(F.col("path").alias("source"), target.alias("target"), F.lit(kind).alias("type"), F.lit("EXTRACTED").alias("confidence"), F.lit(None).cast("int").alias("caller_line"))
    own = F.array(node(F.col("path"), base, F.col("path"), False))
    js = listing.where(ext == "json").withColumn("names", texts.package_names(F.col("path"), F.col("content")))
    js = js.select(
        "key", "path", F.concat(own, F.transform("names", lambda n: node(F.concat(F.lit("import::"), n), n, F.col("path"), True))).alias("nodes"),
        F.transform("names", lambda n: edge(F.concat(F.lit("import::"), n), "imports")).alias("edges"),
        counts(["keyCount"], [texts.json_key_count(F.col("content")).cast("string")]).alias("meta"),
    )
    md = listing.where(ext.isin("md", "mdx")).withColumn("refs", texts.reference_paths(F.col("path"), F.col("content"), root))
    md = md.select(
        "key", "path", own.alias("nodes"), F.transform("refs", lambda r: edge(r, "explains")).alias("edges"),
        counts(["wordCount"], [texts.word_count(F.col("content")).cast("string")]).alias("meta"),
    )
    media = listing.where(ext.isin(*files.MEDIA)).select(
        "key", "path", own.alias("nodes"), F.array().cast(f"array<{code.EDGE_SCHEMA}>").alias("edges"),
        counts(["size", "mtime"], [F.col("size").cast("string"), F.col("mtime_ms").cast("long").cast("string")]).alias("meta"),
    )
    return reduce(lambda a, b: a.unionByName(b), [parsed, js, md, media])


def fragments_of(spark: SparkSession, listing: DataFrame, store: str | None, root: str) -> DataFrame:
    """Fragments of all files: those kept under the same key and path, and the others parsed and kept."""
    path = f"{store}/fragments"
    kept = table_or_none(spark, path) if store else None
    if kept is None:
        kept = spark.createDataFrame([], _FRAGMENT)
    old = kept.dropDuplicates(["key", "path"]).join(listing.select("key", "path"), ["key", "path"], "left_semi")
    new = cut(parse_files(listing.join(kept.select("key", "path"), ["key", "path"], "left_anti"), root))
    if store:
        old = cut(old)
        new.write.mode("append").parquet(path)
    return old.unionByName(new)


def linked(frags: DataFrame, listing: DataFrame, aliases: list[tuple[str, str, int, str]], projects: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the fragments with imports led to the files they name.

    Modules and crates of ``projects`` are looked in first. Imports that no file answers stay packages, but names without a dot in Go are its own library;
    relative documentation links resolve like imports; Markdown references need their file.
    """
    spark = listing.sparkSession
    paths = listing.select("path")
    e = frags.select("path", F.posexplode("edges").alias("k", "e")).select("path", "k", "e.*")
    ext = F.lower(files.extension(F.col("path")))
    markdown = ext.isin("md", "mdx")
    wanted = e.where(F.col("type").isin("imports", "explains") & ~markdown)
    lang = F.create_map(*[F.lit(x) for pair in code.LANGUAGES.items() for x in pair])[ext]
    spec = wanted.select(F.col("path").alias("file"), F.regexp_replace("target", "^import::", "").alias("specifier"), lang.alias("lang")).where("lang is not null").distinct()
    ali = spark.createDataFrame(aliases, "folder string, prefix string, position int, target string")
    scripts = files.resolve_imports(spec.where("lang = 'ts'").select("file", "specifier"), paths, ali)
    others = spec.where("lang <> 'ts'")
    named = files.resolve_modules(others, paths)
    if projects is not None:
        first = cut(files.resolve_projects(others, projects, paths))
        named = first.unionByName(named.join(first.select("file", "specifier"), ["file", "specifier"], "left_anti"))
    resolved = cut(scripts.unionByName(named))
    led = files.link_imports(e.where(~markdown), resolved)
    led = led.withColumns({c: files.base_package(F.col(c), F.col("path")) for c in ("source", "target")})
    own = F.col("type") == "imports"
    dotless = own & F.col("target").startswith("import::") & ~F.split_part(F.regexp_replace("target", "^import::", ""), F.lit("/"), F.lit(1)).contains(".") & F.lower("path").endswith(".go")
    explained = e.where(markdown).join(paths.withColumnRenamed("path", "target"), "target", "left_semi").select(*e.columns)
    out = led.where(~dotless).unionByName(explained).where("source <> target")
    edges = out.select(F.col("source").alias("src"), F.col("target").alias("dst"), F.col("type").alias("relation"), "confidence", "caller_line", F.struct("path", "k").alias("ord"))
    met = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    nodes = frags.select("path", F.posexplode("nodes").alias("k", "n")).select("path", "n.*", F.struct("path", "k").alias("ord"))
    based = files.base_package(F.col("id"), F.col("path"))
    nodes = nodes.withColumns({"name": F.when(based != F.col("id"), F.regexp_replace(based, "^import::", "")).otherwise(F.col("name")), "id": based}).drop("path")
    own = nodes.where("not external")
    return own.unionByName(nodes.where("external").join(met, "id", "left_semi").select(*own.columns)), edges


def merged(nodes: DataFrame, edges: DataFrame) -> Graph:
    """One row per node and pair, placeholders for ends that no fragment has, ghosts led to definitions."""
    n = W.merge_nodes(nodes)
    e = W.merge_edges(edges)
    filled = W.complete_ends(e, n).withColumns({"ord": _last(0), "external": F.lit(False)})
    n = cut(n.withColumn("placeholder", F.lit(False)).unionByName(filled, allowMissingColumns=True))
    e = cut(W.keep_sound_edges(e, n))
    return Graph(*W.resolve_ghosts(n, e))


def with_history(g: Graph, past: History, store: str | None = None) -> Graph:
    """The graph with the commits of its lines.

    With ``store``, the commits of a node whose range and whose file's blame are as an earlier scan
    found them come from there, and so does metadata of commits; only the rest is joined anew.
    """
    spark = g.nodes.sparkSession
    state = past.blame.where("file is not null").groupBy(norm_id("file").alias("file")).agg(F.bit_xor(F.xxhash64("line", "hash")).alias("state"))
    ids = g.nodes.select("id", F.col("start_line").alias("first"), F.col("end_line").alias("last"), F.substring_index("id", "::", 1).alias("file"))
    ids = cut(ids.join(state, "file"))
    kept = table_or_none(spark, f"{store}/blame") if store else None
    todo, links = g.nodes, None
    if kept is not None:
        now = ids.select("id", "state", F.coalesce("first", F.lit(-1)).alias("first"), F.coalesce("last", F.lit(-1)).alias("last"))
        same = cut(kept.where(F.col("version") == VERSION).join(now, ["id", "state", "first", "last"], "left_semi"))
        todo = g.nodes.join(same.select("id").distinct(), "id", "left_anti")
        links = same.where("hash is not null").select("id", "hash", "line")
    open_ = todo.select(F.substring_index("id", "::", 1).alias("file")).distinct()
    fresh = H.symbol_commits(todo, past.blame.withColumn("file", norm_id("file")).join(open_, "file", "left_semi"), past.tracked)
    links = cut(fresh if links is None else fresh.unionByName(links))
    commits = past.commits
    if store:
        rows = ids.join(links, "id", "left").select("id", "state", F.coalesce("first", F.lit(-1)).alias("first"), F.coalesce("last", F.lit(-1)).alias("last"), "hash", "line", F.lit(VERSION).alias("version"))
        cut(rows).write.mode("overwrite").parquet(f"{store}/blame")
        old = table_or_none(spark, f"{store}/commits")
        if old is not None:
            commits = cut(old.unionByName(commits.join(H.missing_commits(commits, old), "hash", "left_semi")))
        commits.write.mode("overwrite").parquet(f"{store}/commits")
    nodes, edges = H.commit_graph(g.nodes, g.edges, links, commits)
    n = g.nodes.unionByName(nodes.withColumns({"ord": _last(1), "external": F.lit(False)}), allowMissingColumns=True)
    return Graph(n, g.edges.unionByName(edges.withColumn("ord", _last(1)), allowMissingColumns=True))


def _last(k: int):
    """A place after those of all files."""
    return F.struct(F.lit("\U0010ffff").alias("path"), F.lit(k).alias("k"))


def scan(spark: SparkSession, root: str, store: str | None = None, past: History | None = None, force: bool = False) -> Graph:
    """The graph of the files below ``root``; with ``store`` (a folder) it is kept there, and what an earlier scan left is used.

    ``force`` parses everything anew. Later reads take it by ``texts.load_graph(spark, store + "/graph")``.
    An empty folder gives an empty graph.
    """
    listing = list_texts(spark, root)
    aliases = aliases_of(listing)
    key = files.content_hash(F.coalesce("content", F.concat_ws("|", F.col("size").cast("string"), F.col("mtime_ms").cast("string"))), F.col("relative"), VERSION, json.dumps(sorted(aliases)))
    listing = cut(listing.withColumn("key", key))
    frags = fragments_of(spark, listing, None if force else store, root)
    seeds = files.file_nodes(listing).withColumn("ord", F.struct(F.lit("").alias("path"), F.lit(0).alias("k"))).drop("extension")
    nodes, edges = linked(frags, listing, aliases, cut(files.find_projects(spark, root)))
    g = merged(nodes.unionByName(seeds, allowMissingColumns=True), edges)
    meta = frags.where("meta is not null").select(F.col("path").alias("id"), "meta")
    g = Graph(g.nodes.join(meta, "id", "left"), g.edges)
    if past is not None:
        g = with_history(Graph(cut(g.nodes), cut(g.edges)), past, store)
    if store:
        texts.save_graph(g, f"{store}/graph")
        return texts.load_graph(spark, f"{store}/graph")
    return g
