"""Queries of the graph operators over the scanned tables, and their SQL."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.functions.text import terms_of
from codelattice.model import Graph, build_graph
from codelattice.operators import community as C
from codelattice.operators import history as H
from codelattice.operators import lookup as L
from codelattice.operators import measure as M
from codelattice.operators import merge as W
from codelattice.operators import traverse as T
from codelattice.operators import view as V
from codelattice.session import shared_folder, table
from codelattice.sources.texts import load_graph, save_graph

HOT = "falconstack/core::emit"
QUESTION = "How does useStore render the emit, emit?"


def graph(spark: SparkSession, d: str) -> Graph:
    """The graph of the tables in ``d``, built from its rows."""
    return build_graph(table(spark, d, "nodes"), table(spark, d, "edges"), table(spark, d, "externals"))


def stored(spark: SparkSession, d: str) -> Graph:
    """The same, built once for each state of the tables and stored with degrees in the shared folder; reads take it from there.

    The state is what the listing of the tables' files tells: a file that is added, removed or
    written anew makes another graph.
    """
    sc = spark.sparkContext
    files = [f for name in ("nodes", "edges", "externals") for f in table(spark, d, name).inputFiles()]
    hadoop, conf = sc._jvm.org.apache.hadoop.fs, sc._jsc.hadoopConfiguration()
    at = [hadoop.Path(f) for f in sorted(files)]
    status = [p.getFileSystem(conf).getFileStatus(p) for p in at]
    state = sha256("\n".join(f"{p} {s.getLen()} {s.getModificationTime()}" for p, s in zip(at, status)).encode()).hexdigest()[:24]
    path = f"{shared_folder(spark)}/graph-{state}"
    done = hadoop.Path(f"{path}/edges/_SUCCESS")
    if not done.getFileSystem(conf).exists(done):
        save_graph(graph(spark, d), path)
    return load_graph(spark, path)


def partition_by_folder(nodes: DataFrame) -> DataFrame:
    """A stand-in partition: the folder of each scanned node; externals and commits are in none."""
    folder = F.regexp_extract("id", "^(/ws/[^:]*)/[^/:]+", 1)
    return nodes.select("id", folder.alias("community")).where("community <> ''")


def blame(spark: SparkSession, d: str) -> DataFrame:
    """Blame lines made of call sites: their file and line, and a hash that a few lines share."""
    e = table(spark, d, "edges").where("source is not null and caller_line is not null")
    file = F.substring_index(F.translate("source", "\\", "/"), "::", 1)
    block = F.floor(F.col("caller_line") / 20).cast("string")
    return e.select(file.alias("file"), F.col("caller_line").alias("line"), F.sha1(F.concat(file, F.lit(":"), block)).alias("hash")).distinct()


def _g(f):
    return lambda s, d: f(stored(s, d))


def _part(f):
    def run(s, d):
        g = stored(s, d)
        return f(g, partition_by_folder(g.nodes))

    return run


def _ghosts(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    g = stored(s, d)
    return W.resolve_ghosts(g.nodes.drop("indeg", "outdeg", "degree"), g.edges)


def _path(a: str, b: str):
    def run(s, d):
        hops = T.shortest_path(stored(s, d), a, b)
        return s.createDataFrame([(a, b, len(hops) if hops is not None else None)], "src string, dst string, hops int")

    return run


def _questions(s: SparkSession, d: str) -> DataFrame:
    g = stored(s, d)
    count = lambda df: df.agg(F.count("*").alias("n"))
    p = partition_by_folder(g.nodes)
    return C.suggested_questions(count(C.surprises(g, p)), M.god_nodes(g, 1, 1).select("name"), count(M.knowledge_gaps(g)), count(p.select("community").distinct()))


def _seeds(g: Graph) -> DataFrame:
    return T.crawl_seeds(g, QUESTION)


def _members(g: Graph) -> DataFrame:
    from codelattice.sources.report import file_members

    return file_members(g)


def _top5(g: Graph, p: DataFrame) -> DataFrame:
    from codelattice.sources.report import community_tops

    return community_tops(g, p)


def _commits(s: SparkSession, d: str) -> DataFrame:
    from codelattice.sources.report import recent_commits

    return recent_commits(stored(s, d).nodes)


QUERIES = {
    "graph_nodes": lambda s, d: graph(s, d).nodes.select("id", "ord", "type", "name", "file", "start_line"),
    "graph_edges": lambda s, d: graph(s, d).edges,
    "graph_size": _g(M.graph_size),
    "merge_edges_first": lambda s, d: W.merge_edges(table(s, d, "edges").select(F.col("source").alias("src"), F.col("target").alias("dst"), F.col("type").alias("relation"), "confidence", "ord")),
    "merge_nodes_last": lambda s, d: W.merge_nodes(table(s, d, "nodes").where("id is not null").select("id", "ord", "type", "name", "file", "start_line")),
    "merge_nodes_definition": lambda s, d: W.merge_nodes(table(s, d, "nodes").where("id is not null").select("id", "ord", "type", "name", "placeholder", "external"), "prefer_definition").select("id", "type", "name", "ord"),
    "placeholder_nodes": lambda s, d: W.complete_ends(
        table(s, d, "edges").select(F.translate("source", "\\", "/").alias("src"), F.translate("target", "\\", "/").alias("dst")), stored(s, d).nodes
    ).select("id", "name", "file"),
    "degree_all": lambda s, d: M.degrees(stored(s, d).edges),
    "in_out_degree": _g(M.in_out_degrees),
    "god_nodes_top10": _g(M.god_nodes),
    "god_nodes_page2": _g(lambda g: M.god_nodes(g, 2, 10)),
    "god_nodes_no_ghosts": _g(lambda g: M.god_nodes(g, 1, 10, True)),
    "confidence_breakdown": lambda s, d: M.confidence_breakdown(stored(s, d).edges),
    "node_type_counts": lambda s, d: M.type_counts(stored(s, d).nodes),
    "max_degree": lambda s, d: M.degrees(stored(s, d).edges).agg(F.greatest(F.max("degree"), F.lit(1)).alias("max_degree")),
    "hub_threshold": _g(M.hub_threshold),
    "hubs_top50": _g(M.hubs),
    "knowledge_gaps": _g(lambda g: M.knowledge_gaps(g).select("id", "degree")),
    "view_model": _g(M.view_model),
    "view_visible": lambda s, d: V.visible(stored(s, d).nodes.select("id", "type"), partition_by_folder(stored(s, d).nodes), ["intent", "function"], ["/ws/ember-grid-107/lib"]).select("id", "type", "community"),
    "view_suggestions": _g(lambda g: V.suggestions(g, "Merge rust .go", ("intent",))),
    "view_neighbours": _g(lambda g: V.neighbour_list(g, HOT, "in", g.nodes.where("type <> 'class'"))),
    "view_legend": lambda s, d: V.legend(partition_by_folder(stored(s, d).nodes)),
    "search_page": _g(lambda g: L.search(g, "Merge")),
    "search_typed": _g(lambda g: L.search(g, "queue", "class", 1, 15)),
    "search_page3": _g(lambda g: L.search(g, "merge", None, 3, 10)),
    "resolve_exact": _g(lambda g: L.resolve(g, HOT)),
    "resolve_suffix": _g(lambda g: L.resolve(g, "core::emit")),
    "resolve_any_case": _g(lambda g: L.resolve(g, "CORE::Emit")),
    "resolve_part": _g(lambda g: L.resolve(g, "stack/core")),
    "resolve_commit": _g(lambda g: L.resolve(g, "0a")),
    "resolve_typed": _g(lambda g: L.resolve(g, "Context", "struct")),
    "node_lookup": _g(lambda g: L.node_lookup(g, "wharfloom::useStore")),
    "neighbors_in": _g(lambda g: L.neighbors(g, HOT, "in")),
    "neighbors_in_page2": _g(lambda g: L.neighbors(g, HOT, "in", "function", 2, 25)),
    "neighbors_out": _g(lambda g: L.neighbors(g, "import::orchardpress", "out")),
    "ghost_winners": lambda s, d: W.ghost_winners(stored(s, d).nodes),
    "ghost_resolved_edges": lambda s, d: _ghosts(s, d)[1].select("src", "dst", "relation", "confidence"),
    "ghost_resolved_nodes": lambda s, d: _ghosts(s, d)[0].select("id", "type", "name"),
    "community_sizes": lambda s, d: partition_by_folder(stored(s, d).nodes).groupBy("community").agg(F.count("*").alias("n")),
    "cohesion": _part(C.cohesion),
    "surprises_all": _part(lambda g, p: C.surprises(g, p).drop("ord")),
    "surprises_page": _part(lambda g, p: C.surprises_page(g, p, 1, 5)),
    "suggested_questions": _questions,
    "term_scores": _g(lambda g: T.term_scores(g, terms_of(QUESTION)).select("id", "score")),
    "crawl_seeds": _g(_seeds),
    "bfs_levels": _g(lambda g: T.bfs_levels(g, _seeds(g), 3)),
    "crawl_edges": _g(lambda g: T.crawl_edges(g, T.bfs_levels(g, _seeds(g), 2))),
    "dfs_crawl": _g(lambda g: T.dfs_levels(g, _seeds(g), 2)),
    "shortest_path_hops": _path(HOT, "wharfloom::useStore"),
    "shortest_path_far": _path("import::orchardpress", "zephyrport::Result"),
    "report_members": _g(_members),
    "report_communities_top5": _part(_top5),
    "recent_commits": _commits,
    "range_commits": lambda s, d: H.symbol_commits(stored(s, d).nodes, blame(s, d)),
    "missing_commits": lambda s, d: H.missing_commits(
        table(s, d, "nodes").where(F.col("id").startswith("commit::")).select(F.split_part("id", F.lit("::"), F.lit(2)).alias("hash")), table(s, d, "git_commits").where("author is not null")
    ),
    "louvain_partition": _g(C.louvain),
    "louvain_sequential": _g(C.louvain_sequential),
    "communities_by_size": _g(lambda g: C.communities_by_size(C.louvain(g), g)),
    "input_order_nodes": _g(lambda g: C.input_order(g)[0]),
}

_G = r"""
WITH RECURSIVE raw AS (
  SELECT replace(id, '\', '/') AS id, ord, 1 AS rnk, type, name, replace(file, '\', '/') AS file, start_line, end_line, external, message, author, commit_date FROM nodes WHERE id IS NOT NULL
  UNION ALL SELECT replace(id, '\', '/'), 1000000000000, 0, type, name, NULL, NULL, NULL, true, NULL, NULL, NULL FROM externals WHERE id IS NOT NULL),
gn AS (SELECT id, mo AS ord, type, name, file, start_line, end_line, external, message, author, commit_date FROM (
  SELECT * EXCLUDE (ord), ord AS o, min(ord) OVER (PARTITION BY id) AS mo, row_number() OVER (PARTITION BY id ORDER BY rnk DESC, coalesce(type <> 'file', false) DESC,
    CASE WHEN coalesce(type <> 'file', false) THEN ord ELSE -ord END DESC) AS rn FROM raw) WHERE rn = 1),
e0 AS (SELECT replace(source, '\', '/') AS src, replace(target, '\', '/') AS dst, type AS relation, confidence, ord FROM edges),
ge AS (SELECT src, dst, relation, confidence, ord FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY ord) AS rn FROM e0 WHERE src <> dst)
  WHERE rn = 1 AND src IN (SELECT id FROM gn) AND dst IN (SELECT id FROM gn)),
deg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM ge UNION ALL SELECT dst FROM ge) GROUP BY id),
nd AS (SELECT gn.*, coalesce(degree, 0) AS degree FROM gn LEFT JOIN deg USING (id)),
clean AS (SELECT * FROM nd WHERE NOT (coalesce(type = 'intent', false) OR starts_with(id, 'import::') OR starts_with(id, 'unresolved_'))),
thr AS (SELECT greatest(50, degree) AS t FROM (SELECT degree, row_number() OVER (ORDER BY degree) AS rn, count(*) OVER () AS n FROM nd) WHERE rn = floor(n * 0.99) + 1),
part AS (SELECT id, regexp_extract(id, '^(/ws/[^:]*)/[^/:]+', 1) AS community FROM gn WHERE regexp_matches(id, '^/ws/[^:]*/[^/:]+')),
"""


def _page(cols: str, source: str, page: int, limit: int, order: str = "degree DESC, ord, id") -> str:
    return f"SELECT rank, {cols} FROM (SELECT *, (row_number() OVER (ORDER BY {order}))::INT AS rank FROM ({source})) WHERE rank > {(page - 1) * limit} AND rank <= {page * limit}"


def _q(select: str, more: str = "done AS (SELECT 1)") -> str:
    return _G + more + "\n" + select


def _resolve(symbol: str, type_: str | None = None) -> str:
    low = symbol.lower()
    ends = lambda c, s: f"({c} = '{s}' OR ends_with({c}, '/{s}') OR ends_with({c}, '::{s}'))"
    return _q(
        "SELECT tier, id FROM hit WHERE tier = (SELECT min(tier) FROM hit) ORDER BY CASE WHEN tier >= 4 AND c THEN 0 ELSE 1 END, CASE WHEN tier >= 4 AND NOT c THEN -degree ELSE 0 END, ord, id LIMIT 1",
        f"""hit AS (SELECT * FROM (SELECT id, ord, degree, starts_with(id, 'commit::{low}') AS c, (CASE WHEN id = '{symbol}' THEN 1 WHEN name = '{symbol}' OR {ends("id", symbol)} THEN 2
  WHEN lower(name) = '{low}' OR {ends("lower(id)", low)} THEN 3 WHEN contains(id, '{symbol}') OR contains(coalesce(name, ''), '{symbol}') THEN 4
  WHEN contains(lower(id), '{low}') OR contains(lower(coalesce(name, '')), '{low}') THEN 5 END)::INT AS tier FROM nd {f"WHERE type = '{type_}'" if type_ else ""}) WHERE tier IS NOT NULL)""",
    )


def _search(term: str, type_: str | None = None) -> str:
    return f"SELECT *, degree AS links FROM nd WHERE (contains(lower(id), '{term}') OR contains(lower(coalesce(name, '')), '{term}')) {f"AND type = '{type_}'" if type_ else ''}"


def _neighbors(node: str, here: str, there: str, page: int, limit: int, type_: str | None = None) -> str:
    inner = f"""SELECT x.id, n.name, n.type, relation, confidence, x.ord AS eord, degree FROM (
  SELECT {there} AS id, relation, confidence, ord, row_number() OVER (PARTITION BY {there}, relation ORDER BY ord) AS rn FROM ge WHERE {here} = '{node}') x JOIN nd n USING (id)
  WHERE rn = 1 {f"AND n.type = '{type_}'" if type_ else ""}"""
    return _q(_page("id, name, type, relation, confidence", inner, page, limit, "CASE WHEN type = 'intent' THEN 0 ELSE 1 END, degree DESC, eord, id"))


_SCORE = " + ".join(
    f"(CASE WHEN n = '{t}' OR i = '{t}' THEN 1000.0 WHEN starts_with(n, '{t}') OR starts_with(i, '{t}') THEN 100.0 WHEN contains(n, '{t}') OR contains(i, '{t}') THEN 1.0 ELSE 0 END + CASE WHEN contains(f, '{t}') THEN 0.5 ELSE 0 END)"
    for t in terms_of(QUESTION)
)
_TERMS = f"scored AS (SELECT id, ord, ({_SCORE})::DOUBLE AS score FROM (SELECT id, ord, lower(coalesce(name, '')) AS n, lower(id) AS i, lower(coalesce(file, '')) AS f FROM gn))"
_SEEDS = _TERMS + ", seeds AS (SELECT (row_number() OVER (ORDER BY score DESC, ord, id) - 1)::INT AS pos, id FROM scored WHERE score > 0 ORDER BY score DESC, ord, id LIMIT 3)"


def _bfs(depth: int) -> str:
    return (
        _SEEDS
        + f""", near AS (SELECT src AS u, dst AS v FROM ge UNION SELECT dst, src FROM ge),
open AS (SELECT id FROM nd, thr WHERE degree < t UNION SELECT id FROM seeds),
walk AS (SELECT id, 0 AS depth FROM seeds UNION SELECT v, depth + 1 FROM walk JOIN open USING (id) JOIN near ON u = id WHERE depth < {depth}),
lev AS (SELECT id, min(depth)::INT AS depth, min(depth) < {depth} AND id IN (SELECT id FROM open) AS expanded FROM walk GROUP BY id)"""
    )


def _hops(a: str, b: str) -> str:
    return _q(
        f"SELECT '{a}' AS src, '{b}' AS dst, min(depth)::INT AS hops FROM walk WHERE id = '{b}'",
        f"""near AS (SELECT src AS u, dst AS v FROM ge UNION SELECT dst, src FROM ge),
walk AS (SELECT '{a}' AS id, 0 AS depth UNION SELECT v, depth + 1 FROM walk JOIN near ON u = id WHERE depth < 8 AND NOT EXISTS (SELECT 1 FROM near n2 WHERE n2.u = walk.id AND n2.v = '{b}' AND v <> '{b}'))""",
    )


_GHOSTS = r"""
dirs AS (SELECT *, CASE WHEN NOT contains(coalesce(file, ''), '/') THEN '.' ELSE regexp_replace(file, '/[^/]*$', '') END AS d, regexp_extract(coalesce(file, ''), '[^/](\.[^./]*)$', 1) AS x FROM gn),
won AS (SELECT g.id AS ghost, c.id AS winner, (CASE WHEN c.d = g.d THEN 10 ELSE 0 END + CASE WHEN c.x = g.x THEN 5 ELSE 0 END)::INT AS score,
    row_number() OVER (PARTITION BY g.id ORDER BY CASE WHEN c.d = g.d THEN 10 ELSE 0 END + CASE WHEN c.x = g.x THEN 5 ELSE 0 END DESC, c.ord, c.id) AS rn
  FROM dirs g JOIN dirs c ON c.name = split_part(split_part(g.name, '.', -1), '::', -1)
  WHERE starts_with(g.id, 'unresolved::') AND NOT starts_with(c.id, 'unresolved::') AND c.type IN ('function', 'class', 'type', 'interface', 'enum', 'struct', 'trait', 'macro')),
win AS (SELECT ghost, winner, score FROM won WHERE rn = 1),
moved AS (SELECT src, coalesce(winner, dst) AS dst, relation, confidence, winner IS NOT NULL AS m, ord FROM ge LEFT JOIN win ON dst = ghost WHERE src NOT IN (SELECT ghost FROM win)),
res AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY m, ord) AS rn FROM moved WHERE src <> dst) WHERE rn = 1)"""
_SURPRISE = """
side AS (SELECT part.id, community, name, degree FROM part JOIN clean USING (id)),
cand AS (SELECT e.src, e.dst, relation, confidence, s.community AS a, d.community AS b, ord, s.degree AS sd, d.degree AS dd, s.name AS sn, d.name AS dn, least(s.degree, d.degree) <= 2 AND greatest(s.degree, d.degree) >= 5 AS r
  FROM ge e JOIN side s ON s.id = e.src JOIN side d ON d.id = e.dst WHERE s.community <> d.community AND relation NOT IN ('imports', 'defines')),
sur AS (SELECT src, dst, relation, confidence, a, b, ord, (1 + CASE WHEN relation = 'references' THEN 2 ELSE 0 END + CASE WHEN r THEN 1 ELSE 0 END + CASE confidence WHEN 'AMBIGUOUS' THEN 3 WHEN 'INFERRED' THEN 2 ELSE 0 END)::INT AS score,
  concat_ws('; ', 'bridges community ' || a || ' → community ' || b, CASE WHEN relation = 'references' THEN 'references relationship (deep AST coupling)' END,
    CASE WHEN r THEN 'peripheral node "' || coalesce(CASE WHEN sd <= 2 THEN sn ELSE dn END, 'null') || '" unexpectedly reaches hub "' || coalesce(CASE WHEN sd <= 2 THEN dn ELSE sn END, 'null') || '"' END,
    CASE confidence WHEN 'AMBIGUOUS' THEN 'ambiguous connection — needs verification' WHEN 'INFERRED' THEN 'inferred connection — not explicitly stated in source' END) AS why FROM cand),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY score DESC, ord, src) AS rn FROM sur) WHERE rn = 1)"""
_BLAME = r"""
bl AS (SELECT DISTINCT split_part(replace(source, '\', '/'), '::', 1) AS file, caller_line AS line, sha1(split_part(replace(source, '\', '/'), '::', 1) || ':' || (caller_line // 20)) AS hash FROM edges WHERE source IS NOT NULL AND caller_line IS NOT NULL),
en AS (SELECT id, split_part(id, '::', 1) AS file, type IN ('file', 'media') AS whole, start_line AS a, coalesce(end_line, start_line) AS z FROM gn WHERE NOT coalesce(external, false) AND type <> 'intent'),
rc AS (SELECT en.id, hash, min(line) AS line FROM en JOIN bl USING (file) WHERE whole OR (a > 0 AND line BETWEEN a AND z) GROUP BY en.id, hash)"""

SQL = {
    "graph_nodes": _q("SELECT id, ord, type, name, file, start_line FROM gn"),
    "graph_edges": _q("SELECT src, dst, relation, confidence, ord FROM ge"),
    "graph_size": _q("SELECT (SELECT count(*) FROM gn) AS n_nodes, (SELECT count(*) FROM ge) AS n_edges"),
    "merge_edges_first": "SELECT src, dst, relation, confidence, ord FROM (SELECT source AS src, target AS dst, type AS relation, confidence, ord, row_number() OVER (PARTITION BY source, target ORDER BY ord) AS rn FROM edges WHERE source <> target) WHERE rn = 1",
    "merge_nodes_last": "SELECT id, mo AS ord, type, name, file, start_line FROM (SELECT *, min(ord) OVER (PARTITION BY id) AS mo, row_number() OVER (PARTITION BY id ORDER BY coalesce(type <> 'file', false) DESC, CASE WHEN coalesce(type <> 'file', false) THEN ord ELSE -ord END DESC) AS rn FROM nodes WHERE id IS NOT NULL) WHERE rn = 1",
    "merge_nodes_definition": "SELECT id, mo AS ord, type, name FROM (SELECT *, min(ord) OVER (PARTITION BY id) AS mo, row_number() OVER (PARTITION BY id ORDER BY coalesce(type <> 'file', false) DESC, NOT coalesce(placeholder, false) AND NOT coalesce(external, false) DESC, CASE WHEN coalesce(type <> 'file', false) THEN ord ELSE -ord END DESC) AS rn FROM nodes WHERE id IS NOT NULL) WHERE rn = 1",
    "placeholder_nodes": _q("SELECT DISTINCT id, CASE WHEN contains(id, '::') THEN substr(id, strpos(id, '::') + 2) ELSE id END AS name, split_part(id, '::', 1) AS file FROM (SELECT src AS id FROM e0 WHERE src <> dst UNION ALL SELECT dst FROM e0 WHERE src <> dst) WHERE id NOT IN (SELECT id FROM gn)"),
    "degree_all": _q("SELECT id, degree FROM deg"),
    "in_out_degree": _q("SELECT id, (SELECT count(*) FROM ge WHERE dst = gn.id) AS indeg, (SELECT count(*) FROM ge WHERE src = gn.id) AS outdeg FROM gn"),
    "god_nodes_top10": _q(_page("id, name, type, degree", "SELECT * FROM clean", 1, 10)),
    "god_nodes_page2": _q(_page("id, name, type, degree", "SELECT * FROM clean", 2, 10)),
    "god_nodes_no_ghosts": _q(_page("id, name, type, degree", "SELECT * FROM clean WHERE NOT starts_with(id, 'unresolved::')", 1, 10)),
    "confidence_breakdown": _q("SELECT confidence, n, n * 100.0::DOUBLE / (SELECT count(*) FROM ge) AS pct FROM (SELECT confidence, count(*) AS n FROM ge GROUP BY 1) WHERE confidence IN ('EXTRACTED', 'INFERRED', 'AMBIGUOUS')"),
    "node_type_counts": _q("SELECT type, count(*) AS n FROM gn GROUP BY type"),
    "max_degree": _q("SELECT greatest(max(degree), 1) AS max_degree FROM deg"),
    "hub_threshold": _q("SELECT t AS threshold FROM thr"),
    "hubs_top50": _q("SELECT id, degree FROM nd ORDER BY degree DESC, ord, id LIMIT 50"),
    "knowledge_gaps": _q("SELECT id, degree FROM clean WHERE degree <= 1"),
    "view_model": _q("SELECT id, CASE WHEN rn <= 50 OR n <= 50 THEN coalesce(name, id) ELSE '' END AS label, 10 + 30 * degree / m AS size, type, degree FROM (SELECT *, row_number() OVER (ORDER BY degree DESC, ord, id) AS rn, count(*) OVER () AS n, greatest(max(degree) OVER (), 1) AS m FROM nd)"),
    "view_visible": _q("SELECT id, type, community FROM gn LEFT JOIN part USING (id) WHERE type NOT IN ('intent', 'function') AND coalesce(community, '') <> '/ws/ember-grid-107/lib'"),
    "view_suggestions": _q(
        _page("id, name, type, score", "SELECT id, coalesce(name, id) AS name, type, ord, p + degree * 0.01::DOUBLE AS score FROM pts WHERE p > 0", 1, 10, "score DESC, ord, id"),
        "pts AS (SELECT id, name, type, ord, degree, ("
        + " + ".join(f"CASE WHEN n = '{t}' OR i = '{t}' THEN 1000.0::DOUBLE WHEN starts_with(n, '{t}') OR starts_with(i, '{t}') THEN 100.0 WHEN contains(n, '{t}') OR contains(i, '{t}') THEN 1.0 WHEN contains(f, '{t}') THEN 0.5 ELSE 0 END" for t in ("merge", "rust", ".go"))
        + ") AS p FROM (SELECT *, lower(coalesce(name, id)) AS n, lower(id) AS i, lower(coalesce(file, '')) AS f FROM nd WHERE type <> 'intent'))",
    ),
    "view_neighbours": _q(_page("id, relation, degree", f"SELECT nd.id, type, relation, degree, ge.ord AS eord FROM ge JOIN nd ON nd.id = src WHERE dst = '{HOT}' AND type <> 'class'", 1, 5, "CASE WHEN type = 'intent' THEN 0 ELSE 1 END, degree DESC, eord")),
    "view_legend": _q("SELECT pos, community, n, (pos * 137.5::DOUBLE) % 360 AS hue FROM (SELECT community, n, (row_number() OVER (ORDER BY community) - 1)::INT AS pos FROM (SELECT community, count(*) AS n FROM part GROUP BY 1))"),
    "search_page": _q(_page("id, name, type, file, links", _search("merge"), 1, 20)),
    "search_typed": _q(_page("id, name, type, file, links", _search("queue", "class"), 1, 15)),
    "search_page3": _q(_page("id, name, type, file, links", _search("merge"), 3, 10)),
    "resolve_exact": _resolve(HOT),
    "resolve_suffix": _resolve("core::emit"),
    "resolve_any_case": _resolve("CORE::Emit"),
    "resolve_part": _resolve("stack/core"),
    "resolve_commit": _resolve("0a"),
    "resolve_typed": _resolve("Context", "struct"),
    "node_lookup": _q("SELECT id, name, type, file, start_line AS line, (SELECT count(*) FROM ge WHERE dst = gn.id) AS incoming, (SELECT count(*) FROM ge WHERE src = gn.id) AS outgoing FROM gn WHERE id = 'wharfloom::useStore'"),
    "neighbors_in": _neighbors(HOT, "dst", "src", 1, 20),
    "neighbors_in_page2": _neighbors(HOT, "dst", "src", 2, 25, "function"),
    "neighbors_out": _neighbors("import::orchardpress", "src", "dst", 1, 20),
    "ghost_winners": _q("SELECT ghost, winner, score FROM win", _GHOSTS),
    "ghost_resolved_edges": _q("SELECT src, dst, relation, confidence FROM res", _GHOSTS),
    "ghost_resolved_nodes": _q("SELECT id, type, name FROM gn WHERE id NOT IN (SELECT ghost FROM win)", _GHOSTS),
    "community_sizes": _q("SELECT community, count(*) AS n FROM part GROUP BY 1"),
    "cohesion": _q(
        "SELECT community, n, coalesce(internal, 0) AS internal, CASE WHEN n <= 1 THEN 1.0 ELSE floor(coalesce(internal, 0) / (n * (n - 1))::DOUBLE * 100 + 0.5) / 100 END AS cohesion FROM sz LEFT JOIN ins USING (community)",
        "sz AS (SELECT community, count(*) AS n FROM part GROUP BY 1), ins AS (SELECT a.community, count(*) AS internal FROM ge JOIN part a ON a.id = src JOIN part b ON b.id = dst WHERE a.community = b.community GROUP BY 1)",
    ),
    "surprises_all": _q("SELECT src, dst, relation, confidence, a, b, score, why FROM best", _SURPRISE),
    "surprises_page": _q(_page("src, dst, relation, confidence, a, b, score, why", "SELECT * FROM best", 1, 5, "score DESC, ord, src"), _SURPRISE),
    "suggested_questions": _q(
        """SELECT (row_number() OVER (ORDER BY k) - 1)::INT AS pos, q AS question FROM (
  SELECT 1 AS k, 'Why are these distinct communities connected via Surprising Connections?' AS q WHERE (SELECT count(*) FROM best) > 0
  UNION ALL SELECT 2, 'How would the system react if the core logic in ''' || name || ''' was refactored?' FROM (SELECT name FROM clean ORDER BY degree DESC, ord, id LIMIT 1)
  UNION ALL SELECT 3, 'There are several isolated modules; are these dead code or missing integration tests?' WHERE (SELECT count(*) FROM clean WHERE degree <= 1) > 5
  UNION ALL SELECT 4, 'Are the boundaries between these communities enforced, or is there hidden leakage?' WHERE (SELECT count(DISTINCT community) FROM part) > 1)""",
        _SURPRISE,
    ),
    "term_scores": _q("SELECT id, score FROM scored WHERE score > 0", _TERMS),
    "crawl_seeds": _q("SELECT pos, id FROM seeds", _SEEDS),
    "bfs_levels": _q("SELECT id, depth, expanded FROM lev", _bfs(3)),
    "crawl_edges": _q(
        "SELECT e.src, e.dst, relation, confidence FROM ge e JOIN lev s ON s.id = e.src JOIN lev d ON d.id = e.dst WHERE s.expanded OR (d.expanded AND NOT EXISTS (SELECT 1 FROM ge r WHERE r.src = e.dst AND r.dst = e.src))", _bfs(2)
    ),
    "shortest_path_hops": _hops(HOT, "wharfloom::useStore"),
    "shortest_path_far": _hops("import::orchardpress", "zephyrport::Result"),
    "report_members": _q(
        "SELECT file, pos, member, more FROM (SELECT src AS file, (row_number() OVER (PARTITION BY src ORDER BY e.ord, dst))::INT AS pos, coalesce(m.name, dst) AS member, greatest(count(*) OVER (PARTITION BY src) - 5, 0) AS more FROM ge e JOIN gn m ON m.id = dst WHERE relation = 'defines' AND src IN (SELECT id FROM top)) WHERE pos <= 5",
        "top AS (SELECT id FROM (SELECT id, external FROM gn WHERE type = 'file' ORDER BY ord, id LIMIT 100) WHERE NOT coalesce(external, false))",
    ),
    "report_communities_top5": _q(
        "SELECT community, pos, id FROM (SELECT community, id, (row_number() OVER (PARTITION BY community ORDER BY degree DESC, ord, id))::INT AS pos FROM part JOIN nd USING (id) WHERE NOT (starts_with(id, 'commit::') OR starts_with(id, 'import::') OR starts_with(id, 'unresolved_'))) WHERE pos <= 5"
    ),
    "recent_commits": _q("SELECT (row_number() OVER (ORDER BY commit_date DESC, ord, id))::INT AS pos, id, author, commit_date, split_part(message, chr(10), 1) AS subject FROM (SELECT * FROM gn WHERE type = 'intent' AND commit_date IS NOT NULL ORDER BY commit_date DESC, ord, id LIMIT 50)"),
    "range_commits": _q("SELECT id, hash, line FROM rc", _BLAME),
    "input_order_nodes": _q("SELECT (row_number() OVER (ORDER BY id) - 1)::INT AS pos, id FROM gn"),
    "missing_commits": "SELECT DISTINCT split_part(id, '::', 2) AS hash FROM nodes WHERE starts_with(id, 'commit::') AND split_part(id, '::', 2) NOT IN (SELECT hash FROM git_commits WHERE hash IS NOT NULL AND author IS NOT NULL)",
}
