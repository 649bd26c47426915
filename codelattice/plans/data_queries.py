"""Queries of the general data problems (orphans, hierarchies, skew) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.operators import hierarchy as H
from codelattice.operators import orphans as O
from codelattice.operators import skew as S
from codelattice.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Unsound ends of edges."""
    return O.orphan_references(table(spark, d, "edges"), table(spark, d, "nodes"), table(spark, d, "externals")).drop("at")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Unsound ends counted per referring table, end, kind and month."""
    return O.orphan_report(table(spark, d, "edges"), table(spark, d, "nodes"), table(spark, d, "externals"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Root and depth of every end of a containment row."""
    return H.hierarchy(H.containment(table(spark, d, "edges"))).select("node_id", "root_id", "depth")


def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    """Full path from the root; null for ends on or below a circle."""
    tree = H.hierarchy(H.containment(table(spark, d, "edges")), with_path=True)
    return tree.select("node_id", "depth", F.array_join("path", " > ").alias("path"))


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every node below every node, with the number of steps."""
    return H.descendants(H.hierarchy(H.containment(table(spark, d, "edges")), with_path=True))


def p2_other_parents(spark: SparkSession, d: str) -> DataFrame:
    """Links to containers beyond the one that counts."""
    return H.other_parents(H.containment(table(spark, d, "edges")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Targets named by at least 1 % of all rows."""
    return S.hot_targets(table(spark, d, "edges"), table(spark, d, "nodes"), table(spark, d, "externals")).select("target")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Rows, callers and degree per target."""
    return S.target_report(table(spark, d, "edges"), table(spark, d, "nodes"), table(spark, d, "externals"))


QUERIES = {
    "p1_found": p1_found, "p1_report": p1_report, "p2_found": p2_found, "p2_paths": p2_paths,
    "p2_descendants": p2_descendants, "p2_other_parents": p2_other_parents, "p6_found": p6_found, "p6_report": p6_report,
}

_P1 = r"""
WITH parents AS (
  SELECT replace(id, '\', '/') AS id, scanned_at AS b, removed_at AS e, coalesce(unresolved, false) AS g FROM nodes WHERE id IS NOT NULL
  UNION ALL SELECT replace(id, '\', '/'), added_at, withdrawn_at, false FROM externals WHERE id IS NOT NULL),
refs AS (
  SELECT ord, 'source' AS endpoint, replace(source, '\', '/') AS id, scanned_at AS t FROM edges WHERE source IS NOT NULL
  UNION ALL SELECT ord, 'target', replace(target, '\', '/'), scanned_at FROM edges WHERE target IS NOT NULL),
asked AS (SELECT DISTINCT id, t FROM refs),
judged AS (
  SELECT a.id, a.t, count(p.id) AS n, bool_and(b > t) AS late,
    count(*) FILTER (b <= t AND NOT coalesce(e <= t, false)) AS live,
    count(*) FILTER (b <= t AND NOT coalesce(e <= t, false) AND NOT g) AS sound
  FROM asked a LEFT JOIN parents p ON a.id = p.id GROUP BY ALL),
found AS (
  SELECT ord, endpoint, CASE WHEN n = 0 THEN 'missing' WHEN live > 0 THEN 'unresolved' WHEN late THEN 'late' ELSE 'deleted' END AS kind, t
  FROM refs JOIN judged USING (id, t) WHERE sound = 0)
"""
_P2 = r"""
WITH RECURSIVE links AS (
  SELECT DISTINCT replace(target, '\', '/') AS v, replace(source, '\', '/') AS p FROM edges
  WHERE type = 'defines' AND source IS NOT NULL AND target IS NOT NULL AND replace(target, '\', '/') <> replace(source, '\', '/')),
walk AS (
  SELECT p AS id, p AS root, 0 AS depth, p AS path, [p] AS ids FROM (SELECT DISTINCT p FROM links WHERE p NOT IN (SELECT v FROM links))
  UNION ALL SELECT l.v, w.root, w.depth + 1, w.path || ' > ' || l.v, list_append(w.ids, l.v) FROM walk w JOIN links l ON l.p = w.id),
up AS (
  SELECT v AS id, p AS above FROM links WHERE v NOT IN (SELECT id FROM walk)
  UNION SELECT up.id, l.p FROM up JOIN links l ON l.v = up.above),
circle AS (SELECT id, above FROM up WHERE above IN (SELECT id FROM up WHERE id = above)),
found AS (
  SELECT id AS node_id, root AS root_id, depth::INT AS depth, path FROM walk
  UNION ALL SELECT id, min(above), -1, NULL FROM circle GROUP BY id)
"""
SQL = {
    "p1_found": _P1 + "SELECT ord, endpoint, kind FROM found",
    "p1_report": _P1 + "SELECT 'edges' AS ref_table, endpoint, kind, strftime(t, '%Y-%m') AS month, count(*) AS n FROM found GROUP BY ALL",
    "p2_found": _P2 + "SELECT node_id, root_id, depth FROM found",
    "p2_paths": _P2 + "SELECT node_id, depth, path FROM found",
    "p2_other_parents": r"""WITH l AS (SELECT DISTINCT replace(target, '\', '/') AS child, replace(source, '\', '/') AS parent FROM edges WHERE type = 'defines' AND replace(target, '\', '/') <> replace(source, '\', '/'))
SELECT * FROM (SELECT child, parent, min(parent) OVER (PARTITION BY child) AS kept FROM l) WHERE parent <> kept""",
    "p2_descendants": _P2
    + "SELECT node_id, descendant_id, steps::INT AS steps FROM (SELECT unnest(ids) AS node_id, id AS descendant_id, depth + 1 - generate_subscripts(ids, 1) AS steps FROM walk) WHERE steps > 0",
    "p6_found": r"SELECT replace(target, '\', '/') AS target FROM edges WHERE target IS NOT NULL GROUP BY 1 HAVING count(*) >= 0.01 * (SELECT count(*) FROM edges)",
    "p6_report": r"""
WITH e AS (SELECT replace(source, '\', '/') AS s, replace(target, '\', '/') AS t FROM edges),
cur AS (SELECT replace(id, '\', '/') AS id, name, type, 0 AS k, row_number() OVER (PARTITION BY replace(id, '\', '/') ORDER BY scanned_at DESC, ord DESC) AS rn FROM nodes WHERE id IS NOT NULL),
known AS (SELECT id, name, type, row_number() OVER (PARTITION BY id ORDER BY k) AS rn
  FROM (SELECT id, name, type, k FROM cur WHERE rn = 1 UNION ALL SELECT replace(id, '\', '/'), name, type, 1 FROM externals WHERE id IS NOT NULL)),
i AS (SELECT t, count(*) AS n, count(DISTINCT s) AS c FROM e WHERE t IS NOT NULL GROUP BY t),
o AS (SELECT s, count(*) AS n FROM e GROUP BY s)
SELECT i.t AS target, k.name, k.type, i.n AS n_rows, i.c AS n_callers, i.n + coalesce(o.n, 0) AS degree
FROM i LEFT JOIN o ON i.t = o.s LEFT JOIN (SELECT * FROM known WHERE rn = 1) k ON k.id = i.t""",
}
