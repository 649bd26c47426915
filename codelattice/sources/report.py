"""Report tables, their Markdown, and the text lines of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelattice.functions.text import fixed1
from codelattice.model import Graph
from codelattice.operators import measure as M


def file_members(g: Graph, files: int = 100, members: int = 5) -> DataFrame:
    """``file, pos, member, more``: the first members that each of the first files defines, and how many more there are.

    External ones count among the first files, but have no rows. The files are a bounded list; per
    file a running top is kept by the window, not the whole group.
    """
    first = g.nodes.where(F.col("type") == "file").orderBy("ord", "id").limit(files)
    if "external" in first.columns:
        first = first.where(~F.coalesce("external", F.lit(False)))
    first = first.select(F.col("id").alias("src"))
    e = g.edges.where(F.col("relation") == "defines").join(F.broadcast(first), "src")  # ``files`` rows
    e = e.join(g.nodes.select(F.col("id").alias("dst"), "name"), "dst").select(F.col("src").alias("file"), F.coalesce("name", "dst").alias("member"), "ord", "dst")
    total = e.groupBy("file").agg(F.greatest(F.count("*") - members, F.lit(0)).alias("more"))
    pos = F.row_number().over(Window.partitionBy("file").orderBy("ord", "dst"))
    return e.withColumn("pos", pos).where(F.col("pos") <= members).join(total, "file").select("file", "pos", "member", "more")


def community_tops(g: Graph, part: DataFrame, top: int = 5) -> DataFrame:
    """``community, pos, id``: the most connected real members of each community."""
    i = F.col("id")
    real = ~(i.startswith("commit::") | i.startswith("import::") | i.startswith("unresolved_"))
    rows = part.where(real).join(M.with_degree(g).select("id", "degree", "ord"), "id")
    pos = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("degree"), "ord", "id"))
    return rows.withColumn("pos", pos).where(F.col("pos") <= top).select("community", "pos", "id")


def recent_commits(nodes: DataFrame, top: int = 50) -> DataFrame:
    """``pos, id, author, commit_date, subject``: commits by date as text, latest first; without date none."""
    order = [F.desc("commit_date"), F.asc("ord"), F.asc("id")]
    rows = nodes.where((F.col("type") == "intent") & F.col("commit_date").isNotNull()).orderBy(*order).limit(top)
    return rows.select(F.row_number().over(Window.orderBy(*order)).alias("pos"), "id", "author", "commit_date", F.split_part("message", F.lit("\n"), F.lit(1)).alias("subject"))


def report_markdown(g: Graph, part: DataFrame, sur: DataFrame, questions: DataFrame, files: int = 100) -> str:
    """A readable report; every section is a bounded list, so what is collected is bounded, too.

    Communities are listed while they have more than one member, at most ``files`` of them.
    """
    from codelattice.operators.community import cohesion

    size = M.graph_size(g).first()
    out = ["# Graph report", "", f"{size['n_nodes']} nodes, {size['n_edges']} edges", "", "## Files"]
    for r in file_members(g, files).groupBy("file", "more").agg(F.sort_array(F.collect_list(F.struct("pos", "member"))).alias("m")).orderBy("file").collect():
        out.append(f"- {r['file']}: " + ", ".join(x["member"] for x in r["m"]) + (f" and {r['more']} more" if r["more"] else ""))
    if (n := g.nodes.where("type = 'file'").count()) > files:
        out.append(f"- and {n - files} more files")
    out += ["", "## Most connected"] + [f"{r['rank']}. {r['name']} ({r['type']}): {r['degree']}" for r in M.god_nodes(g).orderBy("rank").collect()]
    tops = community_tops(g, part).join(g.nodes.select("id", "name"), "id").groupBy("community").agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("name", "id").alias("name")))).alias("top"))
    big = cohesion(g, part).where("n > 1").orderBy(F.desc("n"), "community").limit(files)
    out += ["", "## Communities", f"{part.select('community').distinct().count()} communities"]
    for r in big.join(tops, "community", "left").orderBy(F.desc("n"), "community").collect():
        names = [x["name"] for x in r["top"] or []]
        out.append(f"- {r['community']} ({r['n']} nodes, cohesion {r['cohesion']}): " + ", ".join(names) + (f" and {r['n'] - len(names)} more" if r["n"] > len(names) else ""))
    out += ["", "## Surprises"] + [f"- {r['src']} -> {r['dst']}: {r['why']}" for r in sur.orderBy(F.desc("score"), "src").limit(10).collect()]
    out += ["", "## Gaps"] + [f"- {r['id']}" for r in M.knowledge_gaps(g).orderBy("ord", "id").limit(10).collect()]
    out += ["", "## Questions"] + [f"- {r['question']}" for r in questions.orderBy("pos").collect()]
    if {"commit_date", "message"} <= set(g.nodes.columns):
        out += ["", "## Recent commits"] + [f"- {r['id'].removeprefix('commit::')[:7]} {r['subject'] or ''}" for r in recent_commits(g.nodes).orderBy("pos").collect()]
    return "\n".join(out) + "\n"


def stats_text(g: Graph, n_communities: int) -> str:
    """Counts and confidence shares; percents with one decimal of the exact value, half up."""
    size = M.graph_size(g).first()
    got = {r["confidence"]: r for r in M.confidence_breakdown(g.edges).collect()}
    lines = [f"Nodes: {size['n_nodes']}", f"Edges: {size['n_edges']}", f"Communities: {n_communities}"]
    for c in ("EXTRACTED", "INFERRED", "AMBIGUOUS"):
        r = got.get(c)
        lines.append(f"{c}: {r['n'] if r else 0} ({fixed1(r['pct']) if r else '0.0'}%)")
    return "\n".join(lines)


def crawl_text(nodes: list[dict], edges: list[dict], mode: str, depth: int, seeds: list[str], budget: int = 2000, found: int | None = None) -> str:
    """Lines of a crawl, cut after three characters (UTF-16 units) per token of the budget; ``found`` counts nodes beyond those that fit, too."""
    head = f"Traversal: {mode.upper()} depth={depth} | Start: [{', '.join(seeds)}] | {len(nodes) if found is None else found} nodes found\n\n"
    lines = [f"NODE {n['name'] or n['id']} [src={n['file'] or ''} loc={n['start_line'] or 0} community={n.get('community', '')}]" for n in nodes]
    lines += [f"EDGE {e['src']} --{e['relation'] or ''}{f' [{c}]' if (c := e['confidence']) else ''}--> {e['dst']}" for e in edges]
    text = head + "\n".join(lines)
    raw = text.encode("utf-16-le")
    if len(raw) // 2 <= budget * 3:
        return text
    return raw[: budget * 6].decode("utf-16-le", "ignore") + f"\n... (truncated to ~{budget} token budget)"
