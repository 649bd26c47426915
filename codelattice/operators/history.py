"""Commits of symbols: blame lines meet symbol ranges, commits meet their metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelattice.functions.text import base_name, file_part
from codelattice.model import norm_id

BLOCK = 64  # lines; ranges meet lines by (file, block of lines), so a long file is many small groups
# Files whose history says nothing about code.
LOCK_FILES = (
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "bun.lockb", "shrinkwrap.json", "npm-shrinkwrap.json", "Gemfile.lock", "Cargo.lock", "Pipfile.lock",
    "poetry.lock", "composer.lock", "packages.lock.json", "CHANGELOG.md", "CHANGELOG.txt", "go.sum", "uv.lock", "gradle.lockfile",
)


def parse_blame(text: DataFrame) -> DataFrame:
    """``file, line, hash`` from ``(file, pos, value)`` lines of porcelain blame; the last header of a line counts."""
    head = text.select("file", "pos", F.regexp_extract("value", r"^([0-9a-f]{40}) \d+ (\d+)", 1).alias("hash"), F.regexp_extract("value", r"^([0-9a-f]{40}) \d+ (\d+)", 2).alias("line"))
    return head.where("hash <> ''").groupBy("file", F.col("line").cast("int").alias("line")).agg(F.max_by("hash", "pos").alias("hash"))


def parse_commits(text: DataFrame, mark: str = "<<field>>") -> DataFrame:
    """``hash, author, date, message`` from ``(value)`` records: hash, author, ISO date and body, parted by ``mark``."""
    part = lambda k: F.trim(F.split_part("value", F.lit(mark), F.lit(k)))
    rows = text.select(part(1).alias("hash"), part(2).alias("author"), part(3).alias("date"), part(4).alias("message"))
    return rows.where(F.col("hash").rlike("^[0-9a-f]{40}$"))


def enrichable(nodes: DataFrame) -> DataFrame:
    """``id, file, whole, first, last`` of the nodes whose lines have a history.

    Not external, no commit; symbols by their lines (no start, no history), files and media
    wholly, lock files not at all.
    """
    whole = F.col("type").isin("file", "media")
    n = nodes.where(~F.coalesce("external", F.lit(False)) & (F.col("type") != "intent"))
    n = n.select("id", file_part(F.col("id")).alias("file"), whole.alias("whole"), F.col("start_line").alias("first"), F.coalesce("end_line", "start_line").alias("last"))
    return n.where((F.col("whole") & ~base_name(F.col("file")).isin(*LOCK_FILES)) | (~F.col("whole") & (F.col("first") > 0)))


def symbol_commits(nodes: DataFrame, blame: DataFrame, tracked: DataFrame | None = None) -> DataFrame:
    """``id, hash, line``: the distinct commits of each node's lines, with the first such line.

    Uncommitted lines (hashes starting with eight zeros) are left out, and with ``tracked(file)``
    all files but these. Whole files need no range: their commits are one aggregation.
    """
    lines = blame.where(~F.col("hash").startswith("00000000") & F.col("file").isNotNull()).select(norm_id("file").alias("file"), "line", "hash")
    if tracked is not None:
        lines = lines.join(tracked.select(norm_id("file").alias("file")).distinct(), "file", "left_semi")
    n = enrichable(nodes)
    files = lines.groupBy("file", "hash").agg(F.min("line").alias("line")).join(n.where("whole").select("id", "file"), "file").select("id", "hash", "line")
    block = lambda c: F.floor(F.col(c) / BLOCK).cast("int")
    ranges = n.where("not whole and last >= first").withColumn("block", F.explode(F.sequence(block("first"), block("last"))))
    keyed = lines.withColumn("block", block("line"))
    hits = ranges.join(keyed, ["file", "block"]).where("line between first and last")
    return files.unionByName(hits.groupBy("id", "hash").agg(F.min("line").alias("line")))


def missing_commits(hashes: DataFrame, commits: DataFrame) -> DataFrame:
    """``hash`` without metadata."""
    return hashes.select("hash").where("hash is not null").distinct().join(commits.select("hash"), "hash", "left_anti")


def commit_graph(nodes: DataFrame, edges: DataFrame, links: DataFrame, commits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Commit nodes and ``explains`` edges to add for ``links(id, hash)``; pairs that exist are left out.

    Commits without metadata are skipped; repeated metadata counts once, the first in order of date.
    """
    meta = commits.where("hash is not null").groupBy("hash").agg(F.min(F.struct("commit_date", "message", "author")).alias("_m")).select("hash", "_m.*")
    known = links.join(meta.select("hash"), "hash")
    new = meta.join(known.select("hash").distinct(), "hash", "left_semi").select(
        F.concat(F.lit("commit::"), "hash").alias("id"), F.lit("intent").alias("type"), F.concat(F.lit("Commit "), F.substring("hash", 1, 7)).alias("name"),
        F.lit("").alias("file"), F.lit(0).alias("start_line"), "message", "author", "commit_date",
    )
    pairs = known.select(F.concat(F.lit("commit::"), "hash").alias("src"), F.col("id").alias("dst")).distinct()
    pairs = pairs.join(edges.select("src", "dst"), ["src", "dst"], "left_anti")
    return new.join(nodes.select("id"), "id", "left_anti"), pairs.withColumns({"relation": F.lit("explains"), "confidence": F.lit("EXTRACTED")})
