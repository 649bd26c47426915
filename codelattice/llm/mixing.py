"""Mixing sources to target shares with hash-threshold histograms.

Every document gets a size in tokens and a 60-bit hash. Tokens are summed by source and hash
bucket; the histogram tells what a source has in all, and so how often it is taken whole and
whether its budget lies beyond its last bucket (it falls short). Otherwise the bucket in which
the budget runs out is found, and only that bucket is cut into finer ones, until it holds one
hash. What remains is a threshold per source: a document is taken if its hash is below it, so
nothing is sorted, and a larger budget takes all that a smaller one takes, and more.

Sizes are made once, in one pass over the texts, and only (id, source, hash, size) go on.
Sums are combined map-side, so a source that holds most rows is at most 4096 sums. What is
sent to all tasks has one row per source of the given targets.
"""

from __future__ import annotations

import base64

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelattice.llm.batches import map_rows
from codelattice.session import cut

#: The pattern the vocabulary was made with (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BITS, LEVELS = 12, 5  # of hash per refinement


def folded(c: str) -> Column:
    """A source's spelling without letter case and surrounding white space; blank counts as null."""
    t = F.lower(F.regexp_replace(F.col(c), r"^[\s ]+|[\s ]+$", ""))
    return F.when(t != "", t)


def token_sizes(documents: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, src, tokens, h`` of each document by the vocabulary file at ``tokenizer``; null texts have no tokens."""
    with open(tokenizer, "rb") as f:
        sent = documents.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file, about a megabyte

    def make():
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, sent.value.splitlines())}
        encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

        def run(ids, sources, texts):
            return ids, sources, [len(encode(t)) if t else 0 for t in texts]

        return run

    rows = documents.select("doc_id", folded("source").alias("src"), "text")
    return hashed(map_rows(rows, make, "doc_id bigint, src string, tokens bigint"))


def hashed(sizes: DataFrame) -> DataFrame:
    """``sizes`` with the hash ``h`` that decides in which order the documents of a source are taken."""
    return sizes.withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - BITS * LEVELS))


def histogram(sizes: DataFrame, sources: DataFrame, shift: int = BITS * (LEVELS - 1)) -> DataFrame:
    """``src, bucket, n, lo, hi``: tokens per bucket of hashes of the ``sources(src)``, with the least and greatest hash; summed map-side."""
    rows = sizes.where("tokens > 0").join(F.broadcast(sources.select("src")), "src")  # one row a target
    return rows.groupBy("src", F.shiftright("h", shift).alias("bucket")).agg(F.sum("tokens").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi"))


def mixture_plan(hist: DataFrame, targets: DataFrame) -> DataFrame:
    """Per row of ``targets``: ``source, src, target_share, max_repeats, tokens, wanted, whole, rest, short``.

    ``wanted`` is the share of all tokens whose source is listed; each document is taken
    ``whole`` times, and ``rest`` tokens remain for a part of them. ``short``: even
    ``max_repeats`` times all tokens is less than wanted. A listed source without documents has
    no tokens; rows with a null source or share, or no repeats, want or give nothing. Targets
    that fold to one spelling would share documents; the first in order of spelling counts.
    """
    t = targets.where("source is not null").select(
        "source", folded("source").alias("src"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"),
        F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("max_repeats"),
    )
    t = t.groupBy("src").agg(F.min_by(F.struct("source", "target_share", "max_repeats"), "source").alias("_t")).select("src", "_t.*")
    have = hist.groupBy("src").agg(F.sum("n").alias("tokens"))
    p = t.join(have, "src", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    wanted = F.col("target_share") * F.sum("tokens").over(Window.partitionBy())  # over the targets: one row a source
    p = p.withColumn("wanted", wanted)
    full = F.when(F.col("tokens") > 0, F.floor(F.col("wanted") / F.col("tokens"))).otherwise(0)
    p = p.withColumn("whole", F.least(full, F.col("max_repeats")).cast("int"))
    rest = F.when(F.col("whole") < F.col("max_repeats"), F.floor(F.col("wanted") - F.col("whole") * F.col("tokens"))).otherwise(0)
    return p.withColumn("rest", rest.cast("bigint")).withColumn("short", F.col("max_repeats") * F.col("tokens") < F.col("wanted"))


def thresholds(sizes: DataFrame, plan: DataFrame, hist: DataFrame) -> DataFrame:
    """``src, below``: per source with a rest the hash below which documents are taken once more.

    The tokens below it are at most the rest, and the next hash would exceed it. Documents of
    one hash go together.
    """
    spark = sizes.sparkSession
    goal = {r["src"]: [r["rest"], 0] for r in plan.where("rest > 0 and tokens > 0").select("src", "rest").collect()}  # one row a source
    done: dict[str, int] = {}
    for level in range(LEVELS):
        if not goal:
            break
        shift = BITS * (LEVELS - 1 - level)
        at = F.broadcast(spark.createDataFrame([(s, r, p) for s, (r, p) in goal.items()], "src string, rest bigint, prefix bigint"))
        if level:  # only the boundary buckets are cut finer
            hist = histogram(sizes.join(at, "src").where(F.shiftright("h", shift + BITS) == F.col("prefix")).select("src", "tokens", "h"), at, shift)
        hist = hist.join(at, "src")
        before = F.sum("n").over(Window.partitionBy("src").orderBy("bucket")) - F.col("n")  # at most 2^BITS rows a source
        edge = hist.withColumn("before", before).where("before <= rest and before + n > rest")
        found = {r["src"]: r for r in edge.collect()}  # one row a source
        for s in list(goal):
            r = found.get(s)
            if r is None:  # everything here fits
                done[s] = (goal[s][1] + 1) << (shift + BITS)
                del goal[s]
            elif r["lo"] == r["hi"] or level == LEVELS - 1:
                done[s] = r["bucket"] << shift
                del goal[s]
            else:
                goal[s] = [goal[s][0] - r["before"], r["bucket"]]
    return spark.createDataFrame(list(done.items()), "src string, below bigint")


def mixed(sizes: DataFrame, plan: DataFrame, hist: DataFrame) -> DataFrame:
    """``doc_id, source, tokens, repeats`` of the chosen documents; ``repeats`` is at least 1."""
    t = plan.join(thresholds(sizes, plan, hist), "src", "left").select("src", "source", "whole", F.coalesce("below", F.lit(0)).alias("below"))
    rows = sizes.join(F.broadcast(t), "src")  # one row a source
    return rows.withColumn("repeats", F.col("whole") + (F.col("h") < F.col("below")).cast("int")).where("repeats > 0").select("doc_id", "source", "tokens", "repeats")


def planned(sizes: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The plan of ``sizes(doc_id, src, tokens, h)`` and the first histogram, both materialised: at most 2^BITS rows a target."""
    hist = cut(histogram(sizes, targets.select(folded("source").alias("src")).where("src is not null").distinct()))
    return cut(mixture_plan(hist, targets)), hist


def mixture(documents: DataFrame, targets: DataFrame, tokenizer: str) -> tuple[DataFrame, DataFrame]:
    """The chosen rows, and the report of the shares reached.

    The report has ``source, target_share, wanted, reached, reached_share, documents, short`` of
    each target, with zeros where nothing was chosen.
    """
    sizes = cut(token_sizes(documents, tokenizer))
    plan, hist = planned(sizes, targets)
    rows = mixed(sizes, plan, hist)
    got = rows.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("reached"), F.count("*").alias("documents"))
    zero = F.lit(0).cast("bigint")
    report = plan.join(got, "source", "left").select(
        "source", "target_share", F.floor("wanted").alias("wanted"), F.coalesce("reached", zero).alias("reached"),
        F.coalesce("documents", zero).alias("documents"), "short",
    )
    total = F.sum("reached").over(Window.partitionBy())  # one row a source
    return rows, report.withColumn("reached_share", F.when(total > 0, F.col("reached") / total))


def short_sources(documents: DataFrame, targets: DataFrame, tokenizer: str) -> DataFrame:
    """``source`` of the targets whose budget lies beyond their histogram, however often they are repeated."""
    return planned(token_sizes(documents, tokenizer), targets)[0].where("short").select("source")
