import os

import pytest

from codelattice.llm import mixing as X
from codelattice.llm.queries import tokenizer

TOKENIZER = tokenizer()
pytestmark = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer files")


def docs(spark):
    rows = [(k, "word " * (k % 7 + 1), [" Big", "BIG ", "big"][k % 3], "x") for k in range(900)]
    rows += [(1000 + k, "some other words here", "mid", "x") for k in range(60)] + [(2000 + k, "few", "small\t", "x") for k in range(5)]
    rows += [(3000, None, "mid", "x"), (3001, "", "mid", "x"), (3002, "unlisted text", "none", "x"), (3003, "text", None, "x"), (3004, "x", "  ", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, tokens string")


def targets(spark, rows=(("big", 0.7, 1), ("mid", 0.1, 3), ("Small", 0.15, 2), ("gone", 0.05, 4))):
    return spark.createDataFrame(list(rows), "source string, target_share double, max_repeats int")


def test_budgets_are_met_and_never_exceeded(spark):
    rows, report = X.mixture(docs(spark), targets(spark), TOKENIZER)
    rows = rows.collect()
    rep = {r["source"]: r for r in report.collect()}
    size = {r["doc_id"]: r["tokens"] for r in X.token_sizes(docs(spark), TOKENIZER).collect()}
    assert len({r["doc_id"] for r in rows}) == len(rows) and all(r["tokens"] == size[r["doc_id"]] for r in rows)
    reached = {}
    for r in rows:
        reached[r["source"]] = reached.get(r["source"], 0) + r["tokens"] * r["repeats"]
        assert 1 <= r["repeats"] <= {"big": 1, "mid": 3, "Small": 2}[r["source"]]
    for s, r in rep.items():
        assert r["reached"] == reached.get(s, 0) <= r["wanted"]
    assert rep["big"]["wanted"] - rep["big"]["reached"] <= max(size.values())
    assert rep["mid"]["wanted"] - rep["mid"]["reached"] <= max(size.values()) and not rep["mid"]["short"]
    assert rep["Small"]["short"] and rep["gone"]["short"] and {r["repeats"] for r in rows if r["source"] == "Small"} == {2}
    assert abs(sum(r["reached_share"] for r in rep.values()) - 1) < 1e-9
    assert {r["source"] for r in X.short_sources(docs(spark), targets(spark), TOKENIZER).collect()} == {"Small", "gone"}


def test_thresholds_are_nested_and_agree_with_sorting(spark):
    sizes = X.cut(X.token_sizes(docs(spark), TOKENIZER))
    before = set()
    for share in (0.1, 0.2, 0.4):
        plan, hist = X.planned(sizes, targets(spark, [("big", share, 1), ("mid", 1 - share, 9)]))
        took = {r["doc_id"] for r in X.mixed(sizes, plan, hist).where("source = 'big'").collect()}
        rest = plan.where("source = 'big'").first()["rest"]
        total, want = 0, set()
        for r in sorted(sizes.where("src = 'big' and tokens > 0").collect(), key=lambda r: r["h"]):
            total += r["tokens"]
            if total > rest:
                break
            want.add(r["doc_id"])
        assert took == want and before <= took
        before = took


def test_degenerate_tables(spark):
    d, t = docs(spark), targets(spark)
    assert X.mixture(d.limit(0), t, TOKENIZER)[0].count() == 0 and {r["reached"] for r in X.mixture(d.limit(0), t, TOKENIZER)[1].collect()} == {0}
    assert X.mixture(d, t.limit(0), TOKENIZER)[1].count() == 0
    odd = targets(spark, [("big", None, 2), ("mid", 0.5, None), (None, 0.5, 1), ("BIG", 0.5, 1)])
    got = {r["source"]: r["reached"] for r in X.mixture(d, odd, TOKENIZER)[1].collect()}
    assert set(got) == {"BIG", "mid"} and got["mid"] == 0
    same = spark.createDataFrame([(1, "a b c", "s")] * 50, "doc_id long, text string, source string")  # one hash: all or none
    assert X.mixture(same, targets(spark, [("s", 0.5, 1)]), TOKENIZER)[0].count() == 0
    long = spark.createDataFrame([(1, "word " * 400_000, "s")], "doc_id long, text string, source string")
    assert X.token_sizes(long, TOKENIZER).first()["tokens"] == 400_001
