import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from codelattice.operators.hierarchy import containment, descendants, hierarchy


def brute(links):
    parent = {}
    for c, p in links:
        if c is not None and p is not None and c != p:
            parent[c] = min(p, parent.get(c, p))
    out = {}
    for v in set(parent) | set(parent.values()):
        path = [v]
        while path[-1] in parent and parent[path[-1]] not in path:
            path.append(parent[path[-1]])
        if path[-1] in parent:
            circle = path[path.index(parent[path[-1]]) :]
            out[v] = (min(circle), -1, None)
        else:
            out[v] = (path[-1], len(path) - 1, tuple(path[::-1]))
    return out


def run(spark, links):
    df = spark.createDataFrame(links, "child string, parent string")
    return df, {r["node_id"]: (r["root_id"], r["depth"], r["path"] and tuple(r["path"])) for r in hierarchy(df, True).collect()}


def test_chain_longer_than_any_limit(spark):
    links = [(f"n{i:04}", f"n{i - 1:04}") for i in range(1, 300)]
    random.Random(1).shuffle(links)
    assert run(spark, links)[1] == brute(links)


def test_star_circles_and_what_hangs_on_them(spark):
    links = [(f"leaf{i}", "hub") for i in range(500)] + [("hub", "top"), ("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "d"), ("f", "e"), ("u", "v"), ("v", "u")]
    links += links[:3] + [(None, "x"), ("y", None), ("s", "s")]
    df, got = run(spark, links)
    assert got == brute(links)
    assert got["f"] == ("a", -1, None) and got["leaf7"] == ("top", 2, ("top", "hub", "leaf7")) and "s" not in got
    pairs = {tuple(r) for r in descendants(hierarchy(df, True)).collect()}
    assert ("top", "leaf7", 2) in pairs and len(pairs) == 1001


def test_empty(spark):
    assert run(spark, [])[1] == {}


def test_containment_folds_slashes(spark):
    e = spark.createDataFrame([("a\\b", "a/c", "defines"), ("a/b", "a\\b", "defines"), ("a", "b", "calls")], "source string, target string, type string")
    assert [tuple(r) for r in containment(e).collect()] == [("a/c", "a/b")]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
def test_random_graphs(spark, pairs):
    first = {}
    for c, p in pairs:  # no node has two parents
        first.setdefault(c, p)
    links = [(f"v{c:02}", f"v{p:02}") for c, p in first.items()]
    assert run(spark, links)[1] == brute(links)


def test_further_parents_are_told_and_masks_change_nothing(spark, monkeypatch):
    from codelattice.operators import hierarchy as H

    df = spark.createDataFrame([("c", "b"), ("c", "a"), ("c", "a"), ("d", "c"), ("c", "c"), (None, "a"), ("e", "d")], "child string, parent string")
    assert {tuple(r) for r in H.other_parents(df).collect()} == {("c", "b", "a")}
    want = {tuple(r) for r in H.hierarchy(df).collect()}
    monkeypatch.setattr(H, "KNOWN", 0)
    monkeypatch.setattr(H, "ROWS", 1)
    assert {tuple(r) for r in H.hierarchy(df).collect()} == want and len(want) == 5
