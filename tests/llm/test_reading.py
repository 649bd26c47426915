import random

from codelattice.llm import reading as G

EASY = ["The {n} has a {m}.", "We put the {n} in the {m}.", "You can use a {n}.", "It is a {n} and it has a {m}.", "Look at the {n} and the {m}."]
HARD = [
    "Inasmuch as the {n} presupposes a considerable degree of abstraction, its {m} cannot be dissociated from the reconciliation it necessitates.",
    "Notwithstanding the {n} that delineates every {m}, the ostensible equivalence remains theoretically indeterminate.",
    "What the {n} takes to be a {m} is, for all that the rest may hold, no more than the trace of that which it was left to mean.",
]
NOUNS = "cup box tree lamp key road desk bag book dog".split()
CODE = "\n```\nlet x = parameterisation(epistemological, 3);\n```\n\n10:22:31 INFO instantiation=4\n\n| multidimensional | x |\n|---|---|\n\nNames: fooBarBaz, quxZip\n\n- https://a.example/x\n"


def text(forms, seed, n=14):
    r = random.Random(seed)
    return "# About it\n\n" + " ".join(r.choice(forms).format(n=r.choice(NOUNS), m=r.choice(NOUNS)) for _ in range(n)) + "\n" + CODE


def tables(spark):
    docs, labels, truth = [], [], {}
    for k in range(240):
        level = 1 + k % 5
        forms = HARD if level >= 4 else EASY
        docs.append((k, text(forms, k), level * 10))
        truth[k] = level >= 4
        if k < 120:
            shown = (5 if level < 4 else 1) if k % 15 == 0 else level  # some grades are far off
            labels.append((k, shown, "r1"))
    docs += [(900, None, 1), (901, "", 1), (902, CODE, 1), (903, "Der Ast hat eine Lampe und der Baum ist in der Kiste. Wir lesen die Datei und das Buch.", 1), (904, text(HARD, 7), 1), (904, text(HARD, 7), 1), (905, text(EASY, 5, 20_000), 1)]
    labels += [(5, None, "r2"), (None, 3, "r2"), (7777, 4, "r2"), (900, 3, "r1")]
    return spark.createDataFrame(docs, "doc_id long, text string, level int"), spark.createDataFrame(labels, "doc_id long, level int, rater string"), truth


def test_held_out_accuracy(spark):
    docs, labels, truth = tables(spark)
    got = {r["doc_id"]: r for r in G.reading_levels(docs, labels).collect()}
    held = [k for k in truth if k >= 120]
    right = sum((got[k]["level"] > G.DEMANDING) == truth[k] for k in held)
    assert right >= 0.97 * len(held)
    wrong = [k for k in range(0, 120, 15)]
    assert sum((got[k]["level"] > G.DEMANDING) == truth[k] for k in wrong) >= 0.7 * len(wrong)  # a wrong grade does not hide the text
    assert got[900]["language"] is None and got[901]["level"] is None and got[902]["level"] is None and got[903]["language"] == "de" and got[905]["level"] <= 3
    found = [r["doc_id"] for r in G.demanding_documents(docs, labels).collect()]
    assert found.count(904) == 2 and 903 not in found


def test_prose_only():
    assert [" ".join(s) for s in G.prose_sentences("# Title here\n\nSee the box. It has `aB` a key.\n" + CODE)] == ["see the box", "it has a key"]
    assert [" ".join(s) for s in G.prose_sentences("* We put it\n  in the box.\n* You can use it.\n\n> The lamp is safe.")] == ["we put it in the box", "you can use it", "the lamp is safe"]
    assert G.prose_sentences("-" * 50_000 + "1") == []
    assert G.language([["the", "box", "is", "in", "it"]]) == "en" and G.language([["xx"]]) is None


def test_isotonic_is_monotone_and_least_squares():
    r = random.Random(4)
    pts = [(x / 10, x / 20 + r.gauss(0, 1)) for x in range(100)]
    steps = G.isotonic(pts)
    assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(steps, steps[1:]))
    assert G.isotonic([(0, 1), (1, 3), (2, 2)]) == [(0, 1), (1.5, 2.5)] and G.isotonic([]) == []


def test_without_grades_and_empty(spark):
    docs, labels, _ = tables(spark)
    got = G.reading_levels(docs.limit(20), labels.limit(0)).collect()
    assert {r["level"] for r in got if r["language"] == "en"} <= {3.0}
    assert G.reading_levels(docs.limit(0), labels).count() == 0


def test_long_graded_texts_do_not_end_the_sample(spark, monkeypatch):
    docs, labels, _ = tables(spark)
    long = spark.createDataFrame([(k, text(EASY, k, 2_000), 1) for k in range(2000, 2040)], docs.schema)  # some come first by hash
    more = spark.createDataFrame([(k, 1, "r1") for k in range(2000, 2040)], labels.schema)
    monkeypatch.setattr(G, "MAX_WORDS", 9_000)
    for d, x in ((docs.unionByName(long), labels.unionByName(more)), (long, more)):  # also where every text is too long
        got = G.graded_sample(d, x)
        assert len(got) >= 40 and sum(len(s) for sents, _ in got for s in sents) <= 9_000
    assert any(r["doc_id"] == 904 for r in G.demanding_documents(docs.unionByName(long), labels.unionByName(more)).collect())
