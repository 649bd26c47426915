import random

from codelattice.llm.nonhuman import _TOKEN, gram_hashes, layout_kind, layout_statistics, leading_comments, nonhuman_files, text_statistics

R = random.Random(5)
VERBS, NOUNS = "fold merge pack trim walk scan sort bind".split(), "queue ring slot token trie cache edge heap span stub".split()


def hand(n=40, seed=0):
    r = random.Random(seed)
    out = ["// Data below is small and kept by hand; do not edit while it runs.", "import { x } from './x';", ""]
    for i in range(n // 5):
        out += [f"function {r.choice(VERBS)}{r.choice(NOUNS).title()}{r.randint(0, 99)}({r.choice(NOUNS)}, {r.choice(NOUNS)}) {{"]
        out += [f"    const {r.choice(NOUNS)} = {r.choice(VERBS)}({r.choice(NOUNS)}, {r.choice(NOUNS)}, {r.randint(0, 4000)});" for _ in range(3)] + ["}"]
    return "\n".join(out)


MINIFIED = "".join(f"function {a}({b},{c}){{return {b}?{b}.{c}:void 0}}" for a in "abcdefgh" for b in "xyz" for c in "uvw")
KINDS = {
    "/ws/r1/a.js": MINIFIED, "/ws/r1/b.js": "\n".join(MINIFIED[i : i + 110] for i in range(0, len(MINIFIED), 110)),
    "/ws/r1/c.ts": "export const T = [\n" + "\n".join("  " + ", ".join(str(R.randint(0, 255)) for _ in range(15)) + "," for _ in range(40)) + "\n];",
    "/ws/r1/d.py": "X = [\n" + "\n".join('  "' + "".join(R.choices("ABCDEFabcdef0123456789+/", k=76)) + '",' for _ in range(30)) + "\n]",
    "/ws/r1/e.ts": "\n".join(f"  case {i}: return this.op{i}(stack, {i % 5});" for i in range(40)),
    "/ws/r1/f.go": "// Code generated by toolc v1.2. DO NOT EDIT.\n" + hand(20, 1), "/ws/r1/g.py": "# <auto-generated>\n#  x\n# </auto-generated>\nx = 1\n",
    "/ws/r1/h.ts": "/*\n * Dieser Code wurde von toolc erzeugt. Nicht von Hand aendern.\n */\n" + hand(20, 2), "/ws/r1/i.rs": "// upstream: lib@1.2.3\n" + hand(20, 3),
    "/ws/r1/k.ts": "// lib v1.2.3 - (c) the dock project\n" + hand(20, 5),
}
HUMAN = {
    "/ws/r1/vendor/lib/j.ts": hand(20, 4), "/ws/r1/m.js": hand(60, 6), "/ws/r1/vendors/n.ts": hand(60, 7), "/ws/r1/generated_docs/o.ts": hand(60, 8), "/ws/r1/p.min.ts": "// The minified output is written elsewhere.\n" + hand(30, 9),
    "/ws/r1/q.go": hand(30, 10) + '\nconst BANNER = "// Code generated by x v1.0. DO NOT EDIT.";\n', "/ws/r1/r.py": "", "/ws/r1/s.py": "   \n", "/ws/r1/t.rs": "// Replaces the vendored copy we had until last year.\n" + hand(30, 11),
    "/ws/r1/u.rs": "pub enum A {\n    " + ",\n    ".join(NOUNS).upper() + "\n}\n", "/ws/r1/v.ts": "// Tests for auto-generated names live next door.\n// This module generates ids; do not edit the map while it runs.\n" + hand(30, 12),
}


def run(spark, files, upstream=()):
    f = spark.createDataFrame([(p, float(k), None, c, "x") for k, (p, c) in enumerate(files)], "path string, mtime_ms double, size long, content string, kind string")
    u = spark.createDataFrame([("l", c) for c in upstream], "lib string, content string")
    return {r["path"]: r["kind"] for r in nonhuman_files(f, u).collect()}


def test_kinds(spark):
    got = run(spark, [*KINDS.items(), *HUMAN.items(), (None, "x"), ("/ws/r1/null.ts", None)])
    assert set(got) == set(KINDS), (set(KINDS) - set(got), set(got) - set(KINDS))
    assert got["/ws/r1/b.js"] == "minified" and got["/ws/r1/d.py"] == "data" and got["/ws/r1/e.ts"] == "repetitive"


def test_copies_without_marks(spark):
    known, other = hand(80, 20), hand(80, 21)
    lines = other.split("\n")
    changed = "\n".join(lines[:30] + ["    x.y(1);"] + lines[31:])
    files = [("/ws/r1/a.ts", known.replace("const", "let", 2)), ("/ws/r2/b.ts", other), ("/ws/r3/c.ts", changed), ("/ws/r3/same.ts", hand(80, 22)), ("/ws/r3/same2.ts", hand(80, 22))]
    # Copies within one repository are no copies from another project.
    assert set(run(spark, files, [known])) == {"/ws/r1/a.ts", "/ws/r2/b.ts", "/ws/r3/c.ts"}


def test_newest_version_counts_and_slashes_fold(spark):
    assert run(spark, [("/ws/r1\\a.js", MINIFIED), ("/ws/r1/a.js", hand(30, 30))]) == {}
    assert set(run(spark, [("/ws/r1/a.js", hand(30, 30)), ("/ws/r1\\a.js", MINIFIED), ("/ws/r1\\a.js", MINIFIED)])) == {"/ws/r1/a.js"}


def test_empty_and_long(spark):
    assert run(spark, [(None, None)]) == {}
    assert layout_kind("x" * 2_000_000, "ts") in ("minified", "data") and layout_kind("", "ts") is None
    assert leading_comments("/*\n a\n*/\nx = 1\n// b") == "/*\n a\n*/"


def test_sketches_tell_texts_apart():
    import numpy as np

    from codelattice.llm.nonhuman import _TOKEN, gram_hashes, sketch

    texts = [hand(60, 100 + k) for k in range(40)]
    s = np.array([sketch(gram_hashes(_TOKEN.findall(t))) for t in texts])
    agree = (s[:, None] == s[None]).mean(-1)
    grams = [set(gram_hashes(_TOKEN.findall(t)).tolist()) for t in texts]
    for i in range(40):
        for j in range(i):
            true = len(grams[i] & grams[j]) / len(grams[i] | grams[j])
            assert abs(agree[i, j] - true) < 0.25, (agree[i, j], true)
    assert sketch(gram_hashes(["a"] * 3)) is None


def grown(text, seed, n):
    """``text`` with ``n`` lines exchanged."""
    r, lines = random.Random(seed), text.split("\n")
    for k in r.sample(range(3, len(lines)), n):
        lines[k] = f"    {r.choice(VERBS)}.{r.choice(NOUNS)}{seed}({r.randint(0, 10**6)});"
    return "\n".join(lines)


def test_near_copies_behind_a_less_similar_file_are_compared(spark):
    # Each family shares bands with files of the first and the last repository that are similar, but not to 0.8.
    files, want = [], set()
    for k in range(12):
        base = hand(200, 300 + k)
        x, y = f"/ws/m1/x{k}.ts", f"/ws/m2/y{k}.ts"
        files += [(x, base), (y, grown(base, 1, 1)), *((f"/ws/{r}/f{k}{j}.ts", grown(base, 10 + 40 * n + j, 28)) for n, r in enumerate(("a", "zz", "q")) for j in range(12))]
        want |= {x, y}
    assert set(run(spark, files)) == want


def test_blocks_of_a_band_compare_every_pair(spark):
    from codelattice.llm import nonhuman as M

    base = hand(300, 700)
    texts = [grown(base, 900 + k, 6 if k % 3 else 60) for k in range(60)]
    rows = []
    for k, t in enumerate(texts):
        g = M.gram_hashes(M._TOKEN.findall(t))
        rows.append((M.class_of(g), k % 7 or None, M.sketch(g)))
    classes = spark.createDataFrame(rows, "cls long, repo long, sketch array<smallint>")
    whole = {r["cls"] for r in M.near_classes(classes, 40).collect()}
    assert len(whole) > 30 and {r["cls"] for r in M.near_classes(classes, 40, block=7).collect()} == whole


def test_similarity_is_settled_by_the_exact_grams(spark):
    from codelattice.llm import nonhuman as M

    def grams(t):
        return set(M.gram_hashes(M._TOKEN.findall(t)).tolist())

    files, want, lost, let_in = [], set(), 0, 0
    for k in range(60):
        a = hand(150, 2000 + k)
        b = grown(a, 1, 7 + k % 7)
        x, y = grams(a), grams(b)
        true = len(x & y) / len(x | y)
        s = [M.sketch(M.gram_hashes(M._TOKEN.findall(t))) for t in (a, b)]
        agree = sum(u == v for u, v in zip(*s))
        lost += true >= 0.8 and agree < 52
        let_in += true < 0.8 and agree >= 52
        files += [(f"/ws/r{k}/a.ts", a), (f"/ws/s{k}/b.ts", b)]
        if true >= 0.8:
            want |= {f"/ws/r{k}/a.ts", f"/ws/s{k}/b.ts"}
    assert lost and let_in  # the sketches alone are wrong both ways
    assert set(run(spark, files)) == want


def test_upstream_copies_at_every_size_of_the_upstream_texts(spark, monkeypatch):
    from codelattice.llm import nonhuman as M

    known = [hand(80, 50 + k) for k in range(6)]
    files = [(f"/ws/r1/a{k}.ts", t.replace("const", "let", 2)) for k, t in enumerate(known)] + [("/ws/r1/own.ts", hand(80, 60))]
    want = {f"/ws/r1/a{k}.ts" for k in range(6)}
    monkeypatch.setattr(M, "UPSTREAM_CHARS", 1_000, raising=False)  # the limit that once was
    monkeypatch.setattr(M, "UPSTREAM_GRAMS", 700, raising=False)
    assert set(run(spark, files, known)) == want
    assert set(run(spark, [*files, ("/ws/r1/null.ts", None)], [*known, None])) == want and run(spark, files) == {}


MARK = "Code generated by toolc v1.2. DO NOT EDIT."


def test_marks_anywhere_in_the_leading_comment(spark):
    licence = [f"line {k} of a licence that goes on and on" for k in range(45)]
    files = [
        ("/ws/r1/a.go", "\n".join("// " + x for x in [*licence, MARK]) + "\n" + hand(20, 40)), ("/ws/r1/b.ts", "/*\n" + "\n".join([*licence, MARK]) + "\n*/\n" + hand(20, 41)),
        ("/ws/r1/c.py", '"""\nA module.\n\n' + MARK + '\n"""\n' + hand(20, 42)), ("/ws/r1/d.ts", "<!--\nsome words\n" + MARK + "\n-->\n" + hand(20, 43)),
        ("/ws/r1/e.go", "// " + licence[0] + "\nx := 1\n// " + MARK + "\n" + hand(20, 44)),
    ]
    assert set(run(spark, files)) == {p for p, _ in files[:4]}
    assert leading_comments('"""one line"""\nx = 1\n# y').strip() == '"""one line"""' and leading_comments("/* a */ x = 1\n// y").strip() == "/* a */ x = 1"
    assert leading_comments("\n".join("// x" for _ in range(3000))).count("x") == 3000


def test_tables_on_few_long_lines():
    r = random.Random(8)
    numbers = ", ".join(str(r.randint(0, 99999)) for _ in range(400))
    assert layout_kind(f"static int T[] = {{ {numbers} }};", "cpp") == "data"
    strings = ",  ".join(f"'{r.choice(NOUNS)} {r.choice(NOUNS)}'" for _ in range(300))
    assert layout_kind(f"words = [\n  {strings},\n  {strings}\n]", "py") == "data"
    assert layout_kind("x = [1, 2, 3]\ny = [4, 5]", "py") is None


def test_short_copies_are_copies(spark):
    short, other = "let total = merge(queue, slot, ring) + trim(edge, heap, span);", "fold the queue with each slot that ring and heap share today"
    got = run(spark, [("/ws/r1/a.ts", short), ("/ws/r2/b.ts", short), ("/ws/r3/c.ts", other), ("/ws/r4/d.ts", "x = 1")], [other])
    assert got == {"/ws/r1/a.ts": "copied", "/ws/r2/b.ts": "copied", "/ws/r3/c.ts": "copied"}


def test_recall_of_drifting_copies(spark):
    """Each of 60 repositories holds the version after the last one's, four lines in ninety changed; all are copies of another."""
    r, lines, files = random.Random(12), hand(90, 50).split("\n"), []
    for k in range(60):
        for _ in range(2):
            lines[r.randrange(3, len(lines))] = f"    const {r.choice(NOUNS)} = {r.choice(VERBS)}({r.choice(NOUNS)}, {r.randint(0, 4000)});"
        files.append((f"/ws/repo{k}/lib.ts", "\n".join(lines)))
    grams = [set(map(int, gram_hashes(_TOKEN.findall(t)))) for _, t in files]
    want = {p for k, (p, _) in enumerate(files) if any(j != k and len(grams[k] & grams[j]) >= 0.8 * len(grams[k] | grams[j]) for j in range(60))}
    got = set(run(spark, files))
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) > 50


def test_layout_statistics_agree(spark):
    texts = ["a b\n\n  c1\t2\r\n", "", "   ", None, "x" * 50 + "\n" + "ü 9", *KINDS.values()]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, content string")
    for row in layout_statistics(df).collect():
        t = texts[row["k"]]
        if t:
            assert tuple(row)[2:] == text_statistics(t), t
