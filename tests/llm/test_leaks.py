import random

from codelattice.llm import leaks as L

R = random.Random(3)
WORDS = [a + b for a in "bra clo dru fle gri pla sko tre vun wex".split() for b in "mon tar lin sep dok ram fil gus".split()]
ITEM = " ".join(R.choices(WORDS, k=60))
CODE = "\n".join(f"    let {R.choice(WORDS)} = {R.choice(WORDS)}({R.choice(WORDS)}, {R.randint(10, 4000)});" for _ in range(10))
NOISE = [" ".join(R.choices(WORDS, k=40)) for _ in range(8)]


def leaks(text, items=((1, ITEM), (2, CODE)), free=False):
    """Brute force over all pairs of windows."""
    out = []
    w, t = L.words(text)
    for i, item in items:
        iw, it = L.words(item)
        (h, b, _), (g, c, e) = L.windows(w, t), L.windows(iw, it)
        hits = [(int(p), int(j), int(k - j)) for x, p in zip(h, b) for y, j, k in zip(g, c, e) if x == y]
        if hits and L.passages(*L.heard(*L.told(w, t)), *L.heard(*L.told(iw, it)), hits)[free] >= L.LEAST:
            out.append(i)
    return out


def around(x, k=0):
    return NOISE[k] + ". " + x + ". " + NOISE[k + 1]


def part(n, at=10):
    return " ".join(ITEM.split()[at : at + n])


def test_length_decides():
    assert leaks(around(part(18))) == [1] and leaks(around(part(40))) == [1] and leaks(part(60, 0)) == [1]
    for n in (5, 10, 14, 16):
        assert leaks(around(part(n))) == [], n
    # pieces of a passage that are too short one by one do not add up
    assert leaks(" ".join(part(12, a) + " " + NOISE[k] for k, a in enumerate((0, 13, 26, 39)))) == []


def test_layout_case_and_look_alikes():
    p = part(30)
    assert leaks(around(p.upper())) == [1] and leaks(around(p.replace(" ", "\n> "))) == [1] and leaks(around(p.replace("a", "а").replace("o", "о"))) == [1]
    assert leaks(around(" ".join(f"**{w}**" if k % 4 == 0 else f"<b>{w}</b>," for k, w in enumerate(p.split())))) == [1]
    assert leaks(around(p.replace("r", "r­"))) == [1] and leaks(around("".join(chr(0xFF00 + ord(c) - 32) if c.isalpha() else c for c in p))) == [1]
    assert leaks("\n".join(f"{k + 1}. {x.strip()}" for k, x in enumerate(CODE.split("\n")))) == [2]
    assert leaks("<pre>" + CODE.replace("    ", "\t").replace(",", " ,") + "</pre>") == [2]


def test_changes():
    r = random.Random(9)
    for trial in range(12):
        w = part(40).split()
        for k in range(trial % 3, 40, 11):  # about one word in eleven
            w[k] = r.choice(["", "changed", w[k] + " added"])
        assert leaks(around(" ".join(w))) == [1], trial
        w = part(40).split()
        for k in range(0, 40, 3):
            w[k] = "changed"
        assert leaks(around(" ".join(w))) == []


def test_slots_refilled_consistently():
    item = " ".join(f"{part(4, 4 * k)} {'fooBar' if k % 2 else '37'}" for k in range(10))  # a slot in five words
    new = item.replace("fooBar", "quxZip").replace("37", "912")
    assert leaks(new, [(7, item)]) == [7]
    r = iter(range(1000, 2000))
    mixed = " ".join(f"zed{next(r)}Zed" if w == "fooBar" else str(next(r)) if w == "37" else w for w in item.split())
    assert leaks(mixed, [(7, item)]) == []  # one change in five words, each another


def test_reparameterised_questions():
    word = (
        "Anna buys 12 apples and Ben buys 7 pears at the market. Each apple costs 3 euros and each pear costs 2 euros. "
        "Later Ben gives Anna 2 of his pears because Anna has given 3 apples away. How many euros do Anna and Ben spend together?"
    )
    sums = "Compute 17 + 4 * 3 and then subtract 17 from the result. Divide what is left by 4 and add 3 to it, then round the number up to the next integer."
    refill = lambda t, m: L.re.sub(r"\w+", lambda x: m.get(x[0], x[0]), t)
    items = [(1, word), (2, sums)]
    assert leaks(around(refill(word, {"Anna": "Petra", "Ben": "Oskar", "12": "31", "7": "19", "3": "5", "2": "8"})), items, free=True) == [1]
    assert leaks(around(refill(sums, {"17": "205", "4": "9", "3": "61"})), items, free=True) == [2]
    dense = " ".join(f"{WORDS[k]} Anna {WORDS[k + 9]} 12 {WORDS[k + 18]}" for k in range(9))
    one, each = iter(range(1000, 2000)), lambda x: str(next(one)) if x[0].isdigit() else "Q" + L.re.sub(r"\d", lambda d: "abcdefghij"[int(d[0])], str(next(one)))
    assert leaks(around(refill(dense, {"Anna": "Mia", "12": "44"})), [(4, dense)], free=True) == [4]
    assert leaks(around(L.re.sub(r"\d+|Anna", each, dense)), [(4, dense)], free=True) == []  # one value, many replacements
    assert leaks(around(refill(sums, {"17": "5", "4": "5", "3": "5"}) + " "), [(3, " ".join(["Take 17 then 4 then 3 off it"] * 5))], free=True) == []


def test_recall_on_generated_templates():
    r = random.Random(11)
    names, found, n = ["Mia", "Noah", "Lena", "Omar", "Ines", "Karl", "Yuki", "Zoe"], 0, 60
    for _ in range(n):
        who = r.sample(names, 4)
        nums = r.sample(range(10, 9000), 8)
        make = lambda a, b, v: " ".join(
            f"{x} {a if k % 4 == 0 else b if k % 4 == 1 else v[k % 4]}" if k % 3 == 0 else x for k, x in enumerate(plain)
        )
        plain = r.choices(WORDS, k=36)
        item, text = make(who[0], who[1], nums[:4]), make(who[2], who[3], nums[4:])
        found += leaks(around(text), [(1, item)], free=True) == [1]
    assert found >= 0.9 * n, found


def test_all_slots_are_indexed():
    h, b, e = L.windows(*L.words("take 1 2 3 4 5 6 7 8 9 from it"))
    assert (0, 12) in {(int(x), int(y)) for x, y in zip(b, e)}  # a window reaches over a run of numbers


def test_instructions_are_cut(spark):
    a, b = "Read the passage about all of these many different things and then answer in one short sentence please now.", NOISE[0]

    def cut(texts):
        df = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
        return [bytes(r["words"]) for r in L.item_words(df).orderBy("item_id").collect()]

    low = lambda t: L.words(t)[0].tobytes()
    assert cut([a + "\n" + b, a + "\n" + NOISE[1], b + "\n" + NOISE[2]]) == [low(b), low(NOISE[1]), low(b + "\n" + NOISE[2])]
    assert cut([a + "\n" + b, a + "\n" + b]) == [low(a + "\n" + b)] * 2  # a repeated item shares everything


def test_table(spark):
    rows = [(1, around(part(30)), 5), (1, around(part(30)), 5), (2, None, 5), (3, "", 5), (4, NOISE[0], None), (5, CODE + "\n" + ITEM, 5), (6, (NOISE[3] + " ") * 3000 + part(25), 5), (None, part(30), 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(1, ITEM, 1), (2, CODE, 1), (3, None, 1), (4, "short", 1), (None, ITEM, 1)], "item_id long, text string, doc_id int")
    assert sorted(((r[0] or 0), r[1]) for r in L.leaked_items(docs, items).collect()) == [(0, 1), (1, 1), (1, 1), (5, 1), (5, 2), (6, 1)]
    assert L.leaked_items(docs.limit(0), items).count() == 0 and L.leaked_items(docs, items.limit(0)).count() == 0


def test_placeholders_matter(spark):
    often = " ".join(f"{WORDS[k]} Anna {WORDS[k + 9]} 12 {WORDS[k + 18]}" for k in range(9))  # two values, each refilled once
    many = " ".join(f"{WORDS[k]} Name{chr(97 + k)} {WORDS[k + 9]} {10 + k} {WORDS[k + 18]}" for k in range(9))
    refilled = L.re.sub(r"\d+", lambda x: str(900 - int(x[0])), L.re.sub("Name", "Other", many))
    rows = [(1, around(often)), (2, around(often.replace("Anna", "Mira").replace("12", "40"))), (3, NOISE[4]), (4, around(many)), (5, around(refilled)), (5, around(refilled))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, often), (2, many)], "item_id long, text string")
    assert sorted(tuple(r) for r in L.leaked_items(docs, items).collect()) == [(1, 1), (2, 1), (4, 2)]
    assert [tuple(r)[:2] for r in L.reparameterised_items(docs, items).collect()] == [(5, 2), (5, 2)]
    assert {r["doc_id"] for r in L.leaks(docs, items, templates=False).collect()} == {1, 4}


def test_every_placement_of_two_changes_in_a_shortest_passage():
    for n in (18,):
        for x in range(1, n - 1):
            for y in range(x + 1, n - 1):
                w = part(n).split()
                w[x], w[y] = "changed", "altered"
                assert leaks(around(" ".join(w))) == [1], (n, x, y)
