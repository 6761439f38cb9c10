import random

from pixelmill.llm import decontam
from pixelmill.llm.decontam import Canon, contaminated, template


def frames(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).selectExpr("*", "doc_id AS item_id", "text AS hash")
    return d, spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id")


def found(spark, docs, items):
    return sorted((r["doc_id"], r["item_id"]) for r in contaminated(*frames(spark, docs, items)).collect())


ITEM = "If the train leaves with Maria at 9 and goes 120 km before Maria meets Jonas at 11 then how far is it from there to the coast"


def test_template():
    c = Canon()
    kinds = template(c, b'We saw "Anna" walk 12 km. Then 5kg , of THE salt m away')[2].tolist()
    assert kinds == [0, 0, 3, 0, 1, 2, 0, 1, 0, 0, 0, 0, 0]


def test_asked_again_with_other_values(spark):
    other = ITEM.replace("Maria", "Lena").replace("Jonas", "Omar").replace("9", "7").replace("120 km", "80 miles").replace("11", "8")
    mixed = ITEM.replace("Maria", "Lena", 1).replace("Jonas", "Lena").replace("9", "7").replace("11", "7")
    docs = [(1, "Some words here. " + other + " and more"), (2, "Some words here. " + mixed + " and more"), (3, ITEM), (4, "x " + ITEM.upper() + " y"), (5, ITEM[:40]), (6, "totally other words " * 50), (7, ITEM.replace(" ", ",\n "))]
    assert found(spark, docs, [(10, ITEM)]) == [(1, 10), (3, 10), (4, 10), (7, 10)]


def test_like_brute_force_on_plain_words(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(rng.choices(words, k=rng.choice([3, 5, 8, 12, 30, 60])))) for k in range(20)]
    docs = []
    for k in range(150):
        w = rng.choices(words, k=rng.choice([0, 4, 50, 300]))
        if rng.random() < 0.5:
            item = rng.choice(items)[1].split()
            a = rng.randrange(len(item))
            at = rng.randrange(len(w) + 1)
            w[at:at] = item[a : a + rng.choice([6, 9, 14, 100])] if rng.random() < 0.5 else item
        docs.append((k, " ".join(w)))
    want = []
    for d, text in docs:
        w = text.split()
        for i, t in items:
            u = t.split()
            width = min(8, len(u))  # a shorter item is one window
            have = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}
            n = len(u) - width + 1
            hit = sum(tuple(u[k : k + width]) in have for k in range(n))
            if len(u) >= 4 and hit >= min(6, -(-n // 2)):
                want.append((d, i))
    assert found(spark, docs, items) == sorted(want) and want
    monkeypatch.setattr(decontam, "MAX_BROADCAST", 1)
    assert found(spark, docs, items) == sorted(want)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (None, ITEM), (3, ITEM), (3, ITEM), (4, "w " * 50_000 + ITEM)]
    assert found(spark, docs, [(10, ITEM), (10, ITEM), (11, None), (None, ITEM), (12, "short one")]) == [(3, 10), (4, 10)]
    assert found(spark, docs, []) == [] and found(spark, [], [(10, ITEM)]) == []


def test_names_that_begin_sentences_and_longer_values(spark):
    item = "Tom has 12 apples in his bag. Tom gives 5 kg to Ann at noon. Ann then sells most of them here. Tom buys some more of these again."
    again = item.replace("Tom", "Lena").replace("Ann", "Omar")
    longer = item.replace("Ann", "Mary Lee").replace("5 kg", "7kg")
    mixed = again.replace("Lena", "Omar", 1)
    docs = [(1, again), (2, "Some words here. " + longer + " And more."), (3, mixed), (4, "Rain fell. " * 30)]
    assert found(spark, docs, [(10, item)]) == [(1, 10), (2, 10)]


def test_short_items(spark):
    docs = [(1, "Then she asked: what is 31 times 8? Nobody knew."), (2, "What is 31 times as hard"), (3, "what is this times that"), (4, "is 12 times")]
    items = [(10, "What is 12 times 7?"), (11, "is 12 times"), (12, "Capital of France?"), (13, "Why"), (14, "How many days has March this year?")]
    docs += [(5, "capital of France"), (6, "The capital of France"), (7, "why?"), (8, "Why not"), (9, "x What is 12 times 7"), (10, "So how many days has June this year? Who knows")]
    assert found(spark, docs, items) == [(4, 11), (5, 12), (7, 13), (9, 10), (10, 14)]


def test_equal_values_and_chance_windows(spark):
    """Values that happen to be equal fit; a window of the same form at the same offset elsewhere doesn't hide a true stretch."""
    equal = ITEM.replace("Maria", "Lena").replace("Jonas", "Lena").replace("9", "12").replace("11", "12").replace("120", "12")
    item = "one two Maria four five six seven eight nine ten " + ITEM
    chance = "one two Vera four five six seven eight 9 ten " + ITEM.replace("Maria", "Lena")
    assert found(spark, [(1, equal), (2, "z z " + chance)], [(10, ITEM), (11, item)]) == [(1, 10), (1, 11), (2, 10), (2, 11)]


def test_templates_like_brute_force(spark):
    """Questions of a template with one-word values: a document holds one if its words are the question's, but for values of which one stands for each of the question's."""
    rng = random.Random(11)
    names, numbers = ["Anna", "Bert", "Carl", "Dora", "Emil", "Fred"], ["3", "45", "1,200", "7.5", "99", "18"]
    words = [f"w{k}" for k in range(60)]

    def question(form, values):
        return " ".join(values[w] if w in values else w for w in form)

    def values(a, b, c, d):
        return {"<a>": a, "<b>": b, "<c>": c, "<d>": d}

    items, docs, want = [], [], []
    for i in range(12):
        form = rng.choices(words, k=24)
        for k, slot in zip(rng.sample(range(1, 24, 2), 6), ["<a>", "<b>", "<c>", "<d>", "<a>", "<c>"]):
            form[k] = slot
        first = values(*rng.sample(names, 2), *rng.sample(numbers, 2))
        items.append((i, question(form, first)))
        for _ in range(8):
            new = values(*(rng.choice(names) for _ in "ab"), *(rng.choice(numbers) for _ in "cd"))
            made = [new.get(w, w) for w in form]
            if rng.random() < 0.5:  # the last occurrence of a value has another one
                at = max(k for k, w in enumerate(form) if w in ("<a>", "<c>"))
                made[at] = rng.choice(names if form[at] == "<a>" else numbers)
            docs.append((len(docs), "x y z " + " ".join(made) + " z y x"))
            # plain windows suffice as well; templates need at least one slot, at least four plain words and as many windows
            u, w = items[-1][1].split(), made
            plain = sum(u[k : k + 8] == w[k : k + 8] for k in range(17))
            slots = [sum(x[0] == "<" for x in form[k : k + 8]) for k in range(17)]
            fits = [k for k in range(17) if u[k : k + 8] == w[k : k + 8] or 0 < slots[k] <= 4]
            stretches = [[fits[0]]] if fits else []
            for k in fits[1:]:
                if k == stretches[-1][-1] + 1:
                    stretches[-1].append(k)
                else:
                    stretches.append([k])

            def fit(places):
                """Whether each value of the question stands for one of the document over the windows with slots at ``places``."""
                pairs = {(u[j], w[j]) for k in places if 0 < slots[k] <= 4 for j in range(k, k + 8) if form[j] in first}
                return len({a for a, _ in pairs}) == len(pairs)

            if plain >= 6 or fit(fits) and len(fits) >= 6 or any(fit(f) and len(f) >= 9 for f in stretches):
                want.append((docs[-1][0], i))
    got = found(spark, docs, items)
    assert got == sorted(want) and 20 < len(want) < len(docs)
