import hashlib
import random
import re

from pixelmill.llm.pii import sanitise, span_digests

EMAIL, IP = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD, PHONE = r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for k, (p, ok) in enumerate(((EMAIL, lambda m: True), (IP, lambda m: all(int(x) <= 255 for x in m.split("."))), (CARD, lambda m: 14 <= len(re.sub(r"\D", "", m)) <= 19 and luhn(re.sub(r"\D", "", m))), (PHONE, lambda m: 10 <= len(re.sub(r"\D", "", m)) <= 15))):
        out += [(m.start(), k, m.end()) for m in re.finditer(p, text or "", re.ASCII) if ok(m[0])]
    out.sort()
    names = ("email", "ip", "card", "phone")
    s = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in out)
    return (*(sum(x[1] == k for x in out) for k in range(4)), hashlib.sha256(s.encode()).hexdigest(), s)


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).selectExpr("*", "text AS h", "doc_id AS base")
    return span_digests(df).collect()


def test_base_like_brute_force(spark):
    rng = random.Random(6)
    bits = ["a@b.c", "x.y%+-@mail-1.example.com", "1.2.3.4", "256.1.1.1", "000255.0.0.9", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (456) 555-2186", "+12", "+1..............9", " ", ".", "@", "é", "👍", "\n", "-", "%", "12", "+", "a@b", "1.2.3.", "word", "4876179267539117"]
    rows = [(k, "".join(rng.choices(bits, k=rng.randrange(14)))) for k in range(500)]
    rows += [(900, None), (901, ""), (None, "x a@b.c"), (902, "a@b.c"), (902, "a@b.c"), (903, "1" * 6_000), (904, "1 " * 30_000 + "a@b.c"), (905, "a" * 9_000), (906, "a." * 4_000 + "@b"), (907, "a@" + "b." * 9_000), (908, "1." * 40_000), (909, "+1" + " " * 50_000), (910, "word " * 50_000 + "4111 1111 1111 1111")]
    want = {(i, t): brute(t) for i, t in rows}
    got = run(spark, rows)
    assert len(got) == len(rows)
    assert sorted(tuple(r)[:6] for r in got if r["doc_id"]) == sorted((i, *want[i, t][:5]) for i, t in rows if i)
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] < 900:
            spans = [s for s in r["spans"].split(",") if s.split(":")[0] in ("email", "ip", "card", "phone")]
            assert ",".join(spans) == want[r["doc_id"], rows[r["doc_id"]][1]][5]


def test_revealing_terms(spark):
    rows = [(k, f"account of Zanzibella at zz@mail.com number {k} and common words") for k in range(6)]
    rows += [(100 + k, f"common words and account number {k}") for k in range(300)]
    rows += [(500, "here Zanzibella again, without her address"), (501, "common words only")]
    by = {r["doc_id"]: r for r in run(spark, rows)}
    assert by[500]["spans"] == "term:5:15" and by[501]["spans"] == "" and by[150]["n_term"] == 0
    assert by[3]["spans"] == "term:11:21,email:25:36" and by[3]["n_email"] == 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in sanitise(df).collect()}
    assert clean[3] == "account of  at <EMAIL> number 3 and common words" and clean[501] == rows[-1][1] and len(clean) == len(rows)


def test_planted_names_among_given_documents(spark):
    """Names that only occur with one person's address are found in a copy of the test table, wherever they occur; words of the text around aren't, nor are key words of patterns."""
    rng = random.Random(2)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    words = sorted({w for _, t in docs[:300] if t for w in t.split() if len(w) > 3 and w.isalpha()})
    names = {"Quintavalle": "m.q@corp7.example.com", "Ostrogradsky": "+1 (212) 555-0199", "Wolverhampstead": "44.12.13.14"}
    planted, told = [], {}
    for name, value in names.items():
        for k in range(9):
            t = " ".join(rng.choices(words, k=40))
            text = f"{t} {name} {' '.join(rng.choices(words, k=3))} {value}, {' '.join(rng.choices(words, k=30))}" if k < 8 else f"{t} {name} {t}"
            told[10**6 + len(planted)] = (name, text)
            planted.append((10**6 + len(planted), text))
    copies = [(2 * 10**6 + k, planted[0][1]) for k in range(40)]
    found = {r["doc_id"]: r for r in span_digests(spark.createDataFrame(docs + planted + copies, "doc_id long, text string")).collect()}
    for i, (name, text) in told.items():
        at = text.index(name)
        assert f"term:{at}:{at + len(name)}" in found[i]["spans"].split(",") and found[i]["n_term"] <= 2
    terms = {(i, s) for i, r in found.items() for s in r["spans"].split(",") if s.startswith("term")}
    assert len({i for i, _ in terms if i < 10**6}) <= 2


def test_clean_digest(spark):
    rows = [(k, f"account of Zanzibella at zz@mail.com number {k} and common words") for k in range(9)] + [(100 + k, f"common words and account number {k}") for k in range(300)] + [(900, None), (901, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r["doc_id"]: hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in sanitise(df).collect()}
    assert {r["doc_id"]: r["clean_sha256"] for r in span_digests(df).collect()} == clean


def test_empty(spark):
    assert run(spark, []) == []


def test_secrets(spark):
    rows = [(1, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" end'), (2, "x 1234567890123456789012345678901234567890 y"), (3, 'password: "hunter2hunter2"'), (4, "abcdefabcdefabcdefabcdefabcdefabcdef")]
    got = {r["doc_id"]: (r["n_secret"], [s for s in r["spans"].split(",") if s.startswith("secret")]) for r in run(spark, rows)}
    assert got == {1: (1, ["secret:9:49"]), 2: (0, []), 3: (1, ["secret:11:25"]), 4: (0, [])}


def test_disclosure_like_brute_force(spark):
    """Pairs of terms and entities, shares, classes and decisions, counted in dictionaries."""
    import math
    from collections import Counter

    from pyspark.sql import functions as F

    from pixelmill.llm import pii

    rng = random.Random(9)
    common = [a + b for a in ("ab", "cd", "ef", "gh") for b in ("lle", "mmo", "nni", "ppu", "rra")]
    told = {"zaq@one.com": "zanzibella", "bob@one.com": "bobbington", "1.2.3.4": "harbourkeep", "+1 (456) 555-2186": "hallmarken"}
    texts = []
    for _ in range(240):
        words = rng.choices(common, k=rng.randrange(10, 60))
        if rng.random() < 0.3:
            e = rng.choice(list(told))
            words[len(words) // 2 : len(words) // 2] = [told[e], e] if rng.random() < 0.8 else [e]
        if rng.random() < 0.04:
            words.append(rng.choice(list(told.values())))
        texts.append(" ".join(words))
    texts += texts[:30]  # copies
    term = re.compile(r"[^\W\d_]{4,}")
    near, contexts, n_entity, n_term, d_entity, d_term, seen = Counter(), {}, Counter(), Counter(), Counter(), Counter(), set()
    keys = {"token", "secret", "password", "passwd"}
    for t in texts:
        own = keys | {x.lower() for m in re.finditer("|".join([EMAIL, IP, PHONE]), t, re.ASCII) for x in term.findall(m[0])}
        n_term.update({x.lower() for x in term.findall(t)})
        pairs, ents = set(), set()
        for m in re.finditer("|".join([EMAIL, IP, PHONE]), t, re.ASCII):
            v, k = m[0].lower(), "email" if "@" in m[0] else "ip" if m[0][0] != "+" else "phone"
            of = v.split("@")[-1] if k == "email" else ".".join(v.split(".")[:2]) if k == "ip" else re.sub(r"\D", "", v)[:4]
            around = t[max(0, m.start() - 80) : m.start()] + " " + t[m.end() : m.end() + 80]
            for e in (f"{k}={v}", f"{k}~{of}"):
                ents.add(e)
                for x in {x.lower() for x in term.findall(around)} - own:
                    pairs.add((e, x))
                    contexts.setdefault((e, x), {}).setdefault(t, set()).add(around)
        near.update(pairs)
        n_entity.update(ents)
        if t not in seen:
            d_entity.update(ents)
            d_term.update({x.lower() for x in term.findall(t)})
        seen.add(t)
    k_of = {p: len({min(c) for c in contexts[p].values()}) for p in near}
    many = {p for p in near if k_of[p] > 1 and n_entity[p[0]] > 1}
    share = {(e, x): 1 + math.log2(near[e, x] / (n_term[x] + 0.5)) / -math.log2(n_entity[e] / len(texts)) for e, x in many}
    bits = {(e, x): k_of[e, x] * math.log2(k_of[e, x] * len(seen) / (math.e * d_term[x] * d_entity[e])) for e, x in many}
    sure = {p for p in many if share[p] >= pii.GENERALISE and bits[p] >= pii.SURE + math.log2(len(many))}
    flagged = {x for _, x in sure}
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("h", F.xxhash64("text")).repartition(3)
    got = {r["term"]: r for r in pii.disclosure(rows, rows.select("doc_id", "h", pii.base_spans(F.col("text")).alias("base"))).collect()}
    assert set(got) == flagged and set(told.values()) <= flagged
    for x, r in got.items():
        mine = [e for e, y in sure if y == x]
        assert abs(r["share"] - max(share[e, x] for e in mine)) < 1e-9
        coarse = []
        for e in mine:
            both = sum(near[f, y] for f, y in many if f == e and y[:3] == x[:3])
            every = sum(n for y, n in n_term.items() if y[:3] == x[:3])
            coarse.append(1 + math.log2(both / (every + 0.5)) / -math.log2(n_entity[e] / len(texts)))
        assert abs(r["coarse"] - max(coarse)) < 1e-9


def test_sanitise_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "write to a@b.com now", 7, "x"), (2, None, 8, "y")], "doc_id long, text string, h long, _spans string").selectExpr("*", "doc_id AS spans", "text AS whole", "h AS row")
    got = {r["doc_id"]: r for r in sanitise(df).collect()}
    assert got[1]["text"] == "write to <EMAIL> now" and got[2]["text"] is None and got[1]["h"] == 7 and got[2]["_spans"] == "y" and sanitise(df).columns == df.columns
