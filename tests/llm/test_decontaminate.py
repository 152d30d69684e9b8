import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from fenestra.llm.decontaminate import contamination, drop_contaminated

WORD = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def fixture():
    rng = random.Random(9)
    vocab = ["".join(rng.choices("abcdeé", k=rng.randint(1, 4))) for _ in range(60)]
    line = lambda n: " ".join(rng.choices(vocab, k=n))
    items = [(i, line(rng.randint(12, 40))) for i in range(12)] + [(50, "Short ITEM only"), (51, None), (52, " .. "), (53, "solo"), (54, "x " * 14), (55, "É È é " * 4)]
    docs = []
    for i in range(150):
        parts = [line(rng.randint(3, 40))]
        if i % 4 == 0:
            w = WORD.findall(rng.choice(items[:12])[1])
            a = rng.randrange(len(w) - 9)
            parts += [", ".join(w[a : a + rng.randint(8, 14)]).upper() if i % 8 else "\n".join(w[a:]), line(5)]
        docs.append((i, " ".join(parts)))
    hot = items[3][1] + " tail"
    docs += [(200 + i, hot) for i in range(60)]
    items += [items[2], items[2], (2, items[4][1]), (None, line(14)), (None, "null id too"), (56, "ΟΔΟΣ ΑΣ ΒΣ ΓΣ ΔΣ ΕΣ ΖΣ ΗΣ ΘΣ ΙΣ"), (57, "K İ ſ plus seven more words of this item")]
    docs += [(310, items[2][1]), (311, "ΟΔΟΣ ΑΣ .ΒΣ. ΓΣ ΔΣ.ΕΣ ΖΣ ΗΣ' ΘΣ ΙΣ"), (312, "οδος ας βς γς δς ες ζς ης θς ις"), (313, "x " + items[-4][1]), (314, "k i s plus seven more words of this item"), (315, "K İ ſ PLUS SEVEN MORE WORDS OF THIS ITEM")]
    docs += [(300, None), (301, ""), (302, "a short item ONLY here; solo"), (303, "-x" * 30), (304, "é è é " * 4), (305, "É È é " * 4), (306, line(30_000) + " " + items[5][1]), (None, items[1][1]), (307, "solo"), (307, "solo"), (307, "other")]
    return docs, items


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, items, window=10):
    of = [(i, WORD.findall(lower(t))) for i, t in items]
    out = []
    for doc_id, text in docs:
        words, hit, who = WORD.findall(lower(text)), set(), set()
        for item, w in of:
            k = min(window, len(w))
            if not k:
                continue
            wins = {tuple(w[s : s + k]) for s in range(len(w) - k + 1)}
            for s in range(len(words) - k + 1):
                if tuple(words[s : s + k]) in wins:
                    hit |= set(range(s, s + k))
                    who.add(item)
        sha = hashlib.sha256(",".join(sorted(str(i) for i in who if i is not None)).encode()).hexdigest()
        out.append((doc_id, len(words), len(hit), len(who), sha, bool(hit)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    docs, items = fixture()
    d = spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id bigint, text string, pos string").repartition(6)
    b = spark.createDataFrame(items, "item_id bigint, text string")
    got = contamination(d, b).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got), key=str) == brute(docs, items)
    assert sum(r.n_near for r in got) > 0
    assert {r.doc_id: r.n_hit for r in got}[310] >= 12
    clash = d.withColumns({c: F.lit(c) for c in ("__row", "__id", "row", "it", "place", "item_id")})
    kept = drop_contaminated(clash, b.withColumn("doc_id", F.lit(1)))
    assert kept.dtypes == clash.dtypes
    assert kept.count() == sum(not r[5] for r in brute(docs, items))


def test_empty(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    b = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert contamination(d.where("false"), b).count() == 0
    assert contamination(d, b.where("false")).first().n_hit == 0
    assert contamination(d, b).first().n_hit == 2


def brute_near(docs, items, window=10, slop=3):
    split = lambda t: WORD.findall(lower(t))
    df = Counter(w for _, t in docs for w in split(t))
    out = []
    for doc_id, text in docs:
        n, words = 0, split(text)
        for _, t in items:
            w = split(t)
            seeds = {a for s in range(max(len(w) - window, 0) + 1) for a in sorted(range(s, min(s + window, len(w))), key=lambda a: (df[w[a]], a))[:2]}
            met = [(p - a, a, p) for p, x in enumerate(words) for a in seeds if w[a] == x]
            n += any(abs(s - r) <= slop and a != b and p != q for s, a, p in met for r, b, q in met)
        out.append((doc_id, n))
    return sorted(out, key=str)


def test_proximity_against_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.sample(vocab, 14))) for i in range(6)] + [(6, "twin " * 12), (7, "solo")]
    docs = [(1000, "twin alone"), (1001, "solo"), (1002, None), (1003, "")]
    for item, text in items[:6]:
        w = text.split()
        # words put between or taken out, at every place of the passage modulo 4
        for lead in range(4):
            for put in range(-3, 6):
                body = w[:7] + ["filler"] * put + w[7:] if put >= 0 else w[:6] + w[6 - put :]
                docs.append((item * 100 + lead * 10 + put + 3, " ".join(["lead"] * lead + body)))
    docs += [(2000 + i, " ".join(rng.choices(vocab, k=60))) for i in range(40)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id bigint, text string")
    assert sorted(((r.doc_id, r.n_near) for r in contamination(d, b).collect()), key=str) == brute_near(docs, items)


def test_shifted_seeds_meet_wherever_they_start(spark):
    """Two rare words 1 to 3 words nearer or farther than in the item match, 4 don't."""
    w = [f"c{i}" for i in range(10)]
    item = " ".join(w[:2] + ["rareone"] + w[2:5] + ["raretwo"] + w[5:8])
    common = [(10_000 + i, " ".join(w[:8])) for i in range(100)]
    docs = {lead * 10 + put: " ".join(["x"] * lead + ["rareone"] + ["y"] * (3 + put) + ["raretwo"]) for lead in range(6) for put in range(5)}
    d = spark.createDataFrame([*docs.items(), *common], "doc_id bigint, text string")
    got = {r.doc_id: r.n_near for r in contamination(d, spark.createDataFrame([(1, item)], "item_id bigint, text string")).collect()}
    assert {k: got[k] for k in docs} == {k: int(k % 10 <= 3) for k in docs}
