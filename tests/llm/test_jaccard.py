import random
import re

import numpy as np
import pyarrow as pa
import pytest

from fenestra.llm import jaccard
from fenestra.llm.jaccard import Bands, Shingler, drop_near, near_groups

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def shingles(text, words):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def brute(rows, words, percent):
    sets = [shingles(t, words) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def fixture(seed=1, n=260):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdefghé", k=rng.randint(1, 6))) for _ in range(900)]
    boiler = rng.choices(vocab, k=45)
    rows, texts = [], []
    for i in range(n):
        if texts and rng.random() < 0.6:
            w = list(rng.choice(texts))
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 8])):
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, 2)] = rng.choices(vocab, k=rng.randint(0, 2))
                w = w or ["x"]
        else:
            w = rng.choices(vocab, k=int(3 * 10 ** (2.2 * rng.random()))) + (boiler if rng.random() < 0.3 else [])
        texts.append(w)
        text = rng.choice([" ", "  ", "\n"]).join(w)
        rows.append((i, text.upper() if i % 17 == 0 else text))
    base = rng.choices(vocab, k=200)
    for i in range(80):  # a chain and a cloud of near copies
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((1000 + i, " ".join(w)))
    long = " ".join(rng.choices(vocab, k=12_000))
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "one"), (2004, "ONE"), (2005, "one two"), (2006, long), (2007, long + " and more"), (2008, "z" * 400_000), (None, long), (None, None), (2009, "same words here again"), (2009, "same words here again")]
    return rows


@pytest.mark.parametrize(("words", "percent"), [(4, 85), (5, 80), (2, 60)])
def test_against_brute_force(spark, words, percent):
    rows = fixture()
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id bigint, text string, n int").repartition(6)
    got = near_groups(df, words=words, percent=percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, words, percent)


@pytest.mark.parametrize("skipped", [("centre",), ("centre", "nearest")])
def test_last_round_alone_finds_all(spark, monkeypatch, skipped):
    """Without the rounds before, pairs between components must bring every link."""
    whole = jaccard._pairs
    monkeypatch.setattr(jaccard, "_pairs", lambda mode, percent: (lambda batches: iter(())) if mode in skipped else whole(mode, percent))
    rows = fixture(7, 120)
    got = near_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), words=3, percent=75).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, 3, 75)


def test_blocks_and_large_buckets(spark, monkeypatch):
    """Buckets dealt into many small blocks, and too large to be held, give the same."""
    for name in ("RUN_ROWS", "BLOCK", "FLUSH_PAIRS"):
        monkeypatch.setattr(jaccard, name, 5)
    monkeypatch.setattr(jaccard, "TURN_BYTES", 5000)
    rows = fixture(8, 60)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    for modes in ((), ("centre", "nearest")):
        whole = jaccard._pairs
        monkeypatch.setattr(jaccard, "_pairs", lambda mode, percent: (lambda batches: iter(())) if mode in modes else whole(mode, percent))  # noqa: B023
        got = near_groups(df, words=3, percent=75).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, 3, 75)
        monkeypatch.setattr(jaccard, "_pairs", whole)


def test_rows_made_grow_with_the_sets(spark, monkeypatch):
    """A large group of near copies, of whose pairs only some link, makes rows as its index has, not a row a pair."""
    rng = random.Random(9)
    rows = []
    for i in range(400):
        w = [f"w{j}" for j in range(120)]
        for at in rng.sample(range(120), rng.choice([4, 5, 6, 7, 7, 8, 8, 9, 9, 10])):
            w[at] = f"x{i}y{at}"
        rows.append((i, " ".join(w)))
    made, whole = spark.sparkContext.accumulator(0), jaccard._pairs

    def counted(mode, percent):
        run = whole(mode, percent)

        def counting(batches):
            for batch in run(batches):
                made.add(batch.num_rows)
                yield batch

        return counting

    monkeypatch.setattr(jaccard, "_pairs", counted)
    got = near_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), words=1, percent=80).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, 1, 80)
    assert made.value < 40 * len(rows)


def test_pairs_below_the_threshold_leave_no_rows():
    """Sets just too far apart make one group by their sketches, a forest and no pairs, and no link by their shingles."""
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    sets = [np.unique(np.concatenate((rng.permutation(base)[:188], rng.integers(0, 1 << 63, 12, dtype=np.uint64)))) for _ in range(120)]
    row = lambda i, s, whole: {"bucket": 1, "block": 0, "role": 0, "probe": 0, "class": i, "component": i, "n": len(s), "sketch": jaccard.sketch(s).tobytes(), "shingles": s.tobytes() if whole else None}
    made = []
    for whole in (False, True):
        batch = pa.RecordBatch.from_pylist([row(i, s, whole) for i, s in enumerate(sets)])
        made.append(sum(b.num_rows for b in jaccard._pairs("own", 80)(iter([batch]))))
    linked = [(i, j) for i in range(120) for j in range(i) if 100 * (both := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (len(sets[i]) + len(sets[j]) - both)]
    assert 60 < made[0] < 120 and made[1] <= len(linked)


def test_runs_of_large_buckets(monkeypatch):
    rng = np.random.default_rng(2)
    for most in (3, 10, 1000):
        monkeypatch.setattr(jaccard, "RUN_ROWS", most)
        k = np.sort(rng.integers(0, 30, 500) ** 2 // 40 * 2)
        batches = [pa.RecordBatch.from_arrays([pa.array(x), pa.array(x + 7)], names=["k", "class"]) for x in np.split(k, np.sort(rng.integers(0, 500, 12)))]
        pieces = list(jaccard._runs(iter(batches)))
        assert np.concatenate([p[0] for p in pieces]).tolist() == k.tolist()
        whole = [set((p[0] >> 1).tolist()) for p in pieces if not p[2]]
        parts = {b for p in pieces if p[2] for b in (p[0] >> 1).tolist()}
        assert sum(map(len, whole)) == len(set().union(*whole)) and not parts & set().union(*whole)


def test_repeated_rows_and_clashing_columns(spark):
    schema = "doc_id bigint, text string, __row string, class string, it int"
    same = "the very same seven words in here"
    docs = spark.createDataFrame([(1, same, "a", "b", 1), (1, same, "a", "b", 1), (1, same + " x", "c", "d", 2), (2, same, "e", "f", 3), (3, "alone", None, None, None), (4, None, "g", "h", 4), (4, None, "g", "h", 4)], schema)
    kept = drop_near(docs, words=1, percent=80)
    assert kept.dtypes == docs.dtypes
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 4]
    assert {r["__row"] for r in kept.collect() if r.doc_id == 1} < {"a", "c"}


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(4)
    for size in (3, 40, 700, 9000):
        a, b = (np.unique(rng.integers(0, 2 * size, size, dtype=np.uint64)) for _ in "ab")
        x, y = jaccard.sketch(a), jaccard.sketch(b)
        words = min(len(x), len(y))
        assert np.bitwise_count(jaccard.fold(x, words) ^ jaccard.fold(y, words)).sum() <= len(np.setxor1d(a, b))


def test_every_link_shares_a_bucket():
    """The pigeonhole, on pairs at the very threshold, for many sizes."""
    rng = np.random.default_rng(3)
    for percent in (60, 80, 85, 90):
        bands = Bands(percent)
        for _ in range(400):
            p = int(10 ** rng.uniform(0.3, 3.4))
            a = np.unique(rng.integers(0, 1 << 63, p, dtype=np.uint64))
            room = 2 * len(a) * (100 - percent) // (100 + percent)
            drop = int(rng.integers(0, room + 1))
            b = np.unique(np.concatenate((a[rng.permutation(len(a))[: len(a) - drop]], rng.integers(0, 1 << 63, int(rng.integers(0, room - drop + 1)), dtype=np.uint64))))
            both = len(np.intersect1d(a, b))
            if 100 * both >= percent * (len(a) + len(b) - both) and not np.array_equal(a, b):
                x, y = bands.rows(a), bands.rows(b)
                own = {int(k) >> 1 for k in x if not int(k) & 1}, {int(k) >> 1 for k in y if not int(k) & 1}
                every = {int(k) >> 1 for k in x}, {int(k) >> 1 for k in y}
                assert own[0] & every[1] or own[1] & every[0]


def test_hashes_of_pieces(monkeypatch):
    """Cutting a buffer into small pieces changes nothing."""
    texts = [t for _, t in fixture(5, 60)]
    whole = [s.tolist() for s in Shingler(3).sets(texts)]
    monkeypatch.setattr(jaccard, "PIECE", 300)
    assert [s.tolist() for s in Shingler(3).sets(texts)] == whole
    assert [len(s) for s in whole] == [len(shingles(t, 3)) for t in texts]


def test_pipeline_form_and_empty(spark):
    rows = fixture(2, 100)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = drop_near(df)
    want = {c for _, _, c in brute(rows, 5, 80) if c is not None}
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == want and kept.columns == df.columns
    assert near_groups(df.where("false")).count() == 0
