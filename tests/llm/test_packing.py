import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fenestra.llm import registry
from fenestra.llm.packing import TextIds, best_fit, exact_patterns, fit_counts, pack_documents, packing_runs, round_counts, text_ids, vocabulary_path

HARD = "abzABZ 019.,'’\"-_\n\t\x1c\x85\xa0éÉßØøµªº½²ɏĳİıœŒ–—·×÷Δσς中<|endoftext|>strevmlld"


def plain_ids(encoder: TextIds, text: str | None) -> list[int]:
    return [*encoder.whole.encode(text or "", add_special_tokens=False).ids, 0]


def test_ids_are_the_tokenizers_own():
    encoder, rng = TextIds(vocabulary_path()), random.Random(1)
    assert encoder.plain
    for slice_chars in (1 << 20, 5):
        encoder.SLICE = slice_chars
        for _ in range(3000):
            text = "".join(rng.choices(HARD, k=rng.randint(0, 40)))
            assert encoder(text) == encoder.full(text), text


def test_patterns_are_all_exact_fills():
    got = {tuple(p) for p in exact_patterns(np.array([1, 2, 3, 5, 7, 8, 10]), 10).tolist()}
    lengths = [1, 2, 3, 5, 7, 8]
    want = {(a, b, c) for a in lengths for b in lengths for c in [0, *lengths] if a >= b >= c and a + b + c == 10}
    assert got == want


def test_least_squares_on_what_patterns_can_make():
    rng = np.random.default_rng(3)
    patterns = exact_patterns(np.arange(1, 64), 64)
    made = rng.choice(len(patterns), 40, replace=False)
    counts = np.zeros(65, dtype=np.int64)
    for p in patterns[made]:
        np.add.at(counts, p[p > 0], 50)
    used, repeats = fit_counts(patterns, counts)
    assert (repeats > 0).all() and len(used) <= 64
    got = np.zeros(65)
    np.add.at(got, used.T, np.broadcast_to(repeats, (3, len(used))))
    assert np.abs(got - counts)[1:].sum() < 0.1 * counts.sum()
    whole, left = round_counts(used, repeats, counts)
    np.add.at(left, used.T, np.broadcast_to(whole, (3, len(used))))
    left[0] = 0
    assert (whole >= 0).all() and (left == counts).all()


def fit_one_by_one(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(8))
def test_best_fit_in_bulk_equals_one_by_one(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([rng.randint(1, 100), rng.choice([7, 30, 50])]) for _ in range(rng.randint(0, 400))]
    bins = best_fit(np.bincount(lengths, minlength=101) if lengths else np.zeros(101, dtype=np.int64), 100)
    assert sorted(100 - sum(v * k for v, k in own) for n, own in bins for _ in range(n)) == fit_one_by_one(lengths, 100)


def laid_out(runs, counts):
    """(sequence, offset, length) of every piece of a plan."""
    out = []
    for length, n in enumerate(counts):
        own = runs[runs[:, 0] == length]
        for rank in range(n):
            _, first, each, sequence, offset = own[np.searchsorted(own[:, 1], rank, side="right") - 1]
            out.append((sequence + (rank - first) // each, offset + (rank - first) % each * length, length))
    return out


def gapless(places, capacity):
    at = {}
    for sequence, offset, length in sorted(places):
        assert at.get(sequence, 0) == offset
        at[sequence] = offset + length
    assert all(v <= capacity for v in at.values())
    return len(at)


@pytest.mark.parametrize("shape", ["uniform", "short", "one length", "full", "none", "copies"])
def test_plans_are_gapless_and_near_the_least(shape):
    rng, capacity = np.random.default_rng(5), 256
    lengths = {
        "uniform": rng.integers(1, 257, 4000), "short": rng.integers(1, 12, 4000), "one length": np.full(1000, 100), "full": np.full(50, 256), "none": np.zeros(0, dtype=np.int64),
        "copies": np.concatenate([np.full(1500, 171), np.full(1200, 85), rng.integers(1, 256, 2000)]),
    }[shape]
    counts = np.bincount(lengths, minlength=capacity + 1)
    used = gapless(laid_out(packing_runs(counts, capacity), counts), capacity)
    plain = sum(n for n, _ in best_fit(counts, capacity))
    assert used <= 1.004 * plain


def test_documents(spark):
    rng, encoder = random.Random(4), text_ids(vocabulary_path())
    rows = [(i, " ".join(rng.choices(["word", "Été,", "x1y2", "the", "中文"], k=rng.choice([3, 20, 60, 700]))), "c") for i in range(150)]
    rows += [(500, None, "c"), (501, "", "c"), (None, "no id", "c"), (7, "twice", "c"), (7, "twice", "c"), (502, "long " * 20_000, "c")] + [(600 + i, "same text", "c") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, length string").repartition(5)
    got = pack_documents(docs, capacity=64).collect()
    want = []
    for doc_id, text, _ in rows:
        ids = plain_ids(encoder, text)
        want += [(doc_id, at // 64, at, len(ids[at : at + 64]), zlib.crc32(np.array(ids[at : at + 64], dtype="<u4").tobytes())) for at in range(0, len(ids), 64)]
    order = lambda r: tuple((v is None, v) for v in r)
    assert sorted((tuple(r)[:5] for r in got), key=order) == sorted(want, key=order)
    used = gapless([(r.sequence_id, r.offset, r.length) for r in got], 64)
    assert used <= 1.01 * -(-sum(w[3] for w in want) // 64) + 1


def test_empty_table_and_other_ids(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
    got = pack_documents(spark.createDataFrame([("a", "some words"), ("b", None)], "doc_id string, text string")).collect()
    assert {(r.doc_id, r.piece, r.start) for r in got} == {("a", 0, 0), ("b", 0, 0)} and len({r.sequence_id for r in got}) == 1


def test_query(spark):
    got = registry.QUERIES["op11_pack"](spark, "/root/testdata/sf0.001")
    docs, encoder = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect(), text_ids(vocabulary_path())
    sums = {r.doc_id: r.n for r in got.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert sums == {r.doc_id: len(plain_ids(encoder, r.text)) for r in docs}
    used = gapless([(r.sequence_id, r.offset, r.length) for r in got.collect()], 2048)
    assert used <= 1.01 * -(-sum(sums.values()) // 2048) + 1
