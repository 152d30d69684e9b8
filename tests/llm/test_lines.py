import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from fenestra.llm.lines import PerfectHash, dedup_lines

STRIP = "\x20\t\n\x0b\x0c\r"


def fixture():
    rng = random.Random(4)
    common = ["  Cookie Notice", "cookie notice\t", "ÄHNLICH", "ähnlich", "x", ""]
    docs = []
    for i in range(300):
        lines = [f"line {rng.randint(0, 4000)}" for _ in range(rng.randint(0, 12))]
        lines += rng.choices(common, k=3) + [f"rare {i // 9}", f"often {i // 11}"]
        rng.shuffle(lines)
        docs.append((i, "\n".join(lines)))
    docs += [(900, None), (901, ""), (902, "\n\n"), (903, "x"), (None, "x\nonly here"), (904, "y" * 300_000 + "\nx"), (905, "\n".join(f"l{i}" for i in range(20_000)))]
    return docs + [(906, "twice\nover")] * 12


def brute(docs, least_chars=1, least_docs=10):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(STRIP))
    seen = Counter(k for _, t in docs for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for doc_id, t in docs:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (len(key(x)) >= least_chars and seen[key(x)] >= least_docs)]
        out.append((doc_id, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("least_chars", "shard_keys"), [(1, 10**6), (1, 500), (4, 3000)])
def test_against_brute_force(spark, least_chars, shard_keys):
    docs = fixture()
    df = spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id bigint, text string, gone string").repartition(5)
    got = dedup_lines(df, least_chars=least_chars, shard_keys=shard_keys, keep=("gone",)).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got), key=str) == brute(docs, least_chars)
    assert {r.gone for r in got} == {"x"}


def test_hot_keys_give_the_same(spark, monkeypatch):
    from fenestra.llm import lines

    monkeypatch.setattr(lines, "HOT_PARTS", 400)
    docs = fixture()
    got = dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got), key=str) == brute(docs)


def test_empty(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    assert dedup_lines(spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")).count() == 2


def test_perfect_hash():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 50_000, dtype=np.uint64)
    keys = np.unique(keys)
    h = PerfectHash.from_bytes(PerfectHash.build(keys).to_bytes())
    assert np.array_equal(np.sort(h.find(keys)), np.arange(len(keys))) and len(h) == len(keys)
    assert len(h.to_bytes()) < len(keys)
    assert PerfectHash.from_bytes(PerfectHash.build(keys[:1]).to_bytes()).find(keys[:1])[0] == 0
