import math
import re
from collections import defaultdict

import pytest

from fenestra.llm.mixing import mix_sources

SCHEMA = "doc_id bigint, text string, source string, size string"
WORD = re.compile(r"[^\x20\x09-\x0d]+")


def targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    """Brute force: hand out, cut what is above, hand out again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, out, open_ = share * sum(sizes.values()), dict.fromkeys(order, 0.0), set(order)
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in list(open_):
            out[s] += left * weight[s] / total
        left = 0.0
        for s in list(open_):
            if out[s] >= cap * sizes[s]:
                left += out[s] - cap * sizes[s]
                out[s] = cap * sizes[s]
                open_.discard(s)
    return out


def rows(n):
    out = [(i, "w " * (1 + (i * 7919) % 97 + (900 if i % 50 == 3 else 0)), f"s{i % 7}" if i % 11 else None, "x") for i in range(n)]
    return out + [(10_000, None, "s1", None), (10_001, "", "s2", None), (10_002, " \n\t", "only-empty", None), (None, "a b c", "s3", None), (10_003, "w " * 50_000, "s0", None)] + [(20_000, "same text here", "s5", None)] * 60


def test_against_brute_force(spark):
    data = rows(900)
    got = mix_sources(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(got) == len(data)
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, text, source, _ in data:
        sizes[source] += len(WORD.findall(text or ""))
    want = targets(sizes)
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r["size"]
        assert r.taken == r.copies * r["size"]
        assert r.target == pytest.approx(want[r.source], rel=1e-9)
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(2, 0.002 * t), s


def test_reruns_and_row_order_agree(spark):
    df = spark.createDataFrame(rows(300), SCHEMA)
    a = sorted(map(str, mix_sources(df).collect()))
    b = sorted(map(str, mix_sources(df.repartition(7, "source").orderBy("text")).collect()))
    assert a == b


def test_tilt_is_exponential(spark):
    """Rates of one source follow exp(lambda * size): the share of larger documents falls or rises with their size."""
    data = [(i, "w " * (1 + i % 40), "a" if i % 2 else "b", None) for i in range(4000)]
    got = mix_sources(spark.createDataFrame(data, SCHEMA)).collect()
    for s in "ab":
        of = defaultdict(list)
        for r in got:
            if r.source == s:
                of[r["size"]].append(r.copies)
        rate = {k: sum(v) / len(v) for k, v in of.items()}
        logs = [math.log(rate[k]) for k in sorted(rate) if 0.2 < rate[k] < 1.9]
        steps = [y - x for x, y in zip(logs, logs[1:], strict=False)]
        assert len({x > 0 for x in steps if abs(x) > 0.03}) <= 1


def test_empty(spark):
    assert mix_sources(spark.createDataFrame([], SCHEMA)).collect() == []
