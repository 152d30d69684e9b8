import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from fenestra.llm import oracles, registry, treaps
from fenestra.llm.common import Scratch
from fenestra.llm.treaps import ranked_search, search, segments, word_totals

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def brute(docs, items, k=10):
    counts = [(d, Counter(words(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, n_words = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(words(text))
    out = []
    for item, terms in asked.items():
        scores = []
        for d, c in counts:
            m = 10 + 90 * c.total() * n_docs // n_words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return out


def tables(seed, n=500):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "Straße", "x1", "THE"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    texts = ["-, ".join(rng.choices(vocabulary, weights, k=rng.choice([0, 1, 5, 30, 200]))) for _ in range(n)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, "w3 the w3, copies") for i in range(n // 3)] + [(None, "w50 w51"), (5, "twice w40"), (5, "twice w40"), (6, None), (7, " .,"), (8, "w1 " * 5000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 12])))) for i in range(30)]
    items += [(100, None), (101, ""), (102, "nowhere"), (103, "the THE the É"), (104, "w50"), (104, "twice"), (None, "copies")]
    rng.shuffle(docs)
    return docs, items


def frames(spark, docs, items, parts=4):
    return spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, score string").repartition(parts), spark.createDataFrame([(*i, 1) for i in items], "item_id bigint, text string, rank int")


def rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


@pytest.mark.parametrize(("seed", "docs_each", "short", "block"), [(1, 1 << 16, 64, 20_000), (2, 40, 4, 20_000), (3, 300, 1, 15)])
def test_against_brute_force(spark, monkeypatch, seed, docs_each, short, block):
    for name, value in (("SEGMENT_DOCS", docs_each), ("SHORT", short), ("BLOCK_TERMS", block)):
        monkeypatch.setattr(treaps, name, value)
    docs, items = tables(seed)
    got = rows(ranked_search(*frames(spark, docs, items)))
    assert got == sorted(brute(docs, items), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def test_empty_tables(spark):
    docs, items = frames(spark, *tables(4, 20))
    assert ranked_search(docs.limit(0), items).collect() == [] == ranked_search(docs, items.limit(0)).collect()


def test_treaps_are_search_trees_and_heaps():
    rng = np.random.default_rng(5)
    sizes = np.array([1, 0, 300, 7])
    docs = np.concatenate([np.sort(rng.choice(5000, n, replace=False)) for n in sizes])
    impacts = rng.integers(0, 4, sizes.sum())
    left, right = treaps.treaps(impacts, docs, sizes)
    at = 0
    for size in sizes:
        own = slice(at, at + size)
        l, r, d, v = left[own], right[own], docs[own], impacts[own]
        child = {int(x) for x in [*l, *r] if x >= 0}
        assert len(child) == max(size - 1, 0)
        depth = 0
        todo = [(i, -1, 1 << 40, 1) for i in range(size) if i not in child]
        while todo:
            i, low, high, level = todo.pop()
            depth = max(depth, level)
            assert low < d[i] < high
            for c, lo, hi in ((l[i], low, d[i]), (r[i], d[i], high)):
                if c >= 0:
                    assert v[c] <= v[i]
                    todo.append((c, lo, hi, level + 1))
        assert depth < 12 + 6 * math.log2(size + 1)
        at += size


def test_bounds_leave_documents_out(spark):
    """One document in a thousand has both rare terms; the rest is seen through its bound alone."""
    rng = random.Random(6)
    docs = [(i, ("gold silver " if i % 1000 == 7 else "") + " ".join(rng.choices(["iron", "tin", "lead"], k=20))) for i in range(8000)]
    row = segments(*(lambda d: (d, word_totals(d)))(spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1))).collect()
    assert len(row) == 1
    codes = {t: i for i, t in enumerate(["gold", "iron", "silver"])}
    best = treaps.Best(1, 5)
    scored = treaps.Segment(row[0].asDict(), codes).search(np.zeros(3, dtype=np.int64), np.arange(3), np.array([9000, 10, 9000]), best)
    assert sorted(best.doc % 1000) == [7] * 5 and scored < 1000


def test_an_index_of_all_terms_serves_other_queries(spark):
    docs, items = tables(7, 200)
    table, asked = frames(spark, docs, items)
    kept, totals = Scratch(spark, "index"), word_totals(table)
    index = kept.put(segments(table, totals))
    for own in (items[:5], items[5:]):
        terms = treaps.query_terms(frames(spark, docs[:1], own)[1])
        assert rows(search(kept, index, totals, terms, k=3)) == sorted(brute(docs, own, 3), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def test_query_against_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    df = registry.QUERIES["op12_ranked_search"](spark, "/root/testdata/sf0.01")
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows(df) == sorted(con.sql(f"SELECT item_id, rank, doc_id, score FROM ({oracles.RANKED})").fetchall())
