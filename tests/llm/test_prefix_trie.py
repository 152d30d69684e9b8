import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

from fenestra.llm import oracles, prefix_trie, registry
from fenestra.llm.prefix_trie import Louds

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string"


def conversations(seed=1, convs=400):
    """Copies, a first turn that a third share, one that leads many apart later, missing bases, nulls, ties, deep ones."""
    rng, rows = random.Random(seed), []
    for c in range(convs):
        if rng.random() < 0.1:
            continue
        kind = c % 6
        if kind in (0, 1):
            texts = ["hello", *(rng.choice(["yes", "no", "né", None]) for _ in range(rng.randint(0, 6)))]
        elif kind == 2:
            texts = ["same", "conversation", "all along"]
        elif kind == 3:
            texts = ["a"] * 5 + [f"end {rng.randint(0, 20)}"]
        elif kind == 4 and c % 60 == 4:
            texts = [f"deep {i}" for i in range(300)]
        else:
            texts = [f"own {rng.randint(0, 50)}", "then", ""]
        rows += [(c, None if i == 0 and c % 7 == 0 else i, "user" if i % 2 == 0 else rng.choice(["assistant", None, ""]), t, "x") for i, t in enumerate(texts)]
    rows += [(None, 1, "user", "no conversation", "x"), (-3, 0, "user", "below zero", "x"), (-5, 0, "user", "below zero", "x"), (1001, None, "user", "only one, its base is absent", "x"), (1002, 1, "a", "twice", "x"), (1002, 1, "a", "twice", "x")]
    rng.shuffle(rows)
    return rows


def brute(rows, family, shares):
    own = {}
    for c, turn, role, text, _ in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            own.setdefault(c, []).append((turn is not None, turn or 0, digest, (role, text)))
    own = {c: [t[3] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        base = c - (abs(c) % family) * (1 if c >= 0 else -1)
        built[c] = own.get(base, [])[: shares(c)] + turns[shares(c) :]
    members, ends = {}, {}
    for c, turns in sorted(built.items()):
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    kids, below = {}, {}
    for node in members:
        if node:
            kids[node[:-1]] = kids.get(node[:-1], 0) + 1
    for node, cs in members.items():
        leaf, saved = node not in kids, (len(cs) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            got = below.setdefault(node[:d], [0, 0])
            got[0] += leaf
            got[1] += saved
    return sorted(
        (cs[0], len(n), members[n[:-1]][0] if n else -1, len(cs), kids.get(n, 0), *below[n], hashlib.sha256(",".join(map(str, ends.get(n, []))).encode()).hexdigest()) for n, cs in members.items()
    )


def got(df):
    return sorted((r.conv_id, r.depth, -1 if r.depth == 0 else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


@pytest.mark.parametrize("limits", [(64, 500_000, 50_000, 4096), (3, 500_000, 20, 2), (100_000, 500_000, 50_000, 3)])
def test_against_brute_force(spark, monkeypatch, limits):
    for name, value in zip(("SHARED_BY", "MAX_UPPER", "SHARD_NODES", "STRETCH"), limits, strict=True):
        monkeypatch.setattr(prefix_trie, name, value)
    rows = conversations()
    table = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert got(prefix_trie.prefix_trie(table)) == brute(rows, 1, lambda c: 0)
    shares = lambda c: zlib.crc32(str(c).encode()) % 9
    assert got(prefix_trie.prefix_trie(table, family=5, shares=prefix_trie.crc_shares, most=8)) == brute(rows, 5, shares)


def test_turnless_and_empty(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(c, 0, "user", "one", "x") for c in range(1, 5)]  # base 0 is absent: who shares one turn or more has none
    shares = lambda c: 3
    assert got(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), family=5, shares=shares, most=3)) == [(1, 0, -1, 4, 0, 1, 0, hashlib.sha256(b"1,2,3,4").hexdigest())]


def test_louds_children_parents_and_sums():
    rng = np.random.default_rng(2)
    names = np.array([rng.bytes(16) for _ in range(500)], dtype="S16")
    up = [int(rng.integers(-1, i)) if i else -1 for i in range(500)]
    mixed = rng.permutation(500)
    trie = Louds(names[mixed], np.array([b"none" if up[i] < 0 else names[up[i]] for i in mixed], dtype="S16"))
    again = Louds.stored(np.packbits(trie.bits).tobytes(), trie.labels.tobytes())
    number = {trie.labels[i]: i + 1 for i in range(500)}
    for i in range(500):
        node, parent = number[names[i]], number[names[up[i]]] if up[i] >= 0 else 0
        for t in (trie, again):
            assert t.parent[node] == parent and node in t.children(parent) and t.find(names[i], parent) == node
        assert trie.find(b"nobody", node) == -1
    sums = np.ones(500)
    for i in range(499, -1, -1):
        if up[i] >= 0:
            sums[up[i]] += sums[i]
    assert (trie.add_up(np.concatenate([[0], np.ones(500)]))[[number[n] for n in names]] == sums).all()
    assert Louds(names[:0], names[:0]).children(0) == range(1, 1)


def test_stored_tries_follow_every_conversation(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SHARED_BY", 5)
    rows = [r for r in conversations(3, 200) if r[0] is not None and r[0] < 1000]
    shards = prefix_trie.tries(spark.createDataFrame(rows, SCHEMA)).collect()
    tries = [(Louds.stored(r.bits, r.labels), r.conv_ids) for r in shards]
    assert sum(r.n for r in shards) == len(brute(rows, 1, lambda c: 0))
    upper = next(t for r, (t, _) in zip(shards, tries, strict=True) if r.shard == -1)
    first = hashlib.blake2b(prefix_trie.ROOT + hashlib.sha256(b"4:userhello").digest()[:16], digest_size=16).digest()
    assert upper.find(first, upper.find(prefix_trie.ROOT, 0)) > 0


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    df = registry.QUERIES["op13_prefix_trie"](spark, sf)
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    want = [tuple(-1 if v is None else v for v in r) for r in con.sql(f"SELECT {', '.join(cols)} FROM ({oracles.TRIE})").fetchall()]
    assert df.columns == cols and got(df) == sorted(want)
