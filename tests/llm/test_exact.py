import hashlib
import re

import pytest

from fenestra.llm import exact

SPACE = re.compile(r"[\x20\x09-\x0d]")
ROWS = (
    [(i, f"text number {i % 37}" + " " * (i % 5), "x") for i in range(200)]
    + [(1000 + i, "hot  group", None) for i in range(120)]
    + [(500, None, "n"), (501, "", "n"), (502, " \t\n", "n"), (None, "only null id", "n"), (None, "text number 3", "n"), (503, "Ünï code", "n"), (504, "Ünïcode", "n"), (505, "long " * 40_000, "n"), (506, "long" * 40_000, "n")]
)


def brute(rows):
    groups = {}
    for doc_id, text, _ in rows:
        groups.setdefault(SPACE.sub("", text or ""), []).append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    best = {k: min(v)[3] for k, v in groups.items()}
    return {(d, t): (best[k := SPACE.sub("", t or "")], len(groups[k]), hashlib.sha256(k.encode()).hexdigest()) for d, t, _ in rows}


@pytest.mark.parametrize(("digest_bytes", "files"), [(32, 512), (32, 1), (1, 512)])
def test_against_brute_force(spark, digest_bytes, files):
    """Also in many micro-batches, and with digests so short that unlike texts share them."""
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string, kept string").repartition(5)
    got = exact.exact_groups(docs, digest_bytes=digest_bytes, files_per_batch=files).collect()
    want = brute(ROWS)
    assert len(got) == len(ROWS)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    for (doc_id, text), (keep, n, sha) in want.items():
        if doc_id is not None:
            r = by_id[doc_id]
            assert (r.keep_id, r.group_size, r.text_sha256, r.kept) == (keep, n, sha, keep == doc_id), (doc_id, text)
    assert sum(r.kept for r in got) == len({SPACE.sub("", t or "") for _, t, _ in ROWS})


def test_rows_that_repeat(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "ab"), (2, "other"), (2, "a b")], "doc_id bigint, text string")
    got = exact.exact_groups(docs).collect()
    assert len(got) == 5 and sum(r.kept for r in got) == 2 and {r.group_size for r in got} == {4, 1}
    assert sorted((r.doc_id, r.text) for r in exact.drop_copies(docs).collect()) == [(1, "a b"), (2, "other")]


def test_two_deliveries(spark, tmp_path):
    """A second ledger over the same folder finds copies of what the first was given, by a file and row that can be read again."""
    first = [(1, "one text"), (2, "two"), (3, "three  3"), (9, None)]
    second = [(4, "onetext"), (5, "t w o"), (6, "six"), (0, "three3"), (8, "")]
    for name, rows in (("a", first), ("b", second)):
        spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2).write.parquet(f"{tmp_path}/{name}")
    for digest_bytes in (32, 1):
        home = f"{tmp_path}/ledger{digest_bytes}"
        got = exact.Ledger(spark, home, digest_bytes=digest_bytes).deliver(spark.read.parquet(f"{tmp_path}/a"), 0).collect()
        assert all(r.kept and r.group_size == 1 for r in got) and len(got) == 4
        later = exact.Ledger(spark, home, digest_bytes=digest_bytes)
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in later.deliver(spark.read.parquet(f"{tmp_path}/b"), 1).collect()}
        assert got == {4: (1, 2, False), 5: (5, 2, True), 6: (6, 1, True), 0: (3, 2, False), 8: (8, 2, True)}
    best = {r.best.doc_id: r.best for r in exact.Ledger(spark, f"{tmp_path}/ledger32").state().collect()}
    read = spark.read.parquet(best[3].file).select("_metadata.row_index", "text").where(f"row_index = {best[3].at}").first()
    assert read.text == "three  3"


def test_unlike_texts_of_one_digest_are_told_apart(spark, monkeypatch):
    """With the default digest, if it ever met: every text gets the same one."""

    class Same:
        def __init__(self, data):
            pass

        def digest(self):
            return b"\x01" * 32

    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a "), (4, None)], "doc_id bigint, text string")
    monkeypatch.setattr(exact, "hashlib", type("H", (), {"sha256": Same}))
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact.exact_groups(docs).collect()}
    assert got == {1: (3, 2), 2: (2, 1), 3: (3, 2), 4: (4, 1)}


def test_clashing_columns(spark):
    schema = "doc_id bigint, text string, __id string, `row` string, it string, place map<string,int>, `a.b` int, _metadata int"
    docs = spark.createDataFrame([(1, "a b", "i", "r", "t", {"k": 1}, 1, 1), (1, "a b", "i", "r", "t", {"k": 1}, 1, 1), (2, "ab", None, None, None, None, None, None), (3, "c", "x", "y", "z", {}, 2, 2)], schema)
    kept = exact.drop_copies(docs)
    assert kept.dtypes == docs.dtypes
    assert sorted(map(str, kept.collect())) == sorted({str(r) for r in docs.where("doc_id <> 2").collect()})


def test_pipeline_form_and_empty(spark):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string, kept string")
    kept = exact.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(SPACE.sub("", r.text or "") for r in kept.collect()) == sorted({SPACE.sub("", t or "") for _, t, _ in ROWS})
    assert exact.exact_groups(docs.where("false")).count() == 0
    assert exact.drop_copies(docs.where("false")).count() == 0
