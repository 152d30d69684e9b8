import random

from pyspark.sql import functions as F

from fenestra.llm.tokens import TokenTree, apply_edits, edited_counts, encoder, pieces, token_trees


def texts():
    rng = random.Random(8)
    units = ["word", "  ", "\n", " ", "123", "don't", "é", "ñandú", "!!", " a", "\t", "😀", "Zusammenhang", "  \n ", "x" * 30]
    return [" ".join(rng.choices(units, k=rng.randint(0, 700))) for _ in range(40)] + ["", " ", "a" * 5000, " " * 3000, "no cuts" + "-" * 4000, "word " * 20_000]


def edits(rng, text):
    out = []
    for _ in range(rng.randint(1, 6)):
        a = rng.randint(0, len(text) + 5)
        out.append((a, a + rng.choice([0, 0, 1, 3, 40, 2000]), rng.choice(["", " ", "x", "\n\n", " new words here ", "'s", "9" * 10, " word" * 400])))
    return out


def test_counts_and_edits_equal_full_encoding():
    rng, count = random.Random(1), encoder()
    for text in texts():
        assert "".join(pieces(text)) == text
        tree = TokenTree.of(text, count)
        assert tree.total() == count(text) and tree.total(0) == len(text)
        for change in edits(rng, text):
            want = text[: change[0]] + change[2] + text[max(change[0], change[1]) :]
            text, encoded = tree.edit(text, change, count)
            assert text == want and tree.total() == count(text) and sum(tree.lengths) == len(text)
            assert encoded <= len(text)


def test_edits_encode_little():
    count = encoder()
    text = "some ordinary words " * 20_000
    tree = TokenTree.of(text, count)
    after, encoded = tree.edit(text, (200_000, 200_010, "an edit"), count)
    assert encoded < 6000 and tree.total() == count(after)


def test_operator(spark):
    rng, count = random.Random(2), encoder()
    rows = [(i, t, "x", [{"start": a, "end": b, "new": c} for a, b, c in edits(rng, t)]) for i, t in enumerate(texts())]
    rows += [(100, None, "x", None), (None, "a b", "x", []), (101, None, "x", [{"start": 5, "end": 2, "new": "new text"}]), (1, "twice", "x", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, counts string, edits array<struct<start:int,end:int,new:string>>")
    trees = token_trees(docs)
    assert {(r.doc_id, r.n_tokens) for r in trees.collect()} == {(d, count(t or "")) for d, t, *_ in rows}
    got = apply_edits(trees.join(docs.select("doc_id", "text", "edits").withColumnRenamed("text", "t"), F.col("text").eqNullSafe(F.col("t")) & trees["doc_id"].eqNullSafe(docs["doc_id"])).select(trees["*"], "edits")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_tokens == count(r.text) == sum(r.counts) and sum(r.lengths) == len(r.text)
    query = edited_counts(docs).collect()
    assert len(query) == len(rows) and all(r.n_edited > 0 for r in query)
    assert edited_counts(docs.where("false")).count() == 0
