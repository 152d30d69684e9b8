import random
import re

import zstandard
from pyspark.sql import functions as F

from fenestra.llm.langid import identify

PARTS = {"aa": ["tion", "ment", "eau", "oire"], "bb": ["schaft", "keit", "ung", "heit"], "cc": ["ing", "ness", "ful", "ship"]}


def fixture(spark, n=600):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        lang = sorted(PARTS)[i % 3]
        text = " ".join("".join(rng.choices(PARTS[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(20, 200)))
        rows.append((i, text.upper() if i % 50 == 0 else text, lang if i % 10 else None, "s", "clash"))
    rows += [(n, None, "aa", None, None), (n + 1, "", None, None, None), (n + 2, "123 --- 5", "bb", None, None), (None, "heitung keitschaft ungheit " * 9, None, None, None), (n + 3, "keitung " * 60_000, None, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, score string")


def test_held_out_accuracy(spark):
    docs = fixture(spark)
    got = identify(docs).collect()
    assert len(got) == docs.count()
    test = [r for r in got if r.held_out and r.doc_id < 600]
    assert len(test) > 100
    assert sum(r.lang_pred == sorted(PARTS)[r.doc_id % 3] for r in test) >= 0.99 * len(test)
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].lang_pred for i in (600, 601, 602)] == ["und"] * 3
    assert by_id[None].lang_pred == "bb" and by_id[603].lang_pred == "bb"
    assert all(0 <= r.score <= 1 for r in got) and not by_id[600].reliable


def test_sizes_against_brute_force(spark):
    """Sizes computed afresh, of equal sizes the first language wins; rows that repeat are equal."""
    dictionaries = {"aa": b"tion ment eau oire " * 20, "bb": b"schaft keit ung heit " * 20, "bc": b"schaft keit ung heit " * 20}
    docs = fixture(spark, 120).union(fixture(spark, 120).limit(5)).select("doc_id", "text")
    for r in docs.join(identify(docs, dictionaries=dictionaries).withColumnRenamed("doc_id", "d"), F.expr("doc_id <=> d")).where("doc_id < 120").collect():
        words = b" ".join(re.sub(rb"[^a-z\x80-\xff]", b" ", r.text.encode().lower()).split())
        sizes = {}
        for lang, raw in dictionaries.items():
            coder = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes[lang] = sum(len(coder.compress(words[i : i + 2048])) for i in range(0, len(words), 2048))
        (best, lang), (second, _) = sorted((n, lang) for lang, n in sizes.items())[:2]
        assert r.lang_pred == lang and lang != "bc" and abs(r.margin - (1 - best / second)) < 1e-9


def test_nothing_to_learn_from(spark):
    docs = fixture(spark, 30)
    assert {r.lang_pred for r in identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert identify(docs.where("false")).count() == 0
