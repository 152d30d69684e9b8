import random
import re

import corpus_pipeline
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_jaccard import brute as groups

SPACE = re.compile(r"[\x20\x09-\x0d]")


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(11)
    vocab = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 5))) for _ in range(500)]
    line = lambda n: " ".join(rng.choices(vocab, k=n))
    items = [(i, line(25)) for i in range(6)]
    rows = []
    for i in range(400):
        text = line(rng.randint(20, 120))
        if i % 6 == 0:
            text += ". you grobian lump " + line(4)
        elif i % 6 == 1 and rows:
            text = rng.choice(rows)[1] + rng.choice(["", " ", "\n"])
        elif i % 6 == 2 and rows:
            w = rng.choice(rows)[1].split(" ")
            w[len(w) // 2] = "changed"
            text = " ".join(w)
        elif i % 6 == 3 and i % 4 == 3:
            text += " " + items[i % 6][1]
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    toxic = {d for d, t, *_ in rows if "grobian" in t}
    spark.createDataFrame([(d, int(d in toxic)) for d, *_ in rows], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "mix_sources":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id for r in docs.collect()}
    text = {d: t for d, t, *_ in rows}
    assert kept["toxicity"] == set(text) - toxic
    best = {}
    for d in kept["toxicity"]:
        k = SPACE.sub("", text[d])
        best[k] = min(best.get(k, (0, d)), (-len(text[d]), d))
    assert kept["exact_dedup"] == {d for _, d in best.values()}
    assert kept["ngram_jaccard"] == {c for _, _, c in groups([(d, text[d]) for d in sorted(kept["exact_dedup"])], 5, 80)}
    clean = {r[0] for r in leaks([(d, text[d]) for d in kept["ngram_jaccard"]], items) if not r[5]}
    assert kept["decontaminate"] == clean
    assert kept["mix_sources"] <= clean
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(str, whole)) == sorted(map(str, docs.select(*whole[0].__fields__).collect()))
