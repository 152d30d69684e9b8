"""Which article answers a question: words of the question against keywords and words of articles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a word of a question counts.
KEYWORD, IN_KEYWORD, WORD, IN_WORD, LEAST = 3.0, 2.0, 1.0, 0.5, 0.3
#: A task holds so many questions and articles, and scores so many articles at a time.
QUESTIONS, ARTICLES, AT_ONCE = 1 << 15, 1 << 15, 256


def tokens(text: Column, stop: list[str]) -> Column:
    """Lower-case words of two characters or more, in order and with repeats, without stop words."""
    parts = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9_\sæøåéäöü]", " "), r"\s+")
    return F.filter(parts, lambda t: (F.length(t) > 1) & ~t.isin(*stop)) if stop else F.filter(parts, lambda t: F.length(t) > 1)


def _grams(x: str) -> Column:
    """Distinct stretches of two and of three characters."""
    of = lambda n: F.when(F.length(x) >= n, F.transform(F.sequence(F.lit(1), F.length(x) - (n - 1)), lambda i: F.substring(F.col(x), i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(of(2), of(3)))


def _held(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(inner, outer) where the one string stands in the other: they meet once, by the first three characters of the inner one, or its two. Both sides are distinct."""
    heads = inner.select("inner", F.substring("inner", 1, 3).alias("gram"))
    return outer.select("outer", F.explode(_grams("outer")).alias("gram")).join(heads, "gram").where(F.contains("outer", "inner")).select("inner", "outer")


def _outer_words(articles: DataFrame, stop: list[str]) -> tuple[DataFrame, DataFrame]:
    """(article_id, outer): keywords, and words of the text and the keywords."""
    own = articles.select("article_id", F.transform(F.coalesce("keywords", F.array().cast("array<string>")), F.lower).alias("k"), "text")
    keyed = own.select("article_id", F.explode("k").alias("outer")).distinct()
    return keyed, own.select("article_id", F.explode(tokens(F.concat_ws(" ", "text", F.array_join("k", " ")), stop)).alias("outer")).distinct()


def _word_points(words: DataFrame, keywords: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(word, outer, points) of the distinct words of questions (inner) against distinct keywords, and against distinct words of texts (outer)."""
    flip = lambda d: d.select(F.col("outer").alias("inner"))
    points = lambda pairs, value: pairs.select(F.col("inner").alias("word"), "outer", value.alias("points"))
    same = lambda yes, no: F.when(F.col("inner") == F.col("outer"), yes).otherwise(no)
    in_text = points(_held(words, texts), same(WORD, IN_WORD))
    around = _held(flip(texts), words.select(F.col("inner").alias("outer"))).where("inner <> outer").select(F.col("outer").alias("word"), F.col("inner").alias("outer"), F.lit(IN_WORD).alias("points"))
    return points(_held(words, keywords), same(KEYWORD, IN_KEYWORD)), in_text.unionByName(around)


def article_scores(questions: DataFrame, articles: DataFrame, *, ids: list[str], stop: list[str] = ()) -> DataFrame:
    """(ids, article_id, score) of questions (ids, text) and articles (article_id, text, keywords) with a word in common.

    Each word of a question counts, for an article: 3 if it is a keyword, 2 if it stands in one, 1
    if it is a word of the article, 0.5 if one of both stands in the other; the score is the mean over the
    question's words. Distinct words are compared with distinct words only, through an index of short stretches.
    """
    stop = list(stop)
    asked = questions.select(*ids, tokens(F.col("text"), stop).alias("t")).withColumn("total", F.size("t"))
    counts = asked.select(*ids, "total", F.explode("t").alias("word")).groupBy(*ids, "total", "word").agg(F.count("*").alias("n"))
    keyed, worded = _outer_words(articles, stop)
    by_key, by_text = _word_points(counts.select(F.col("word").alias("inner")).distinct(), keyed.select("outer").distinct(), worded.select("outer").distinct())
    by_key, by_text = by_key.join(keyed, "outer"), by_text.join(worded, "outer")
    worth = by_key.unionByName(by_text).groupBy("word", "article_id").agg(F.max("points").alias("points"))
    return counts.join(worth, "word").groupBy(*ids, "article_id").agg((F.sum(F.col("points") * F.col("n")) / F.first("total")).alias("score"))


def _best_of_block(ids: list[str], digits: int | None):
    """Of each question of a block the best article of a shard: (ids, article_id, score)."""

    def run(questions: pa.Table, known: pa.Table) -> pa.Table:
        is_item = pc.is_null(known["word"])
        items, lists = known.filter(is_item).sort_by("article_id"), known.filter(pc.invert(is_item))
        code = np.zeros(questions.num_rows, np.int64)  # rows with the same ids are one question
        for c in ids:
            column = questions[c].combine_chunks().dictionary_encode("encode")
            code = np.unique(code * (len(column.dictionary) + 1) + column.indices.to_numpy(), return_inverse=True)[1]
        first = np.unique(code, return_index=True)[1]
        texts = pc.split_pattern(questions["t"].combine_chunks(), " ")
        word = pc.index_in(texts.flatten(), value_set=lists["word"].combine_chunks()).fill_null(-1).to_numpy().astype(np.int64)
        asker = np.repeat(code, pc.list_value_length(texts).to_numpy())[word >= 0]
        cells, times = np.unique(asker * max(lists.num_rows, 1) + word[word >= 0], return_counts=True)
        asker, word = np.divmod(cells, max(lists.num_rows, 1))
        total = questions["total"].to_numpy()[first]
        best, item = np.full(len(first), -1.0), np.full(len(first), -1)
        score = np.zeros(len(first))
        own = items["feats"].combine_chunks()
        of_item, feats = np.repeat(np.arange(items.num_rows), pc.list_value_length(own).to_numpy()), own.flatten().to_numpy()
        packed, ends = lists["feats"].combine_chunks().flatten().to_numpy(), np.cumsum(pc.list_value_length(lists["feats"].combine_chunks()).to_numpy())
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        n_feats = int(max(feats.max(initial=-1), (packed >> 3).max(initial=-1))) + 1
        for a in range(0, items.num_rows if len(cells) else 0, AT_ONCE):
            z = min(a + AT_ONCE, items.num_rows)
            here = (of_item >= a) & (of_item < z)
            holds = np.zeros((n_feats, z - a), np.uint8)
            holds[feats[here], of_item[here] - a] = 1
            points = np.empty((lists.num_rows, z - a), np.uint8)
            for i, j in _runs(ends):
                part = packed[starts[i] : ends[j - 1]]
                points[i:j] = np.maximum.reduceat(holds[part >> 3] * (part & 7).astype(np.uint8)[:, None], starts[i:j] - starts[i])
            heads = np.flatnonzero(np.diff(asker, prepend=-1))
            tails = np.append(heads[1:], len(asker))
            for i, j in _runs(tails):
                part = slice(heads[i], tails[j - 1])
                sums = np.add.reduceat(points[word[part]] * times[part, None].astype(np.int32), heads[i:j] - heads[i], dtype=np.int64)
                who = asker[heads[i:j]]
                scores = sums / 2 / total[who][:, None]
                level = scores if digits is None else np.floor(scores * 10**digits + 0.5)
                top = level.argmax(axis=1)  # of equal ones the smallest article
                row = np.arange(j - i)
                better = level[row, top] > best[who]
                best[who[better]], item[who[better]], score[who[better]] = level[row, top][better], (a + top)[better], scores[row, top][better]
        met = item >= 0
        return pa.table([*(questions[c].take(first[met]) for c in ids), items["article_id"].take(item[met]), pa.array(score[met])], names=[*ids, "article_id", "score"])

    return run


def _runs(ends: np.ndarray, most: int = 1 << 15):
    """(from, to): stretches of lists, by where they end, that hold about `most` entries."""
    i = 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        yield i, j
        i = j


def best_articles(questions: DataFrame, articles: DataFrame, *, ids: list[str], stop: list[str] = (), least: float = LEAST, digits: int | None = None) -> DataFrame:
    """(ids, article_id, score): the article with the highest score of at least `least`, of equal ones the smallest id; scores are rounded to `digits` before they are compared.

    Scores as in `article_scores`, but no row a question and article is made: questions are dealt into blocks, each
    of which gets the articles (a shard of them at a time), by the numbers of their words, and for its own distinct words the
    numbers of the words that count, with points. A task adds up the points of a few hundred articles at a time. Articles with the
    same words are scored once.
    """
    stop, spark = list(stop), questions.sparkSession
    keyed, worded = _outer_words(articles, stop)
    sets = keyed.withColumn("key", F.lit(True)).unionByName(worded.withColumn("key", F.lit(False))).groupBy("article_id").agg(F.sort_array(F.collect_list(F.struct("key", "outer"))).alias("set"))
    single = sets.groupBy("set").agg(F.min("article_id").alias("article_id"))
    shards = max(-(-single.count() // ARTICLES), 1)
    single = single.withColumn("shard", F.pmod(F.xxhash64("set"), F.lit(shards)).cast("int"))
    entries = single.select("shard", "article_id", F.explode("set").alias("x")).select("shard", "article_id", "x.*")
    number = (F.row_number().over(Window.partitionBy("shard").orderBy("key", "outer")) - 1).alias("feat")
    numbered = entries.select("shard", "key", "outer").distinct().select("shard", "key", "outer", number)
    items = entries.join(numbered, ["shard", "key", "outer"]).groupBy("shard", "article_id").agg(F.collect_list("feat").alias("feats"))
    blocks = max(-(-questions.count() // QUESTIONS), 1)
    asked = questions.select(*ids, tokens(F.col("text"), stop).alias("t"), F.pmod(F.xxhash64(*ids), F.lit(blocks)).cast("int").alias("block")).withColumn("total", F.size("t"))
    seen = asked.select("block", F.explode(F.array_distinct("t")).alias("word")).groupBy("word").agg(F.collect_set("block").alias("blocks"))
    words = seen.where(F.size("blocks") > 0).select(F.col("word").alias("inner"))  # always so, but all uses of `seen` have the same columns and share one shuffle
    outer = lambda key: numbered.where(F.col("key") == key).select("outer").distinct()
    by_key, by_text = _word_points(words, outer(True), outer(False))
    pairs = by_key.withColumn("key", F.lit(True)).unionByName(by_text.withColumn("key", F.lit(False))).join(numbered, ["key", "outer"])
    lists = pairs.repartition("word").groupBy("word", "shard").agg(F.collect_list((F.col("feat") * 8 + F.col("points") * 2).cast("int")).alias("feats"))
    nothing = F.lit(None).cast(dict(articles.dtypes)["article_id"]).alias("article_id")
    every = lambda name, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    known = seen.join(lists, "word").select(F.explode("blocks").alias("block"), "shard", "word", nothing, "feats").unionByName(items.select(every("block", blocks), "shard", F.lit(None).cast("string").alias("word"), "article_id", "feats"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)  # blocks aren't put together by size
    dealt = lambda d, *to: d.repartition(parts, *to).groupBy(*to)
    kinds = dict(questions.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in ids), f"article_id {dict(articles.dtypes)['article_id']}", "score double"])
    copied = asked.select(*ids, F.array_join("t", " ").alias("t"), "total", F.col("block").alias("own_block"), every("own_shard", shards))
    found = dealt(copied, "own_block", "own_shard").cogroup(dealt(known, "block", "shard")).applyInArrow(_best_of_block(ids, digits), schema)
    rounded = F.col("score") if digits is None else F.round("score", digits)
    best = found.withColumn("score", rounded).groupBy(*ids).agg(F.min(F.struct((-F.col("score")).alias("less"), "article_id")).alias("__best"))
    return best.select(*ids, F.col("__best.article_id").alias("article_id"), (-F.col("__best.less")).alias("score")).where(F.col("score") >= least)
