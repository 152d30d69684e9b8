"""Benchmark decontamination with a positional inverted index (operator 9, DataFrame functions only).

A window is a run of consecutive words of a benchmark item. Terms of the items are
counted over all documents. The two rarest terms of every window are its seeds;
their postings (document, position) are what the index stores first. A posting and
the offset of its term in an item give the place where the item would start: the
offset-adjusted lists. Where both seeds of a window agree on that start, the
document is a candidate, and only of candidates the postings of all item words are
stored and intersected. Runs of agreeing positions as long as a window are exact
phrases. Seeds that agree up to a few words are proximity matches.

Items are told apart by identifier and text together, so that a repeated item counts
once and a repeated or null identifier does no harm. Words have A-Z lower-cased on
both sides and no other letters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fenestra.llm.common import ALNUM_GAP, ALNUM_REGEX, Scratch, cut, row_key, sifted, stored, without

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 10
SEEDS = 2
#: Words by which seeds may be off for a proximity match.
SLOP = 3


def words(text: Column) -> Column:
    """The words of a text by position; an empty last one may follow, which no item has."""
    return F.split(F.regexp_replace(text, f"^{ALNUM_GAP}", ""), ALNUM_GAP)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _bounded(items: DataFrame) -> DataFrame:
    """Broadcast tables made from the benchmark only if they are small; else the planner chooses."""
    return F.broadcast(items) if items.count() <= 200_000 else items


def item_words(benchmark: DataFrame) -> DataFrame:
    """item (number of an item_id with a text), item_id, at, n, word: words of the items by position."""
    split = benchmark.where("text IS NOT NULL").select("item_id", words(lower_ascii(F.col("text"))).alias("w"), F.xxhash64("item_id", "text").alias("item")).distinct()
    whole = split.withColumn("w", F.filter("w", lambda x: x != ""))
    return whole.select("item", "item_id", F.size("w").alias("n"), F.posexplode("w").alias("at", "word"))


def seeds(items: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """item, item_id, at, word, need: positions of the rarest terms of every window; a start needs so many of them."""
    known = items.join(counts, "word", "left").select("item", "item_id", "at", "n", "word", F.coalesce("df", F.lit(0)).alias("df"))
    last = F.greatest(F.col("n") - window, F.lit(0))
    starts = F.sequence(F.greatest(F.col("at") - window + 1, F.lit(0)), F.least("at", last))
    in_window = known.select("*", F.explode(starts).alias("start"))
    rank = F.row_number().over(Window.partitionBy("item", "start").orderBy("df", "at"))
    return in_window.withColumn("rank", rank).where(F.col("rank") <= SEEDS).select("item", "item_id", "at", "word", F.least(F.lit(SEEDS), F.col("n")).cast("int").alias("need")).distinct()


def placed_words(texts: DataFrame) -> DataFrame:
    """doc_id, row, pos, word: all words of all `texts` (doc_id, row, text)."""
    return texts.where("text IS NOT NULL").select("doc_id", "row", F.posexplode(words(lower_ascii(F.col("text")))).alias("pos", "word"))


def in_proximity(agreed: DataFrame) -> DataFrame:
    """doc_id, row, item_id, near: items of which `need` seeds, at as many words, give starts that are up to SLOP words apart.

    `agreed` has one row a start, with the offsets (ats) that give it. The range slides
    over the starts, so that no match depends on where it lies.
    """
    ahead = Window.partitionBy("doc_id", "row", "item").orderBy(F.col("start").cast("bigint")).rangeBetween(0, SLOP)
    inside = F.collect_list(F.struct("start", "ats")).over(ahead)
    offsets = F.size(F.array_distinct(F.flatten(F.transform("inside", lambda s: s["ats"]))))
    # one word that an item has at several places is one word
    places = F.size(F.array_distinct(F.flatten(F.transform("inside", lambda s: F.transform(s["ats"], lambda at: s["start"] + at)))))
    seen = agreed.where("need > 1").withColumn("inside", inside).select("doc_id", "row", "item", "item_id", "need", F.least(offsets, places).alias("seen"))
    return seen.where("seen >= need").groupBy("doc_id", "row", "item_id").agg(F.max("seen").alias("near"))


def find(docs: DataFrame, benchmark: DataFrame, space: Scratch, *, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Exact matches (doc_id, row, item_id, pos: words inside occurring windows) and proximity matches (doc_id, row, item_id, near)."""
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), row_key().alias("row"), "text")
    items = cut(item_words(benchmark))
    vocabulary = _bounded(items.select("word").distinct())
    counts = placed_words(keyed).join(vocabulary, "word", "left_semi").groupBy("word").agg(F.count("*").alias("df"))
    seeded = cut(seeds(items, counts, window))
    # the stored index: postings of the seeds
    index = space.put(placed_words(keyed).join(_bounded(seeded.select("word").distinct()), "word").select("doc_id", "row", "pos", "word"))
    starts = index.join(_bounded(seeded), "word").select("doc_id", "row", "item", "item_id", (F.col("pos") - F.col("at")).alias("start"), "need", "at")
    # dealt by document and item, so that the starts of both are at one place to slide over
    agreed = starts.repartition("doc_id", "row", "item").groupBy("doc_id", "row", "item", "item_id", "start").agg(F.collect_set("at").alias("ats"), F.first("need").alias("need"))
    candidates = cut(agreed.where("size(ats) >= need").select("doc_id", "row", "item", "start"))
    near = in_proximity(agreed)
    # all postings of the candidates, met with the words their items expect at each position
    who = candidates.select(F.col("doc_id").alias("c_id"), F.col("row").alias("c_row")).distinct()
    maybe, _ = sifted(keyed.where("text IS NOT NULL"), candidates)
    texts = maybe.join(who, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("row") == F.col("c_row")), "left_semi").dropDuplicates(["doc_id", "row"])
    full = placed_words(texts).select(F.col("doc_id").alias("t_id"), F.col("row").alias("t_row"), "pos", F.col("word").alias("found"))
    expected = candidates.join(_bounded(items), "item").select("doc_id", "row", "item", "item_id", "start", "n", "at", (F.col("start") + F.col("at")).alias("expect"), "word")
    same = (F.col("row") == F.col("t_row")) & (F.col("expect") == F.col("pos")) & (F.col("word") == F.col("found")) & F.col("doc_id").eqNullSafe(F.col("t_id"))
    met = expected.join(full, same).select("doc_id", "row", "item", "item_id", "start", "n", "at", "pos")
    line = Window.partitionBy("doc_id", "row", "item", "start")
    runs = met.withColumn("run", F.col("at") - F.row_number().over(line.orderBy("at")))
    whole = runs.withColumn("size", F.count("*").over(Window.partitionBy("doc_id", "row", "item", "start", "run"))).where(F.col("size") >= F.least(F.col("n"), F.lit(window)))
    return whole.select("doc_id", "row", "item_id", "pos"), near


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """One row per row of `docs` (doc_id, text), for a `benchmark` of item_id, text.

    doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near (items met in
    proximity). A null or empty text has no words and no hits; an item with fewer
    words than a window is one window, one without words none. Repeated rows have
    equal results. Items that repeat count once, and so do unlike texts of one
    item_id; a null item_id counts as an item, but has no name in items_sha256. An
    empty benchmark hits nothing. Other columns, whatever their names, are ignored.
    """
    exact, near = find(docs, benchmark, Scratch(docs.sparkSession, "op9"), window=window)
    by_item = exact.groupBy("doc_id", "row", "item_id").agg(F.collect_set("pos").alias("at"))
    hits = by_item.groupBy("doc_id", "row").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("at")))).cast("bigint").alias("n_hit"), F.count("*").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.collect_list(F.col("item_id").cast("string"))), ","), 256).alias("items_sha256"),
    )
    close = near.groupBy("doc_id", "row").agg(F.count("*").alias("n_near"))
    none = F.lit(None)
    both = hits.withColumn("n_near", none.cast("bigint")).unionByName(close.select("doc_id", "row", *(none.cast(t).alias(c) for c, t in hits.dtypes[2:]), "n_near"))
    found = both.groupBy(F.col("doc_id").alias("h_id"), F.col("row").alias("h_row")).agg(*(F.max(c).alias(c) for c in ("n_hit", "n_items", "items_sha256", "n_near")))
    rows = docs.select("doc_id", row_key().alias("row"), F.coalesce(F.regexp_count("text", F.lit(ALNUM_REGEX)), F.lit(0)).cast("bigint").alias("n_words"))
    out = rows.join(found, F.col("doc_id").cast("bigint").eqNullSafe(F.col("h_id")) & (F.col("row") == F.col("h_row")), "left")
    none = F.lit(0).cast("bigint")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", none).alias("n_hit"), F.coalesce("n_items", none).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.coalesce("n_hit", none) > 0).alias("contaminated"), F.coalesce("n_near", none).alias("n_near"), "row",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """The rows of `docs`, with all their columns, in which no window of the benchmark occurs."""
    space = Scratch(docs.sparkSession, "op9")
    exact, _ = find(docs, benchmark, space, window=window)
    dropped = stored(exact.select("doc_id", "row", F.lit(0).alias("stay")).distinct(), "op9-dropped")
    space.drop()
    return without(docs, dropped)
