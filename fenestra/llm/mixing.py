"""Mixing sources to target weights by entropy balancing (operator 1, DataFrame functions only).

Of all document rates whose words add up to each source's target, entropy
balancing takes those closest to one copy each. The convex dual has one
multiplier a source; its optimum tilts the rate of a document exponentially in
its words, rate = min(cap, exp(lambda * words / scale)). Newton steps, kept inside
a bracket, solve for all sources at once: every step is one aggregation over a
histogram (source, words, documents), which is far smaller than the documents.

Sums run over integers (fixed point), so that they don't depend on the order of
rows: reruns agree.

Rates become copies in two steps. Along falling sizes, the running sum of the
fractions is rounded, which leaves at most half of the largest document of a
source; a few exchanges then take that rest away with cells whose size fits.
Which documents of a cell get one copy more is decided by a hash of the row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fenestra.llm.common import WORD_REGEX, cut

#: Documents of one source and size that one window sorts.
CELL_ROWS = 500
#: Fixed point of the sums over words and rates.
UNIT = 4096.0
MAX_STEPS = 80


def _sum(x: Column) -> Column:
    return (F.sum(F.round(x * UNIT).cast("decimal(38,0)")).cast("double") / UNIT)


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """Per source: weight by rank, and the target after resharing what is above `cap` times its size.

    Sources fill in the order of cap / weight: the level at which those not yet full
    share the rest is where the resharing ends. sizes: skey, source, source_size.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("most", F.col("source_size") * cap).withColumn("ratio", F.col("most") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", "skey")
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy()
    filled = ranked.select(
        "*",
        (F.sum("source_size").over(total) * share - F.coalesce(F.sum("most").over(upto), F.lit(0.0))).alias("rest"),
        (F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(upto), F.lit(0))).alias("open"),
    ).withColumn("level", F.col("rest") / F.col("open"))
    # the first source, by ratio, that isn't full sets the level of all that follow
    level = filled.withColumn("final", F.first(F.when(F.col("level") < F.col("ratio"), F.col("level")), ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return level.select("skey", "source_size", F.when(F.col("final").isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("final") * F.col("weight"))).alias("target"))


def _solve(hist: DataFrame, targets: DataFrame, cap: float) -> DataFrame:
    """(skey, source_size, target, scale, lam): the multipliers. lam is null where all documents are taken `cap` times."""
    scale = hist.groupBy("skey").agg((F.sum(F.col("n") * F.col("size") * F.col("size").cast("double")) / F.greatest(F.sum(F.col("n") * F.col("size")), F.lit(1))).alias("scale"))
    none = F.lit(None).cast("double")
    state = cut(
        targets.join(scale, "skey").select(
            "skey", "source_size", "target", F.greatest("scale", F.lit(1.0)).alias("scale"),
            F.when(F.col("target") < F.col("source_size") * cap * (1 - 1e-12), F.lit(0.0)).alias("lam"),
            none.alias("lo"), none.alias("hi"), F.lit(1.0).alias("off"),
        )
    )
    top = math.log(cap)
    for _ in range(MAX_STEPS):
        tilt = F.col("lam") * F.col("size") / F.col("scale")
        words = F.col("n") * F.col("size") * F.exp(F.least(tilt, F.lit(top)))
        sums = hist.where("size > 0").join(state.where("lam IS NOT NULL").select("skey", "lam", "scale"), "skey").groupBy("skey").agg(_sum(words).alias("got"), _sum(F.when(tilt < top, words * F.col("size") / F.col("scale")).otherwise(0.0)).alias("slope"))
        now = state.join(sums, "skey", "left").withColumn("miss", F.col("got") - F.col("target"))
        now = now.withColumn("lo", F.when(F.col("miss") < 0, F.col("lam")).otherwise(F.col("lo"))).withColumn("hi", F.when(F.col("miss") >= 0, F.col("lam")).otherwise(F.col("hi")))
        reach = F.greatest(F.lit(2.0), F.abs("lam") * 4)
        step = F.col("lam") - F.col("miss") / F.greatest(F.col("slope"), F.lit(1e-9))
        step = F.greatest(F.least(step, F.col("lam") + reach), F.col("lam") - reach)
        inside = F.coalesce(step > F.col("lo"), F.lit(True)) & F.coalesce(step < F.col("hi"), F.lit(True))
        step = F.when(inside, step).otherwise((F.col("lo") + F.col("hi")) / 2)
        off = F.coalesce(F.abs("miss") / F.greatest(F.col("target"), F.lit(1.0)), F.lit(0.0))
        # a source that is there stays where it is
        state = cut(now.select("skey", "source_size", "target", "scale", F.when(off < 1e-7, F.col("lam")).otherwise(F.coalesce(step, F.col("lam"))).alias("lam"), "lo", "hi", off.alias("off")))
        most = state.agg(F.max("off")).first()[0] or 0.0
        if most < 1e-7:
            return state
    if most > 1e-4:
        raise ArithmeticError(f"after {MAX_STEPS} steps a source is still {most:.2g} of its target away from it")
    return state


def _rounded(hist: DataFrame, state: DataFrame, cap: int, exchanges: int) -> DataFrame:
    """(skey, size, n, copies): copies of all documents of a cell together."""
    rate = F.when(F.col("lam").isNull(), F.lit(float(cap))).otherwise(F.exp(F.least(F.col("lam") * F.col("size") / F.col("scale"), F.lit(math.log(cap)))))
    falling = Window.partitionBy("skey").orderBy(F.desc("size"))
    cells = hist.join(state.select("skey", "target", "lam", "scale"), "skey").withColumn("rate", rate).withColumn("whole", F.floor("rate"))
    cells = cells.withColumn("run", F.round(F.sum(F.col("n") * (F.col("rate") - F.col("whole"))).over(falling.rowsBetween(Window.unboundedPreceding, 0))))
    more = (F.col("run") - F.coalesce(F.lag("run").over(falling), F.lit(0.0))).cast("bigint")
    cells = cells.select("skey", "size", "n", "target", F.least(F.col("n") * cap, F.col("n") * F.col("whole") + F.greatest(more, F.lit(0))).cast("bigint").alias("copies"))
    for _ in range(exchanges):
        cells = cut(cells)
        miss = cells.groupBy("skey").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("miss"))
        free = F.when(F.col("miss") > 0, F.col("n") * cap - F.col("copies")).otherwise(F.col("copies"))
        m = F.least(free, F.greatest(F.lit(1), F.round(F.abs("miss") / F.col("size")).cast("bigint")))
        left = F.abs(F.abs("miss") - F.col("m") * F.col("size"))
        best = cells.where("size > 0").join(miss, "skey").withColumn("m", m).where("m > 0").withColumn("left", left).where(F.col("left") < F.abs("miss")).groupBy("skey").agg(F.min(F.struct("left", "size", (F.col("m") * F.signum("miss")).cast("bigint").alias("by"))).alias("best"))
        moves = best.select("skey", F.col("best.size").alias("size"), F.col("best.by").alias("by"))
        cells = cells.join(moves, ["skey", "size"], "left").select("skey", "size", "n", "target", (F.col("copies") + F.coalesce("by", F.lit(0))).alias("copies"))
    return cells.select("skey", "size", "n", "copies")


def mix_sources(docs: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2, exchanges: int = 4) -> DataFrame:
    """One row per row of `docs` (doc_id, text, source): how many copies the mix takes.

    Returns doc_id, size, source_size, target, taken, copies, source. A null or empty
    text has size 0 and is taken with 0 words. A null source is a source of its
    own, ranked last. Rows that repeat are counted and mixed as rows. Texts of any
    length count whole; of equally large documents, a hash of id and text says which is
    taken once more. An empty table gives an empty result. Other columns of `docs` are
    ignored.
    """
    rows = cut(
        docs.select(
            "doc_id", F.col("source").cast("string").alias("source"),
            F.coalesce(F.regexp_count("text", F.lit(WORD_REGEX)), F.lit(0)).cast("bigint").alias("size"),
            F.xxhash64("doc_id", "text").alias("h"),
            F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("source").cast("string"))).alias("skey"),
        )
    )
    hist = cut(rows.groupBy("skey", "size").agg(F.count("*").alias("n"), F.first("source").alias("source")))
    sizes = hist.groupBy("skey").agg(F.first("source").alias("source"), F.sum(F.col("n") * F.col("size")).alias("source_size"))
    state = _solve(hist.drop("source"), cut(source_targets(sizes, weights, share, cap)), cap)
    cells = cut(_rounded(hist.drop("source"), state, cap, exchanges).withColumn("whole", F.expr("copies div n")).withColumn("more", F.expr("copies - (copies div n) * n")).withColumn("parts", F.expr(f"(n - 1) div {CELL_ROWS} + 1")))
    placed = rows.join(cells, ["skey", "size"]).withColumn("part", F.expr("pmod(h, parts)"))
    # a large cell is dealt over parts; each gets its share of the documents with a copy more
    shares = placed.where("parts > 1").groupBy("skey", "size", "part").agg(F.count("*").alias("in_part"), F.first("more").alias("more"), F.first("n").alias("n"))
    upto = F.sum("in_part").over(Window.partitionBy("skey", "size").orderBy("part"))
    shares = shares.withColumn("upto", upto).select("skey", "size", "part", F.expr("(more * upto) div n - (more * (upto - in_part)) div n").alias("in_share"))
    dealt = placed.join(shares, ["skey", "size", "part"], "left").withColumn("rank", F.row_number().over(Window.partitionBy("skey", "size", "part").orderBy("h", "doc_id")))
    copies = F.col("whole") + F.when(F.col("rank") <= F.coalesce("in_share", "more"), 1).otherwise(0)
    out = dealt.join(state.select("skey", "source_size", "target"), "skey")
    return out.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), (copies * F.col("size")).cast("bigint").alias("taken"), copies.cast("int").alias("copies"), "source")
