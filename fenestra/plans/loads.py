"""Jobs over deliveries: loads with publication, bulk merges, point reads, and the learning cycle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fenestra.operators.learning import LearningCycle
from fenestra.plans.book import Book
from fenestra.sources.files import scratch
from fenestra.sources.keyed import KeyedTable
from fenestra.sources.tables import table

BOOK = Book()


# ---------------------------------------------------------------- loads


def _years(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[int]]:
    lines = table(spark, sf_dir, "lineitem").withColumn("year", F.year("l_shipdate"))
    return lines, [r[0] for r in lines.select("year").distinct().orderBy("year").collect()]


#: Most of a delivery that may be invalid, and the lines that a part must have to count as valid.
INVALID_SHARE, LEAST_LINES = 0.06, 2


def full_load_deliveries(lines: DataFrame, years: list[int]):
    """(year, rows by part: price, lines, supplier) in order; the supplier is missing where a part has only one line."""
    for year in years:
        own = lines.where(F.col("l_shipdate").between(F.lit(f"{year}-01-01").cast("timestamp"), F.lit(f"{year}-12-31 23:59:59.999999").cast("timestamp")))
        yield year, own.groupBy("l_partkey").agg(F.max("l_extendedprice").alias("price"), F.count("*").alias("n_lines"), F.when(F.count("*") >= LEAST_LINES, F.min("l_suppkey")).alias("supplier"))


@BOOK.query(f"""
WITH d AS (SELECT year(l_shipdate) AS delivery, l_partkey, max(l_extendedprice) AS price, count(*) AS n_lines, CASE WHEN count(*) >= {LEAST_LINES} THEN min(l_suppkey) END AS supplier FROM lineitem GROUP BY 1, 2),
g AS (SELECT delivery, avg(CAST(supplier IS NULL AS int)) AS invalid FROM d GROUP BY 1),
a AS (SELECT d.*, invalid <= {INVALID_SHARE} AS good FROM d JOIN g USING (delivery)),
w AS (SELECT *, lag(price) OVER p AS b_price, lag(n_lines) OVER p AS b_lines, lag(supplier) OVER p AS b_supplier, lag(true) OVER p AS b_here FROM a WHERE good WINDOW p AS (PARTITION BY l_partkey ORDER BY delivery))
SELECT CAST(delivery AS bigint) AS delivery, round(invalid, 6) AS invalid, invalid <= {INVALID_SHARE} AS published,
 (SELECT count(*) FILTER (WHERE b_here IS NULL) FROM w WHERE w.delivery = g.delivery) AS n_new,
 (SELECT count(*) FILTER (WHERE b_here AND (price <> b_price OR n_lines <> b_lines OR supplier IS DISTINCT FROM b_supplier)) FROM w WHERE w.delivery = g.delivery) AS n_changed,
 (SELECT count(*) FILTER (WHERE b_here AND price = b_price AND n_lines = b_lines AND supplier IS NOT DISTINCT FROM b_supplier) FROM w WHERE w.delivery = g.delivery) AS n_unchanged
FROM g""")
def full_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly deliveries: validated, merged by key, gated as a whole and published; a row for each with its changes.

    A delivery with too many invalid rows isn't merged, and a candidate without rows or
    prices isn't published; readers then keep what was visible.
    """
    lines, years = _years(spark, sf_dir)
    catalogue = KeyedTable(spark, scratch(spark, "full-load"), ["l_partkey"], {"price": "new", "n_lines": "new", "supplier": "new"}, buckets=16)
    gates = {"rows": (F.count("*"), 1, True), "without price": (F.count_if(F.col("price").isNull()), 0, False)}
    log = []
    for year, rows in full_load_deliveries(lines, years):
        invalid = rows.agg(F.avg(F.col("supplier").isNull().cast("int"))).first()[0]
        done = catalogue.merge(rows, gates) if invalid <= INVALID_SHARE else None
        log.append((year, round(invalid, 6), bool(done and not done.failed), *((done.new, done.changed, done.unchanged) if done else (0, 0, 0))))
    return spark.createDataFrame(log, "delivery bigint, invalid double, published boolean, n_new bigint, n_changed bigint, n_unchanged bigint")


@BOOK.query("""
WITH d AS (SELECT year(l_shipdate) AS y, l_partkey, l_suppkey, max(l_extendedprice) AS price, sum(l_quantity) AS quantity, max(CASE WHEN l_returnflag = 'R' THEN l_discount END) AS discount FROM lineitem GROUP BY 1, 2, 3)
SELECT l_partkey, l_suppkey, max(price) AS price, round(sum(quantity), 2) AS quantity, arg_max(discount, y) FILTER (WHERE discount IS NOT NULL) AS discount FROM d GROUP BY 1, 2""")
def bulk_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table by part and supplier after all yearly deliveries: the highest price, all quantities, the last discount that isn't null."""
    lines, years = _years(spark, sf_dir)
    state = KeyedTable(spark, scratch(spark, "bulk-merge"), ["l_partkey", "l_suppkey"], {"price": "max", "quantity": "sum", "discount": "fill"}, buckets=16)
    for year in years:
        own = lines.where(F.col("year") == year)
        state.merge(own.groupBy("l_partkey", "l_suppkey").agg(F.max("l_extendedprice").alias("price"), F.sum("l_quantity").alias("quantity"), F.max(F.when(F.col("l_returnflag") == "R", F.col("l_discount"))).alias("discount")))
    return state.rows().select("l_partkey", "l_suppkey", "price", F.round("quantity", 2).alias("quantity"), "discount")


@BOOK.query("""
WITH n AS (SELECT p_brand, p_name, count(*) AS n, min(p_retailprice) AS least FROM part GROUP BY 1, 2), t AS (SELECT p_brand, count(*) AS n_models, CAST(sum(n) AS bigint) AS n_products, min(least) AS least FROM n GROUP BY 1)
SELECT p_brand, n_models, n_products, least FROM t WHERE p_brand IN (SELECT min(p_brand) FROM part UNION SELECT max(p_brand) FROM part)""")
def point_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents precomputed for each brand, kept by key; two of them are read, from their buckets alone."""
    parts = table(spark, sf_dir, "part")
    models = parts.groupBy("p_brand", "p_name").agg(F.count("*").alias("n"), F.min("p_retailprice").alias("least"))
    pages = models.groupBy("p_brand").agg(F.count("*").alias("n_models"), F.sum("n").alias("n_products"), F.min("least").alias("least"))
    store = KeyedTable(spark, scratch(spark, "point-read"), ["p_brand"], {"n_models": "new", "n_products": "new", "least": "new"}, buckets=32)
    store.merge(pages)
    ends = parts.agg(F.min("p_brand"), F.max("p_brand")).first()
    return store.lookup([(b,) for b in sorted(set(ends))]).select("p_brand", "n_models", "n_products", "least")


# ---------------------------------------------------------------- the learning cycle


FLAGS = {"returned": "l_returnflag = 'R'", "open": "l_linestatus = 'O'", "reduced": "l_discount > 0.05", "large": "l_quantity > 25"}
_SHARE = lambda of, n: f"floor({of} / {n} * 100 + 0.5) / 100"
_RIGHT = " + ".join(f"CASE WHEN coalesce(r0.p_{f}, r1.p_{f}, 0) >= 0.5 THEN c.{f} ELSE c.n - c.{f} END" for f in FLAGS)
_MOVED = " + ".join(f"CAST(abs(a.p_{f} - b.p_{f}) >= 0.2 - 1e-9 AS int)" for f in FLAGS)


@BOOK.query(f"""
WITH RECURSIVE c AS (SELECT year(l_shipdate) AS period, p_brand, p_name, count(*) AS n, {', '.join(f'count(*) FILTER (WHERE {x}) AS {f}' for f, x in FLAGS.items())} FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),
r0 AS (SELECT period AS version, p_brand, p_name, {', '.join(f"{_SHARE(f, 'n')} AS p_{f}" for f in FLAGS)} FROM c WHERE n >= 3),
r1 AS (SELECT period AS version, p_brand, {', '.join(f"{_SHARE(f'sum({f})', 'sum(n)')} AS p_{f}" for f in FLAGS)} FROM c GROUP BY 1, 2 HAVING sum(n) >= 5),
r AS (SELECT version, 0 AS grain, p_brand, p_name, {', '.join(f'p_{f}' for f in FLAGS)} FROM r0 UNION ALL SELECT version, 1, p_brand, NULL, {', '.join(f'p_{f}' for f in FLAGS)} FROM r1),
v AS (SELECT period AS version, lead(period) OVER (ORDER BY period) AS next, row_number() OVER (ORDER BY period) AS i FROM (SELECT DISTINCT period FROM c)),
m AS (SELECT v.version, c.period, CAST(sum({_RIGHT}) AS bigint) AS correct, CAST(sum(c.n) * {len(FLAGS)} AS bigint) AS total, CAST(coalesce(sum(c.n) FILTER (WHERE coalesce(r0.version, r1.version) IS NOT NULL), 0) AS bigint) AS covered
  FROM v JOIN c ON c.period > v.version LEFT JOIN r0 ON r0.version = v.version AND r0.p_brand = c.p_brand AND r0.p_name = c.p_name LEFT JOIN r1 ON r1.version = v.version AND r1.p_brand = c.p_brand GROUP BY 1, 2),
f AS (SELECT i, version, next, CAST(NULL AS bigint) AS in_force, true AS promoted, version AS active FROM v WHERE i = 1 AND next IS NOT NULL
  UNION ALL SELECT v.i, v.version, v.next, f.active, x.correct >= y.correct, CASE WHEN x.correct >= y.correct THEN v.version ELSE f.active END
  FROM f JOIN v ON v.i = f.i + 1 JOIN m x ON x.version = v.version AND x.period = v.next JOIN m y ON y.version = f.active AND y.period = v.next)
SELECT CAST(f.version AS bigint) AS version, CAST(f.next AS bigint) AS tried_on, (SELECT count(*) FROM r WHERE r.version = f.version) AS rules,
  (SELECT count(*) FROM r a WHERE a.version = f.version AND NOT EXISTS (SELECT 1 FROM r b WHERE b.version = f.in_force AND b.grain = a.grain AND b.p_brand = a.p_brand AND b.p_name IS NOT DISTINCT FROM a.p_name)) AS discoveries,
  CAST(coalesce((SELECT sum({_MOVED}) FROM r a JOIN r b ON b.grain = a.grain AND b.p_brand = a.p_brand AND b.p_name IS NOT DISTINCT FROM a.p_name WHERE a.version = f.version AND b.version = f.in_force), 0) AS bigint) AS drifted,
  x.correct, x.total, x.covered, f.in_force, y.correct AS in_force_correct, f.promoted
FROM f JOIN m x ON x.version = f.version AND x.period = f.next LEFT JOIN m y ON y.version = f.in_force AND y.period = f.next""")
def learning_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly versions of rules by brand and name, and by brand alone: each is tried on the year after and promoted, or not."""
    lines, years = _years(spark, sf_dir)
    cycle = learning(spark, scratch(spark, "learning"))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name")
    for year in years:
        cycle.step(flagged(lines.where(F.col("year") == year).join(parts, F.col("l_partkey") == F.col("p_partkey"))), year)
    return cycle.decisions().drop("tried")


def learning(spark: SparkSession, home: str) -> LearningCycle:
    return LearningCycle(spark, home, [["p_brand", "p_name"], ["p_brand"]], list(FLAGS), [3, 5])


def flagged(lines: DataFrame) -> DataFrame:
    return lines.withColumns({f: F.expr(x) for f, x in FLAGS.items()})


QUERIES, ORACLES = BOOK.queries, BOOK.oracles
