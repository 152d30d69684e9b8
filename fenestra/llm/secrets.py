r"""Secret scans with character Markov models (operator 10, DataFrame functions only).

Rules find assignments, access keys and hex strings. Besides, every long token gets
the log-likelihood ratio of two first-order character models: one of random
strings, one of ordinary identifiers. Both are trained from a labelled sample:
random are values that the rules find in a bounded sample of documents, and
digests in several alphabets; ordinary are the other words of that sample, as they
are, in capitals and as parts of a path.

Spark has no function for the places of all matches of a pattern. They follow from
the pieces between the matches: a match starts where its piece ends.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The rules, fixed by the contract: name, pattern, group whose length counts, least length.
RULES = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Tokens that the models judge, and their alphabet; all other characters share class 0.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
CLASSES = len(ALPHABET) + 1
#: A token is random if its ratio exceeds this in all and by character.
MIN_RATIO = 12.0
MIN_RATIO_PER_CHAR = 0.6
#: Bound of the labelled sample: documents, about.
SAMPLE_DOCS = 3000
SYNTHETIC = 1500
#: Weight, in transitions, of single characters in a context's chances.
BACKOFF = 8.0

SPAN = "array<struct<start:int,end:int>>"


def matches(text: Column, pattern: str, group: int, least: int) -> Column:
    """Spans, in code points, of the non-overlapping matches whose `group` has at least `least` characters."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    pieces = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    steps = F.arrays_zip(pieces.alias("p"), found.alias("m"), values.alias("v"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def add(a: Column, x: Column) -> Column:
        begin = a["at"] + F.length(x[0])
        end = begin + F.length(x[1])
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(F.length(x[2]) >= least, F.concat(a["out"], span)).otherwise(a["out"]).alias("out"))

    return F.aggregate(steps, start, lambda a, x: add(a, _fields(x)), lambda a: a["out"])


def _fields(x: Column) -> list[Column]:
    return [x["p"], x["m"], x["v"]]


def located(text: Column, pattern: str, group: int, least: int) -> Column:
    """`matches`, looking for places only where the pattern occurs at all."""
    return F.when(F.regexp_like(text, F.lit(pattern)), matches(text, pattern, group, least)).otherwise(F.array().cast(SPAN))


def labelled_sample(docs: DataFrame, rows: int = SAMPLE_DOCS) -> DataFrame:
    """(value, random): of about `rows` documents, chosen by a hash of the text, and of synthetic digests."""
    total = docs.count()
    part = min(1.0, rows / max(1, total))
    some = docs.where("text IS NOT NULL").where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < part * (1 << 30)).select("text")
    ruled = [F.regexp_extract_all("text", F.lit(p), F.lit(g)) for _, p, g, _ in RULES]
    hits = some.select(F.explode(F.concat(*ruled)).alias("value")).where("length(value) >= 16").distinct().select("value", F.lit(True).alias("random"))
    words = some.select(F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z_][A-Za-z0-9_-]{4,}"), F.lit(0))).alias("value")).where(f"NOT value RLIKE '[0-9]' OR length(value) < 12").distinct()
    words = words.select(F.explode(F.array("value", F.upper("value"), F.concat_ws("/", "value", "value"))).alias("value"), F.lit(False).alias("random"))
    digest = F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")), 256)
    coded = F.base64(F.unhex(digest))
    made = docs.sparkSession.range(SYNTHETIC).select(F.explode(F.array(F.substring(digest, 1, 40), coded, F.translate(coded, "+/=", "-_"), F.upper(F.regexp_replace(coded, "[+/=]", "")))).alias("value"), F.lit(True).alias("random"))
    return hits.unionByName(words).unionByName(made)


def _classes(value: Column) -> Column:
    return F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c))


def fit(docs: DataFrame, *, rows: int = SAMPLE_DOCS) -> list[float]:
    """Log ratios, random over ordinary, of the transitions between character classes.

    Transitions are counted by Spark; at most 2 * CLASSES^2 counts reach the driver.
    """
    codes = labelled_sample(docs, rows).where("value <> ''").select("random", _classes(F.col("value")).alias("c"))
    pairs = codes.select("random", F.explode(F.zip_with(F.slice("c", F.lit(1), F.greatest(F.size("c") - 1, F.lit(0))), F.slice("c", F.lit(2), F.size("c")), lambda a, b: a * CLASSES + b)).alias("pair"))
    counts: dict[bool, dict[int, int]] = {True: {}, False: {}}
    for r in pairs.groupBy("random", "pair").count().collect():
        counts[r["random"]][r["pair"]] = r["count"]
    chance = []  # by kind and pair; a context seen rarely leans on how often the character is met at all
    for kind in (True, False):
        single = [sum(counts[kind].get(a * CLASSES + b, 0) for a in range(CLASSES)) + 0.5 for b in range(CLASSES)]
        single = [x / sum(single) for x in single]
        rows_of = [[counts[kind].get(a * CLASSES + b, 0) for b in range(CLASSES)] for a in range(CLASSES)]
        chance.append([(row[b] + BACKOFF * single[b]) / (sum(row) + BACKOFF) for row in rows_of for b in range(CLASSES)])
    return [round(log(x) - log(y), 6) for x, y in zip(*chance, strict=True)]


def ratio(value: Column, table: list[float]) -> Column:
    """The log-likelihood ratio of a string under the two models."""
    logs = F.split(F.lit(",".join(map(str, table))), ",").cast("array<double>")
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))
    step = lambda a, c: F.struct(c.alias("last"), (a["sum"] + F.when(a["last"] < 0, F.lit(0.0)).otherwise(F.element_at(logs, a["last"] * CLASSES + c + 1))).alias("sum"))
    return F.aggregate(_classes(value), start, step, lambda a: a["sum"])


def random_spans(text: Column, table: list[float]) -> Column:
    """Spans of the tokens that the models call random."""
    found = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    pieces = F.slice(F.split(text, TOKEN, -1), F.lit(1), F.size(found))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def add(a: Column, x: Column) -> Column:
        begin = a["at"] + F.length(x["p"])
        end = begin + F.length(x["m"])
        odd = ratio(x["m"], table)
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when((odd >= MIN_RATIO) & (odd >= MIN_RATIO_PER_CHAR * F.length(x["m"])), F.concat(a["out"], span)).otherwise(a["out"]).alias("out"))

    return F.when(F.size(found) > 0, F.aggregate(F.arrays_zip(pieces.alias("p"), found.alias("m")), start, add, lambda a: a["out"])).otherwise(F.array().cast(SPAN))


def _named(spans: Column, rank: int, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def scan_secrets(docs: DataFrame, *, table: list[float] | None = None) -> DataFrame:
    """One row per row of `docs` (doc_id, text), with every whole text scanned.

    doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans. Spans are
    kind:start:end in code points, end exclusive, by start and then by kind in the
    order assign, access, hex, markov. A token that the models find is added only
    where it touches no span of the rules. A null text counts as empty: no spans,
    and the digest of the empty string. Long texts are scanned whole; rows that repeat
    give equal rows, an empty table none; other columns are ignored.
    """
    table = fit(docs) if table is None else table
    text = F.coalesce("text", F.lit(""))
    spans = docs.select("doc_id", *(located(text, p, g, n).alias(name) for name, p, g, n in RULES), random_spans(text, table).alias("tokens"))
    base = [_named(F.col(name), i, name) for i, (name, *_) in enumerate(RULES)]
    spans = spans.withColumn("base", F.array_sort(F.concat(*base)))
    free = F.filter("tokens", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    spans = spans.withColumn("more", _named(free, len(RULES), "markov"))
    line = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return spans.select(
        "doc_id", *(F.size(name).cast("bigint").alias(f"n_{name}") for name, *_ in RULES), F.size("more").cast("bigint").alias("n_markov"),
        F.sha2(line(F.col("base")), 256).alias("base_sha256"), line(F.array_sort(F.concat("base", "more"))).alias("spans"),
    )
