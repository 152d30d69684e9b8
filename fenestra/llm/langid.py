"""Language identification by compression (operator 4).

Each language has a raw-content zstandard dictionary made of passages of labelled
documents. A text is compressed once with each dictionary; the language whose
dictionary gives the smallest size wins. Before that, all that isn't part of a word
becomes a space and A-Z becomes a-z. Long texts are compressed in blocks, each with
a fresh dictionary: otherwise a long text would soon be its own dictionary.
Where the best and the second best differ by too little, the answer is marked as
not reliable.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of what is learned from: rows a language, and characters of a passage.
ROWS_PER_LANGUAGE = 600
PASSAGE_CHARS = 400
DICTIONARY_BYTES = 192 * 1024
#: Bytes of text that are compressed at once.
BLOCK_BYTES = 2048
LEVEL = 3
#: Below this difference, in parts of the best size, an answer is not reliable.
MARGIN = 0.01
UNDETERMINED = "und"
#: bytes.translate table: ASCII beside letters becomes spaces, A-Z becomes a-z.
LETTERS_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 97 <= c <= 122 else 32 for c in range(256))
LETTER = regex.compile(r"\p{L}")


def plain(text: str) -> bytes:
    return b" ".join(text.encode("utf-8", "replace").translate(LETTERS_TABLE).split())


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2


def fit(docs: DataFrame, *, rows: int = ROWS_PER_LANGUAGE) -> dict[str, bytes]:
    """Dictionaries by language, from a bounded sample of labelled rows that aren't held out.

    About `rows` rows a language are chosen by a hash of doc_id, and a passage of
    each, from a place that the hash chooses too, goes into the dictionary. Rows
    whose id, text or lang is null take no part. What reaches the driver is about
    1.5 * rows * PASSAGE_CHARS characters for each language, of which there are few.
    """
    usable = docs.select("doc_id", "lang", "text").where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").where(~held_out())
    counts = usable.groupBy("lang").count()
    pick = F.pmod(F.xxhash64("doc_id", F.lit("dictionary")), F.lit(1 << 30))
    chosen = usable.withColumn("pick", pick).join(counts, "lang").where(F.col("pick") < F.least(F.lit(1.0), F.lit(1.5 * rows) / F.col("count")) * (1 << 30))
    at = F.pmod(F.xxhash64("doc_id", F.lit("place")), F.greatest(F.lit(1), F.length("text") - PASSAGE_CHARS + 1)).cast("int") + 1
    passages = chosen.select("lang", "pick", "doc_id", F.substring("text", at, F.lit(PASSAGE_CHARS)).alias("passage"))
    best: dict[str, list[str]] = {}
    for r in sorted(passages.distinct().collect(), key=lambda r: (r["lang"], r["pick"], r["doc_id"], r["passage"])):
        best.setdefault(r["lang"], []).append(r["passage"])
    return {lang: plain(" ".join(found))[-DICTIONARY_BYTES:] for lang, found in sorted(best.items()) if any(found)}


class Classifier:
    """Sizes of a text under each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        self.coders = []
        for lang, raw in sorted(dictionaries.items()):
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.coders.append((lang, zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)))

    def classify(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin). The score is 1 - (best / second best) ^ 20, above 0.5 from a margin of 3.4 %."""
        if not self.coders or text is None or not LETTER.search(text):
            return UNDETERMINED, 0.0, 0.0
        data = plain(text)
        blocks = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
        sizes = sorted((sum(len(c.compress(b)) for b in blocks), lang) for lang, c in self.coders)
        if len(sizes) == 1:
            return sizes[0][1], 1.0, 1.0
        ratio = sizes[0][0] / max(1, sizes[1][0])
        return sizes[0][1], 1.0 - ratio**20, 1.0 - ratio


def identify(docs: DataFrame, *, dictionaries: dict[str, bytes] | None = None, margin: float = MARGIN) -> DataFrame:
    """One row per row of `docs` (doc_id, text, lang): doc_id, held_out, lang_pred, score, margin, reliable.

    lang_pred is a learned language, or `und` where the text is null or has no
    letter, or nothing could be learned. Of equal sizes, the language first in
    order wins. Every text is compressed whole, however long. lang is read by fit()
    only, other columns are ignored. Rows that repeat give equal rows, an empty table none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs) if dictionaries is None else dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(shared.value)
        for batch in batches:
            found = [classifier.classify(t.as_py()) for t in batch.column(1)]
            lang, score, gap = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(gap, pa.float64()), pa.array([x != UNDETERMINED and g >= margin for x, g in zip(lang, gap, strict=True)], pa.bool_())],
                names=["doc_id", "held_out", "lang_pred", "score", "margin", "reliable"],
            )

    chosen = docs.select("doc_id", "text", F.coalesce(held_out(), F.lit(False)).alias("held_out"))
    return chosen.mapInArrow(run, f"doc_id {chosen.dtypes[0][1]}, held_out boolean, lang_pred string, score double, margin double, reliable boolean")
