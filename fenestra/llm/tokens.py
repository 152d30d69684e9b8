"""Edit-aware token counts (operator 8).

Each document keeps a segment tree over its pre-tokens: leaves are pieces of the
text, cut where the pre-tokeniser surely cuts, with their lengths and token counts;
inner nodes are sums. An edit touches a few leaves. These, and one more on either
side for context, are cut and encoded again; all other leaves keep their counts,
and the sums above are brought up to date. Counts equal those of a full encoding.

A cut lies before a single space or line break between two characters that are not
white space: the pattern of the byte-level tokenisers has no token that crosses
such a place, and none that looks behind it.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folder of the public tokenizers' files, and the vocabulary in it.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Characters of a leaf, at least; it ends at the next cut.
LEAF_CHARS = 512
CUT = re.compile(r"(?<=\S) (?=\S)")
#: The pre-tokeniser's pattern that belongs to the vocabulary (a fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

Edit = tuple[int, int, str]


def encoder(folder: str = TOKENIZERS, name: str = VOCABULARY) -> Callable[[str], int]:
    """A function that counts the tokens of a text."""
    import tiktoken

    with open(f"{folder}/{name}", "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(coder.encode_ordinary(text))


def pieces(text: str, least: int = LEAF_CHARS) -> list[str]:
    """The text cut into leaves; an empty text has none."""
    out, at = [], 0
    while at < len(text):
        found = CUT.search(text, at + least)
        end = found.start() if found else len(text)
        out.append(text[at:end])
        at = end
    return out


class TokenTree:
    """Leaves (characters, tokens) of one document and a Fenwick tree of sums for each."""

    def __init__(self, lengths: list[int], counts: list[int]):
        self.lengths, self.counts = list(lengths), list(counts)
        self._build()

    def _build(self) -> None:
        self.sums = []
        for values in (self.lengths, self.counts):
            tree = [0, *values]
            for i in range(1, len(tree)):
                up = i + (i & -i)
                if up < len(tree):
                    tree[up] += tree[i]
            self.sums.append(tree)

    @classmethod
    def of(cls, text: str, count: Callable[[str], int]) -> TokenTree:
        leaves = pieces(text)
        return cls([len(x) for x in leaves], [count(x) for x in leaves])

    def total(self, which: int = 1) -> int:
        tree, i, out = self.sums[which], len(self.counts), 0
        while i:
            out += tree[i]
            i -= i & -i
        return out

    def _add(self, leaf: int, length: int, count: int) -> None:
        for tree, by in zip(self.sums, (length, count), strict=True):
            i = leaf + 1
            while i < len(tree):
                tree[i] += by
                i += i & -i

    def edit(self, text: str, change: Edit, count: Callable[[str], int]) -> tuple[str, int]:
        """Replaces text[start:end]. Returns the new text and how many characters were encoded again."""
        start, end, new = change
        start = min(max(0, start), len(text))
        end = min(max(start, end), len(text))
        starts = [0, *accumulate(self.lengths)]
        if self.lengths:
            first = max(0, min(bisect_right(starts, start) - 1, len(self.lengths) - 1) - 1)
            last = min(len(self.lengths), min(bisect_right(starts, end) - 1, len(self.lengths) - 1) + 2)
        else:
            first = last = 0
        left, right = starts[first], starts[last]
        region = text[left:start] + new + text[end:right]
        after = text[:start] + new + text[end:]
        # what follows must still begin where a cut may lie
        while last < len(self.lengths) and not CUT.match(after, left + len(region)):
            region += text[right : starts[last + 1]]
            last += 1
            right = starts[last]
        while first and not CUT.match(after, left):
            first -= 1
            region = text[starts[first] : left] + region
            left = starts[first]
        leaves = pieces(region)
        lengths, counts = [len(x) for x in leaves], [count(x) for x in leaves]
        if len(leaves) == last - first:
            for i, (a, b) in enumerate(zip(lengths, counts, strict=True), first):
                self._add(i, a - self.lengths[i], b - self.counts[i])
            self.lengths[first:last], self.counts[first:last] = lengths, counts
        else:
            self.lengths[first:last], self.counts[first:last] = lengths, counts
            self._build()
        return after, len(region)


def token_trees(docs: DataFrame, *, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """doc_id, text, n_tokens, lengths, counts: the leaves of every whole text. A null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(folder, name)
        for batch in batches:
            trees = [TokenTree.of(t.as_py() or "", count) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([t.total() for t in trees], pa.int64()), pa.array([t.lengths for t in trees], pa.list_(pa.int32())), pa.array([t.counts for t in trees], pa.list_(pa.int32()))],
                names=["doc_id", "text", "n_tokens", "lengths", "counts"],
            )

    chosen = docs.select("doc_id", "text")
    return chosen.mapInArrow(run, f"doc_id {chosen.dtypes[0][1]}, text string, n_tokens bigint, lengths array<int>, counts array<int>")


def apply_edits(trees: DataFrame, *, folder: str = TOKENIZERS, name: str = VOCABULARY, keep_text: bool = True) -> DataFrame:
    """The trees after their `edits` (array of start, end, new; in code points, one after the other).

    doc_id, text, n_tokens, lengths, counts, n_before, n_chars, n_encoded (characters encoded again).
    Edits beyond the text are moved to its end; null edits change nothing; a null text counts as empty.
    """
    plain = trees.select("doc_id", "text", "lengths", "counts", "n_tokens", "edits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(folder, name)
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py() or ""
                tree = TokenTree(batch.column(2)[i].as_py() or [], batch.column(3)[i].as_py() or [])
                encoded = 0
                for e in batch.column(5)[i].as_py() or []:
                    text, n = tree.edit(text, (e["start"], e["end"], e["new"] or ""), count)
                    encoded += n
                for column, value in zip(out, (text if keep_text else None, tree.total(), tree.lengths, tree.counts, len(text), encoded), strict=True):
                    column.append(value)
            kinds = (pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.int64())
            made = [pa.array(v, k) for v, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made[:4], batch.column(4), *made[4:]], names=["doc_id", "text", "n_tokens", "lengths", "counts", "n_before", "n_chars", "n_encoded"])

    return plain.mapInArrow(run, f"doc_id {plain.dtypes[0][1]}, text string, n_tokens bigint, lengths array<int>, counts array<int>, n_before bigint, n_chars bigint, n_encoded bigint")


def sample_edits(text: Column, doc_id: Column) -> Column:
    """Three edits of every document, from a hash of its id: an insertion, a deletion and a replacement of a dozen characters."""
    n = F.greatest(F.coalesce(F.length(text), F.lit(0)), F.lit(1))
    place = lambda salt: F.pmod(F.xxhash64(doc_id, F.lit(salt)), n.cast("bigint")).cast("int")
    edit = lambda a, size, new: F.struct(a.alias("start"), (a + size).alias("end"), F.lit(new).alias("new"))
    return F.array(edit(place("insert"), 0, " inserted words,\n"), edit(place("delete"), 12, ""), edit(place("replace"), 12, "Replaced"))


def edited_counts(docs: DataFrame, *, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """One row per row of `docs` (doc_id, text): n_tokens of the whole text, n_edited after `sample_edits`, n_chars then, n_encoded."""
    trees = token_trees(docs, folder=folder, name=name)
    edited = apply_edits(trees.withColumn("edits", sample_edits(F.col("text"), F.col("doc_id"))), folder=folder, name=name, keep_text=False)
    return edited.select("doc_id", F.col("n_before").alias("n_tokens"), F.col("n_tokens").alias("n_edited"), "n_chars", "n_encoded")
