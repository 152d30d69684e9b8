"""Best-fit packing of tokenised documents into sequences (operator 11).

Documents become token ids and an end, are cut into pieces of at most `capacity` ids,
and the pieces share sequences. What is packed is the histogram of lengths, whose
size is bounded by `capacity` however many documents there are:

1. All patterns of two or three lengths that fill a sequence exactly are enumerated.
2. Non-negative least squares fits how often each pattern is repeated, so that the
   lengths it uses match the histogram; longer lengths weigh more.
3. The counts are rounded down, then up where enough pieces are left, largest fraction first.
4. What is left of the histogram is packed by best fit, longest first, many equal bins at once.

The plan is a short list of runs: ranks of pieces of one length, the sequences they go
to and their place there. Pieces know their rank among pieces of their length from
counts by task, so that no length, however frequent, meets in one task.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from fenestra.llm.common import Scratch

#: The vocabulary's file; by default that of the public tokenizers.
VOCABULARY = "word_bpe_49k.json"
#: Tokens of a sequence.
CAPACITY = 2048
#: Parts of texts that a worker remembers with their ids: the first ones, among which are the frequent ones.
MAX_WORDS = 600_000


# ---------------------------------------------------------------- token ids


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> str:
    """The characters that stand for the 256 bytes in byte-level vocabularies: printable ones stand for themselves."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return "".join(chr(b if b in printable else next(others)) for b in range(256))


class TextIds:
    """Ids of whole texts as little-endian 32-bit integers, the same as the tokenizer's own.

    A text in which all characters are ASCII, Latin letters below U+0250 or general
    punctuation is lower-cased and parted by the vocabulary's own pattern here; each
    part goes to the tokenizer's model once and is remembered. Every other text, or one
    with a special token in it, goes to the tokenizer as a whole.
    """

    LETTER, NUMBER, SPACE = "a-zªµºß-öø-ɏ", "0-9²³¹¼-¾", r"\t-\r \x85\xa0"
    #: The vocabulary's pattern (a fixed value) over the characters of OTHER's complement.
    PART = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^{SPACE}{LETTER}{NUMBER}]+")
    OTHER = re.compile("[^\x00-\u012f\u0131-\u024f\u2010-\u2027]")

    #: Characters of a text that are encoded at once, at least.
    SLICE = 1 << 20

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.letters = byte_letters()
        self.known: dict[str, bytes] = {}
        #: Whether texts may be parted here: a sample of hard cases has to come out alike.
        self.plain = self.parted(hard := "Ab, the  THE the's l'\u00e9t\u00e9.\n\u00c9t\u00e9!! x1y22 na\u00efve?!'start \u2018\u0153uf\u2019 \x1c 3\u00bd\u00aa\xa0_a") == self.full(hard)

    def full(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def part(self, part: str) -> bytes:
        mapped = part if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(self.letters)
        ids = array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()
        if len(self.known) < MAX_WORDS and len(part) <= 64:
            self.known[part] = ids
        return ids

    def parted(self, text: str) -> bytes:
        parts = self.PART.findall(text.lower())
        ids = list(map(self.known.get, parts))
        if None in ids:
            ids = [self.part(p) if i is None else i for p, i in zip(parts, ids, strict=True)]
        return b"".join(ids)

    def slices(self, text: str) -> Iterator[str]:
        """Stretches of about SLICE characters, cut at spaces, which part tokens."""
        at = 0
        while at < len(text):
            end = text.find(" ", at + self.SLICE)
            yield text[at : end if end >= 0 else len(text)]
            at = end if end >= 0 else len(text)

    def __call__(self, text: str) -> bytes:
        whole = not self.plain or self.OTHER.search(text) or any(s in text for s in self.special)
        return b"".join(map(self.full if whole else self.parted, self.slices(text)))


_ENCODERS: dict[str, TextIds] = {}


def text_ids(path: str) -> TextIds:
    """One encoder a worker: it keeps the words that it knows for later tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextIds(path)
    return _ENCODERS[path]


def token_pieces(docs: DataFrame, *, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, nth) of every piece of every row.

    A text (null counts as empty) is its ids and id 0 at the end. `nth` numbers the
    pieces of one length that a task has made, from 0; keep the table before use, since
    another run may be cut into other tasks.
    """
    path = vocabulary or vocabulary_path()
    id_type: DataType = docs.schema["doc_id"].dataType

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = text_ids(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            rows, pieces, starts, lengths, sums, nths = [], [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                ids = encode(text.as_py() or "") + b"\0\0\0\0"
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    rows.append(row)
                    pieces.append(piece)
                    starts.append(at // 4)
                    lengths.append(len(own) // 4)
                    sums.append(zlib.crc32(own))
                    nths.append(seen[len(own) // 4])
                    seen[len(own) // 4] += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64()), pa.array([task] * len(rows), pa.int32()), pa.array(nths, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"],
            )

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(cut_up, f"doc_id {id_type.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint, task int, nth bigint")


# ---------------------------------------------------------------- the plan, from the histogram alone


def exact_patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """All (a, b, c) with a >= b >= c, of the given lengths, that add up to `capacity`; c may be 0 for none."""
    have = np.zeros(capacity + 1, dtype=bool)
    have[lengths] = True
    have[capacity] = False
    allowed = have.copy()
    allowed[0] = True
    found = []
    for a in np.flatnonzero(have):
        b = np.arange(max(1, (capacity - a + 1) // 2), min(a, capacity - a) + 1)
        c = capacity - a - b
        ok = have[b] & allowed[c]
        found.append(np.column_stack([np.full(int(ok.sum()), a), b[ok], c[ok]]))
    return np.concatenate(found) if found else np.zeros((0, 3), dtype=np.int64)


def fit_counts(patterns: np.ndarray, counts: np.ndarray, *, rounds: int = 40, grow: int = 150) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative least squares: (used patterns, repeats) that bring the lengths they use near `counts`.

    An active-set method: of the patterns by whose growth the error falls most, some
    that share no length are let in together, at most `grow`; the normal equations are
    solved, and patterns that would be repeated less than zero times leave, until none
    would. It ends after `rounds`, or when no pattern lowers the error any more.
    """
    capacity = len(counts) - 1
    weight = np.arange(capacity + 1) / capacity  # an unmatched long piece costs more
    target = counts * weight
    active, x = np.zeros(0, dtype=np.int64), np.zeros(0)
    columns, gram = np.zeros((capacity + 1, 0)), np.zeros((0, 0))
    for _ in range(rounds):
        rest = target - columns @ x
        worth = (rest * weight)[patterns].sum(axis=1)
        worth[active] = 0.0
        top = np.argsort(-worth, kind="stable")[: 20 * grow]
        met, new = np.zeros(capacity + 1, dtype=bool), []
        for k in top[worth[top] > 1e-6 * counts.sum()]:
            own = patterns[k][patterns[k] > 0]
            if not met[own].any():
                met[own] = True
                new.append(k)
                if len(new) == grow:
                    break
        if not new:
            break
        more = np.zeros((capacity + 1, len(new)))
        np.add.at(more, (patterns[new].T, np.arange(len(new))), 1.0)
        more *= weight[:, None]
        across = columns.T @ more
        gram = np.block([[gram, across], [across.T, more.T @ more]])
        active, columns = np.concatenate([active, new]), np.hstack([columns, more])
        while len(active):
            x = np.linalg.solve(gram + 1e-9 * np.eye(len(active)), columns.T @ target)
            stay = x > 0
            if stay.all():
                break
            active, columns, gram, x = active[stay], columns[:, stay], gram[np.ix_(stay, stay)], x[stay]
    return patterns[active], x


def round_counts(patterns: np.ndarray, repeats: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole repeats that the histogram can serve, and what is left of it."""
    left, whole = counts.copy(), np.zeros(len(patterns), dtype=np.int64)

    def take(k: int, most: int) -> None:
        own, each = np.unique(patterns[k][patterns[k] > 0], return_counts=True)
        n = min(most, int((left[own] // each).min()))
        if n > 0:
            left[own] -= n * each
            whole[k] += n

    for k in np.argsort(-repeats, kind="stable"):
        take(int(k), int(repeats[k]))
    for k in np.argsort(np.floor(repeats) - repeats, kind="stable"):
        take(int(k), 1)
    return whole, left


Bins = list[tuple[int, list[tuple[int, int]]]]


def best_fit(left: np.ndarray, capacity: int) -> Bins:
    """Longest first, each into the fullest bin that has room: (equal bins, [(length, pieces of it)]).

    Bins of the same content are one entry with a number. Putting a piece into the
    fullest bin leaves it the fullest, so that it takes as many of that length as it can.
    """
    rooms: list[int] = []
    at: dict[int, Bins] = {}

    def add(n: int, own: list[tuple[int, int]], room: int) -> None:
        if n:
            if room not in at:
                insort(rooms, room)
                at[room] = []
            at[room].append((n, own))

    for length in np.flatnonzero(left)[::-1].tolist():
        count = int(left[length])
        while count:
            i = bisect_left(rooms, length)
            if i == len(rooms):
                each = capacity // length
                add(count // each, [(length, each)], capacity - each * length)
                if rest := count % each:
                    add(1, [(length, rest)], capacity - rest * length)
                break
            room = rooms[i]
            n, own = at[room].pop()
            if not at[room]:
                del at[room], rooms[i]
            each = min(room // length, count)
            used = min(n, count // each)
            add(n - used, own, room)
            add(used, [*own, (length, each)], room - each * length)
            count -= used * each
    return [b for room in rooms for b in at[room]]


def packing_runs(counts: np.ndarray, capacity: int) -> np.ndarray:
    """Rows (length, first rank, each, sequence, offset), by length and first rank.

    Rank r of a length, from the run with the largest first rank up to r, goes to
    sequence + (r - first) // each, at offset + (r - first) % each * length.
    """
    patterns = exact_patterns(np.flatnonzero(counts), capacity)
    used, repeats = fit_counts(patterns, counts)
    whole, left = round_counts(used, repeats, counts)
    bins: Bins = [(int(n), [(int(v), int(k)) for v, k in zip(*np.unique(p[p > 0], return_counts=True), strict=True)]) for p, n in zip(used, whole, strict=True) if n]
    bins += best_fit(left, capacity)
    rank, sequence, rows = np.zeros(capacity + 1, dtype=np.int64), 0, []
    for n, own in bins:
        offset = 0
        for length, each in own:
            rows.append((length, rank[length], each, sequence, offset))
            rank[length] += n * each
            offset += length * each
        sequence += n
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


# ---------------------------------------------------------------- the operator


def pack_documents(docs: DataFrame, *, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every row of `docs` is a document of its own, rows that repeat (also with the same
    doc_id, which may be null or of any type) and null or empty texts, which are the end
    alone, included. Only documents of more than `capacity` ids are cut. An empty table
    gives none. Other columns are not read. Ties between pieces of one length are free:
    any of them may take a place.
    """
    spark = docs.sparkSession
    kept = Scratch(spark, "op11")
    pieces = kept.put(token_pieces(docs, capacity=capacity, vocabulary=vocabulary))
    by_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        counts[r.length] = r.n
    runs = packing_runs(counts, capacity)
    shared = spark.sparkContext.broadcast((runs, runs[:, 0] * (1 << 48) + runs[:, 1]))
    before = by_task.select("task", "length", F.expr("sum(n) OVER (PARTITION BY length ORDER BY task ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)").alias("before"))
    ranked = pieces.join(before, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.coalesce("before", F.lit(0)) + F.col("nth")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, keys = shared.value
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            run = runs[np.searchsorted(keys, length * (1 << 48) + rank, side="right") - 1]
            nth = rank - run[:, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(run[:, 3] + nth // run[:, 2]), pa.array(run[:, 4] + nth % run[:, 2] * length)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema.fields[:5])
    return ranked.mapInArrow(place, f"{fields}, sequence_id bigint, offset bigint")
