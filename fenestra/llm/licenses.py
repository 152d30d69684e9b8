"""Short licence notices, exact and fuzzy (operator 6).

A text is reduced to its words, joined by single spaces. A notice that may have k
edits is cut into k + 1 pieces: after k edits at least one piece is untouched and at
most k characters off, so its exact places lead to all words where the notice may
start. From there the regex library matches the whole notice, up to every word end
in reach, with at most k character edits, and reports the span.

Of matches that overlap, the one with fewer edits stays, then the first; an exact
match is never lost.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from fenestra.llm.common import ALNUM_TABLE

#: Notices whose exact places are the base, with their labels (fixed values of the contract).
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices that only the method reports.
MORE = {"gnu general public license": "gpl", "redistribution and use in source and binary forms": "bsd", "mozilla public license": "mpl", "cc by nd": "cc-by-nd", "cc by sa": "cc-by-sa"}
#: One edit for every so many characters of a notice, and one at least.
CHARS_PER_EDIT = 10


@dataclass(frozen=True)
class Notice:
    phrase: str
    label: str
    base: bool

    @property
    def edits(self) -> int:
        return max(1, len(self.phrase) // CHARS_PER_EDIT)

    def pieces(self) -> list[tuple[int, str]]:
        """(offset, piece): edits + 1 pieces that together are the phrase."""
        n, size = self.edits + 1, len(self.phrase)
        cuts = [size * i // n for i in range(n + 1)]
        return [(a, self.phrase[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


NOTICES = tuple(Notice(p, x, True) for p, x in BASE.items()) + tuple(Notice(p, x, False) for p, x in MORE.items())


class Scanner:
    def __init__(self, notices: tuple[Notice, ...] = NOTICES):
        self.notices = notices
        # by number of edits; marks at both ends let edits lie there, too
        self.fuzzy = {n: [regex.compile(rf"\x01(?:{regex.escape(n.phrase, literal_spaces=True)}){{e<={k}}}\x02") for k in range(1, n.edits + 1)] for n in notices}
        self.exact = {n: re.compile(rf"(?<!\S)(?={re.escape(n.phrase)}(?!\S))") for n in notices}
        self.any_seed = re.compile("|".join(re.escape(piece) for piece in sorted({piece for n in notices for _, piece in n.pieces()})))

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, str, bool, int]]]:
        """Number of words, and (first word, words, label, base, edits) of each match by place."""
        words = (text or "").encode("utf-8", "replace").translate(ALNUM_TABLE).split()
        if not words:
            return 0, []
        line = b" ".join(words).decode("utf-8", "replace")
        if not self.any_seed.search(line):
            return len(words), []
        starts, ends = [0], []
        for w in line.split(" "):
            ends.append(starts[-1] + len(w))
            starts.append(ends[-1] + 1)
        starts.pop()
        taken, near = [], []
        for notice in self.notices:
            size = notice.phrase.count(" ")
            for m in self.exact[notice].finditer(line):
                first = bisect_left(starts, m.start())
                taken.append((first, first + size, notice, 0))
            near += self._near(line, starts, ends, notice)
        for edits, first, last, notice in sorted(near, key=lambda x: (*x[:3], x[3].label)):
            if all(last < a or b < first for a, b, *_ in taken):
                taken.append((first, last, notice, edits))
        return len(words), sorted((a, b - a + 1, n.label, n.base and not edits, edits) for a, b, n, edits in taken)

    def _near(self, line: str, starts: list[int], ends: list[int], notice: Notice) -> list[tuple[int, int, int, Notice]]:
        """(edits, first word, last word, notice): of each first word the best match with edits, if any."""
        room, size, firsts, found = notice.edits, len(notice.phrase), set(), []
        for at, piece in notice.pieces():
            i = line.find(piece)
            while i >= 0:
                firsts.update(range(bisect_left(starts, i - at - room), bisect_right(starts, i - at + room)))
                i = line.find(piece, i + 1)
        for first in firsts:
            best = None
            for last in range(max(first, bisect_left(ends, starts[first] + size - room)), bisect_right(ends, starts[first] + size + room)):
                part = line[starts[first] : ends[last]]
                if part != notice.phrase and self.fuzzy[notice][-1].fullmatch(f"\x01{part}\x02"):
                    edits = next(k for k, p in enumerate(self.fuzzy[notice], 1) if p.fullmatch(f"\x01{part}\x02"))
                    best = min(best or (edits, first, last), (edits, first, last))
            if best:
                found.append((*best, notice))
        return found


def scan_licenses(docs: DataFrame, *, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """One row per row of `docs` (doc_id, text), with every whole text scanned.

    doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and
    `matches` (word, words, label, edits). A null or empty text has no words, no
    labels and score 0; very long texts are scanned whole. An exact match scores 1, one with edits 1 - edits / length of
    the notice; the best of a document counts. Repeated rows give equal rows.
    """
    sizes = {n.label: len(n.phrase) for n in notices}
    match = pa.list_(pa.struct([("word", pa.int64()), ("words", pa.int32()), ("label", pa.string()), ("edits", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices)
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for text in batch.column(1):
                n, found = scanner.scan(text.as_py())
                base = [x for x in found if x[3]]
                row = (
                    n, len(base), base[0][0] if base else None, max(x[0] for x in base) if base else None,
                    ",".join(sorted({x[2] for x in base})), ",".join(sorted({x[2] for x in found})),
                    max((1.0 - e / sizes[label] for _, _, label, _, e in found), default=0.0),
                    [{"word": w, "words": k, "label": label, "edits": e} for w, k, label, _, e in found],
                )
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), match)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, k) for v, k in zip(out, kinds, strict=True))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"])

    chosen = docs.select("doc_id", "text")
    return chosen.mapInArrow(run, f"doc_id {chosen.dtypes[0][1]}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, matches array<struct<word:bigint,words:int,label:string,edits:int>>")
