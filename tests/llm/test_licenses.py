import random
import re

from fenestra.llm.licenses import BASE, NOTICES, Scanner, scan_licenses

ROWS = [
    (1, "Released under the MIT License."),
    (2, "under  the\nMIT--license under the mit license; Apache License, Version 2.0 and CC BY-NC 4.0"),
    (3, "relased under the MIT Lisence as is"),
    (4, "under the mitt license"),
    (5, "apache licence version 2"),
    (6, "GNU General Public License v3"),
    (7, "nothing to see, cc by nd, thunder the mit license"),
    (8, None),
    (9, ""),
    (10, "é" * 10 + " ünder the mit license " + "w " * 60_000 + "CC-BY-NC"),
    (11, "cc by nc"),
    (11, "cc by nc"),
    (None, "Licensed under the Apache License, Version 2.0"),
]
WORD = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = [(i, label) for phrase, label in BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), sorted(places)


def test_base_against_brute_force_and_edits(spark):
    docs = spark.createDataFrame([(a, b, "x") for a, b in ROWS], "doc_id bigint, text string, labels string")
    got = sorted(scan_licenses(docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    assert len(got) == len(ROWS)
    for r, (_, text) in zip(got, ROWS, strict=True):
        n, places = brute(text)
        assert (r.n_words, r.n_base) == (n, len(places))
        assert r.first_word == (places[0][0] if places else None) and r.last_word == (places[-1][0] if places else None)
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1 and (r.score == 1 or not places)
    by_id = {r.doc_id: r for r in got}
    assert by_id[3].labels == "mit" and by_id[3].base_labels == "" and by_id[3].matches[0].edits == 2
    assert by_id[4].labels == "mit" and by_id[5].labels == "apache-2" and by_id[6].labels == "gpl" and by_id[6].score == 1.0
    assert by_id[10].labels == "cc-by-nc,mit" and by_id[10].last_word == 60_005
    assert by_id[7].labels == "cc-by-nd,mit" and by_id[7].base_labels == "" and by_id[8].labels == ""
    assert scan_licenses(docs.where("false")).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
    return row[-1]


def brute_spans(words):
    """All runs of words within the edits of a notice, by edit distance; the best of each start; then without overlaps."""
    taken, near = [], []
    for n in NOTICES:
        for i in range(len(words)):
            best = None
            for j in range(i, min(len(words), i + n.phrase.count(" ") + n.edits + 2)):
                part = " ".join(words[i : j + 1])
                if part == n.phrase:
                    taken.append((i, j, n, 0))
                elif abs(len(part) - len(n.phrase)) <= n.edits and (d := distance(part, n.phrase)) <= n.edits:
                    best = min(best or (d, i, j), (d, i, j))
            if best:
                near.append((*best, n))
    for d, i, j, n in sorted(near, key=lambda x: (*x[:3], x[3].label)):
        if all(j < a or b < i for a, b, *_ in taken):
            taken.append((i, j, n, d))
    return sorted((i, j - i + 1, n.label, n.base and not d, d) for i, j, n, d in taken)


def edited(rng, phrase, edits):
    text = list(phrase)
    for _ in range(edits):
        at = rng.choice([0, len(text), rng.randrange(len(text) + 1)])
        kind = rng.choice("ids")
        if kind == "i":
            text.insert(at, rng.choice("abcxyz "))
        elif text:
            at = min(at, len(text) - 1)
            text[at : at + 1] = [] if kind == "d" else [rng.choice("abcxyz ")]
    return "".join(text)


def test_every_match_within_the_edits_is_found():
    """Random edits at the start, at the end and within, notices side by side, at the beginning and the end of texts."""
    rng, scanner, planted, met = random.Random(21), Scanner(), 0, 0
    texts = ["aunder the mit licenseb", "egnu general public liaense", "x aunder the mit licenseb y", "cc bi nc", "cc by nc cc by nc", "cc by n", "ccby nc", "c by nd"]
    for i in range(700):
        parts = [edited(rng, n.phrase, rng.randint(0, n.edits)) for n in rng.choices(NOTICES, k=rng.randint(1, 3))]
        fill = lambda: " ".join(rng.choices(["a", "cc", "by", "the", "license", "mit", "word", "x"], k=rng.randint(0, 3)))
        texts.append(" ".join([fill() if i % 3 else "", *parts, fill() if i % 2 else ""]).strip())
    for text in texts:
        words, want = text.split(), brute_spans(text.split())
        assert scanner.scan(text) == (len(words), want), text
    for _ in range(400):  # a planted notice alone is always found, unless an edit left it more than the edits away
        n = rng.choice(NOTICES)
        text = " ".join(edited(rng, n.phrase, n.edits).split())
        if distance(text, n.phrase) <= n.edits:
            planted += 1
            met += any(x[2] == n.label or x[4] <= distance(text, n.phrase) for x in scanner.scan(text)[1])
    assert planted > 300 and met == planted
