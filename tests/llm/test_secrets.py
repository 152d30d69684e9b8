import hashlib
import random
import re

from fenestra.llm.secrets import scan_secrets

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
KEY = "Zk3vQ9xT7bLw2RmY8pNc4HfJ6sDg1aXe"


def fixture():
    rng = random.Random(3)
    words = ["alpha", "beta", "gammadelta", "configuration", "internationalization", "some_identifier_name", "over"]
    parts = ["con", "fig", "ur", "ation", "inter", "na", "tion", "al", "ize", "Set", "Get", "Value", "_of", "able", "ment"]
    words += ["".join(rng.choices(parts, k=rng.randint(2, 8))) for _ in range(1500)]
    rows = [(i, " ".join(rng.choices(words, k=60))) for i in range(150)]
    hexed = "".join(rng.choices("0123456789abcdef", k=40))
    rows += [
        (1000, f"password=abc123 and token = \"{hexed}\" end"),
        (1001, f"ü😀 secret: 'x' API_KEY:longvalue99 passwd = token: abcdefgh {hexed}"),
        (1002, f"AKIA{'A1B2' * 5} AKIASHORT {KEY} plain"),
        (1003, None),
        (1004, ""),
        (1005, "word " * 50_000 + f"Token={KEY}"),
        (1006, "token=" + "f" * 23 + " " + "f" * 23 + " " + "a1" * 12),
        (1007, "secret=token=abcdef, secret:token=short PassWord\"=\"a.b/c+d=e-f"),
        (1002, f"AKIA{'A1B2' * 5} AKIASHORT {KEY} plain"),
        (None, f"see {KEY}"),
    ]
    return rows


def brute(text):
    text = text or ""
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_against_brute_force(spark):
    rows = fixture()
    docs = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id bigint, text string, spans string")
    got = sorted(scan_secrets(docs).collect(), key=str)
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for doc_id, text in rows:
        r, want = by_id[doc_id], brute(text)
        line = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest(), (doc_id, r.spans, line)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x[3] == k for x in want) for k in ("assign", "access", "hex")]
        assert set(filter(None, line.split(","))) <= set(r.spans.split(","))
    at = fixture()[152][1].index(KEY)
    assert f"markov:{at}:{at + len(KEY)}" in by_id[1002].spans and by_id[None].n_markov == 1
    assert sum(by_id[i].n_markov for i in range(150)) == 0


def test_empty(spark):
    assert scan_secrets(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_recall_of_planted_keys(spark):
    """Random keys of several alphabets and lengths that no rule finds, against long ordinary words: recall and false alarms."""
    rng = random.Random(17)
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    alphabets = {"base62": lower + upper + digits, "base64": lower + upper + digits + "+/", "url": lower + upper + digits + "-_", "upper": upper + digits, "lower": lower + digits}
    plain = fixture()[:150]
    keys = {i: (name, "".join(rng.choices(a, k=rng.randint(24, 48)))) for i, (name, a) in enumerate(sorted(alphabets.items()) * 60, 5000)}
    names = ["internationalization_of_identifiers", "getConfigurationValueOfSetting", "some-very-long-hyphenated-name", "SETTINGS_OVERRIDE_DEFAULT_VALUE", "path/to/some/nested/directory/name"]
    rows = plain + [(i, f"see {key} here") for i, (_, key) in keys.items()] + [(9000 + i, f"call {x} now") for i, x in enumerate(names * 20)]
    got = {r.doc_id: r for r in scan_secrets(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()}
    found = {i: f"markov:4:{4 + len(key)}" in got[i].spans or got[i].n_hex > 0 for i, (_, key) in keys.items()}
    by_alphabet = {name: sum(found[i] for i, (n, _) in keys.items() if n == name) / 60 for name in alphabets}
    alarms = {names[i % 5] if i >= 9000 else i for i in got if (i < 5000 or i >= 9000) and got[i].n_markov}
    assert min(by_alphabet.values()) >= 0.9, by_alphabet
    assert not alarms
