import random

import pytest
from pyspark.sql import functions as F

from fenestra.functions import codes


def by_hand(code):
    """One field after the other, as the matrix is described."""
    if code is None:
        return None
    out = {"vehicle": code[:4], "category": None, "glass_type": None, "tint": None, "top_tint": None, "body": None, "position": None, "traits": [], "error": None, "at": None}
    if len(code) < 5:
        return out | {"error": "short", "at": len(code) + 1}
    rest = code[4:]
    kinds = [(c, rest[:n]) for c, n in ((5, 2), (6, 2), (1, 1), (2, 1), (3, 1), (4, 1)) if rest[:n] in codes.TYPES[c]]
    if not kinds:
        return out | {"error": "type", "at": 5}
    category, symbol = kinds[0]
    out |= {"category": codes.CATEGORIES[category], "glass_type": codes.TYPES[category][symbol]}
    rest = rest[len(symbol) :]
    for field in codes.FIELDS[category]:
        table = codes.SYMBOLS[field]
        for n in (2, 1):
            if rest[:n] in table and len(rest[:n]) == n:
                out[field], rest = table[rest[:n]], rest[n:]
                break
    while rest and rest[0] in codes.TRAITS and len(out["traits"]) < 5:
        out["traits"].append(rest[0])
        rest = rest[1:]
    if out["position"] is None:
        out["position"] = "Left" if "L" in out["traits"] else "Right" if "R" in out["traits"] else None
    return out | ({"error": "rest", "at": len(code) - len(rest) + 1} if rest else {})


@pytest.mark.parametrize("seed", [1, 2])
def test_decoding_against_field_by_field(spark, seed):
    rng = random.Random(seed)
    symbols = [s for t in codes.TYPES.values() for s in t] + [*codes.TINTS, *codes.TOP_TINTS, *codes.BODIES, *codes.PLACES, *codes.TRAITS, "?", "1"]
    texts = ["".join(rng.choices("0123A", k=rng.choice([4, 4, 4, 4, 2]))) + "".join(rng.choices(symbols, k=rng.randint(0, 8))) for _ in range(1500)] + ["", "1234", "1234A", None, "1234ASAS", "1234LLGLGL"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, code string").select("id", codes.decoded(F.col("code")).alias("d")).collect()
    for r in got:
        want, have = by_hand(texts[r.id]), r.d.asDict() if r.d else None
        if want is None:
            assert have is None
        else:
            assert {k: have[k] for k in want} == want, texts[r.id]
            assert have["trait_labels"] == [codes.TRAITS[t] for t in want["traits"]]


@pytest.mark.parametrize(("code", "side"), [("1234AL", "driver"), ("1234AR", "passenger"), ("1234FGNRD", "passenger"), ("1234FGNFD", "driver"), ("1234FGNMD", None), ("1234A", None)])
def test_sides(spark, code, side):
    assert spark.range(1).select(codes.decoded(F.lit(code))["side"].alias("s")).first().s == side


def test_states_form_a_table_without_doubles():
    rows = codes.transitions()
    assert len({r[:2] for r in rows}) == len(rows) and {r[4] for r in rows} - {r[0] for r in rows} == {"end"}


def test_round_trip(spark):
    rows = [("12", "A", "GN", None, ["H", "M"]), ("1234", "B", "CL", "BZ", []), ("9999", "SX", None, None, ["A"])]
    df = spark.createDataFrame(rows, "v string, t string, tint string, top string, traits array<string>")
    got = df.select(codes.encoded(F.col("v"), F.col("t"), F.col("tint"), F.col("top"), traits=F.col("traits")).alias("code"), "traits", "tint").withColumn("d", codes.decoded(F.col("code"))).collect()
    assert [r.code for r in got] == ["1200AGNHM", "1234BCLBZ", "9999SXA"]
    assert all(r.d.traits == r.traits and r.d.error is None and r.d.tint == codes.TINTS.get(r.tint) for r in got)
