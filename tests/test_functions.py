"""Functions and operators on small tables of their own, with nulls, ties and empty input."""

import pytest
from pyspark.sql import functions as F

from fenestra.functions import flags, semantics, similarity, text, years
from fenestra.operators import aggregate, match, quality, upsert, windows

#: Pairs of model names that must not, and must, be the same.
DIFFERENT = [
    ("JAGUAR I-PACE", "E-PACE", "jaguar"), ("JAGUAR I-PACE", "F-PACE", "jaguar"), ("BMW 3 SERIE", "5 SERIE", "bmw"), ("BMW 3-SERIE", "8-SERIE", "bmw"), ("BMW X3", "X30", "bmw"), ("BMW M3", "M4", "bmw"), ("MAZDA CX-5", "CX-50", "mazda"),
    ("MAZDA CX5", "CX50", "mazda"), ("AUDI A3", "A30", "audi"), ("AUDI Q3", "Q5", "audi"), ("MERCEDES C-KLASSE", "E-KLASSE", "mercedes"), ("VW TRANSPORTER T5", "T6", "vw"), ("VOLVO XC60", "XC 90", "volvo"), ("AUDI A4", "A40", "audi"),
]
SAME = [
    ("JAGUAR I-PACE", "I-PACE", "jaguar"), ("BMW 3 SERIE", "3 SERIE", "bmw"), ("BMW 3-SERIE", "3 SERIE", "bmw"), ("BMW X3", "X3", "bmw"), ("MAZDA CX-5", "CX 5", "mazda"), ("AUDI A3", "A3", "audi"),
    ("MERCEDES C-KLASSE", "C-KLASSE", "mercedes"), ("VW TRANSPORTER T5", "TRANSPORTER T5", "vw"), ("VOLVO XC60", "XC 60", "volvo"),
]


def values(spark, expression, *inputs):
    """The expression over a column x of the inputs, in order."""
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("x"))).collect()]


def test_model_equivalence(spark):
    rows = [(a, b, m, False) for a, b, m in DIFFERENT] + [(a, b, m, True) for a, b, m in SAME] + [("x", None, "y", False), (None, None, None, False), ("", "", "bmw", False)]
    rows += [("transporter t5", "transporter t6", "volkswagen nutzfahrzeuge", False), ("transporter t5", "multivan t5", "Volkswagen AG", True), ("c-klasse", "e-klasse", "mercedes-amg", False), ("c-klasse", "w205", "mercedes-amg", True)]
    rows += [("cross cross", "cross", "mini", True), ("cross x cross", "polo cross", "vw", False), ("cross cross up", "polo cross", "vw", False)]
    df = spark.createDataFrame(rows, "a string, b string, m string, want boolean")
    assert [r.a for r in df.where(similarity.model_equivalent(F.col("a"), F.col("b"), F.col("m")) != F.col("want")).collect()] == []


def test_input_types(spark):
    got = values(spark, text.input_type, "ab 12345", "AB-1234", "wvwzzz1kz6w000001", "8569AGNV", "85AG1", "1234AG12", "abc12x", "a-b-1", "two words", "", None, "É")
    assert [g["type"] for g in got] == ["regnr", "regnr", "vin", "oem", "oem", "eurocode", "oem", "sku", "text", "text", "text", "text"]


def test_years(spark):
    got = values(spark, years.year_range, "T5 2015-2019; x", "90-03 ", "03-", "x 2009- y", "(2017)", "none", None, "2015-2019")
    assert [tuple(g) for g in got] == [(2015, 2019), (1990, 2003), (2003, None), (2009, None), (2017, None), (None, None), (None, None), (None, None)]
    assert [tuple(r) for r in values(spark, years.year_month, "03/05-11/12", "99/01-", "x")] == [(2003, 5, 2011, 12), (1999, 1, None, None), (None, None, None, None)]
    assert values(spark, years.model_year, "WVWZZZ1KZKW000001", "12345678980", "short", "WVWZZZ1KZIW000001") == [2019, 2008, None, None]
    assert values(spark, years.last_year, "1999 then 2004x", "12004", None) == [2004, None, None]


def test_negation(spark):
    said = lambda x: flags.mentioned(flag_tokens(x), ["ANT", "ANTENNE"])
    flag_tokens = flags.flag_tokens
    assert values(spark, said, "glass +ANT", "IKKE ANT", "ant, ikke", "no a b c ant", "nothing", "", None, "uten x ant ANTENNE") == [True, False, False, True, None, None, None, False]


def test_text(spark):
    assert values(spark, lambda x: text.prefix4(x), " ab12cd", "abc", None) == ["AB12", None, None]
    assert values(spark, lambda x: F.array_join(text.adjacent_once(F.split(x, " ")), " "), "a a b a", "x", "") == ["a b a", "x", ""]
    assert values(spark, lambda x: F.array_join(text.all_codes(x, [{"GN": "g", "GNEL": "ge"}, {"EL": "e"}]), ","), "xgnelgn", "gnel", "none") == ["ge,g", "ge", ""]
    assert values(spark, lambda x: text.entity_decoded(x), "a&amp;b &quot c", None) == ['a&b " c', None]
    assert [tuple(v) for v in values(spark, lambda x: text.vehicle_text(x, {"LAND ROVER": "LANDROVER"}), "Land Rover Defender 2020", "Skoda Superb", "x")] == [("LANDROVER", "Defender", 2020), ("SKODA", "Superb", None), ("X", "", None)]


def test_similarity():
    assert similarity.jaro_winkler_of("a5", "a8") == pytest.approx(0.7, abs=1e-3)
    assert similarity.jaro_winkler_of("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert similarity.jaro_winkler_of("", "x") == 0.0 and similarity.jaro_winkler_of("x", "x") == 1.0


def test_semantics(spark):
    df = spark.createDataFrame([(None, None), (1, 5), (None, 3), (4, None)], "lo int, hi int")
    assert [r[0] for r in df.select(semantics.covers(F.col("lo"), F.col("hi"), 4)).collect()] == [True, True, False, True]
    assert [r[0] for r in df.select(semantics.overlap_length(F.col("lo"), F.col("hi"), F.lit(3), F.lit(4))).collect()] == [2, 2, 1, 1]
    assert spark.range(1).select(semantics.round2(F.lit(0.285))).first()[0] == 0.28
    assert spark.range(20).agg(semantics.percentile_at(F.col("id"), 0.95)).first()[0] == 19
    assert values(spark, semantics.int_prefix, "12x", " -3", "x", "", None) == [12, -3, None, None, None]


def test_joins(spark):
    left = spark.createDataFrame([(1, "a", 10), (2, "a", 14), (3, "b", 5), (4, None, 1)], "id int, k string, at int")
    right = spark.createDataFrame([(7, "a", 8), (8, "a", 12), (9, "a", 16), (10, "a", 8)], "rid int, k string, t int")
    got = {r.id: r.rid for r in match.nearest_join(left, right, ["k"], "at", "t", "id", "rid").collect()}
    assert got == {1: 7, 2: 8, 3: None, 4: None}
    layers = [spark.createDataFrame([("x", 1)], "code string, v int"), spark.createDataFrame([("x", 2), ("y", 3)], "code string, v int")]
    assert sorted(tuple(r) for r in match.ordered_layers(layers, ["code"], ["v"]).collect()) == [("x", 1, 0), ("y", 3, 1)]
    a = spark.createDataFrame([(1, 0, 100), (2, 500, 600)], "a int, lo int, hi int")
    b = spark.createDataFrame([(5, 90, 510), (6, 101, 400)], "b int, lo2 int, hi2 int").withColumn("blk", F.lit(1))
    pairs = match.overlap_join(a.withColumn("blk", F.lit(1)), b, ["blk"], ("lo", "hi"), ("lo2", "hi2"), bin_size=30)
    assert sorted((r.a, r.b) for r in pairs.collect()) == [(1, 5), (2, 5)]


def test_aggregates_and_state(spark):
    rows = spark.createDataFrame([("k", "x"), ("k", "x"), ("k", "y"), ("l", None), ("m", "b"), ("m", "a")], "k string, v string")
    assert sorted((r.k, r.v, r.votes, r.total) for r in aggregate.mode_vote(rows, ["k"], "v").collect()) == [("k", "x", 2, 3), ("m", "a", 1, 2)]
    state = spark.createDataFrame([("a", 1, None, 2)], "k string, name int, best int, evidence bigint")
    fresh = spark.createDataFrame([("a", None, 5), ("b", 7, 1)], "k string, name int, best int")
    merged = upsert.merge_evidence(state, fresh, ["k"], fill=["name"], most=["best"])
    assert sorted(tuple(r) for r in merged.collect()) == [("a", 1, 5, 3), ("b", 7, 1, 1)]
    kept = upsert.insert_absent(spark.createDataFrame([("a", 1)], "k string, v int"), spark.createDataFrame([("a", 2), ("b", 3)], "k string, v int"), ["k"])
    assert sorted(tuple(r) for r in kept.collect()) == [("a", 1), ("b", 3)]
    line = spark.createDataFrame([(1, True), (2, False), (3, False), (4, True), (5, False)], "at int, ok boolean").withColumn("k", F.lit("x"))
    assert [r.streak for r in windows.failure_streak(line, ["k"], ["at"], F.col("ok")).orderBy("at").collect()] == [0, 1, 2, 0, 1]
    gates = quality.gates(rows, {"rows": (F.count("*"), 5.0, True), "nulls": (F.count_if(F.col("v").isNull()), 0.0, False)})
    assert sorted((r.gate, r.passed) for r in gates.collect()) == [("nulls", False), ("rows", True)]
    assert aggregate.mode_vote(rows.where("false"), ["k"], "v").count() == 0


def test_generation_and_negation_in_characters(spark):
    assert values(spark, years.generation_of, "Transporter T5", "x t-6 y", "MK4", "T45", "none", "", None) == ["T5", "T6", "T4", None, None, None, None]
    said = lambda x: flags.mentioned_within(x, ["heated", "warm"], "uten|ikke", 15)
    assert values(spark, said, "heated", "uten heated", "ikke " + "x" * 15 + "heated", "uten warm, heated", "", None, "cold") == [True, False, True, False, None, None, None]


def test_completeness_and_centrality(spark):
    fields = lambda x: similarity.completeness([(x, 3), (F.length(x), 1), (F.lit(None), 4)])
    assert values(spark, fields, "a", None) == [0.5, 0.0]
    near = lambda x: semantics.centrality(F.lit(2), F.lit(6), x.cast("int"))
    assert values(spark, near, "4", "2", "9") == [1.0, pytest.approx(0.2), 0.0]


def test_shared_tokens_and_numbers(spark):
    left = spark.createDataFrame([("b", 1, ["x", "y"]), ("b", 2, []), ("c", 3, ["x"]), (None, 4, ["x"])], "block string, i int, a array<string>")
    right = spark.createDataFrame([("b", 10, ["y", "x", "z"]), ("b", 11, ["z"]), (None, 12, ["x"])], "block string, j int, b array<string>")
    got = match.shared_tokens(left, right, ["block"], ["i"], ["j"], tokens=("a", "b")).collect()
    assert [(r.block, r.i, r.j, r.shared) for r in got] == [("b", 1, 10, 2)]
    rows = spark.createDataFrame([("b", 2), ("a", 9), ("b", 1), (None, 5), ("a", 3)], "block string, n int")
    assert sorted((r.k, r.block, r.n) for r in match.numbered(rows, "block", ["n"], "k").collect()) == [(1, None, 5), (2, "a", 3), (3, "a", 9), (4, "b", 1), (5, "b", 2)]
    assert match.numbered(rows.where("false"), "block", ["n"], "k").count() == 0
