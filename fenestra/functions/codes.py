"""The official matrix of part codes, read by a table of states.

A code is four characters of the vehicle, a type of one or two letters, and then
optional fields. Each state has a table of symbols; a symbol names a feature and the
state that comes next, and where no symbol fits, a state may be left as it is.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the matrix, edition 2014.7.31.
CATEGORIES = {1: "frontrute", 2: "bakrute", 3: "bodyglass", 4: "takglass", 5: "bodyglass-laminated", 6: "accessory"}
TYPES = {
    1: {"A": "Windscreen", "C": "Alternative windscreen", "D": "Windscreen with accessories in pack"},
    2: {"B": "Backlight", "E": "Backlight with accessories in pack"},
    3: {"F": "Front door", "H": "Rear door", "L": "Front quarterlight", "M": "Middle door", "R": "Rear quarterlight", "T": "Vent"},
    4: {"G": "Glass roof"},
    5: {
        "AK": "Front door - laminated", "BK": "Rear door - laminated", "CK": "Front quarterlight - laminated", "FK": "Front door - laminated", "LK": "Front quarterlight - laminated", "RK": "Rear quarterlight - laminated",
        "GK": "Glass roof - laminated", "SK": "Sliding roof - laminated", "AS": "Front door - sliding", "BS": "Rear door - sliding", "CS": "Front quarterlight - sliding", "FS": "Front door - sliding",
        "LS": "Front quarterlight - sliding", "RS": "Rear quarterlight - sliding", "GS": "Glass roof - sliding", "SS": "Sliding roof - sliding",
    },
    6: {
        "AX": "Accessory - front door", "BX": "Accessory - rear door", "CX": "Accessory - front quarterlight", "FX": "Accessory - front door", "LX": "Accessory - front quarterlight", "RX": "Accessory - rear quarterlight",
        "GX": "Accessory - glass roof", "SX": "Accessory - sliding roof",
    },
}
TINTS = {
    "AB": "Anti-bandit clear (5-ply)", "AC": "Anti-bandit (2-ply with multiple PVB ply)", "AF": "Anti Firearm (2-ply glass + 1-ply polycarbonate)", "AG": "Anti-bandit green (5-ply)", "AP": "Anti-bandit privacy (5-ply)",
    "AS": "Security Clear (3-ply)", "BA": "Blue + acoustic", "BB": "Blue absorbing", "BL": "Blue", "BS": "Blue - solar control", "BZ": "Bronze", "CA": "Clear + acoustic", "CB": "Clear absorbing", "CC": "Clear with coating",
    "CD": "Clear with coating + Acoustic", "CH": "Coated glass with high heat reflective effect", "CK": "Coated glass with high heat reflective effect and acoustic PVB", "CL": "Clear", "GA": "Green + acoustic", "GB": "Green absorbing",
    "GC": "Green absorbing + acoustic", "GN": "Green", "GS": "Green - solar control", "GY": "Grey", "LG": "Light green (Japanese)", "YA": "Grey + acoustic", "YC": "Grey coated",
}
TOP_TINTS = {"BL": "Blue top tint", "BZ": "Bronze top tint", "GN": "Green top tint", "GY": "Grey top tint", "LG": "Light green top tint", "YD": "Dark grey top tint"}
BODIES = {"H": "Hatchback", "S": "Saloon/sedan", "C": "Coupe", "E": "Estate/break", "M": "MPV", "R": "Ranger", "T": "Tourer sport/cabrio", "L": "Lorry/truck", "V": "Van", "P": "Pick-up"}
PLACES = {"FD": "Front door", "FQ": "Front quarterlight", "FV": "Front vent", "MD": "Middle door", "MQ": "Middle quarter", "PG": "Partition glass", "RD": "Rear door", "RQ": "Rear quarterlight", "RV": "Rear vent"}
TRAITS = {
    "A": "Antenna", "B": "RHD (right hand drive)", "C": "Camera bracket / LDW / IHC / LC / TL / City emergency braking / Traffic sign recognition", "D": "Double glazed", "E": "Electrically operated", "F": "Front part", "G": "GPS",
    "H": "Heated", "I": "Hardware (not used in fitting)", "J": "TV antenna", "K": "Heating through coating", "L": "Left half", "M": "Sensor (light and/or moisture)", "N": "Water repellent glass", "O": "De-Vapour (defoging) detector",
    "P": "Modification of silkscreen for Sensor / LDW / IHC / etc.", "Q": "Quarter", "R": "Right Half", "S": "Sliding", "T": "Top", "U": "H.U.Display / Upper", "V": "Vin Notch / Hardware used for fitting",
    "W": "Hardware used for the fitting of glass", "X": "Alarm wire / Extra", "Y": "Specific for RHD (right hand drive) vehicles", "Z": "Encapsulation through Injection PU robot extrusion",
}
MOST_TRAITS = 5

#: The fields behind the type, by category: each may be absent, and they come in this order.
FIELDS = {c: ["tint", "top_tint", *{2: ["body"], 3: ["position"]}.get(c, [])] for c in CATEGORIES}
SYMBOLS = {"tint": TINTS, "top_tint": TOP_TINTS, "body": BODIES, "position": PLACES}


def transitions() -> list[tuple[str, str, str | None, str | None, str]]:
    """(state, symbol, feature, value, next state); an empty symbol takes nothing. States behind the type are field:category and trait:number."""
    rows: list[tuple[str, str, str | None, str | None, str]] = []
    for category, types in TYPES.items():
        chain = [*(f"{f}:{category}" for f in FIELDS[category]), "trait:1"]
        rows += [("type", symbol, "type", value, chain[0]) for symbol, value in types.items()]
        for state, after in zip(chain, chain[1:], strict=False):
            feature = state.partition(":")[0]
            rows += [(state, symbol, feature, value, after) for symbol, value in SYMBOLS[feature].items()] + [(state, "", None, None, after)]
    for n in range(1, MOST_TRAITS + 1):
        rows += [(f"trait:{n}", symbol, "trait", value, f"trait:{n + 1}" if n < MOST_TRAITS else "end") for symbol, value in TRAITS.items()]
    return rows


FOUND = "array<struct<feature:string,symbol:string,value:string>>"


def _table(rows: list[tuple[str, str, str | None, str | None, str]]) -> Column:
    """state -> symbol -> (feature, value, next) as one constant."""
    states: dict[str, dict[str, dict]] = {}
    for state, symbol, feature, value, after in rows:
        states.setdefault(state, {})[symbol] = {"feature": feature, "value": value, "next": after}
    return F.from_json(F.lit(json.dumps(states)), "map<string,map<string,struct<feature:string,value:string,next:string>>>")


def _let(x: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of x, which is computed once however often it is used."""
    return F.element_at(F.transform(F.array(x), then), 1)


def decoded(code: Column) -> Column:
    """What a code says: vehicle, category, glass_type, tint, top_tint, body, position, side, traits (codes and labels), error, at.

    At each state the longest symbol that fits is taken. error: null, "short" (fewer
    than five characters), "type" (no such type) or "rest" (characters that no state
    takes); `at` is the character, from 1, where it lies. Fields before an error are kept; a null
    code gives null.
    """
    table = _table(transitions())
    begin = F.struct(F.lit("type").alias("state"), F.lit(5).alias("at"), F.array().cast(FOUND).alias("found"))

    def step(s: Column, _: Column) -> Column:
        part = lambda n: F.substring(code, s["at"], F.lit(n))
        fits = lambda here, n: (F.length(part(n)) == n) & F.map_contains_key(here, part(n))
        symbol = lambda here: F.when(fits(here, 2), part(2)).when(fits(here, 1), part(1)).otherwise("")

        def moved(cell: Column) -> Column:
            taken = F.filter(F.array(F.struct(cell["c"]["feature"].alias("feature"), cell["s"].alias("symbol"), cell["c"]["value"].alias("value"))), lambda x: x["feature"].isNotNull())
            return F.struct(F.coalesce(cell["c"]["next"], F.lit("end")).alias("state"), (s["at"] + F.length(cell["s"])).alias("at"), F.concat(s["found"], taken.cast(FOUND)).alias("found"))

        here = F.coalesce(F.try_element_at(table, s["state"]), F.from_json(F.lit("{}"), "map<string,struct<feature:string,value:string,next:string>>"))
        return _let(here, lambda here: _let(symbol(here), lambda symbol: _let(F.struct(symbol.alias("s"), F.try_element_at(here, symbol).alias("c")), moved)))

    longest = 1 + max(map(len, FIELDS.values())) + MOST_TRAITS
    ended = F.aggregate(F.sequence(F.lit(1), F.lit(longest)), begin, step)
    categories = F.from_json(F.lit(json.dumps({t: CATEGORIES[c] for c, types in TYPES.items() for t in types})), "map<string,string>")

    def said(e: Column) -> Column:
        one = lambda feature, part="value": F.try_element_at(F.filter(e["found"], lambda x: x["feature"] == feature), F.lit(1))[part]
        traits = F.filter(e["found"], lambda x: x["feature"] == "trait")
        has = lambda t: F.exists(traits, lambda x: x["symbol"] == t)
        place = F.coalesce(one("position"), F.when(has("L"), "Left").when(has("R"), "Right"))
        side = F.when(F.lower(place).rlike("left|front|driver"), "driver").when(F.lower(place).rlike("right|rear|passenger"), "passenger")
        wrong = [(F.length(code) < 5, "short", F.length(code) + 1), (one("type").isNull(), "type", F.lit(5)), (e["at"] <= F.length(code), "rest", e["at"])]
        error, at = F.lit(None).cast("string"), F.lit(None).cast("int")
        for when, name, place_of in reversed(wrong):
            error, at = F.when(when, name).otherwise(error), F.when(when, place_of).otherwise(at)
        return F.struct(
            F.substring(code, 1, 4).alias("vehicle"), F.try_element_at(categories, one("type", "symbol")).alias("category"), one("type").alias("glass_type"), one("tint").alias("tint"), one("top_tint").alias("top_tint"),
            one("body").alias("body"), place.alias("position"), side.alias("side"), F.transform(traits, lambda x: x["symbol"]).alias("traits"), F.transform(traits, lambda x: x["value"]).alias("trait_labels"), error.alias("error"), at.alias("at"),
        )

    return F.when(code.isNotNull(), _let(ended, said))


def encoded(vehicle: Column, type_symbol: Column, *fields: Column, traits: Column) -> Column:
    """A code from symbols in their order; null fields are left out."""
    return F.concat(F.rpad(vehicle, 4, "0"), type_symbol, *(F.coalesce(f, F.lit("")) for f in fields), F.array_join(traits, ""))
