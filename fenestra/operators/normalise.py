"""Brands and models as catalogues write them, by rules that are rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fenestra.functions import text
from fenestra.operators import phrases

# Words of model texts that name no model, and first words of descriptions that are none.
NOISE = [
    "LASTEVOGN", "LASTEBIL", "VAREBIL", "KASSEVOGN", "ST", "VOGN", "HATCHBACK", "STATIONWAGON", "STASJONSVOGN", "PICKUP", "AUTOMOBILES", "CARS", "VANS", "4D", "5D", "3D", "2D", "HBK", "SED", "CPE", "CAB", "WAG", "SW", "SUV",
    "AFMKT", "NO", "RAM", "SOFTTOP", "SOFT/TOP", "HARDTOP", "HARD/TOP",
]
NO_MODEL = [
    "FRONTR", "BAKR", "DØRR", "SIDER", "VENTIL", "VENTR", "FRO", "FR", "DR", "SR", "GRN", "GN", "GB", "YP", "HS", "VS", "CL", "NB", "EL", "ANT", "ALA", "INNK", "SOTET", "CROM", "SORT", "HUD", "LDW", "SENS", "DUGG", "SENSOR", "LAM",
    "INN", "UTG", "MÅL", "HØYDE", "TODELT", "MAX", "NB+", "GLASS", "SVERIGE",
]
# What a code in place of a brand looks like, short brands that are none, references to another article.
CODE_BRAND = r"^(DD|DW|DQ|FD|FQ|FV|FW|DL|DS|DT|DY)[0-9]|^[A-Z0-9]{5,}$"
SHORT_BRANDS = ["VW", "MG", "AC"]
REFERENCE = r"(?i)^(\+\+\+BRUK|(BRUK|USE|VED TOM|=) *W[0-9]+|=BRUK)"
UNKNOWN, ACCESSORY = "UNKNOWN", "TILBEHØR"


def brands(rows: DataFrame, aliases: DataFrame, known: DataFrame, *, brand: str, description: str, suppliers: list[str], no_vehicle: list[str]) -> DataFrame:
    """Rows with `normal_brand`.

    aliases (brand, context, normal): a brand means `normal` if its description has
    the phrase `context` (null: always), the one with a context first, then the longest, then by `normal`. Of
    brands that no alias explains: codes, other brands of one or two characters and
    suppliers' names give way to the first brand of `known` (phrase, brand) in the
    description, else they are UNKNOWN; names of no vehicle are accessories; others stay as they are.
    Work is done once for each distinct (brand, description).
    """
    each = rows.select(F.col(brand).alias("b_brand"), F.col(description).alias("b_text")).distinct()
    each = each.withColumn("b_key", F.sha2(F.concat(F.coalesce(F.concat(F.length("b_brand").cast("string"), F.lit(":"), "b_brand"), F.lit("-")), F.coalesce("b_text", F.lit(""))), 256)).withColumn("b_up", F.upper(F.trim("b_brand")))
    contexts = aliases.where("context IS NOT NULL").select("context").distinct().select(F.xxhash64("context").alias("rule"), F.col("context").alias("phrase"), F.lit(None).cast("string").alias("make"), F.col("context").alias("replacement"), F.lit(0).alias("priority"))
    spots = phrases.found(each, contexts, key="b_key", text="b_text").select("b_key", F.col("replacement").alias("context")).distinct()
    said = each.select("b_key", "b_up").join(aliases.withColumnRenamed("brand", "b_up"), "b_up")
    plain = said.where("context IS NULL").select("b_key", F.lit(0).alias("size"), "normal")
    meant = said.join(spots, ["b_key", "context"]).select("b_key", F.length("context").alias("size"), "normal").unionByName(plain)
    alias = meant.groupBy("b_key").agg(F.min(F.struct((-F.col("size")).alias("less"), "normal"))["normal"].alias("alias"))
    names = known.select(F.xxhash64("phrase", "brand").alias("rule"), "phrase", F.lit(None).cast("string").alias("make"), F.col("brand").alias("replacement"), F.lit(0).alias("priority"))
    first = phrases.found(each, names, key="b_key", text="b_text").groupBy("b_key").agg(F.min_by("replacement", "at").alias("first"))
    odd = F.col("b_up").rlike(CODE_BRAND) | ((F.length("b_up") <= 2) & ~F.col("b_up").isin(*SHORT_BRANDS)) | F.col("b_up").isin(*suppliers)
    found = F.when(F.coalesce("b_up", F.lit("")) == "", UNKNOWN).when(F.col("alias").isNotNull(), F.col("alias")).when(F.col("b_up").isin(*no_vehicle), ACCESSORY).when(odd, F.coalesce("first", F.lit(UNKNOWN))).otherwise(F.col("b_up"))
    done = each.join(alias, "b_key", "left").join(first, "b_key", "left").select("b_brand", "b_text", found.alias("normal_brand"))
    return rows.join(done, F.col(brand).eqNullSafe(F.col("b_brand")) & F.col(description).eqNullSafe(F.col("b_text")), "left").drop("b_brand", "b_text")


def without_brand(w: Column, brand: Column) -> Column:
    """Words without those of the brand at their beginning."""
    b = phrases.words(F.coalesce(brand, F.lit("")))
    return F.when((F.size(b) > 0) & (F.slice(w, 1, F.size(b)) == b), F.slice(w, F.size(b) + 1, F.size(w))).otherwise(w)


def models(rows: DataFrame, aliases: DataFrame, *, model: str, make: str, noise: list[str] = NOISE) -> DataFrame:
    """Rows with `normal_model`: entities decoded, the brand at the front gone, aliases applied, noise dropped.

    aliases (phrase, make, replacement, priority): the whole text written without
    spaces, else the whole text, else its first word, may be an alias; one of the row's
    make (null: any) goes before one of any make, then the higher priority.
    """
    distinct = rows.select(F.col(make).alias("m_make"), F.col(model).alias("m_model")).distinct()
    bare = distinct.select("m_make", "m_model", without_brand(phrases.words(text.entity_decoded(F.col("m_model"))), F.col("m_make")).alias("w"))
    forms = F.array(F.array_join("w", ""), F.array_join("w", " "), F.try_element_at("w", F.lit(1)))
    asked = bare.select("m_make", "m_model", "w", F.posexplode(forms).alias("form", "phrase")).where("phrase <> ''")
    own = aliases.select(F.array_join(phrases.words(F.col("phrase")), " ").alias("phrase"), F.col("make").alias("a_make"), "replacement", "priority")
    met = asked.join(own, "phrase").where(F.col("a_make").isNull() | (F.col("a_make") == F.col("m_make")))
    best = met.groupBy(F.col("m_make").alias("b_make"), F.col("m_model").alias("b_model")).agg(F.min(F.struct("form", F.col("a_make").isNull().alias("any"), (-F.col("priority")).alias("less"), "replacement")).alias("best"))
    known = bare.join(best, F.col("m_make").eqNullSafe(F.col("b_make")) & F.col("m_model").eqNullSafe(F.col("b_model")), "left")
    as_words = F.filter(F.split(F.coalesce("best.replacement", F.lit("")), " "), lambda x: x != "")
    after = F.when(F.col("best").isNull(), F.col("w")).when(F.col("best.form") < 2, as_words).otherwise(F.concat(as_words, F.slice("w", 2, F.size("w"))))
    done = known.select("m_make", "m_model", F.array_join(F.filter(after, lambda x: ~x.isin(*noise)), " ").alias("normal_model"))
    return rows.join(done, F.col(make).eqNullSafe(F.col("m_make")) & F.col(model).eqNullSafe(F.col("m_model")), "left").drop("m_make", "m_model")


def described_models(rows: DataFrame, known: DataFrame, *, description: str, make: str) -> DataFrame:
    """Rows with `model`, read from a description.

    known (phrase, make, priority): of the make's models that stand in the description the one with
    the highest priority; else the first word after the brand, if it may be a model's
    name; else null. References to another article have no model.
    """
    distinct = rows.select(F.col(make).alias("d_make"), F.col(description).alias("d_text")).distinct()
    distinct = distinct.withColumn("d_key", F.sha2(F.concat(F.coalesce(F.concat(F.length("d_make").cast("string"), F.lit(":"), "d_make"), F.lit("-")), F.coalesce("d_text", F.lit(""))), 256))
    rules = known.select(F.xxhash64("phrase", "make").alias("rule"), "phrase", "make", F.col("phrase").alias("replacement"), "priority")
    spots = phrases.found(distinct, rules, key="d_key", text="d_text", make="d_make").join(rules.select("rule", "priority"), "rule")
    best = spots.groupBy("d_key").agg(F.min(F.struct((-F.col("priority")).alias("less"), "replacement"))["replacement"].alias("listed"))
    word = F.try_element_at(without_brand(phrases.words(F.col("d_text")), F.col("d_make")), F.lit(1))
    free = F.when((F.length(word) > 1) & ~word.rlike(r"^\d{2}-\d{2}$") & ~word.isin(*NO_MODEL), word)
    done = distinct.join(best, "d_key", "left").select("d_make", "d_text", F.when(~F.trim("d_text").rlike(REFERENCE), F.coalesce("listed", free)).alias("model"))
    return rows.join(done, F.col(make).eqNullSafe(F.col("d_make")) & F.col(description).eqNullSafe(F.col("d_text")), "left").drop("d_make", "d_text")
