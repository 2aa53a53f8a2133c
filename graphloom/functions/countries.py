"""Country names and codes, from the Java runtime's own table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def countries(spark: SparkSession) -> DataFrame:
    """alias, name, iso2: each country by its English name, two- and three-letter code, in lower case; a few hundred rows."""
    locale = spark._jvm.java.util.Locale
    rows = []
    for code in locale.getISOCountries():
        one = locale("", code)
        name = one.getDisplayCountry(locale.ENGLISH)
        rows += [(alias.lower(), name, code) for alias in dict.fromkeys((name, code, one.getISO3Country()))]
    return spark.createDataFrame(rows, "alias string, name string, iso2 string")


def normalized_countries(rows: DataFrame, column: str, known: DataFrame) -> DataFrame:
    """rows with country_name and iso2 of a text column: an equal alias, else, for texts of more than three letters, the name that holds the text, the shortest first; else null."""
    t = F.lower(F.trim(F.col(column)))
    texts = rows.select(t.alias("_t")).where("_t <> ''").distinct()
    small = F.broadcast(known)  # a few hundred rows
    exact = texts.join(small, F.col("_t") == F.col("alias")).select("_t", F.lit(0).alias("_k"), "name", "iso2")
    names = F.broadcast(known.select("name", "iso2").distinct())
    near = texts.where(F.length("_t") > 3).join(names, F.lower("name").contains(F.col("_t"))).select("_t", (1 + F.length("name")).alias("_k"), "name", "iso2")
    best = exact.unionByName(near).groupBy("_t").agg(F.min_by(F.struct("name", "iso2"), F.struct("_k", "name")).alias("_c"))
    return rows.withColumn("_t0", t).join(best, F.col("_t0") == F.col("_t"), "left").select(*[rows[f"`{c}`"] for c in rows.columns], F.col("_c.name").alias("country_name"), F.col("_c.iso2").alias("iso2"))


def person_record(raw: Column) -> Column:
    """A person's row of a file, a map of strings, as a struct of what a person has: blanks collapsed, a status, a confidence."""
    clean = lambda k: F.trim(F.regexp_replace(raw[k], r"\s+", " "))
    name = F.trim(F.regexp_replace(F.coalesce(F.when(raw["full_name"] != "", raw["full_name"]), raw["name"]), r"\s+", " "))
    return F.struct(
        name.alias("label"), F.lit("person").alias("entity_type"), name.alias("full_name"), raw["date_of_birth"].alias("date_of_birth"), *[clean(k).alias(k) for k in ("nationality", "passport_number", "national_id")],
        F.lower(F.trim(F.coalesce(F.when(raw["status"] != "", raw["status"]), F.lit("active")))).alias("status"), F.coalesce(raw["confidence"].try_cast("double"), F.lit(1.0)).alias("confidence"),
    )
