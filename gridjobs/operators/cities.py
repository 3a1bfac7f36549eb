"""The catalog of cities: building, searching, resolving names to boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridjobs.functions.grid import bbox_from_point
from gridjobs.functions.tables import few
from gridjobs.functions.text import city_key, slugify

#: Local names of six cities.
ALIASES = {"milano": "milan", "roma": "rome", "napoli": "naples", "torino": "turin", "firenze": "florence", "venezia": "venice"}


def city_catalog(places: DataFrame, countries: DataFrame, continent: str) -> DataFrame:
    """Places of a continent with their ids, by population, country and label."""
    some = places.join(few(countries.where(F.col("continent") == continent)), "country_code")
    value = F.concat_ws("_", slugify(F.concat_ws("_", "label", "country")), F.col("geonameid").cast("string"))
    return sort_catalog(some.select(value.alias("value"), "label", "country", "country_code", "lat", "lon", "population"))


def sort_catalog(cities: DataFrame) -> DataFrame:
    """By population, country and label; the id parts what is equal in these."""
    return cities.orderBy(F.desc("population"), "country", "label", "value")


def search_cities(cities: DataFrame, query: str, most: int = 200) -> DataFrame:
    found = cities.where(F.contains(F.lower(F.concat_ws(" ", "label", "country")), F.lit(query.lower())))
    return found.orderBy(F.desc("population"), "country", "label", "value").limit(most)


def resolve_city(queries: DataFrame, cities: DataFrame, half: float, accents: bool = True) -> DataFrame:
    """The most populous city that a name means (label, first token of the id, or label and country)
    and its box."""
    key = city_key("query", accents)
    names = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))
    asked = queries.withColumn("key", F.coalesce(F.try_element_at(names, key), key))
    first = F.element_at(F.split("value", "_"), 1)
    keys = F.array_distinct(F.array(city_key("label", accents), city_key(first, accents), city_key(F.concat_ws(" ", "label", "country"), accents)))
    known = cities.withColumn("key", F.explode(keys))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("population"), "country", "label", "value"))
    best = asked.join(known, "key").withColumn("_n", rank).where("_n = 1").drop("_n", "key")
    return best.withColumns(bbox_from_point("lat", "lon", half))
