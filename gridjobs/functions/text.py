"""Names: slugs, unit tokens, accents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridjobs.functions.values import col


def slugify(c, default: str = "selected_area") -> Column:
    clean = F.trim(F.regexp_replace(F.lower(F.trim(col(c))), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(clean == "", default).otherwise(clean)


def unit_token(c) -> Column:
    text = F.lower(F.replace(F.replace(col(c), F.lit("°"), F.lit("")), F.lit("/"), F.lit("_per_")))
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", "_"), F.lit("_"))


def unit_name(unit: str) -> str:
    """unit_token of one known unit, for column names; nothing left is native."""
    import re

    return "_".join(re.findall("[a-z0-9]+", unit.replace("°", "").replace("/", "_per_").lower())) or "native"


def feature_label(prefix: str, variable, unit) -> Column:
    return F.concat_ws("_", F.lit(prefix), F.lower(col(variable)), unit_token(unit))


def strip_accents(c) -> Column:
    """NFKD without combining marks; there is no SQL function for it, and names are few once distinct."""

    @F.pandas_udf("string")
    def plain(s):
        import unicodedata

        def one(x):
            return None if x is None else "".join(ch for ch in unicodedata.normalize("NFKD", x) if not unicodedata.combining(ch))

        return s.map(one)

    return plain(col(c))


def city_key(c, accents: bool = True) -> Column:
    text = F.lower(F.trim(col(c)))
    text = strip_accents(text) if accents else text
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))


def split_list(c) -> Column:
    """Entries parted by commas or semicolons, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(col(c), "[,;]"), lambda x: F.trim(x)), lambda x: x != "")
