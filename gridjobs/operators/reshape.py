"""Wide and long tables; columns are found by name on the driver, from the schema alone."""

from __future__ import annotations

import re
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridjobs.functions.grid import STEP, cell_keys, inside
from gridjobs.functions.months import MONTH_NAMES, month_number, month_start
from gridjobs.functions.values import number


def month_of_column(name: str, variable: str) -> date | None:
    """The month a column name tells: 06/2019, 2019_06, 201906 or a month's name beside the year.

    The variable may stand before or after, in any case, or be absent.
    """
    text = re.sub(re.escape(variable), " ", name, flags=re.IGNORECASE)
    for pattern, order in ((r"(?<!\d)(\d{1,2})\D(\d{4})(?!\d)", "my"), (r"(?<!\d)(\d{4})\D(\d{1,2})(?!\d)", "ym"), (r"(?<!\d)(\d{4})(\d{2})(?!\d)", "ym"), (r"(?<!\d)(\d{2})(\d{4})(?!\d)", "my")):
        if found := re.search(pattern, text):
            a, b = map(int, found.groups())
            month, year = (a, b) if order == "my" else (b, a)
            if 1 <= month <= 12:
                return date(year, month, 1)
    words = re.findall(r"[a-z]+|\d+", text.casefold())
    years = [int(w) for w in words if re.fullmatch(r"\d{4}", w)]
    months = [MONTH_NAMES[w] for w in words if w in MONTH_NAMES]
    return date(years[0], months[0], 1) if years and months else None


def find_monthly_column(columns: list[str], variable: str, month: date) -> str:
    """The first column of that month, those that name the variable first; KeyError names the month."""
    fits = [c for c in columns if month_of_column(c, variable) == month]
    named = [c for c in fits if variable.casefold() in c.casefold()]
    if not fits:
        raise KeyError(f"no column of {variable} for {month:%Y-%m}")
    return (named or fits)[0]


def monthly_wide_to_long(df: DataFrame, variable: str, keys: list[str], months: list[date] | None = None) -> DataFrame:
    """One row per key and month column; wanted months are chosen before anything is read."""
    chosen: dict[date, str] = {}
    for c in df.columns:
        m = month_of_column(c, variable) if c not in keys else None
        if m and variable.casefold() in c.casefold() and (months is None or m in months):
            chosen.setdefault(m, c)
    pairs = F.array(*(F.struct(F.lit(m).alias("month"), number(F.col(f"`{c}`")).alias("value")) for m, c in sorted(chosen.items())))
    return df.select(*keys, F.explode(pairs).alias("_r")).select(*keys, "_r.*")


def value_column(columns: list[str], variable: str) -> str:
    names = {c.strip().casefold(): c for c in columns}
    v = variable.casefold()
    for candidate in (v, "value", "mean", "mean_value", f"{v}_value", f"{v}_mean"):
        if candidate in names:
            return names[candidate]
    for c in columns:
        if v in c.casefold():
            return c
    raise KeyError(f"no value column for {variable}")


def monthly_long(df: DataFrame, variable: str, keys: list[str]) -> DataFrame:
    """The same output from Year and Month, a date, or a Month column."""
    names = {c.casefold(): c for c in df.columns}
    pick = lambda *ns: next((names[n] for n in ns if n in names), None)
    year, month, when = pick("year", "anno"), pick("month", "mese"), pick("timestamp", "date", "valid_time")
    if year and month:
        m = F.make_date(number(year).cast("int"), month_number(month), F.lit(1))
    elif when or month:
        m = month_start(F.col(when or month).try_cast("date"))
    else:
        raise KeyError("no date columns")
    return df.select(*keys, m.alias("month"), number(value_column([c for c in df.columns if c not in keys], variable)).alias("value"))


def year_columns(columns: list[str], prefix: str) -> dict[int, str]:
    found = {}
    for c in columns:
        if m := re.fullmatch(rf"{re.escape(prefix)}_?(\d{{4}})", c, re.IGNORECASE):
            found[int(m[1])] = c
    return dict(sorted(found.items()))


def yearly_wide_to_long(df: DataFrame, prefix: str, keys: list[str]) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(y).alias("year"), number(c).alias("value")) for y, c in year_columns(df.columns, prefix).items()))
    return df.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.*")


def long_to_yearly_wide(df: DataFrame, prefix: str, keys: list[str], years: list[int]) -> DataFrame:
    """One column per year; the years are given, so no extra job looks for them."""
    wide = df.groupBy(*keys).pivot("year", years).agg(F.first("value", ignorenulls=True))
    return wide.withColumnsRenamed({str(y): f"{prefix}_{y}" for y in years})


def group_wide(grid: DataFrame, keys: list[str], names: list[str], suffix: str = "_native") -> DataFrame:
    """One row per cell, one column per variable or level."""
    wide = grid.groupBy(*keys).pivot("name", names).agg(F.first("value", ignorenulls=True))
    return wide.withColumnsRenamed({n: f"{n}{suffix}" for n in names})


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def flatten(df: DataFrame) -> DataFrame:
    """Nested columns of rows as (row keys) key and value text with dotted keys, lists as JSON."""
    from pyspark.sql import types as T

    def leaves(schema, at):
        for f in schema.fields:
            name = f"{at}.{f.name}" if at else f.name
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, name)
            else:
                plain = F.col(name).cast("string") if not isinstance(f.dataType, (T.ArrayType, T.MapType)) else F.to_json(F.col(name))
                yield F.struct(F.lit(name).alias("key"), plain.alias("value"))

    return df.select(F.explode(F.array(*leaves(df.schema, ""))).alias("r")).select("r.*")


#: The variables of a forecast month and their columns.
FORECAST_COLUMNS = {
    "temperature": "temperature_mean_c", "ndvi": "ndvi_mean", "swvl1": "swvl1_mean", "swvl2": "swvl2_mean", "stl1": "stl1_mean", "stl2": "stl2_mean",
    "cropland": "cropland_mean", "arable": "arable_mean", "forest": "forest_mean",
}


def forecast_month_cells(layers: DataFrame, bounds, columns: dict[str, str] = FORECAST_COLUMNS) -> DataFrame:
    """All layers of each month side by side within a box, with cell id and weight.

    layers: month, variable, lat_i, lon_i, value. A cell is there if any layer has it; species counts
    are not forecast and stay missing.
    """
    wide = forecast_cells(layers.where(F.col("variable").isin(*columns)), list(columns)).withColumnsRenamed(columns)
    at = wide.withColumns({"latitude": F.round(F.col("lat_i") * STEP, 2), "longitude": F.round(F.col("lon_i") * STEP, 2)}).where(inside(bounds))
    return cell_keys(at).select("month", "latitude", "longitude", "cell_id", "latitude_weight", F.lit(None).cast("long").alias("species_count_observed_cell"), *columns.values())


def forecast_cells(layers: DataFrame, variables: list[str]) -> DataFrame:
    """Long layers of a month side by side: one shuffle on the cell instead of a join per layer."""
    return layers.groupBy("month", "lat_i", "lon_i").pivot("variable", variables).agg(F.first("value", ignorenulls=True))
