"""Months: first-of-month dates, labels, sequences, forecast windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridjobs.functions.values import col

#: Names of months that tables use.
MONTH_NAMES = {
    "jan": 1, "january": 1, "gen": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4, "april": 4, "may": 5, "mag": 5,
    "jun": 6, "june": 6, "jul": 7, "july": 7, "aug": 8, "august": 8, "sep": 9, "sept": 9, "september": 9,
    "oct": 10, "october": 10, "nov": 11, "november": 11, "dec": 12, "december": 12,
}


def month_start(c) -> Column:
    return F.trunc(col(c).cast("date"), "MM")


def month_label(c) -> Column:
    return F.date_format(col(c), "yyyy-MM")


def days_in_month(c) -> Column:
    return F.dayofmonth(F.last_day(col(c)))


def month_number(c) -> Column:
    """1..12 from a number, digits or a month's name or first three letters."""
    text = F.lower(F.trim(col(c).cast("string")))
    names = F.create_map(*(F.lit(x) for pair in MONTH_NAMES.items() for x in pair))
    digits = F.when(text.rlike(r"^-?\d+(\.\d+)?$"), text.try_cast("double").cast("int"))
    named = F.coalesce(F.try_element_at(names, text), F.try_element_at(names, F.substring(text, 1, 3)))
    return F.when(digits.isNotNull(), F.when(digits.between(1, 12), digits)).otherwise(named)


def filter_months(df: DataFrame, start: str, end: str, max_steps: int | None = None, month: str = "month") -> DataFrame:
    """Inclusive range of months; optionally only the first so many distinct months that have rows."""
    some = df.where(F.col(month).between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    if max_steps is None:
        return some
    first = some.select(month).distinct().orderBy(month).limit(max_steps)
    return some.join(F.broadcast(first), month, "left_semi")


def month_sequence(df: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """One row per month from start to end, inclusive."""
    return df.withColumn("month", F.explode(F.sequence(month_start(start), month_start(end), F.expr("interval 1 month"))))


def two_month_windows(months: DataFrame, last: str = "last_month", keys: tuple[str, ...] = ()) -> DataFrame:
    """Inputs (t - 1, t), target t + 1, for consecutive months t up to the last available one."""
    before = F.lag("month").over(Window.partitionBy(*(keys or (F.lit(0),))).orderBy("month"))
    rows = months.withColumn("previous", before).where((F.col("previous") == F.add_months("month", -1)) & (F.col("month") <= F.col(last)))
    return rows.withColumn("target", F.add_months("month", 1)).withColumn("compare_available", F.col("target") <= F.col(last))


def forecast_month(start, end, last) -> dict[str, Column]:
    """Forecast month of an input period: the one after its end, and whether it can be compared."""
    target = F.add_months(month_start(end), 1)
    valid = (month_start(start) < month_start(end)) & (month_start(end) <= month_start(last))
    return {"forecast_month": F.when(valid, target), "compare_available": F.coalesce(valid & (target <= month_start(last)), F.lit(False))}


def months_missing(required: DataFrame, available: DataFrame, keys=("source", "month")) -> DataFrame:
    """Required months without data."""
    return required.join(available.select(*keys).distinct(), list(keys), "left_anti")


def months_available(targets: DataFrame, published: DataFrame, keys=("month",)) -> DataFrame:
    return targets.join(published.select(*keys).distinct(), list(keys), "left_semi")


def covers_months(table: DataFrame, requests: DataFrame) -> DataFrame:
    """Whether a source's latest month reaches the last requested one; unknown sources do not."""
    latest = table.groupBy("source").agg(F.max("month").alias("latest"))
    return requests.join(latest, "source", "left").withColumn("covered", F.coalesce(F.col("last_month") <= F.col("latest"), F.lit(False)))
