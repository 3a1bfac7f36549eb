"""Exact quantiles without a task that holds all values of a group.

Selection by histograms: counts and extremes of value ranges tell which bucket holds a rank, its range is
cut again, until the rows left are few or all alike. Only bucket counts are shuffled.
"""

from __future__ import annotations

from math import ceil, floor, inf, nan

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridjobs.functions.tables import FEW
from gridjobs.functions.values import col

#: Buckets that all ranges of one pass have together, least and most of one range.
BUCKETS, LEAST, MOST = 1 << 20, 16, 1 << 12
#: Rows of a range that are sorted in one task.
SORTED = 1 << 12


def bucket_of(v: Column, low: Column, high: Column, n: int) -> Column:
    """The bucket, from 0 to n - 1, of a finite number in [low, high]: by value, or by magnitude where the
    range goes over many of them. It never falls as v grows."""
    size = lambda x: F.signum(x) * F.when(x == 0, 0.0).otherwise(F.log2(F.abs(x)) + 1100.0)
    wide = F.greatest(F.abs(low), F.abs(high)) > 1e6 * F.greatest(F.least(F.abs(low), F.abs(high)), F.lit(1e-320))
    part = F.when(F.greatest(F.abs(low), F.abs(high)) > 1, 0.25).otherwise(1.0)  # differences of quarters never overflow
    share = lambda x, a, b: F.coalesce(F.try_divide(x * part - a * part, b * part - a * part), F.lit(0.0))
    at = F.when(wide, share(size(v), size(low), size(high))).otherwise(share(v, low, high))
    return F.greatest(F.least(F.floor(at * n), F.lit(n - 1)), F.lit(0)).cast("int")


def column_quantiles(df: DataFrame, columns: list[str], shares=(0.25, 0.5, 0.75), keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, column_name, q array<double>): quantiles of each column in each group, with linear
    interpolation; q is null for a group and column without values.

    Missing values are left out; -inf comes first, inf and then NaN last. Each pass reads the columns once
    and shuffles at most about 2^20 bucket counts; what the driver keeps is a few numbers for each group,
    column and share, of which there may be 100,000, else it raises ValueError (groups so many are small:
    median_of_group suits them).
    """
    spark = df.sparkSession
    one = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in columns)))
    rows = df.select(*keys, one.alias("x")).select(*keys, "x.*").where(F.col("v").isNotNull())
    odd = F.isnan("v") | (F.abs("v") == inf)
    finite = F.when(~odd, F.col("v"))
    by = [*keys, "column_name"]
    ends = rows.groupBy(*by).agg(F.count_if(F.col("v") == -inf).alias("under"), F.count(finite).alias("n"), F.count_if(F.col("v") == inf).alias("over"), F.count_if(F.isnan("v")).alias("none"), F.min(finite).alias("low"), F.max(finite).alias("high"))
    groups = ends.limit(FEW // len(shares) + 1).collect()
    if len(groups) > FEW // len(shares):
        raise ValueError("more groups than the driver keeps")

    # what rank is wanted where: a finite one is a rank of a range of its group
    known: dict[tuple[int, int], float] = {}
    left: dict[tuple[int, int], tuple[int, float, float, int]] = {}
    total = [g["under"] + g["n"] + g["over"] + g["none"] for g in groups]
    for k, g in enumerate(groups):
        for r in {int(f(s * (total[k] - 1))) for s in shares for f in (floor, ceil)}:
            at = r - g["under"]
            if 0 <= at < g["n"]:
                left[k, r] = (at, g["low"], g["high"], g["n"])
            else:
                known[k, r] = -inf if at < 0 else inf if at < g["n"] + g["over"] else nan
    fields = [f for f in ends.schema.fields if f.name in by]
    shape = T.StructType([*fields, T.StructField("range", T.IntegerType()), T.StructField("_low", T.DoubleType()), T.StructField("_high", T.DoubleType())])

    def in_ranges(wanted) -> tuple[DataFrame, list]:
        """Rows of the ranges that the wanted ranks are in, and the ranges."""
        ranges = sorted({(k, low, high) for (k, _), (_, low, high, _) in wanted.items()})
        table = spark.createDataFrame([(*(groups[k][c] for c in by), i, low, high) for i, (k, low, high) in enumerate(ranges)], shape)
        mine = rows.alias("r").join(F.broadcast(table).alias("t"), [F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}")) for c in by])
        return mine.where(F.col("v").between(F.col("_low"), F.col("_high"))).select("range", "v", "_low", "_high"), ranges

    def ranks_of(wanted, ranges) -> DataFrame:
        place = {x: i for i, x in enumerate(ranges)}
        return F.broadcast(spark.createDataFrame([(k, r, place[k, low, high], at) for (k, r), (at, low, high, _) in wanted.items()], "k int, r long, range int, at long"))

    while True:
        for key, (_, low, high, _) in list(left.items()):
            if low == high:
                known[key] = low
                del left[key]
        large = {key: x for key, x in left.items() if x[3] > SORTED}
        if not large:
            break
        mine, ranges = in_ranges(large)
        n = max(LEAST, min(MOST, BUCKETS // len(ranges)))
        counts = mine.groupBy("range", bucket_of(F.col("v"), F.col("_low"), F.col("_high"), n).alias("bucket")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = F.sum("n").over(Window.partitionBy("range").orderBy("bucket"))  # at most n rows
        counts = counts.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("n"))
        hit = counts.join(ranks_of(large, ranges), "range").where((F.col("at") >= F.col("before")) & (F.col("at") < F.col("upto")))
        for x in hit.collect():
            left[x["k"], x["r"]] = (x["at"] - x["before"], x["low"], x["high"], x["n"])
    if left:
        mine, ranges = in_ranges(left)
        lists = mine.groupBy("range").agg(F.sort_array(F.collect_list("v")).alias("vs"))  # at most SORTED rows
        for x in lists.join(ranks_of(left, ranges), "range").select("k", "r", F.element_at("vs", (F.col("at") + 1).cast("int")).alias("v")).collect():
            known[x["k"], x["r"]] = x["v"]

    def at_share(k: int, s: float) -> float:
        place = s * (total[k] - 1)
        a, b = known[k, floor(place)], known[k, ceil(place)]
        return a if a == b or floor(place) == place else a + (b - a) * (place - floor(place))

    found = T.StructType([*fields, T.StructField("q", T.ArrayType(T.DoubleType()))])
    return spark.createDataFrame([(*(g[c] for c in by), [float(at_share(k, s)) for s in shares]) for k, g in enumerate(groups)], found)


def median_exceeds(value, limit: float) -> Column:
    """Aggregate: whether the median of the present values is over the limit, null if there are none.

    The counts on both sides of the limit and the values next to it decide, so nothing is sorted.
    """
    v, n = col(value), F.count(col(value))
    under = F.count_if(v <= limit)
    middle = (F.max(F.when(v <= limit, v)) + F.min(F.when(v > limit, v))) / 2 > limit
    return F.when(n > 0, F.when(2 * under < n, True).when(2 * under == n, middle).otherwise(False))


def median_of_group(df: DataFrame, keys: list[str], value: str, name: str) -> tuple[DataFrame, Column]:
    """df with a column by which the returned aggregate, grouped by keys, is the median of value.

    For many groups of bounded size: a spillable sort by group, whose partitioning the aggregate keeps.
    """
    group = Window.partitionBy(*keys)
    place = F.row_number().over(group.orderBy(F.asc_nulls_last(value)))
    n = F.count(value).over(group)
    middle = (place == F.floor((n + 1) / 2)) | (place == F.floor((n + 2) / 2))
    return df.withColumn(name, middle), F.avg(F.when(F.col(name), F.col(value)))
