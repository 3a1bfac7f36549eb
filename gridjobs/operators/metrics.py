"""Predicted against observed values: continuous, presence and area metrics.

A row takes part if both values are present; for NDVI an observed zero counts as missing. All
metrics of a group come from one aggregation with map-side partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridjobs.functions.grid import flag_inside, inside
from gridjobs.functions.text import unit_name
from gridjobs.functions.values import EPS, col, finite, pct_error, ratio


def valid_pair(group="grp", variable="variable", predicted="predicted", observed="observed") -> Column:
    p, o = finite(predicted), finite(observed)
    ndvi = (col(group) == "vegetation") & (F.lower(col(variable)) == "ndvi")
    return F.coalesce(p.isNotNull() & o.isNotNull() & (~ndvi | (F.abs(o) > EPS)), F.lit(False))


def _aggregates(valid: Column, p: Column, o: Column) -> dict[str, Column]:
    on = lambda x: F.when(valid, x)
    d = p - o
    size = F.abs(p) + F.abs(o)
    pv, ov = on(p), on(o)
    spread = (F.max(pv) > F.min(pv)) & (F.max(ov) > F.min(ov))
    mean_o = F.abs(F.avg(ov))
    return {
        "cell_count": F.count(F.lit(1)),
        "valid_cell_count": F.count_if(valid),
        "predicted_mean": F.avg(pv),
        "observed_mean": F.avg(ov),
        "mae": F.avg(on(F.abs(d))),
        "rmse": F.sqrt(F.avg(on(d * d))),
        "bias": F.avg(on(d)),
        "correlation": F.when(spread, F.try_divide(F.covar_pop(pv, ov), F.stddev_pop(pv) * F.stddev_pop(ov))),
        "predicted_min": F.min(pv),
        "predicted_max": F.max(pv),
        "observed_min": F.min(ov),
        "observed_max": F.max(ov),
        "wape_pct": ratio(100.0 * F.sum(on(F.abs(d))), F.sum(on(F.abs(o))), EPS),
        "smape_pct": F.avg(on(F.when(size > EPS, 200.0 * F.abs(d) / size).otherwise(0.0))),
        "rmae_pct": ratio(100.0 * F.avg(on(F.abs(d))), mean_o, EPS),
        "cvrmse_pct": ratio(100.0 * F.sqrt(F.avg(on(d * d))), mean_o, EPS),
    }


def continuous_metrics(pairs: DataFrame, keys: list[str], predicted: str = "predicted", observed: str = "observed", valid: Column | None = None) -> DataFrame:
    """Counts, means, errors, correlation and extremes per group; no valid row gives counts and NULLs."""
    ok = valid_pair(predicted=predicted, observed=observed) if valid is None else valid
    told = _aggregates(ok, finite(predicted), finite(observed))
    return pairs.groupBy(*keys).agg(*(c.alias(n) for n, c in told.items()))


def plain_valid(predicted: str, observed: str) -> Column:
    return finite(predicted).isNotNull() & finite(observed).isNotNull()


def cell_metrics(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Per cell: percent errors and share of the map's WAPE, with the map's totals from one small join."""
    p, o, ok = finite("predicted"), finite("observed"), valid_pair()
    told = _aggregates(ok, p, o)
    totals = pairs.groupBy(*keys).agg(*(told[c].alias(c) for c in ("wape_pct", "rmae_pct", "cvrmse_pct")), F.sum(F.when(ok, F.abs(o))).alias("_sum"))
    rows = pairs.join(totals, keys)
    size, d = F.abs(p) + F.abs(o), F.abs(p - o)
    return rows.withColumns({
        "metric_valid": ok,
        "ape_pct": F.when(ok & (F.abs(o) > EPS), 100.0 * d / F.abs(o)),
        "cell_smape_pct": F.when(ok, F.when(size > EPS, 200.0 * d / size).otherwise(0.0)),
        "wape_contribution_pct": F.when(ok & (F.col("_sum") > EPS), 100.0 * d / F.col("_sum")),
    }).drop("_sum")


def presence_counts(threshold, predicted="predicted", observed="observed") -> dict[str, Column]:
    """Counts of presence: a value at or over the threshold; a missing one is absent."""
    p = F.coalesce(finite(predicted) >= threshold, F.lit(False))
    o = F.coalesce(finite(observed) >= threshold, F.lit(False))
    return {"tp": F.count_if(p & o), "fp": F.count_if(p & ~o), "fn": F.count_if(~p & o), "tn": F.count_if(~p & ~o)}


def scores(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Counts of presence and the scores from them."""
    return {
        "tp": tp, "fp": fp, "fn": fn, "tn": tn,
        "precision": F.try_divide(tp, tp + fp), "recall": F.try_divide(tp, tp + fn),
        "f1_score": F.try_divide(2 * tp, 2 * tp + fp + fn), "jaccard_similarity": F.try_divide(tp, tp + fp + fn),
        "sorensen_similarity": F.try_divide(2 * tp, 2 * tp + fp + fn), "accuracy": F.try_divide(tp + tn, tp + fp + fn + tn),
        "specificity": F.try_divide(tn, tn + fp),
    }


def binary_aggregates(threshold, predicted="predicted", observed="observed") -> dict[str, Column]:
    return scores(**presence_counts(threshold, predicted, observed))


def binary_scores(pairs: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    return pairs.groupBy(*keys).agg(*(c.alias(n) for n, c in binary_aggregates(threshold).items()))


RICHNESS = ("predicted_mean", "observed_mean", "mae", "rmse", "bias", "correlation", "wape_pct", "smape_pct", "rmae_pct", "cvrmse_pct", "cell_count")


def species_richness(pairs: DataFrame, keys: list[str], cell: list[str], thresholds=(0.1, 0.5)) -> DataFrame:
    """Per run and threshold: presence scores over species and cells, and metrics of richness per cell.

    Thresholds are columns of one aggregation per cell and one per run, not copies of the rows: the
    scores are sums of the cells' counts.
    """
    counts = {(k, n): c for k, t in enumerate(thresholds) for n, c in presence_counts(t).items()}
    by_cell = pairs.groupBy(*keys, *cell).agg(*(c.alias(f"{n}_{k}") for (k, n), c in counts.items()))
    told = []
    for k, t in enumerate(thresholds):
        p, o = ((F.col(f"tp_{k}") + F.col(f"{x}_{k}")).cast("double") for x in ("fp", "fn"))
        rich = _aggregates(F.lit(True), p, o)
        own = scores(*(F.sum(f"{n}_{k}") for n in ("tp", "fp", "fn", "tn")))
        told.append(F.struct(*(c.alias(n) for n, c in own.items()), *(rich[n].alias(f"richness_{n}") for n in RICHNESS), F.lit(float(t)).alias("threshold")))
    return by_cell.groupBy(*keys).agg(F.array(*told).alias("_r")).select(*keys, F.explode("_r").alias("_r")).select(*keys, "_r.*")


def species_matrix(pairs: DataFrame, keys: list[str], bounds, threshold: float = 0.5) -> DataFrame:
    """Per species, on the full grid and on the selected area: continuous metrics and presence scores.

    Both scopes and both kinds of metrics are columns of one aggregation.
    """
    within = F.coalesce(inside(bounds), F.lit(False))
    told = []
    for scope, some in (("full_grid", F.lit(True)), ("selected_area", within)):
        p, o = (F.when(some, finite(c)) for c in ("predicted", "observed"))
        ok = some & p.isNotNull() & o.isNotNull()
        over = {c: F.coalesce(v >= threshold, F.lit(False)) for c, v in (("p", p), ("o", o))}
        counts = (F.count_if(some & a & b) for a, b in ((over["p"], over["o"]), (over["p"], ~over["o"]), (~over["p"], over["o"]), (~over["p"], ~over["o"])))
        metrics = _aggregates(ok, p, o) | {"cell_count": F.count_if(some)}
        told.append(F.struct(F.lit(scope).alias("scope"), *(c.alias(n) for n, c in metrics.items()), *(c.alias(n) for n, c in scores(*counts).items())))
    return pairs.groupBy(*keys).agg(F.array(*told).alias("_r")).select(*keys, F.explode("_r").alias("_r")).select(*keys, "_r.*")


def cell_matrix(pairs: DataFrame, keys: list[str], variable: str, unit: str, bounds) -> DataFrame:
    """One variable's cells: predicted, observed, difference and absolute error in columns named after
    variable and unit, the percent columns of cell_metrics, and whether a cell lies in the area."""
    label = f"{variable}_{unit_name(unit)}"
    rows = flag_inside(cell_metrics(pairs.where(F.col("variable") == variable), keys), bounds)
    d = F.col("predicted") - F.col("observed")
    named = {"predicted": F.col("predicted"), "observed": F.col("observed"), "difference": d, "abs_error": F.abs(d)}
    percent = ("metric_valid", "ape_pct", "cell_smape_pct", "wape_contribution_pct", "wape_pct", "rmae_pct", "cvrmse_pct")
    return rows.select(*keys, F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), *(c.alias(f"{n}_{label}") for n, c in named.items()), "inside_selected_area", *percent)


def sort_metrics(metrics: DataFrame, nulls_first: bool = False) -> DataFrame:
    """By month, group, variable and level; missing values first in one report, last in the other."""
    order = F.asc_nulls_first if nulls_first else F.asc_nulls_last
    return metrics.orderBy(*(order(c) for c in ("forecast_month", "grp", "variable", "level")))


def species_proxy(pairs: DataFrame, keys: list[str], cell: list[str]) -> DataFrame:
    """Metrics of the per-cell sum of species values (missing if any is) and of two presence counts."""
    whole = lambda c: F.when(F.count(finite(c)) == F.count(F.lit(1)), F.sum(finite(c)))
    over = lambda c, t: F.count_if(F.coalesce(finite(c) >= t, F.lit(False))).cast("double")
    names = ("species_sum_proxy", "species_count_threshold_0_5", "species_count_threshold_0_1")
    measures = {c: (whole(c), over(c, 0.5), over(c, 0.1)) for c in ("predicted", "observed")}
    by_cell = pairs.groupBy(*keys, *cell).agg(F.array(*(F.struct(F.lit(n).alias("variable"), measures["predicted"][k].alias("predicted"), measures["observed"][k].alias("observed")) for k, n in enumerate(names))).alias("m"))
    rows = by_cell.select(*keys, F.explode("m").alias("m")).select(*keys, F.lit("species_proxy").alias("grp"), "m.*")
    return continuous_metrics(rows, [*keys, "grp", "variable"], valid=plain_valid("predicted", "observed"))


def variable_comparison(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Means skip missing values on each side alone; bias is their difference, errors use common rows."""
    p, o = finite("predicted"), finite("observed")
    d = p - o
    rows = pairs.groupBy(*keys, "grp", "variable").agg(F.avg(p).alias("predicted_mean"), F.avg(o).alias("observed_mean"), F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"))
    kelvin = pct_error(F.col("predicted_mean") + 273.15, F.col("observed_mean") + 273.15)
    error = F.when(F.col("variable") == "t2m", kelvin).otherwise(pct_error("predicted_mean", "observed_mean"))
    return rows.withColumn("bias", F.col("predicted_mean") - F.col("observed_mean")).withColumn("error_pct", error)


def group_comparison(pairs: DataFrame, keys: list[str]) -> DataFrame:
    rows = variable_comparison(pairs, keys)
    means = {"mean_predicted": "predicted_mean", "mean_observed": "observed_mean", "mean_bias": "bias", "mean_mae": "mae", "mean_rmse": "rmse", "mean_error_pct": "error_pct"}
    return rows.groupBy(*keys, "grp").agg(F.count("*").alias("variable_count"), *(F.avg(c).alias(n) for n, c in means.items()))


#: The four ways a predicted map may lie.
SCENARIOS = {"original": (False, False), "flip_lat": (True, False), "flip_lon": (False, True), "flip_both": (True, True)}


def alignment_scenarios(pairs: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    """Metrics with the prediction in each of four orientations.

    The cells that a map's turns exchange form an orbit, at most four places. One shuffle brings an orbit
    together, and each orbit yields its pairs of all four orientations; rows meet in no join.
    """
    one = [*keys, "grp", "variable"]
    i, j = F.col("lat_index"), F.col("lon_index")
    orbit = {"_i": F.least(i, height - 1 - i), "_j": F.least(j, width - 1 - j)}
    cells = pairs.select(*one, *(c.alias(n) for n, c in orbit.items()), F.struct(i.alias("i"), j.alias("j"), F.col("predicted").alias("p"), F.col("observed").alias("o")).alias("c"))
    cells = cells.groupBy(*one, "_i", "_j").agg(F.collect_list("c").alias("cs"))  # four rows, if a map has one for each cell
    turned = lambda x, lat, lon: ((height - 1 - x["i"]) if lat else x["i"], (width - 1 - x["j"]) if lon else x["j"])

    def paired(name: str, lat: bool, lon: bool) -> Column:
        def of(x):
            at_i, at_j = turned(x, lat, lon)
            there = F.filter("cs", lambda y: (y["i"] == at_i) & (y["j"] == at_j))
            return F.transform(there, lambda y: F.struct(F.lit(name).alias("scenario"), x["p"].alias("predicted"), y["o"].alias("observed")))

        return F.flatten(F.transform("cs", of))

    rows = cells.select(*one, F.explode(F.concat(*(paired(n, *t) for n, t in SCENARIOS.items()))).alias("r")).select(*one, "r.*")
    return continuous_metrics(rows, [*one, "scenario"])
