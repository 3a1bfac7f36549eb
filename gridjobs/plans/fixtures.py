"""Inputs of the registered queries, derived from the star-schema tables in SQL both engines read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

_MONTH = "CAST(date_trunc('month', {}) AS DATE)"

SQL = {
    "occ": """SELECT concat('sp_', CAST(l_partkey % 28 AS STRING)) AS species,
      CAST(3950 + (l_orderkey * 37 + l_linenumber * 11) % 200 AS DOUBLE) / CAST(100 AS DOUBLE) AS latitude,
      CAST((l_suppkey * 53 + l_orderkey * 7) % 240 - 450 AS DOUBLE) / CAST(100 AS DOUBLE) AS longitude, l_shipdate AS ts FROM {lineitem}""",
    "grid_base": f"""SELECT {_MONTH.format("o_orderdate")} AS month, CAST(160 + (o_custkey % 400 - o_custkey % 20) / 20 AS INT) AS lat_i, CAST(o_custkey % 20 AS INT) AS lon_i,
      avg(o_totalprice) AS price, min(o_orderkey) AS k FROM {{orders}} GROUP BY 1, 2, 3""",
    "grid_obs": """SELECT month, lat_i, lon_i, lat_i * CAST(0.25 AS DOUBLE) AS latitude, lon_i * CAST(0.25 AS DOUBLE) AS longitude,
      CASE WHEN k % 17 = 0 THEN NULL ELSE 260 + price / 10007 END AS t2m, CASE WHEN k % 19 = 0 THEN NULL ELSE price / CAST(100000007 AS DOUBLE) END AS avg_tprate, price / 1000003 AS tp,
      price / 500009 AS swvl1, CASE WHEN k % 11 = 0 THEN NULL ELSE price / 400009 END AS swvl2, 255 + price / 12007 AS stl1, 256 + price / 13007 AS stl2,
      CASE WHEN k % 7 = 0 THEN NULL ELSE price / 200003 END AS lai_hv, CASE WHEN k % 14 = 0 THEN NULL ELSE price / 300007 END AS lai_lv,
      CASE WHEN k % 3 = 0 THEN NULL ELSE price / 600011 END AS ndvi, CAST(CASE WHEN (lat_i * 20 + lon_i) % 5 = 0 THEN 0 ELSE 1 END AS DOUBLE) AS lsm FROM {grid_base}""",
    "grid_long": " UNION ALL ".join(f"SELECT month, lat_i, lon_i, latitude, longitude, '{g}' AS grp, '{v}' AS variable, {v} AS value FROM {{grid_obs}}" for g, v in (("climate", "t2m"), ("climate", "tp"), ("edaphic", "swvl1"), ("edaphic", "stl1"))),
    "pair_base": f"""SELECT {_MONTH.format("l_shipdate")} AS forecast_month, l_linenumber AS ln, CAST(l_suppkey % 25 AS INT) AS c, avg((l_quantity * 2 + l_discount * 20 - l_tax * 10) / 1.0037) AS predicted, avg(l_quantity * 2) AS quantity,
      min(l_orderkey) AS k FROM {{lineitem}} GROUP BY 1, 2, 3""",
    "pairs": """SELECT concat('run_', CAST(forecast_month AS STRING)) AS run_id, forecast_month, CASE ln WHEN 1 THEN 'climate' WHEN 2 THEN 'climate' WHEN 3 THEN 'land' WHEN 4 THEN 'vegetation' WHEN 5 THEN 'edaphic' WHEN 6 THEN 'atmospheric' ELSE 'agriculture' END AS grp,
      CASE ln WHEN 1 THEN 't2m' WHEN 2 THEN 'tp' WHEN 3 THEN 'Land' WHEN 4 THEN 'NDVI' WHEN 5 THEN 'swvl1' WHEN 6 THEN 'q' ELSE 'Cropland' END AS variable, CASE WHEN ln = 6 THEN 850 END AS level,
      CAST((c - c % 5) / 5 AS INT) AS lat_index, CAST(c % 5 AS INT) AS lon_index, CAST(160 + (c - c % 5) / 5 AS INT) AS lat_i, CAST(c % 5 AS INT) AS lon_i,
      40 + (c - c % 5) / 5 * CAST(0.25 AS DOUBLE) AS latitude, c % 5 * CAST(0.25 AS DOUBLE) AS longitude, predicted,
      CASE WHEN k % 17 = 0 THEN NULL WHEN ln = 3 THEN CAST(7 AS DOUBLE) WHEN k % 13 = 0 THEN CAST(0 AS DOUBLE) ELSE quantity END AS observed FROM {pair_base}""",
    "species_pairs": f"""SELECT {_MONTH.format("l_shipdate")} AS forecast_month, concat('sp_', CAST(l_partkey % 8 AS STRING)) AS species, CAST(l_suppkey % 4 AS INT) AS lat_index, CAST(l_linenumber % 2 AS INT) AS lon_index,
      avg(l_discount * 10 / 1.0037) AS predicted, CASE WHEN min(l_orderkey) % 23 = 0 THEN NULL ELSE avg(l_tax * 12.5 / 1.0041) END AS observed FROM {{lineitem}} GROUP BY 1, 2, 3, 4""",
    "land_long": """SELECT CAST(160 + (l_partkey % 400 - l_partkey % 20) / 20 AS INT) * CAST(0.25 AS DOUBLE) AS latitude, CAST(l_partkey % 20 AS INT) * CAST(0.25 AS DOUBLE) AS longitude,
      CAST(160 + (l_partkey % 400 - l_partkey % 20) / 20 AS INT) AS lat_i, CAST(l_partkey % 20 AS INT) AS lon_i,
      CASE l_linenumber % 3 WHEN 0 THEN 'Agriculture' WHEN 1 THEN 'Arable' ELSE 'Cropland' END AS variable, CAST(year(l_shipdate) AS INT) AS year,
      CASE WHEN min(l_orderkey) % 29 = 0 THEN NULL ELSE avg(l_quantity) END AS value FROM {lineitem} WHERE year(l_shipdate) <> 1998 GROUP BY 1, 2, 3, 4, 5, 6""",
    "pixels": """SELECT CAST(l_suppkey % 4 AS INT) AS tile_seq, 40 + CAST(l_orderkey % 80 AS DOUBLE) / 40 AS latitude, CAST(l_partkey % 80 AS DOUBLE) / 40 AS longitude,
      CASE l_linenumber WHEN 1 THEN 1110 WHEN 2 THEN 2100 WHEN 3 THEN 3200 WHEN 4 THEN 4100 WHEN 5 THEN 1210 WHEN 6 THEN 5000 END AS code, l_quantity * 3 - 20 AS value, CAST(10 AS DOUBLE) AS nodata FROM {lineitem}""",
    "areas": """SELECT s_name AS area_label, s_suppkey AS seq, 40 + s_suppkey % 10 * CAST(0.2 AS DOUBLE) AS min_lat, 40 + s_suppkey % 10 * CAST(0.2 AS DOUBLE) + s_suppkey % 3 * CAST(0.25 AS DOUBLE) + CAST(0.05 AS DOUBLE) AS max_lat,
      s_suppkey % 7 * CAST(0.2 AS DOUBLE) AS min_lon, s_suppkey % 7 * CAST(0.2 AS DOUBLE) + CAST(0.3 AS DOUBLE) AS max_lon FROM {supplier}""",
    "cities": """SELECT concat('city_', CAST(c_custkey AS STRING)) AS value, concat('City ', CAST(c_custkey % 300 AS STRING)) AS label, n_name AS country, CAST(n_nationkey AS STRING) AS country_code, r_name AS continent, c_custkey AS geonameid,
      40 + CAST(c_custkey % 40 AS DOUBLE) / 4 AS lat, CAST(c_custkey % 60 AS DOUBLE) / 4 AS lon, CAST(floor(c_acctbal) AS BIGINT) + 2000 AS population
      FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "runs": f"""SELECT concat('run_', CAST(o_custkey AS STRING), CASE WHEN o_orderkey % 3 = 0 THEN ' 4' ELSE '' END) AS run_id, {_MONTH.format("o_orderdate")} AS forecast_month, CASE WHEN o_orderkey % 2 = 0 THEN 'small' ELSE 'large' END AS checkpoint,
      CASE WHEN o_custkey % 4 = 0 THEN 'clean' ELSE 'all' END AS input_mode, o_custkey % 5 = 0 AS atmosphere, concat('p/', CAST(o_orderkey AS STRING)) AS path, o_totalprice AS price, o_orderkey AS seq FROM {{orders}}""",
    "cases": """SELECT concat('city_', CAST(o_custkey % 15 AS STRING)) AS city, o_orderkey AS case_id, o_totalprice / 20011 AS temperature_predicted_c, o_totalprice / 20011 + (o_orderkey % 7 - 3) AS temperature_observed_c,
      o_totalprice / 5003 AS precipitation_predicted_mm, CASE WHEN o_orderkey % 9 = 0 THEN CAST(0 AS DOUBLE) ELSE o_totalprice / 5003 * (1 + (o_orderkey % 5) / CAST(50 AS DOUBLE)) END AS precipitation_observed_mm,
      CAST(o_custkey % 9 AS DOUBLE) AS species_predicted_proxy, CAST(o_custkey % 9 + o_orderkey % 2 AS DOUBLE) AS species_observed_proxy FROM {orders}""",
    # every seventh month of a source is in the archive instead, so whole months of sources are missing
    "sources": f"""SELECT CASE kind WHEN 0 THEN 'temperature' WHEN 1 THEN 'precipitation' WHEN 2 THEN 'soil' WHEN 3 THEN 'species' WHEN 4 THEN 'ndvi' ELSE 'archive' END AS source, month, kind AS priority, value
      FROM (SELECT CAST(CASE WHEN (year(o_orderdate) * 12 + month(o_orderdate) + o_custkey % 5 * 3) % 7 = 0 THEN 5 ELSE o_custkey % 5 END AS INT) AS kind, {_MONTH.format("o_orderdate")} AS month,
        CASE WHEN o_orderkey % 3 = 0 THEN CAST(0 AS DOUBLE) ELSE o_totalprice / 1000 END AS value FROM {{orders}}) AS _s""",
    "months": f"SELECT DISTINCT {_MONTH.format('o_orderdate')} AS month FROM {{orders}}",
    "area_series": f"""SELECT concat('area_', CAST(o_custkey % 10 AS STRING)) AS area, {_MONTH.format("o_orderdate")} AS month, CASE WHEN min(o_orderkey) % 5 = 0 THEN NULL ELSE avg(o_totalprice) / 10007 END AS t, avg(o_totalprice) / 12007 AS stl1, max(o_totalprice) / 20011 AS stl2,
      min(o_totalprice) / 10007 AS swvl1, CASE WHEN min(o_orderkey) % 4 = 0 THEN NULL ELSE avg(o_totalprice) / 9001 END AS swvl2, avg(o_totalprice) / 300007 AS ndvi, max(o_totalprice) / 30011 AS forest, avg(o_totalprice) / 40009 AS arable, avg(o_totalprice) / 50021 AS cropland
      FROM {{orders}} GROUP BY 1, 2""",
}


class Fixtures:
    """Lazily built inputs of one (spark, sf_dir)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in SQL:
            raise AttributeError(name)
        if name not in self.made:
            text = SQL[name]
            self.made[name] = self.spark.sql(text, **{n: getattr(self, n) for n in set(re.findall(r"\{(\w+)\}", text))})
        return self.made[name]


def duckdb(text: str) -> str:
    """The query with the inputs it names in braces as common table expressions."""
    order: list[str] = []

    def visit(t: str):
        for n in re.findall(r"\{(\w+)\}", t):
            if n in SQL and n not in order:
                visit(SQL[n])
                order.append(n)

    visit(text)
    plain = lambda t: re.sub(r"\{(\w+)\}", r"\1", t)
    ctes = [f"{n} AS ({plain(SQL[n])})" for n in order]
    return (f"WITH {', '.join(ctes)} " if ctes else "") + plain(text)
