"""Covariate, feature, validation and forecast queries on a monthly order panel."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.expanding import block_rows, cross_predict_expanding, expanding_fills, fold_fills
from tidemark.operators.features import (
    calendar_features,
    feature_columns,
    lag_features,
    panel_features,
    usable_rows,
)
from tidemark.operators.fill import fill_in_order
from tidemark.operators.folds import expanding_folds, history_gate
from tidemark.operators.forecast import (
    annual_forecast,
    fold_forecast,
    future_stub,
    recent_history,
    with_year_month,
)
from tidemark.operators.importance import permutation_importance
from tidemark.operators.joins import stack_frames
from tidemark.operators.families import TREE_CANDIDATES, TREE_TYPE, cross_predict
from tidemark.operators.linear import LINEAR_CANDIDATES, linear_prediction
from tidemark.operators.permute import DIGITS
from tidemark.operators.preprocess import FeatureSet, apply_preprocessor, fit_preprocessor
from tidemark.operators.rollup import monthly_rollup
from tidemark.operators.selection import (
    best_models,
    best_per_group,
    fold_metrics,
    mean_metrics,
    top_per_group,
)
from tidemark.operators.series import economic_features, pct_change, pivot_series, zscores
from tidemark.plans.enrichment import enrich_panel, with_date, with_event_flags
from tidemark.plans.forecasting import ForecastSpec, PanelForecast
from tidemark.plans.reports import actual_and_forecast
from tidemark.session import keep_table, shared_folder
from tidemark.sources.exports import read_table_csv
from tidemark.sources.observations import name_series
from workloads.base import Register, fixed, fixed_all, sql_fixed, table

register = Register()

SERIES, DATE, TARGET = "series", "date", "n_orders"

# The month panel: one row per order priority and month.
PANEL_SQL = """
    m AS (SELECT o_orderpriority AS series, CAST(date_trunc('month', o_orderdate) AS DATE) AS date,
                 count(o_orderkey) AS n_orders, sum(o_totalprice) AS total, avg(o_totalprice) AS mean_price
          FROM orders GROUP BY ALL)
"""


def month_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = monthly_rollup(
        table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", SERIES),
        "o_orderdate",
        [SERIES],
        counts={TARGET: "o_orderkey"},
        sums={"total": "o_totalprice"},
        means={"mean_price": "o_totalprice"},
    )
    return rolled.withColumnRenamed("year_month", DATE).select(SERIES, DATE, TARGET, "total", "mean_price")


# Covariates -----------------------------------------------------------------

NAMES = {
    "consumer_sentiment": "1-URGENT",
    "unemployment_rate": "2-HIGH",
    "cpi": "3-MEDIUM",
    "gas_price": "5-LOW",
}


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order prices as observations of named series (one priority stays unnamed)."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("series_id"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.col("o_totalprice").alias("value"),
    )
    return name_series(orders, NAMES)


PIVOT_SQL = (
    """
    w AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
                 CAST(date_trunc('month', o_orderdate) AS DATE) AS year_month,
"""
    + ", ".join(f"avg(o_totalprice) FILTER (o_orderpriority = '{i}') AS {n}" for n, i in NAMES.items())
    + " FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED' GROUP BY ALL)"
)


@register.add(
    "series_pivot",
    f"WITH {PIVOT_SQL} SELECT year, month, year_month, "
    + ", ".join(f"{sql_fixed(n, 4)} AS {n}" for n in NAMES)
    + " FROM w",
)
def pivoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixed_all(pivot_series(observations(spark, sf_dir), list(NAMES)), *NAMES, digits=4)


ECONOMIC_SQL = f"""
    {PIVOT_SQL},
    y AS (SELECT *, (cpi / lag(cpi, 12) OVER (ORDER BY year, month) - 1) * 100 AS cpi_yoy_pct FROM w),
    s AS (SELECT *, (gas_price - avg(gas_price) OVER ()) / stddev_samp(gas_price) OVER () AS gas_price_z,
                 (cpi_yoy_pct - avg(cpi_yoy_pct) OVER ()) / stddev_samp(cpi_yoy_pct) OVER () AS cpi_yoy_pct_z,
                 (unemployment_rate - avg(unemployment_rate) OVER ()) / stddev_samp(unemployment_rate) OVER ()
                     AS unemployment_rate_z,
                 (consumer_sentiment - avg(consumer_sentiment) OVER ()) / stddev_samp(consumer_sentiment) OVER ()
                     AS consumer_sentiment_z
          FROM y),
    e AS (SELECT *, gas_price_z + cpi_yoy_pct_z + unemployment_rate_z - consumer_sentiment_z
                     AS economic_pressure_index FROM s)
"""
DERIVED = (
    *NAMES,
    "cpi_yoy_pct",
    "gas_price_z",
    "cpi_yoy_pct_z",
    "unemployment_rate_z",
    "consumer_sentiment_z",
    "economic_pressure_index",
)


@register.add(
    "pressure_index",
    f"WITH {ECONOMIC_SQL} SELECT year, month, year_month, "
    + ", ".join(f"{sql_fixed(n)} AS {n}" for n in DERIVED)
    + " FROM e",
)
def economics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixed_all(economic_features(observations(spark, sf_dir), list(NAMES)), *DERIVED)


@register.add(
    "yoy_pct",
    f"""
    WITH {PANEL_SQL}
    SELECT series, date, {sql_fixed("(total / lag(total, 12) OVER (PARTITION BY series ORDER BY date) - 1) * 100")}
               AS total_yoy_pct FROM m
    """,
)
def yearly_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = pct_change(month_panel(spark, sf_dir), "total", [DATE], keys=[SERIES])
    return fixed_all(changed.select(SERIES, DATE, "total_yoy_pct"), "total_yoy_pct")


@register.add(
    "zscore",
    f"""
    SELECT l_orderkey, l_linenumber, l_partkey,
           {sql_fixed("(l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_samp(l_extendedprice) OVER ()")}
               AS l_extendedprice_z,
           CASE WHEN stddev_samp(flat) OVER () = 0 THEN 0.0::DOUBLE END AS flat_z
    FROM (SELECT *, 1.0::DOUBLE AS flat FROM lineitem)
    """,
)
def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("flat", F.lit(1.0))
    out = zscores(rows, ["l_extendedprice", "flat"])
    keep = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice_z", "flat_z"]
    return fixed_all(out.select(*keep), "l_extendedprice_z")


@register.add(
    "ffill_bfill",
    """
    WITH c AS (SELECT c_custkey, c_nationkey, CASE WHEN c_acctbal >= 3000 THEN c_acctbal END AS balance,
                      CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_mktsegment END AS segment FROM customer)
    SELECT c_custkey, c_nationkey,
           coalesce(last_value(balance IGNORE NULLS) OVER f, first_value(balance IGNORE NULLS) OVER b) AS balance,
           coalesce(last_value(segment IGNORE NULLS) OVER f, first_value(segment IGNORE NULLS) OVER b) AS segment
    FROM c
    WINDOW f AS (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
           b AS (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    """,
)
def filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select(
        "c_custkey",
        "c_nationkey",
        F.when(F.col("c_acctbal") >= 3000, F.col("c_acctbal")).alias("balance"),
        F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment")).alias("segment"),
    )
    return fill_in_order(customer, ["balance", "segment"], "c_custkey", ["c_nationkey"])


@register.add(
    "ffill_whole_table",
    """
    SELECT o_orderkey,
           coalesce(last_value(p IGNORE NULLS) OVER (ORDER BY o_orderdate, o_orderkey
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                    first_value(p IGNORE NULLS) OVER (ORDER BY o_orderdate, o_orderkey
                        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS price
    FROM (SELECT *, CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS p FROM orders)
    """,
)
def filled_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderdate", F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")).alias("price")
    )
    return fill_in_order(orders, ["price"], "o_orderdate", tie=["o_orderkey"]).select("o_orderkey", "price")


CLOSED, LOST = ("1997-03-01", "1998-02-28"), "1999-08-01"
FLAGS_SQL = f"""CAST(date BETWEEN DATE '{CLOSED[0]}' AND DATE '{CLOSED[1]}' AS INTEGER) AS covid_flag,
                CAST(date >= DATE '{LOST}' AS INTEGER) AS cms_loss_flag"""


@register.add("event_flags", f"WITH {PANEL_SQL} SELECT series, date, {FLAGS_SQL} FROM m")
def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = with_date(month_panel(spark, sf_dir).select(SERIES, DATE))
    return with_event_flags(panel, DATE, CLOSED, LOST)


@register.add(
    "enrich_panel",
    f"""
    WITH {PANEL_SQL}, {ECONOMIC_SQL},
    l AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, arg_min(o_orderpriority, (-n, o_orderpriority)) AS label
          FROM (SELECT o_orderdate, o_orderpriority, count(*) OVER (PARTITION BY year(o_orderdate), o_orderpriority) AS n
                FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1999 AND year(o_orderdate) <> 1998)
          GROUP BY 1),
    j AS (SELECT series, date, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, n_orders, label
          FROM m LEFT JOIN l ON year(date) = l.year)
    SELECT series, year, month, n_orders, date, {FLAGS_SQL},
           coalesce(last_value(label IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                    first_value(label IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
               AS label,
           {sql_fixed("cpi", 4)} AS cpi, {sql_fixed("economic_pressure_index")} AS economic_pressure_index
    FROM j LEFT JOIN e USING (year, month)
    """,
)
def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel plus flags, a label known for some years only, and covariates."""
    panel = month_panel(spark, sf_dir).select(
        SERIES, F.year(DATE).alias("year"), F.month(DATE).alias("month"), TARGET
    )
    counts = (
        table(spark, sf_dir, "orders")
        .groupBy(F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("label"))
        .agg((-F.count(F.lit(1))).alias("less"))
    )
    known = counts.filter(F.col("year").isin(1996, 1997, 1999))
    labels = best_per_group(known, ["year"], ["less", "label"]).drop("less")
    full = enrich_panel(
        panel,
        labels,
        economic_features(observations(spark, sf_dir), list(NAMES)),
        "label",
        ["cpi", "economic_pressure_index"],
        closure=CLOSED,
        loss=LOST,
    )
    return full.withColumns(
        {"cpi": fixed(F.col("cpi"), 4), "economic_pressure_index": fixed(F.col("economic_pressure_index"))}
    )


# Features and folds ----------------------------------------------------------

CALENDAR_SQL = f"""
    CAST(year(date) AS INTEGER) AS year_num, CAST(month(date) AS INTEGER) AS month_num,
    CAST(quarter(date) AS INTEGER) AS quarter,
    {sql_fixed("sin(2 * pi() * month(date) / 12)")} AS month_sin, {sql_fixed("cos(2 * pi() * month(date) / 12)")} AS month_cos,
    {sql_fixed("sin(2 * pi() * quarter(date) / 4)")} AS quarter_sin,
    {sql_fixed("cos(2 * pi() * quarter(date) / 4)")} AS quarter_cos,
    CAST(month(date) IN (12, 1, 2) AS INTEGER) AS is_winter, CAST(month(date) IN (3, 4, 5) AS INTEGER) AS is_spring,
    CAST(month(date) IN (6, 7, 8) AS INTEGER) AS is_summer, CAST(month(date) IN (9, 10, 11) AS INTEGER) AS is_fall
"""
CYCLES = ("month_sin", "month_cos", "quarter_sin", "quarter_cos")


@register.add("calendar_features", f"WITH {PANEL_SQL} SELECT series, date, {CALENDAR_SQL} FROM m")
def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixed_all(calendar_features(month_panel(spark, sf_dir).select(SERIES, DATE), DATE), *CYCLES)


LAG_NAMES = [f"{TARGET}_lag_{k}" for k in (1, 2, 3, 12)]
ROLL_NAMES = [f"{TARGET}_roll_mean_{w}" for w in (3, 12)]
DIFF_NAME = f"{TARGET}_seasonal_diff"
LAG_SQL = ", ".join(
    [f"lag(n_orders, {k}) OVER o AS n_orders_lag_{k}" for k in (1, 2, 3, 12)]
    + [
        f"CASE WHEN count(n_orders) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING) = {w}"
        f" THEN avg(n_orders) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING) END"
        f" AS n_orders_roll_mean_{w}"
        for w in (3, 12)
    ]
    + ["n_orders - lag(n_orders, 12) OVER o AS n_orders_seasonal_diff"]
)
FEATURES_SQL = f"{PANEL_SQL}, f AS (SELECT *, {LAG_SQL} FROM m WINDOW o AS (PARTITION BY series ORDER BY date))"


@register.add(
    "lag_features",
    f"""
    WITH {FEATURES_SQL}
    SELECT series, date, n_orders, {", ".join(LAG_NAMES)}, n_orders_seasonal_diff,
           {", ".join(f"{sql_fixed(n)} AS {n}" for n in ROLL_NAMES)} FROM f
    """,
)
def lagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = month_panel(spark, sf_dir).select(SERIES, DATE, TARGET)
    return fixed_all(lag_features(panel, SERIES, DATE, TARGET), *ROLL_NAMES)


# Months that a series skips, and months with two rows.
SKIPPED_SQL = f"""
    {PANEL_SQL},
    k AS (SELECT series, date, n_orders, CAST(year(date) * 12 + month(date) AS INTEGER) AS t FROM m
          WHERE (year(date) * 12 + month(date)) % 11 <> 4),
    g AS (SELECT * FROM k UNION ALL SELECT series, CAST(date + INTERVAL 9 DAY AS DATE), n_orders + 5, t FROM k WHERE t % 13 = 0),
    a AS (SELECT series, t, avg(n_orders) AS v FROM g GROUP BY ALL)
"""


@register.add(
    "calendar_lags",
    f"""
    WITH {SKIPPED_SQL}
    SELECT g.series, g.date, g.n_orders,
           {", ".join(f"{sql_fixed(f'max(a.v) FILTER (a.t = g.t - {k})')} AS n_orders_lag_{k}" for k in (1, 2, 3, 12))},
           {", ".join(
               f"CASE WHEN count(a.v) FILTER (a.t >= g.t - {w}) = {w} THEN "
               + sql_fixed(f"avg(a.v) FILTER (a.t >= g.t - {w})") + f" END AS n_orders_roll_mean_{w}"
               for w in (3, 12)
           )},
           {sql_fixed("g.n_orders - max(a.v) FILTER (a.t = g.t - 12)")} AS n_orders_seasonal_diff
    FROM g LEFT JOIN a ON a.series = g.series AND a.t BETWEEN g.t - 12 AND g.t - 1
    GROUP BY g.series, g.date, g.n_orders, g.t
    """,
)
def calendar_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lags by calendar month of series that skip months and have months with two rows."""
    t = F.year(DATE) * 12 + F.month(DATE)
    panel = month_panel(spark, sf_dir).select(SERIES, DATE, TARGET).filter(t % 11 != 4)
    twice = panel.filter(t % 13 == 0).select(SERIES, F.date_add(DATE, 9).alias(DATE), (F.col(TARGET) + 5).alias(TARGET))
    out = lag_features(panel.union(twice), SERIES, DATE, TARGET, calendar=True)
    return fixed_all(out, *LAG_NAMES, *ROLL_NAMES, "n_orders_seasonal_diff")


@register.add(
    "usable_rows",
    f"""
    WITH {FEATURES_SQL}
    SELECT series, date, n_orders, {sql_fixed("total", 2)} AS total, {sql_fixed("mean_price")} AS mean_price,
           {CALENDAR_SQL}, {", ".join(LAG_NAMES)}, n_orders_seasonal_diff,
           {", ".join(f"{sql_fixed(n)} AS {n}" for n in ROLL_NAMES)}
    FROM f WHERE n_orders_lag_12 IS NOT NULL AND n_orders_roll_mean_12 IS NOT NULL
    """,
)
def usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = usable_rows(panel_features(month_panel(spark, sf_dir), SERIES, DATE, TARGET), TARGET)
    return fixed_all(fixed_all(out, "total", digits=2), "mean_price", *CYCLES, *ROLL_NAMES)


def usable_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usable_rows(lag_features(month_panel(spark, sf_dir), SERIES, DATE, TARGET), TARGET)


FOLDS_SQL = f"""
    {FEATURES_SQL},
    u AS (SELECT *, dense_rank() OVER (PARTITION BY series ORDER BY date) AS r
          FROM f WHERE n_orders_lag_12 IS NOT NULL AND n_orders_roll_mean_12 IS NOT NULL),
    n AS (SELECT series, (count(DISTINCT date) - 24) // 3 AS folds FROM u GROUP BY series),
    x AS (SELECT u.*, CAST(k AS INTEGER) AS fold, CASE WHEN r <= 24 + 3 * k THEN 'train' ELSE 'valid' END AS role
          FROM u JOIN (SELECT series, unnest(generate_series(0, folds - 1)) AS k FROM n) g
               ON u.series = g.series AND u.r <= 27 + 3 * k)
"""


@register.add("expanding_splits", f"WITH {FOLDS_SQL} SELECT series, date, fold, role FROM x")
def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expanding_folds(usable_panel(spark, sf_dir), SERIES, DATE).select(SERIES, DATE, "fold", "role")


@register.add(
    "history_gate",
    """
    WITH m AS (SELECT o_custkey AS series, CAST(date_trunc('month', o_orderdate) AS DATE) AS date,
                      count(*) AS n_orders FROM orders GROUP BY ALL)
    SELECT series, count(*) AS usable_rows, count(DISTINCT date) AS usable_months, count(*) >= 15 AS is_kept
    FROM m GROUP BY series
    """,
)
def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", SERIES)
    panel = monthly_rollup(orders, "o_orderdate", [SERIES], counts={TARGET: "o_orderkey"})
    return history_gate(panel, SERIES, "year_month", 12, 3)


# Two lags, the price and the quarter label: numbers and a category.
SMALL_SET = FeatureSet(["n_orders_lag_1", "n_orders_lag_12", "mean_price"], ["quarter_name"])


def small_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose price is unknown in March and whose label is unknown in June."""
    month = F.month(DATE)
    return usable_panel(spark, sf_dir).withColumns(
        {
            "mean_price": F.when(month != 3, F.col("mean_price")),
            "quarter_name": F.when(month != 6, F.concat(F.lit("Q"), F.quarter(DATE))),
        }
    )


def small_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expanding_folds(small_panel(spark, sf_dir), SERIES, DATE)


SMALL_SQL = f"""
    {FOLDS_SQL},
    z AS (SELECT series, date, fold, role, n_orders, CAST(n_orders_lag_1 AS DOUBLE) AS a,
                 CAST(n_orders_lag_12 AS DOUBLE) AS b, CASE WHEN month(date) <> 3 THEN mean_price END AS c,
                 CASE WHEN month(date) <> 6 THEN 'Q' || quarter(date) END AS q FROM x),
    k AS (SELECT series, fold, median(a) AS ma, median(b) AS mb, median(c) AS mc FROM z WHERE role = 'train' GROUP BY ALL),
    q AS (SELECT series, fold, arg_min(q, (-n, q)) AS mq, list_sort(list(q)) AS cats
          FROM (SELECT series, fold, q, count(*) AS n FROM z WHERE role = 'train' AND q IS NOT NULL GROUP BY ALL)
          GROUP BY ALL),
    i AS (SELECT z.* EXCLUDE (c, q), coalesce(c, mc) AS c, coalesce(z.q, mq) AS q, ma, mb, mc, mq, cats
          FROM z JOIN k USING (series, fold) JOIN q USING (series, fold)),
    t AS (SELECT series, fold, avg(a) AS ua, avg(b) AS ub, avg(c) AS uc,
                 stddev_pop(a) AS sa, stddev_pop(b) AS sb, stddev_pop(c) AS sc
          FROM i WHERE role = 'train' GROUP BY ALL)
"""


@register.add(
    "preprocessor_parameters",
    f"""
    WITH {SMALL_SQL}
    SELECT DISTINCT series, fold, {sql_fixed("ma")} AS median_a, {sql_fixed("mc")} AS median_c,
           {sql_fixed("ub")} AS mean_b, {sql_fixed("uc")} AS mean_c, {sql_fixed("sa")} AS scale_a,
           {sql_fixed("sc")} AS scale_c, mq AS mode, array_to_string(cats, ',') AS categories
    FROM i JOIN t USING (series, fold)
    """,
)
def parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = small_folds(spark, sf_dir).filter(F.col("role") == "train")
    fitted = fit_preprocessor(train, [SERIES, "fold"], SMALL_SET)
    return fitted.select(
        SERIES,
        "fold",
        fixed(F.col("medians")[0]).alias("median_a"),
        fixed(F.col("medians")[2]).alias("median_c"),
        fixed(F.col("means")[1]).alias("mean_b"),
        fixed(F.col("means")[2]).alias("mean_c"),
        fixed(F.col("scales")[0]).alias("scale_a"),
        fixed(F.col("scales")[2]).alias("scale_c"),
        F.col("modes")[0].alias("mode"),
        F.array_join(F.col("categories")[0], ",").alias("categories"),
    )


@register.add(
    "expanding_fills",
    f"""
    WITH {FOLDS_SQL},
    z AS (SELECT series, fold, CAST(n_orders_lag_1 AS DOUBLE) AS a, CASE WHEN month(date) <> 3 THEN mean_price END AS c,
                 CASE WHEN month(date) <> 6 THEN 'Q' || quarter(date) END AS q FROM x WHERE role = 'train'),
    k AS (SELECT series, fold, quantile_cont(a, 0.5) AS ma, quantile_cont(c, 0.5) AS mc FROM z GROUP BY ALL),
    q AS (SELECT series, fold, arg_min(q, (-n, q)) AS mode, array_to_string(list_sort(list(q)), ',') AS categories
          FROM (SELECT series, fold, q, count(*) AS n FROM z WHERE q IS NOT NULL GROUP BY ALL) GROUP BY ALL)
    SELECT series, fold, {sql_fixed("ma")} AS median_a, {sql_fixed("mc")} AS median_c, mode, categories
    FROM k JOIN q USING (series, fold)
    """,
)
def growing_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians and modes of all folds from one pass over each series."""
    blocks = block_rows(small_panel(spark, sf_dir), SERIES, DATE, TARGET, SMALL_SET)
    return fold_fills(expanding_fills(blocks, SMALL_SET), SERIES).select(
        SERIES,
        "fold",
        fixed(F.col("medians")[0]).alias("median_a"),
        fixed(F.col("medians")[2]).alias("median_c"),
        F.col("modes")[0].alias("mode"),
        F.array_join(F.col("categories")[0], ",").alias("categories"),
    )


@register.add(
    "standardised_rows",
    f"""
    WITH {SMALL_SQL}
    SELECT series, fold, role, date, {sql_fixed("(a - ua) / sa")} AS z_a, {sql_fixed("(b - ub) / sb")} AS z_b,
           {sql_fixed("(c - uc) / sc")} AS z_c,
           CAST(CASE WHEN list_contains(cats, q) THEN list_position(cats, q) END AS INTEGER) AS hot
    FROM i JOIN t USING (series, fold)
    """,
)
def standardised(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds, keys = small_folds(spark, sf_dir), [SERIES, "fold"]
    fitted = fit_preprocessor(folds.filter(F.col("role") == "train"), keys, SMALL_SET)
    rows = apply_preprocessor(folds, fitted, keys, SMALL_SET, [DATE, "role"])
    slots = F.slice("features", 4, 100)
    hot = F.array_position(slots, F.lit(1.0)).cast("int")
    return rows.select(
        SERIES,
        "fold",
        "role",
        DATE,
        *[fixed(F.col("features")[i]).alias(f"z_{n}") for i, n in enumerate("abc")],
        F.when(hot > 0, hot).alias("hot"),
    )


# Validation and selection -----------------------------------------------------

NAIVE = ("lag_1", "lag_12", "roll_mean_3", "roll_mean_12")


def naive_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation rows with four naive predictions, some of them negative."""
    folds = expanding_folds(usable_panel(spark, sf_dir), SERIES, DATE).filter(F.col("role") == "valid")
    models = [
        F.struct(F.lit(n).alias("model_name"), (F.col(f"{TARGET}_{n}") * 1.5 - F.col(f"{TARGET}_lag_3") * 1.4).alias("prediction"))
        for n in NAIVE
    ]
    long = folds.withColumn("_m", F.explode(F.array(*models)))
    return long.select(SERIES, "fold", DATE, F.col(TARGET).cast("double").alias("actual"), "_m.*")


def naive_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [SERIES, "model_name"]
    return mean_metrics(fold_metrics(naive_scores(spark, sf_dir), keys), keys)


NAIVE_SQL = (
    FOLDS_SQL
    + ", s AS ("
    + " UNION ALL ".join(
        f"SELECT series, fold, date, n_orders AS y, '{n}' AS model_name, n_orders_{n} * 1.5::DOUBLE - n_orders_lag_3 * 1.4::DOUBLE AS p"
        " FROM x WHERE role = 'valid'"
        for n in NAIVE
    )
    + """),
    e AS (SELECT *, y - CASE WHEN p < 0 THEN 0.0 ELSE p END AS d FROM s),
    pf AS (SELECT series, model_name, fold, sqrt(avg(d * d)) AS rmse, avg(abs(d)) AS mae,
                  avg(abs(d / greatest(abs(y), 1e-6))) * 100 AS mape FROM e GROUP BY ALL),
    mm AS (SELECT series, model_name, avg(rmse) AS rmse_mean, avg(mae) AS mae_mean, avg(mape) AS mape_mean
           FROM pf GROUP BY ALL)
"""
)
METRIC_COLUMNS = ("rmse_mean", "mae_mean", "mape_mean")


@register.add(
    "fold_metrics",
    f"WITH {NAIVE_SQL} SELECT series, model_name, fold, "
    + ", ".join(f"{sql_fixed(c)} AS {c}" for c in ("rmse", "mae", "mape"))
    + " FROM pf",
)
def per_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixed_all(fold_metrics(naive_scores(spark, sf_dir), [SERIES, "model_name"]), "rmse", "mae", "mape")


@register.add(
    "forecast_metrics",
    f"WITH {NAIVE_SQL} SELECT series, model_name, "
    + ", ".join(f"{sql_fixed(c)} AS {c}" for c in METRIC_COLUMNS)
    + " FROM mm",
)
def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixed_all(naive_results(spark, sf_dir), *METRIC_COLUMNS)


@register.add(
    "best_model",
    f"""
    WITH {NAIVE_SQL}
    SELECT series, model_name AS best_model_name, {sql_fixed("rmse_mean")} AS best_rmse,
           {sql_fixed("mae_mean")} AS best_mae, {sql_fixed("mape_mean")} AS best_mape
    FROM mm QUALIFY row_number() OVER (PARTITION BY series ORDER BY rmse_mean, mae_mean, mape_mean, model_name) = 1
    """,
)
def winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixed_all(best_models(naive_results(spark, sf_dir), SERIES), "best_rmse", "best_mae", "best_mape")


GRID = tuple(f"{n}_{side}" for n in ("roll_mean_12", "lag_12", "lag_1", "roll_mean_3") for side in ("second", "first"))


@register.add(
    "tied_grid",
    f"""
    WITH {NAIVE_SQL},
    t AS (SELECT series, model_name || '_' || side AS model_name, rmse_mean, mae_mean, mape_mean,
                 list_position({list(GRID)!r}, model_name || '_' || side) AS place
          FROM mm, (SELECT unnest(['first', 'second']) AS side))
    SELECT series, model_name AS best_model_name, {sql_fixed("rmse_mean")} AS best_rmse,
           {sql_fixed("mae_mean")} AS best_mae, {sql_fixed("mape_mean")} AS best_mape
    FROM t QUALIFY row_number() OVER (PARTITION BY series ORDER BY rmse_mean, mae_mean, mape_mean, place) = 1
    """,
)
def tied_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate twice with equal scores: the first one of the grid wins."""
    sides = F.explode(F.array(F.lit("first"), F.lit("second"))).alias("side")
    twice = naive_results(spark, sf_dir).select("*", sides)
    twice = twice.withColumn("model_name", F.concat_ws("_", "model_name", "side")).drop("side")
    return fixed_all(best_models(twice, SERIES, GRID), "best_rmse", "best_mae", "best_mape")


# One standardised feature has closed-form ridge and elastic-net weights.
ONE_FEATURE = FeatureSet(["n_orders_lag_12"])


@register.add(
    "linear_cv_one_feature",
    f"""
    WITH {FOLDS_SQL},
    z AS (SELECT series, fold, role, date, CAST(n_orders AS DOUBLE) AS y, CAST(n_orders_lag_12 AS DOUBLE) AS v FROM x),
    t AS (SELECT series, fold, count(*) AS n, avg(v) AS u, stddev_pop(v) AS s, avg(y) AS ybar
          FROM z WHERE role = 'train' GROUP BY ALL),
    w AS (SELECT series, fold, n, u, s, ybar, sum((v - u) / s * (y - ybar)) AS m
          FROM z JOIN t USING (series, fold) WHERE role = 'train' GROUP BY ALL),
    ra AS (SELECT unnest([0.1, 1.0, 10.0, 100.0]::DOUBLE[]) AS alpha),
    ea AS (SELECT unnest([0.01, 0.05, 0.1, 0.5]::DOUBLE[]) AS alpha),
    er AS (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9]::DOUBLE[]) AS ratio),
    c AS (SELECT series, fold, 'ridge_alpha=' || alpha AS model_name, m / (n + alpha) AS weight, u, s, ybar
          FROM w CROSS JOIN ra
          UNION ALL
          SELECT series, fold, 'elasticnet_alpha=' || alpha || '_l1_ratio=' || ratio,
                 sign(m) * greatest(abs(m) - alpha * ratio * n, 0) / (n + alpha * (1 - ratio) * n), u, s, ybar
          FROM w CROSS JOIN ea CROSS JOIN er),
    e AS (SELECT series, fold, model_name, y, y - greatest(ybar + weight * (v - u) / s, 0) AS d
          FROM z JOIN c USING (series, fold) WHERE role = 'valid'),
    pf AS (SELECT series, model_name, fold, sqrt(avg(d * d)) AS rmse, avg(abs(d)) AS mae,
                  avg(abs(d / greatest(abs(y), 1e-6))) * 100 AS mape FROM e GROUP BY ALL)
    SELECT series, model_name, {sql_fixed("avg(rmse)")} AS rmse_mean, {sql_fixed("avg(mae)")} AS mae_mean,
           {sql_fixed("avg(mape)")} AS mape_mean
    FROM pf GROUP BY ALL
    """,
)
def one_feature_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 24 linear candidates on one feature, checked against closed forms."""
    rows = usable_panel(spark, sf_dir)
    scored_rows = cross_predict_expanding(rows, SERIES, DATE, TARGET, ONE_FEATURE, LINEAR_CANDIDATES)
    by = [SERIES, "model_name"]
    return fixed_all(mean_metrics(fold_metrics(scored_rows, by), by), *METRIC_COLUMNS)


# Two standardised features have a 2 x 2 system, solved by Cramer's rule.
TWO_FEATURES = FeatureSet(["n_orders_lag_1", "n_orders_lag_12"])


@register.add(
    "ridge_cv_two_features",
    f"""
    WITH {FOLDS_SQL},
    z AS (SELECT series, fold, role, CAST(n_orders AS DOUBLE) AS y, CAST(n_orders_lag_1 AS DOUBLE) AS v,
                 CAST(n_orders_lag_12 AS DOUBLE) AS w FROM x),
    t AS (SELECT series, fold, count(*) AS n, avg(v) AS vm, stddev_pop(v) AS vs, avg(w) AS wm, stddev_pop(w) AS ws,
                 avg(y) AS ybar, corr(v, w) AS r FROM z WHERE role = 'train' GROUP BY ALL),
    p AS (SELECT series, fold, n, vm, vs, wm, ws, ybar, r,
                 sum((v - vm) / vs * (y - ybar)) AS a, sum((w - wm) / ws * (y - ybar)) AS b
          FROM z JOIN t USING (series, fold) WHERE role = 'train' GROUP BY ALL),
    k AS (SELECT unnest([0.1, 1.0, 10.0, 100.0]::DOUBLE[]) AS alpha),
    c AS (SELECT *, 'ridge_alpha=' || alpha AS model_name, (n + alpha) * (n + alpha) - n * r * n * r AS det
          FROM p CROSS JOIN k),
    e AS (SELECT series, fold, model_name, y,
                 y - greatest(ybar + (a * (n + alpha) - b * n * r) / det * (v - vm) / vs
                                   + (b * (n + alpha) - a * n * r) / det * (w - wm) / ws, 0) AS d
          FROM z JOIN c USING (series, fold) WHERE role = 'valid'),
    pf AS (SELECT series, model_name, fold, sqrt(avg(d * d)) AS rmse, avg(abs(d)) AS mae,
                  avg(abs(d / greatest(abs(y), 1e-6))) * 100 AS mape FROM e GROUP BY ALL)
    SELECT series, model_name, {sql_fixed("avg(rmse)")} AS rmse_mean, {sql_fixed("avg(mae)")} AS mae_mean,
           {sql_fixed("avg(mape)")} AS mape_mean
    FROM pf GROUP BY ALL
    """,
)
def two_feature_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge candidates on two correlated features."""
    folds, keys = expanding_folds(usable_panel(spark, sf_dir), SERIES, DATE), [SERIES, "fold"]
    fitted = fit_preprocessor(folds.filter(F.col("role") == "train"), keys, TWO_FEATURES)
    matrix = apply_preprocessor(folds, fitted, keys, TWO_FEATURES, [DATE, "role", TARGET])
    by = [SERIES, "model_name"]
    scored_rows = cross_predict(matrix, SERIES, DATE, TARGET, [c for c in LINEAR_CANDIDATES if c.family == "ridge"])
    return fixed_all(mean_metrics(fold_metrics(scored_rows, by), by), *METRIC_COLUMNS)


def rank_shift_sql(turn: int, half: str) -> str:
    return f"('0x' || substr(md5(key || '|{turn}|' || {half}), 1, {DIGITS}))::BIGINT"


@register.add(
    "importance_fixed_model",
    f"""
    WITH RECURSIVE {FEATURES_SQL},
    u AS (SELECT series, date, CAST(n_orders AS DOUBLE) AS y, CAST(n_orders_lag_1 AS DOUBLE) AS a,
                 CAST(n_orders_lag_12 AS DOUBLE) AS b
          FROM f WHERE n_orders_lag_12 IS NOT NULL AND n_orders_roll_mean_12 IS NOT NULL),
    rows_ AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date) AS i FROM u),
    sizes AS (SELECT series, n, CAST(ceil(sqrt(n)) AS BIGINT) AS wide, CAST(ceil(n / ceil(sqrt(n))) AS BIGINT) AS high
              FROM (SELECT series, count(*) AS n FROM rows_ GROUP BY series)),
    trials AS (SELECT *, '42|' || f || '|' || r AS key
               FROM sizes, (SELECT unnest([0, 1]) AS f), (SELECT unnest(range(0, 5)) AS r)),
    s0 AS (SELECT *, x % wide AS p, x // wide AS q FROM (SELECT *, unnest(range(wide * high)) AS x FROM trials)),
    s1 AS (SELECT * REPLACE ((p + {rank_shift_sql(0, "q")}) % wide AS p) FROM s0),
    s2 AS (SELECT * REPLACE ((q + {rank_shift_sql(1, "p")}) % high AS q) FROM s1),
    s3 AS (SELECT * REPLACE ((p + {rank_shift_sql(2, "q")}) % wide AS p) FROM s2),
    s4 AS (SELECT * REPLACE ((q + {rank_shift_sql(3, "p")}) % high AS q) FROM s3),
    images AS (SELECT series, f, r, n, x, q * wide + p AS y FROM s4),
    walks AS (SELECT * FROM images WHERE x < n
              UNION ALL
              SELECT w.series, w.f, w.r, w.n, w.x, i.y
              FROM walks w JOIN images i ON i.series = w.series AND i.f = w.f AND i.r = w.r AND i.x = w.y WHERE w.y >= w.n),
    places AS (SELECT series, f, r, x + 1 AS i, y + 1 AS at_ FROM walks WHERE y < n),
    mixed AS (SELECT o.series, p.f, p.r, o.y, CASE WHEN p.f = 0 THEN d.a ELSE o.a END AS a,
                     CASE WHEN p.f = 1 THEN d.b ELSE o.b END AS b
              FROM places p JOIN rows_ o ON o.series = p.series AND o.i = p.at_
                            JOIN rows_ d ON d.series = p.series AND d.i = p.i),
    scores AS (SELECT series, f, r, 1 - sum((y - 3 - 0.4 * a - 0.55 * b) ** 2) / (var_pop(y) * count(*)) AS s
               FROM mixed GROUP BY ALL),
    base AS (SELECT series, 1 - sum((y - 3 - 0.4 * a - 0.55 * b) ** 2) / (var_pop(y) * count(*)) AS s
             FROM rows_ GROUP BY series)
    SELECT s.series, CASE WHEN f = 0 THEN 'n_orders_lag_1' ELSE 'n_orders_lag_12' END AS feature,
           {sql_fixed("avg(b.s - s.s)")} AS importance_mean, {sql_fixed("stddev_pop(b.s - s.s)")} AS importance_std
    FROM scores s JOIN base b ON s.series = b.series GROUP BY s.series, f
    """,
)
def fixed_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Permutation importance of a model with given weights."""

    def predict(rows: DataFrame) -> DataFrame:
        return rows.withColumn("prediction", 3 + 0.4 * F.col("n_orders_lag_1") + 0.55 * F.col("n_orders_lag_12"))

    found = permutation_importance(
        usable_panel(spark, sf_dir), predict, TWO_FEATURES.numeric, SERIES, DATE, TARGET, repeats=5
    )
    return fixed_all(found, "importance_mean", "importance_std")


# Forecasts ---------------------------------------------------------------------

LAST_MONTH = "2002-04-30"


def stub_sql(end: str | None = None) -> str:
    """The twelve months after each series' last one, up to ``end`` if there is one."""
    stop = "CAST(last + INTERVAL 12 MONTH AS TIMESTAMP)"
    stop = f"least({stop}, TIMESTAMP '{end}')" if end else stop
    return f"""
    l AS (SELECT series, arg_max(total, date) AS total, arg_max(mean_price, date) AS mean_price, max(date) AS last
          FROM m GROUP BY series),
    st AS (SELECT series, total, mean_price, CAST(unnest(generate_series(
               CAST(last + INTERVAL 1 MONTH AS TIMESTAMP), {stop}, INTERVAL 1 MONTH)) AS DATE) AS date
           FROM l)
"""


@register.add(
    "future_stub",
    f"""
    WITH {PANEL_SQL}, {stub_sql(LAST_MONTH)}
    SELECT series, date, NULL::BIGINT AS n_orders, {sql_fixed("total", 2)} AS total,
           {sql_fixed("mean_price")} AS mean_price, CAST(year(date) AS INTEGER) AS year,
           CAST(month(date) AS INTEGER) AS month, 0 AS covid_flag
    FROM st
    """,
)
def stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = month_panel(spark, sf_dir).withColumns(
        {"year": F.year(DATE), "month": F.month(DATE), "covid_flag": F.lit(1)}
    )
    out = future_stub(panel, SERIES, DATE, TARGET, end=LAST_MONTH)
    return out.withColumns({"total": fixed(F.col("total"), 2), "mean_price": fixed(F.col("mean_price"))})


@register.add(
    "future_stub_open_end",
    f"""
    WITH {PANEL_SQL}, l AS (SELECT series, max(date) AS last FROM m GROUP BY series)
    SELECT series, CAST(last + INTERVAL (k) MONTH AS DATE) AS date, NULL::BIGINT AS n_orders
    FROM l, (SELECT unnest(range(1, 13)) AS k)
    """,
)
def open_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without an end every series gets the whole horizon, wherever its panel stops."""
    return future_stub(month_panel(spark, sf_dir), SERIES, DATE, TARGET).select(SERIES, DATE, TARGET)


# Weight and fill of each lag feature, and the base, of three fixed models.
FIXED_MODELS = {
    "naive": (0.0, {"n_orders_lag_1": 1.0}),
    "blend": (2.0, {"n_orders_lag_1": 0.3, "n_orders_lag_12": 0.4, "n_orders_roll_mean_3": 0.25}),
    "sinking": (-30.0, {"n_orders_lag_2": 0.5, "n_orders_roll_mean_12": 0.6}),
}
LAG_FEATURES = (*LAG_NAMES, *ROLL_NAMES)


def gapped_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A month counts as unknown when its mean price is high, so some lags are null."""
    return month_panel(spark, sf_dir).withColumn(
        TARGET, F.when(F.col("mean_price") < 260000, F.col(TARGET).cast("double"))
    )


def fixed_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recursive forecasts of the fixed models; no fitted part."""
    panel = gapped_panel(spark, sf_dir)
    steps = future_stub(panel, SERIES, DATE, TARGET).select(SERIES, DATE)
    models = [
        F.struct(
            F.lit(name).alias("model_name"),
            F.lit(base).alias("base"),
            *[F.lit(weights.get(c, 0.0)).alias(c) for c in LAG_FEATURES],
        )
        for name, (base, weights) in FIXED_MODELS.items()
    ]
    long = steps.withColumn("_m", F.explode(F.array(*models))).select(SERIES, DATE, "_m.*")
    plans = long.groupBy(SERIES, "model_name", *LAG_FEATURES).agg(
        F.array_sort(F.collect_list(F.struct(F.col(DATE).alias("date"), "base"))).alias("steps")
    )
    history = recent_history(panel, SERIES, DATE, TARGET, 12)
    terms = {c: (F.col(c), F.lit(40.0)) for c in LAG_FEATURES}
    return with_year_month(fold_forecast(plans.join(history, SERIES), [SERIES, "model_name"], TARGET, terms))


def _lag_item(k: int) -> str:
    return f"CASE WHEN len(h) >= {k} THEN h[len(h) - {k - 1}] END"


def _mean_item(w: int) -> str:
    recent = f"h[len(h) - {w - 1}:]"
    whole = f"len(h) >= {w} AND len(list_filter({recent}, lambda v: v IS NOT NULL)) = {w}"
    return f"CASE WHEN {whole} THEN list_sum({recent}) / {w} END"


_ITEMS = {**{f"n_orders_lag_{k}": _lag_item(k) for k in (1, 2, 3, 12)}}
_ITEMS |= {f"n_orders_roll_mean_{w}": _mean_item(w) for w in (3, 12)}
FIXED_CASES = {
    name: f"{base}::DOUBLE" + "".join(f" + {w}::DOUBLE * (coalesce({_ITEMS[c]}, 40.0) - 40.0)" for c, w in weights.items())
    for name, (base, weights) in FIXED_MODELS.items()
}
_ANY = " OR ".join(f"({item}) IS NOT NULL" for item in _ITEMS.values())


def recursion_sql(cases: dict[str, str]) -> str:
    """Twelve months of every model; ``cases`` gives a month's value from the history ``h``."""
    chosen = " ".join(f"WHEN '{name}' THEN {value}" for name, value in cases.items())
    return f"""
    RECURSIVE {PANEL_SQL}, {stub_sql()},
    g AS (SELECT series, date, CASE WHEN mean_price < 260000 THEN CAST(n_orders AS DOUBLE) END AS y FROM m),
    hh AS (SELECT series, list(y ORDER BY date) AS h, arg_max(y, date) FILTER (y IS NOT NULL) AS lk
           FROM (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY series ORDER BY date DESC) <= 12) GROUP BY series),
    lkk AS (SELECT series, arg_max(y, date) FILTER (y IS NOT NULL) AS lk FROM g GROUP BY series),
    sn AS (SELECT series, date, row_number() OVER (PARTITION BY series ORDER BY date) AS i FROM st),
    r AS (
        SELECT hh.series, model_name, CAST(0 AS BIGINT) AS i, hh.h AS h, lkk.lk AS lk, CAST(NULL AS DOUBLE) AS p
        FROM hh JOIN lkk USING (series) CROSS JOIN (SELECT unnest({list(cases)!r}) AS model_name)
        UNION ALL
        SELECT series, model_name, i + 1, list_append(h, q), coalesce(q, lk), q
        FROM (SELECT series, model_name, i, h, lk,
                     CASE WHEN {_ANY} THEN greatest(CASE model_name {chosen} END, 0.0) ELSE lk END AS q
              FROM r WHERE i < 12)
    ),
    fc AS (SELECT r.series, model_name, sn.date, p AS prediction, CAST(year(sn.date) AS INTEGER) AS year,
                  CAST(month(sn.date) AS INTEGER) AS month
           FROM r JOIN sn ON r.series = sn.series AND r.i = sn.i WHERE p IS NOT NULL)
"""


FIXED_SQL = recursion_sql(FIXED_CASES)


@register.add(
    "recursive_forecast",
    f"WITH {FIXED_SQL} SELECT series, model_name, date, {sql_fixed('prediction')} AS prediction, year, month FROM fc",
)
def fixed_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixed_all(fixed_forecast(spark, sf_dir), "prediction")


@register.add(
    "annual_forecast",
    f"""
    WITH {FIXED_SQL}
    SELECT series, model_name, year, {sql_fixed("sum(prediction)")} AS forecast_students FROM fc GROUP BY ALL
    """,
)
def annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = annual_forecast(fixed_forecast(spark, sf_dir), [SERIES, "model_name"])
    return fixed_all(out, "forecast_students")


# Two small trees over the lag features, nodes in arrays; the children of a node are one after the other.
FIXED_TREES = (
    {"feature": [0, -1, 3, -1, -1], "cut": [38.5, 0.0, 41.25, 0.0, 0.0], "child": [1, 0, 3, 0, 0],
     "value": [0.0, 12.0, 0.0, -4.0, 8.5], "depth": 2},
    {"feature": [5, 4, -1, -1, 1, -1, -1], "cut": [39.1, 36.3, 0.0, 0.0, 44.0, 0.0, 0.0],
     "child": [1, 3, 0, 0, 5, 0, 0], "value": [0.0, 0.0, 3.25, 1.5, 0.0, 2.0, -1.0], "depth": 2},
)


def tree_sql(tree: dict, node: int = 0) -> str:
    if tree["feature"][node] < 0:
        return f"{tree['value'][node]}::DOUBLE"
    item = f"CAST(CAST(coalesce({_ITEMS[LAG_FEATURES[tree['feature'][node]]]}, 40.0) AS FLOAT) AS DOUBLE)"
    low, high = (tree_sql(tree, tree["child"][node] + side) for side in (0, 1))
    return f"CASE WHEN {item} <= {tree['cut'][node]}::DOUBLE THEN {low} ELSE {high} END"


TREE_CASE = f"22::DOUBLE + 0.5::DOUBLE * (coalesce({_ITEMS['n_orders_lag_1']}, 40.0) - 40.0)"


@register.add(
    "fixed_tree_forecast",
    f"""
    WITH {recursion_sql({"trees": " + ".join([TREE_CASE, *map(tree_sql, FIXED_TREES)])})}
    SELECT series, model_name, date, {sql_fixed('prediction')} AS prediction, year, month FROM fc
    """,
)
def fixed_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recursion of a model with a linear part and trees, in one expression."""
    panel = gapped_panel(spark, sf_dir)
    steps = future_stub(panel, SERIES, DATE, TARGET).select(SERIES, DATE)
    item = F.struct(
        F.col(DATE).alias("date"), F.lit(22.0).alias("base"),
        F.array(*[F.lit(40.0)] * len(LAG_FEATURES)).alias("features"),
    )
    plans = steps.groupBy(SERIES).agg(F.array_sort(F.collect_list(item)).alias("steps"))
    literal = F.from_json(F.lit(json.dumps(FIXED_TREES)), f"array<{TREE_TYPE}>")
    plans = plans.withColumns({"model_name": F.lit("trees"), "trees": literal})
    history = recent_history(panel, SERIES, DATE, TARGET, 12)
    slots = {c: (i, F.lit(0.0), F.lit(1.0)) for i, c in enumerate(LAG_FEATURES)}
    terms = {"n_orders_lag_1": (F.lit(0.5), F.lit(40.0))}
    out = fold_forecast(plans.join(history, SERIES), [SERIES, "model_name"], TARGET, terms, tree_slots=slots)
    return fixed_all(with_year_month(out), "prediction")


# How the fixed models rank: by distance of their base from zero.
@register.add(
    "actual_vs_forecast",
    f"""
    WITH {FIXED_SQL},
    top AS (SELECT series, model_name FROM (SELECT series, model_name, avg(prediction) AS score FROM fc GROUP BY ALL)
            QUALIFY row_number() OVER (PARTITION BY series ORDER BY score DESC, model_name) <= 2)
    SELECT series, date, 'actual' AS line, {sql_fixed("CAST(n_orders AS DOUBLE)")} AS value FROM m
    UNION ALL
    SELECT series, date, model_name AS line, {sql_fixed("prediction")} AS value
    FROM fc JOIN top USING (series, model_name)
    """,
)
def actual_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actual orders with the forecasts of each series' two highest models."""
    forecast = fixed_forecast(spark, sf_dir)
    scores = forecast.groupBy(SERIES, "model_name").agg(F.avg("prediction").alias("score"))
    top = top_per_group(scores, [SERIES], [F.col("score").desc(), "model_name"], 2)
    kept = forecast.join(top.select(SERIES, "model_name"), [SERIES, "model_name"], "left_semi")
    actual = month_panel(spark, sf_dir).withColumn(TARGET, F.col(TARGET).cast("double"))
    return fixed_all(actual_and_forecast(actual, kept, SERIES, DATE, TARGET), "value")


# Fitted models: no SQL equivalent ------------------------------------------------


def model_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month panel with a flag, a category and gaps in a covariate."""
    panel = with_event_flags(month_panel(spark, sf_dir), DATE, CLOSED, LOST)
    return panel.withColumns(
        {
            "label": F.concat(F.lit("Y"), (F.year(DATE) % 3).cast("string")),
            "mean_price": F.when(F.month(DATE) != 3, F.col("mean_price")),
        }
    )


def order_forecast(spark: SparkSession, sf_dir: str, **settings) -> PanelForecast:
    spec = ForecastSpec(series=SERIES, date=DATE, target=TARGET, **settings)
    return PanelForecast(model_panel(spark, sf_dir), spec)


RIDGE = tuple(c for c in LINEAR_CANDIDATES if c.family == "ridge")
ELASTIC_NET = tuple(c for c in LINEAR_CANDIDATES if c.family == "elasticnet")


@register.add("ridge_cv")
def ridge_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_forecast(spark, sf_dir, linear=RIDGE, trees=()).results()


@register.add("elasticnet_cv")
def elasticnet_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_forecast(spark, sf_dir, linear=ELASTIC_NET, trees=()).results()


@register.add("ridge_forecast")
def ridge_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refit on all usable rows, then the native recursion over twelve months."""
    return order_forecast(spark, sf_dir, linear=RIDGE, trees=()).forecast()


@register.add("best_linear_forecast")
def best_linear_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search all linear candidates, pick and forecast each series in one plan."""
    return order_forecast(spark, sf_dir, exclude_leaky=("n_orders_seasonal_diff",), trees=()).best_forecast()


@register.add("permutation_importance")
def importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance of each series' best linear model."""
    run = order_forecast(spark, sf_dir, trees=())
    return run.importance(keep_table(run.best().withColumnRenamed("best_model_name", "model_name")))


@register.add("tree_cv")
def tree_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tree candidates on every series and fold."""
    return order_forecast(spark, sf_dir, linear=(), trees=TREE_CANDIDATES).results()


@register.add("tree_forecast")
def tree_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each series' best of all tree candidates, refitted and run forward in one expression."""
    return order_forecast(spark, sf_dir, linear=(), trees=TREE_CANDIDATES).best_forecast()


@register.add(
    "saved_tables",
    f"""
    WITH {FEATURES_SQL},
    u AS (SELECT series, count(*) AS n FROM f
          WHERE n_orders_lag_12 IS NOT NULL AND n_orders_roll_mean_12 IS NOT NULL GROUP BY series HAVING count(*) >= 27),
    e AS (SELECT series, max(date) AS last FROM m GROUP BY series),
    y AS (SELECT DISTINCT series, year(last + INTERVAL (k) MONTH) AS year
          FROM e JOIN u USING (series), (SELECT unnest(range(1, 13)) AS k))
    SELECT 'model_results' AS name, series, CAST(4 AS BIGINT) AS rows FROM u
    UNION ALL SELECT 'best_models', series, 1 FROM u
    UNION ALL SELECT 'monthly_forecast', series, 12 FROM u
    UNION ALL SELECT 'annual_forecast', series, count(*) FROM y GROUP BY series
    """,
)
def saved_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables that a run writes, read back: their rows per series."""
    folder = shared_folder(spark, "run")
    order_forecast(spark, sf_dir, linear=RIDGE, trees=()).save(folder)
    names = ("model_results", "best_models", "monthly_forecast", "annual_forecast")
    parts = [
        read_table_csv(spark, f"{folder}/{n}").groupBy(SERIES).agg(F.count("*").alias("rows")).withColumn("name", F.lit(n))
        for n in names
    ]
    return stack_frames(parts).select("name", SERIES, "rows")


@register.add("untuned_cv")
def untuned_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One candidate of every family, as without a search."""
    return order_forecast(spark, sf_dir, tuning=False).results()


@register.add(
    "linear_optimality",
    f"""
    WITH {FEATURES_SQL},
    u AS (SELECT series, count(*) AS n FROM f
          WHERE n_orders_lag_12 IS NOT NULL AND n_orders_roll_mean_12 IS NOT NULL GROUP BY series HAVING count(*) >= 27),
    names AS (SELECT 'ridge_alpha=' || unnest([0.1, 1.0, 10.0, 100.0]::DOUBLE[]) AS model_name
              UNION ALL
              SELECT 'elasticnet_alpha=' || alpha || '_l1_ratio=' || ratio
              FROM (SELECT unnest([0.01, 0.05, 0.1, 0.5]::DOUBLE[]) AS alpha),
                   (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9]::DOUBLE[]) AS ratio))
    SELECT series, model_name, TRUE AS optimal FROM u CROSS JOIN names
    """,
)
def optimality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 24 linear candidates on all features: whether the weights returned are optimal.

    The duality gap of each fit, worked out from its residuals, is within the
    solver's tolerance of the target's sum of squares.
    """
    run = order_forecast(spark, sf_dir, trees=())
    matrix = apply_preprocessor(run.kept(), run.parameters(), [SERIES], run.features, [DATE, TARGET])
    models = run.refit()
    penalties = spark.createDataFrame(
        [
            (c.label, *((dict(c.params)["alpha"], 0.0, False) if c.family == "ridge"
                        else (dict(c.params)["alpha"], dict(c.params)["l1_ratio"], True)))
            for c in LINEAR_CANDIDATES
        ],
        "model_name string, alpha double, ratio double, per_row boolean",
    )
    scored = matrix.join(models, SERIES).withColumn("r", F.col(TARGET) - linear_prediction())
    level = F.avg(TARGET).over(Window.partitionBy(SERIES, "model_name"))
    scored = scored.withColumn("yc", F.col(TARGET) - level)
    sums = scored.groupBy(SERIES, "model_name").agg(
        F.count("*").alias("n"),
        F.sum(F.col("r") * F.col("r")).alias("residual"),
        F.sum(F.col("yc") * F.col("r")).alias("agreement"),
        F.sum(F.col("yc") * F.col("yc")).alias("energy"),
        F.first("weights").alias("w"),
    )
    pulls = scored.select(SERIES, "model_name", "r", F.posexplode("features").alias("j", "z"))
    pulls = pulls.groupBy(SERIES, "model_name", "j").agg(F.sum(F.col("z") * F.col("r")).alias("pull"))
    joined = pulls.join(sums, [SERIES, "model_name"]).join(F.broadcast(penalties), "model_name")
    scale = F.when(F.col("per_row"), F.col("n")).otherwise(1)
    l1, l2 = F.col("alpha") * F.col("ratio") * scale, F.col("alpha") * (1 - F.col("ratio")) * scale
    rest = [F.first(c).alias(c) for c in ("residual", "agreement", "energy", "w")]
    each = joined.withColumns({"l1": l1, "l2": l2}).groupBy(SERIES, "model_name", "l1", "l2")
    each = each.agg(F.max(F.abs(F.col("pull") - F.col("l2") * F.get("w", F.col("j")))).alias("slack"), *rest)
    size = F.aggregate("w", F.lit(0.0), lambda a, x: a + x * x)
    length = F.aggregate("w", F.lit(0.0), lambda a, x: a + F.abs(x))
    shrink = F.when(F.col("slack") > F.col("l1"), F.col("l1") / F.col("slack")).otherwise(1.0)
    primal = F.col("residual") / 2 + F.col("l1") * length + F.col("l2") * size / 2
    dual = shrink * F.col("agreement") - shrink * shrink * (F.col("residual") + F.col("l2") * size) / 2
    # Without an L1 part the gradient itself must vanish.
    smooth = F.col("slack") <= 1e-6 * F.col("energy")
    optimal = F.when(F.col("l1") > 0, primal - dual <= 1.001e-4 * F.col("energy")).otherwise(smooth)
    return each.select(SERIES, "model_name", optimal.alias("optimal"))


def numeric_and_categorical(spark: SparkSession, sf_dir: str) -> tuple[list[str], list[str]]:
    """Feature split of the model panel, for reports and tests."""
    featured = panel_features(model_panel(spark, sf_dir), SERIES, DATE, TARGET)
    return feature_columns(featured, [SERIES, DATE], TARGET)
