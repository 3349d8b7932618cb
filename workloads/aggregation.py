"""Rollup, quantile, distribution, join and top-k queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.distributions import binned_density, density, histogram
from tidemark.operators.joins import keep_top_groups, merge_heavy, merge_on_keys, stack_frames, top_groups
from tidemark.operators.quantiles import group_median, group_quantiles, trimmed_mean
from tidemark.operators.rollup import (
    aggregate_to_month,
    distinct_values,
    group_stats,
    monthly_rollup,
    most_frequent,
    price_points,
    profile,
    profile_by,
    with_month_parts,
)
from tidemark.operators.selection import last_row, top_per_group
from tidemark.operators.sketches import merged_sketches, month_sketches
from tidemark.plans.reports import (
    home_price_points,
    monthly_prices,
    price_density,
    price_histogram,
    price_range,
    yearly_trends,
)
from tidemark.session import keep_table
from workloads.base import Register, fixed, fixed_all, sql_fixed, table

register = Register()


@register.add(
    "monthly_rollup",
    f"""
    SELECT o_orderpriority, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
           CAST(date_trunc('month', o_orderdate) AS DATE) AS year_month,
           {sql_fixed("sum(o_totalprice)", 2)} AS total, {sql_fixed("avg(o_totalprice)")} AS mean_price,
           count(o_custkey) AS n_orders, arg_min(o_orderstatus, o_orderkey) AS first_status
    FROM orders GROUP BY ALL
    """,
)
def rollup_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = monthly_rollup(
        table(spark, sf_dir, "orders"),
        "o_orderdate",
        ["o_orderpriority"],
        sums={"total": "o_totalprice"},
        means={"mean_price": "o_totalprice"},
        counts={"n_orders": "o_custkey"},
        firsts={"first_status": "o_orderstatus"},
        first_order="o_orderkey",
    )
    return out.withColumns({"total": fixed(F.col("total"), 2), "mean_price": fixed(F.col("mean_price"))})


def month_query(agg: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        orders = table(spark, sf_dir, "orders").withColumn(
            "value", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
        )
        out = aggregate_to_month(orders, "value", agg, "o_orderdate", ["o_orderpriority"], ["o_orderkey"])
        return fixed_all(out, "value", digits=4)

    return run


MONTH_SQL = """
    SELECT o_orderpriority, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
           CAST(date_trunc('month', o_orderdate) AS DATE) AS year_month, {0} AS value
    FROM (SELECT *, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS v FROM orders) GROUP BY ALL
"""
for _agg, _sql in {
    "mean": "avg(v)",
    "sum": "coalesce(sum(v), 0)",
    "last": "arg_max(v, (o_orderdate, o_orderkey)) FILTER (v IS NOT NULL)",
}.items():
    register.add(f"aggregate_to_month_{_agg}", MONTH_SQL.format(sql_fixed(_sql, 4)))(month_query(_agg))


def priced_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems with their part's attributes."""
    lineitem = table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "p_partkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand", "p_name")
    return lineitem.join(part, "p_partkey")


PRICED_SQL = "lineitem JOIN part ON l_partkey = p_partkey"


@register.add(
    "group_quantile_bounds",
    f"""
    SELECT p_type, {sql_fixed("quantile_cont(l_extendedprice, 0.05)")} AS q05,
           {sql_fixed("quantile_cont(l_extendedprice, 0.95)")} AS q95 FROM {PRICED_SQL} GROUP BY p_type
    """,
)
def quantile_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = group_quantiles(priced_parts(spark, sf_dir), ["p_type"], "l_extendedprice", {"q05": 0.05, "q95": 0.95})
    return fixed_all(out, "q05", "q95")


@register.add(
    "group_median",
    f"""
    SELECT l_returnflag, l_linestatus, {sql_fixed("median(l_extendedprice)")} AS median
    FROM lineitem GROUP BY ALL
    """,
)
def medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = table(spark, sf_dir, "lineitem")
    return fixed_all(group_median(lineitem, ["l_returnflag", "l_linestatus"], "l_extendedprice"), "median")


@register.add(
    "most_frequent",
    """
    SELECT c_nationkey, arg_min(c_mktsegment, (-n, c_mktsegment)) AS segment
    FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL) GROUP BY c_nationkey
    """,
)
def frequent_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return most_frequent(table(spark, sf_dir, "customer"), ["c_nationkey"], "c_mktsegment", "segment")


def trimmed_sql(low: float, high: float) -> str:
    return f"""
    WITH p AS (SELECT * FROM {PRICED_SQL}),
    b AS (SELECT p_type, quantile_cont(l_extendedprice, {low}) AS lo, quantile_cont(l_extendedprice, {high}) AS hi
          FROM p GROUP BY p_type)
    SELECT CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month, p_type,
           {sql_fixed("avg(l_extendedprice)", 2)} AS mean_price
    FROM p JOIN b USING (p_type) WHERE l_extendedprice BETWEEN lo AND hi GROUP BY ALL
    """


def trimmed_query(low: float, high: float):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        priced = with_month_parts(priced_parts(spark, sf_dir), "l_shipdate")
        by = ["year", "month", "p_type"]
        out = trimmed_mean(priced, "p_type", "l_extendedprice", by, low, high, "mean_price", digits=None)
        return fixed_all(out, "mean_price", digits=2)

    return run


register.add("trimmed_mean", trimmed_sql(0.05, 0.95))(trimmed_query(0.05, 0.95))
register.add("trimmed_mean_wide", trimmed_sql(0.10, 0.90))(trimmed_query(0.10, 0.90))


def merge_frames(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Three monthly tables of whole inputs whose months and statuses only partly overlap."""
    orders, lineitem = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    a = monthly_rollup(
        orders.withColumnRenamed("o_orderstatus", "status"),
        "o_orderdate",
        ["status"],
        counts={"n": "o_orderkey"},
    )
    b = monthly_rollup(
        lineitem.withColumnRenamed("l_linestatus", "status"), "l_shipdate", ["status"], counts={"n": "l_orderkey"}
    )
    c = monthly_rollup(
        orders.withColumns({"status": F.col("o_orderstatus"), "quarter_on": F.date_add("o_orderdate", 92)}),
        "quarter_on",
        ["status"],
        sums={"total": "o_totalprice"},
    )
    return [f.drop("year_month") for f in (a, b, c)]


def merge_query(how: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = merge_on_keys(merge_frames(spark, sf_dir), ["month", "year", "status"], how)
        return fixed_all(out, "total", digits=2)

    return run


MERGE_SQL = """
    WITH a AS (SELECT o_orderstatus AS status, CAST(year(o_orderdate) AS INTEGER) AS year,
                      CAST(month(o_orderdate) AS INTEGER) AS month, count(o_orderkey) AS n_x
               FROM orders GROUP BY ALL),
    b AS (SELECT l_linestatus AS status, CAST(year(l_shipdate) AS INTEGER) AS year,
                 CAST(month(l_shipdate) AS INTEGER) AS month, count(l_orderkey) AS n_y FROM lineitem GROUP BY ALL),
    d AS (SELECT *, CAST(o_orderdate AS DATE) + 92 AS later FROM orders),
    c AS (SELECT o_orderstatus AS status, CAST(year(later) AS INTEGER) AS year,
                 CAST(month(later) AS INTEGER) AS month, sum(o_totalprice) AS t
          FROM d GROUP BY ALL)
    SELECT month, year, status, n_x, n_y, {1} AS total
    FROM a {0} JOIN b USING (month, year, status) {0} JOIN c USING (month, year, status)
"""
for _how, _join in {"outer": "FULL", "inner": "INNER", "left": "LEFT", "right": "RIGHT"}.items():
    register.add(f"merge_on_keys_{_how}", MERGE_SQL.format(_join, sql_fixed("t", 2)))(merge_query(_how))


@register.add(
    "top_groups",
    f"""
    SELECT p_name, count(l_extendedprice) AS n FROM {PRICED_SQL} GROUP BY p_name ORDER BY n DESC, p_name LIMIT 12
    """,
)
def frequent_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_groups(priced_parts(spark, sf_dir), "p_name", "l_extendedprice", 12)


@register.add(
    "topk_semi_join",
    f"""
    WITH t AS (SELECT p_name FROM {PRICED_SQL} GROUP BY p_name ORDER BY count(l_extendedprice) DESC, p_name LIMIT 10)
    SELECT l_orderkey, l_linenumber, p_name, l_extendedprice FROM {PRICED_SQL}
    WHERE p_name IN (SELECT p_name FROM t)
    """,
)
def top_name_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keep_top_groups(priced_parts(spark, sf_dir), "p_name", "l_extendedprice", 10)
    return rows.select("l_orderkey", "l_linenumber", "p_name", "l_extendedprice")


@register.add(
    "topk_per_group",
    """
    SELECT l_returnflag, l_orderkey, l_linenumber, l_extendedprice FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_returnflag
                               ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) <= 5
    """,
)
def top_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber", "l_partkey"]
    rows = top_per_group(table(spark, sf_dir, "lineitem"), ["l_returnflag"], order, 5)
    return rows.select("l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice")


@register.add(
    "last_row",
    """
    SELECT o_orderpriority, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey,
           CAST(max(o_orderdate) AS DATE) AS day
    FROM orders GROUP BY o_orderpriority
    """,
)
def last_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        "o_orderpriority",
        "o_orderkey",
        F.col("o_orderdate").cast("date").alias("day"),
        F.struct("o_orderdate", "o_orderkey").alias("place"),
    )
    return last_row(orders, ["o_orderpriority"], "place").drop("place")


@register.add(
    "group_stats",
    f"""
    SELECT p_name, {sql_fixed("avg(l_extendedprice)", 4)} AS mean, {sql_fixed("stddev_samp(l_extendedprice)", 4)} AS std,
           count(l_extendedprice) AS count
    FROM {PRICED_SQL} GROUP BY p_name ORDER BY stddev_samp(l_extendedprice) DESC, p_name LIMIT 20
    """,
)
def widest_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixed_all(group_stats(priced_parts(spark, sf_dir), "p_name", "l_extendedprice"), "mean", "std", digits=4)


@register.add(
    "yearly_rollup",
    f"""
    SELECT CAST(year(l_shipdate) AS INTEGER) AS year, p_brand,
           {sql_fixed("sum(l_quantity)", 2)} AS l_quantity, {sql_fixed("avg(l_extendedprice)", 4)} AS l_extendedprice
    FROM {PRICED_SQL} GROUP BY ALL
    """,
)
def yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_month_parts(priced_parts(spark, sf_dir), "l_shipdate")
    out = yearly_trends(rows, "p_brand", ["l_quantity"], ["l_extendedprice"])
    return out.withColumns(
        {"l_quantity": fixed(F.col("l_quantity"), 2), "l_extendedprice": fixed(F.col("l_extendedprice"), 4)}
    )


@register.add(
    "price_points",
    """
    SELECT p_retailprice, p_brand, count(*) AS count FROM part
    GROUP BY ALL ORDER BY p_retailprice, p_brand LIMIT 50
    """,
)
def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return price_points(table(spark, sf_dir, "part"), "p_retailprice", "p_brand")


@register.add(
    "home_price_points",
    """
    SELECT c_acctbal, c_mktsegment, count(*) AS count
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE r_name = 'EUROPE' GROUP BY ALL ORDER BY c_acctbal, c_mktsegment LIMIT 50
    """,
)
def home_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation, region = (table(spark, sf_dir, n) for n in ("customer", "nation", "region"))
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    located = customer.join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = located.withColumn("Location", F.concat_ws(", ", "n_name", "r_name"))
    return home_price_points(rows, "c_acctbal", "c_mktsegment", "EUROPE")


@register.add(
    "profile",
    """
    SELECT CAST(min(o_orderdate) AS DATE) AS min_date, CAST(max(o_orderdate) AS DATE) AS max_date,
           count(*) AS row_count, count(DISTINCT o_custkey) AS key_count
    FROM orders
    """,
)
def order_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    return profile(orders, "day", "o_custkey")


@register.add(
    "profile_by_series",
    """
    SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS min_date, CAST(max(o_orderdate) AS DATE) AS max_date,
           count(*) AS row_count
    FROM orders GROUP BY o_custkey
    """,
)
def customer_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    return profile_by(orders, "day", "o_custkey")


@register.add("distinct_values", "SELECT DISTINCT p_brand, p_type FROM part ORDER BY ALL")
def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_values(table(spark, sf_dir, "part"), "p_brand", "p_type")


@register.add(
    "stack_frames",
    """
    SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment, NULL::BIGINT AS s_suppkey FROM customer
    UNION ALL BY NAME SELECT s_name AS name, s_acctbal AS balance, s_suppkey FROM supplier
    UNION ALL BY NAME SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer
    """,
)
def parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")
    )
    supplier = table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name")
    )
    return stack_frames([customer, supplier, customer])


def histogram_sql(source: str, group: str, value: str) -> str:
    return f"""
    r AS (SELECT {group} AS g, {value} AS v FROM {source}),
    b AS (SELECT g, min(v) AS lo, max(v) AS hi FROM r GROUP BY g),
    h AS (SELECT g, lo, (hi - lo) / 30 AS step,
                 CAST(CASE WHEN hi = lo THEN 1 ELSE least(floor((v - lo) / (hi - lo) * 30) + 1, 30) END AS INTEGER) AS bin
          FROM r JOIN b USING (g))
    SELECT g AS {group}, bin, {sql_fixed("lo + (bin - 1) * step")} AS bin_start,
           {sql_fixed("lo + bin * step")} AS bin_end, count(*) AS count
    FROM h GROUP BY g, bin, lo, step
    """


@register.add("histogram", "WITH " + histogram_sql("lineitem", "l_returnflag", "l_extendedprice"))
def price_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = histogram(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice")
    return fixed_all(out, "bin_start", "bin_end")


@register.add(
    "price_histogram_top",
    f"""
    WITH f AS (SELECT p_name, l_extendedprice FROM {PRICED_SQL} WHERE l_extendedprice > 1000 AND l_extendedprice < 60000),
    t AS (SELECT p_name FROM f GROUP BY p_name ORDER BY count(*) DESC, p_name LIMIT 12),
    k AS (SELECT * FROM f WHERE p_name IN (SELECT p_name FROM t)),
    """
    + histogram_sql("k", "p_name", "l_extendedprice"),
)
def top_price_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = price_range(priced_parts(spark, sf_dir), "l_extendedprice", 1000, 60000)
    return fixed_all(price_histogram(rows, "p_name", "l_extendedprice"), "bin_start", "bin_end")


def density_sql(source: str, group: str, value: str) -> str:
    return f"""
    r AS (SELECT {group} AS g, {value} AS v FROM {source}),
    b AS (SELECT g, count(*) AS n, min(v) AS lo, (max(v) - min(v)) / 199 AS step,
                 pow(count(*), -0.2) * stddev_samp(v) AS h FROM r GROUP BY g HAVING stddev_samp(v) > 0),
    c AS (SELECT g, v, count(*) AS w FROM r GROUP BY g, v),
    p AS (SELECT CAST(unnest(generate_series(0, 199)) AS INTEGER) AS point)
    SELECT g AS {group}, point, {sql_fixed("lo + point * step")} AS x,
           {sql_fixed("sum(w * exp(-pow((lo + point * step - v) / h, 2) / 2)) / (n * h * sqrt(2 * pi()))", 9)} AS density
    FROM c JOIN b USING (g) CROSS JOIN p GROUP BY g, point, lo, step, n, h
    """


@register.add("density", "WITH " + density_sql("part", "p_type", "p_retailprice"))
def price_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = density(table(spark, sf_dir, "part"), "p_type", "p_retailprice")
    return out.withColumns({"x": fixed(F.col("x")), "density": fixed(F.col("density"), 9)})


@register.add(
    "price_density_top",
    """
    WITH t AS (SELECT p_name FROM part GROUP BY p_name ORDER BY count(*) DESC, p_name LIMIT 12),
    k AS (SELECT * FROM part WHERE p_name IN (SELECT p_name FROM t)),
    """
    + density_sql("k", "p_name", "p_retailprice"),
)
def top_price_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = price_density(table(spark, sf_dir, "part"), "p_name", "p_retailprice")
    return out.withColumns({"x": fixed(F.col("x")), "density": fixed(F.col("density"), 9)})


@register.add(
    "monthly_prices_top",
    f"""
    WITH m AS (SELECT p_name, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month,
                      CAST(date_trunc('month', l_shipdate) AS DATE) AS year_month, avg(l_extendedprice) AS price
               FROM {PRICED_SQL} GROUP BY ALL),
    t AS (SELECT p_name FROM m GROUP BY p_name ORDER BY count(*) DESC, p_name LIMIT 10)
    SELECT p_name, year, month, year_month, {sql_fixed("price", 4)} AS price
    FROM m WHERE p_name IN (SELECT p_name FROM t)
    """,
)
def top_monthly_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = monthly_rollup(
        priced_parts(spark, sf_dir), "l_shipdate", ["p_name"], means={"price": "l_extendedprice"}
    )
    return fixed_all(monthly_prices(panel.drop("year_month"), "p_name", "price"), "price", digits=4)


@register.add(
    "binned_density",
    f"""
    WITH r AS (SELECT l_returnflag AS g, l_extendedprice AS v FROM lineitem),
    b AS (SELECT g, count(*) AS n, min(v) AS lo, (max(v) - min(v)) / 199 AS step, max(v) - min(v) AS span,
                 pow(count(*), -0.2) * stddev_samp(v) AS h FROM r GROUP BY g HAVING stddev_samp(v) > 0),
    d AS (SELECT *, span / ceil(span / (h * sqrt(8 * 1e-6::DOUBLE))) AS cell FROM b),
    s AS (SELECT g, CAST(floor((v - lo) / cell) AS BIGINT) AS at_, (v - lo) / cell - floor((v - lo) / cell) AS part
          FROM r JOIN d USING (g)),
    c AS (SELECT g, at_, sum(w) AS w FROM (SELECT g, at_, 1 - part AS w FROM s UNION ALL SELECT g, at_ + 1, part FROM s)
          WHERE w > 0 GROUP BY ALL),
    p AS (SELECT CAST(unnest(generate_series(0, 199)) AS INTEGER) AS point)
    SELECT g AS l_returnflag, point, {sql_fixed("lo + point * step")} AS x,
           {sql_fixed("sum(w * exp(-pow((lo + point * step - lo - at_ * cell) / h, 2) / 2)) / (n * h * sqrt(2 * pi())) * 1e4")}
               AS density
    FROM c JOIN d USING (g) CROSS JOIN p GROUP BY g, point, lo, step, n, h
    """,
)
def price_curve_of_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The density of all line prices from counts on a grid, ten thousand times."""
    out = binned_density(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice")
    return out.withColumns({"x": fixed(F.col("x")), "density": fixed(F.col("density") * 1e4)})


@register.add(
    "sketch_ranges",
    f"""
    SELECT o_orderpriority, CAST(year(o_orderdate) AS INTEGER) AS year, count(o_totalprice) AS n,
           {sql_fixed("sum(o_totalprice)", 2)} AS total, {sql_fixed("min(o_totalprice)", 2)} AS least,
           {sql_fixed("max(o_totalprice)", 2)} AS most, count(DISTINCT o_custkey) AS distinct,
           {sql_fixed("quantile_disc(o_totalprice, 0.5)", 2)} AS middle,
           {sql_fixed("quantile_disc(o_totalprice, 0.95)", 2)} AS high
    FROM orders GROUP BY ALL
    """,
)
def sketch_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years from stored sketches of months; groups of up to 4096 values are exact, larger ones within 0.13 %."""
    stored = keep_table(
        month_sketches(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderdate", "o_totalprice", "o_custkey")
    )
    by_year = stored.withColumn("year", F.year("month"))
    out = merged_sketches(by_year, ["o_orderpriority", "year"], {"middle": 0.5, "high": 0.95})
    return fixed_all(out, "total", "least", "most", "middle", "high", digits=2)


HEAVY_KEY = "CASE WHEN l_linenumber <= 2 THEN NULL WHEN l_linenumber = 3 THEN -1 ELSE l_suppkey END"


@register.add(
    "merge_heavy_keys",
    f"""
    WITH a AS (SELECT {HEAVY_KEY} AS k, l_orderkey, l_linenumber, l_partkey FROM lineitem),
    b AS (SELECT s_suppkey + 5 AS k, s_name FROM supplier UNION ALL SELECT NULL, 'none ' || n_name FROM nation
          UNION ALL SELECT -2, r_name FROM region)
    SELECT a.k IS NULL AND b.k IS NULL AS no_key, coalesce(a.k, b.k) AS k, s_name, count(l_orderkey) AS n,
           CAST(sum(l_partkey) AS BIGINT) AS parts
    FROM a FULL JOIN b ON a.k IS NOT DISTINCT FROM b.k GROUP BY ALL
    """,
)
def heavy_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full merge in which a null key, and one that only one side has, hold a large share of the rows."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.expr(HEAVY_KEY).alias("k"), "l_orderkey", "l_linenumber", "l_partkey"
    )
    none = table(spark, sf_dir, "nation").select(F.lit(None).cast("long").alias("k"), F.concat(F.lit("none "), "n_name").alias("s_name"))
    alone = table(spark, sf_dir, "region").select(F.lit(-2).cast("long").alias("k"), F.col("r_name").alias("s_name"))
    names = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 5).alias("k"), "s_name")
    merged = merge_heavy(lines, names.union(none).union(alone), ["k"], "outer")
    return merged.groupBy("k", "s_name").agg(
        F.count("l_orderkey").alias("n"), F.sum("l_partkey").alias("parts")
    ).select(F.col("k").isNull().alias("no_key"), "k", "s_name", "n", "parts")
