"""Parsing, key and text queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.dates import parse_timestamp, strict_date
from tidemark.functions.numbers import (
    currency_to_number,
    round_half_even,
    to_integer,
    to_number,
    to_number_or_zero,
)
from tidemark.functions.text import (
    KeyRule,
    canonical_key,
    classify,
    collapse_spaces,
    html_text,
    last_part,
    strip_accents,
)
from tidemark.operators.joins import attach_dimension
from tidemark.sources.observations import observations_from_json
from tidemark.sources.pages import label_pages
from workloads.base import Register, fixed, sql_fixed, table

register = Register()


@register.add(
    "clean_currency",
    f"""
    SELECT o_orderkey,
           CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS price,
           CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS price_number,
           CASE WHEN o_orderstatus = 'P' THEN 0.0 ELSE o_totalprice END AS price_or_zero,
           CAST(o_custkey AS INTEGER) AS customer
    FROM orders
    """,
)
def clean_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Currency text and plain number text; pending orders hold junk or nothing."""
    orders = table(spark, sf_dir, "orders")
    amount = F.format_number("o_totalprice", 2)
    pending = F.col("o_orderstatus") == "P"
    texts = orders.select(
        "o_orderkey",
        "o_custkey",
        F.when(pending, F.lit(" USD")).otherwise(F.concat(F.lit("$"), amount, F.lit(" USD"))).alias("currency"),
        F.when(pending, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string")).alias("plain"),
    )
    return texts.select(
        "o_orderkey",
        currency_to_number(F.col("currency")).alias("price"),
        to_number(F.col("plain")).alias("price_number"),
        to_number_or_zero(F.col("plain")).alias("price_or_zero"),
        to_integer(F.col("o_custkey")).alias("customer"),
    )


@register.add(
    "parse_dates",
    """
    SELECT o_orderkey,
           CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS parsed,
           CAST(o_orderdate AS DATE) AS strict
    FROM orders
    """,
)
def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in several layouts, unreadable ones for pending orders."""
    orders = table(spark, sf_dir, "orders")
    day = F.col("o_orderdate")
    layouts = (
        "M/d/yyyy", "MMMM d, yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "M/d/yyyy H:mm:ss", "yyyy/MM/dd", "M/d/yy",
        "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "yyyy-MM-dd HH:mm", "dd-MMM-yyyy", "d MMM yyyy", "M/d/yyyy h:mm a",
    )
    text = F.lit("31/31/2020")
    for i, layout in enumerate(layouts):
        # Two-digit years stand for this century.
        fits = F.col("o_orderkey") % len(layouts) == i
        shown = F.date_format(day, layout)
        if "yyyy" not in layout:
            shown = F.when(F.year(day) >= 2000, shown).otherwise(F.date_format(day, "M/d/yyyy"))
        text = F.when((F.col("o_orderstatus") != "P") & fits, shown).otherwise(text)
    return orders.select(
        "o_orderkey",
        parse_timestamp(text).cast("date").alias("parsed"),
        strict_date(F.date_format(day, "yyyy-MM-dd")).alias("strict"),
    )


@register.add(
    "drop_missing",
    """
    SELECT c_nationkey, count(*) AS row_count
    FROM customer WHERE c_acctbal >= 0 AND c_mktsegment <> 'MACHINERY' GROUP BY c_nationkey
    """,
)
def drop_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows null in either of two columns are dropped before counting."""
    customer = table(spark, sf_dir, "customer").select(
        "c_nationkey",
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"),
        F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment")).alias("segment"),
    )
    kept = customer.na.drop(subset=["balance", "segment"])
    return kept.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("row_count"))


KEY_RULES = (KeyRule(r"small\s*w", "widget", "widget 1"), KeyRule(r"large\s*w", "widget", "widget 2"))


@register.add(
    "canonical_key",
    r"""
    WITH k AS (
        SELECT p_partkey, trim(lower('  ' || upper(p_name) || ' ')) AS cleaned FROM part
    )
    SELECT p_partkey, cleaned,
           CASE WHEN regexp_matches(cleaned, 'small\s*w') AND contains(cleaned, 'widget') THEN 'widget 1'
                WHEN regexp_matches(cleaned, 'large\s*w') AND contains(cleaned, 'widget') THEN 'widget 2'
                ELSE cleaned END AS series
    FROM k
    """,
)
def canonical_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    name = F.concat(F.lit("  "), F.upper("p_name"), F.lit(" "))
    return part.select(
        "p_partkey", canonical_key(name).alias("cleaned"), canonical_key(name, KEY_RULES).alias("series")
    )


@register.add(
    "location_country",
    """
    SELECT r_name AS country, count(*) AS customers, sum(CASE WHEN r_name = 'EUROPE' THEN 1 ELSE 0 END)::BIGINT AS home
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    GROUP BY r_name
    """,
)
def location_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Country is the last comma part of "segment, nation,  region "."""
    customer, nation, region = (table(spark, sf_dir, n) for n in ("customer", "nation", "region"))
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    located = customer.withColumnRenamed("c_nationkey", "n_nationkey")
    located = attach_dimension(located, places, ["n_nationkey"], ["n_name", "r_name"])
    text = F.concat_ws(", ", "c_mktsegment", "n_name", F.concat(F.lit(" "), F.col("r_name"), F.lit(" ")))
    country = located.select(last_part(text).alias("country"))
    home = F.count(F.when(F.col("country") == "EUROPE", 1))
    return country.groupBy("country").agg(F.count(F.lit(1)).alias("customers"), home.alias("home"))


@register.add(
    "round_half_even",
    """
    SELECT l_orderkey, l_linenumber, round_even(l_extendedprice / 8 * 100, 0) / 100 AS eighth
    FROM lineitem
    """,
)
def rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    eighth = round_half_even(F.col("l_extendedprice") / 8, 2)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", eighth.alias("eighth"))


@register.add(
    "strip_accents",
    "SELECT doc_id, strip_accents(text) AS plain FROM documents",
)
def stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", strip_accents(F.col("text")).alias("plain"))


@register.add(
    "collapse_spaces",
    r"""SELECT doc_id, trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')) AS line FROM documents""",
)
def collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", collapse_spaces(F.col("text")).alias("line"))


TEXT_RULES = (
    ("accented-first", ("ecio", "nacion")),
    ("french", ("eaux", "tre ")),
    ("german", ("lich", "sch")),
)


@register.add(
    "text_classify",
    """
    WITH t AS (SELECT doc_id, lang, lower(strip_accents(text)) AS p FROM documents)
    SELECT doc_id, lang,
           CASE WHEN contains(p, 'ecio') OR contains(p, 'nacion') THEN 'accented-first'
                WHEN contains(p, 'eaux') OR contains(p, 'tre ') THEN 'french'
                WHEN contains(p, 'lich') OR contains(p, 'sch') THEN 'german'
                ELSE 'Unknown' END AS label
    FROM t
    """,
)
def text_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return documents.select("doc_id", "lang", classify(F.col("text"), TEXT_RULES, "Unknown").alias("label"))


# Page text as the oracle sees it: hidden parts and tags become chr(1), and the four
# references that the raw pages hold are read.
TAG_TEXT_SQL = r"""
    replace(replace(replace(replace(
        regexp_replace(
            regexp_replace(html,
                '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<template\b.*?</template\s*>|<!--.*?-->',
                chr(1), 'g'),
            '<[^>]*>', chr(1), 'g'),
        '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&')
"""


@register.add(
    "html_text",
    rf"""
    SELECT page_id, trim(regexp_replace(replace({TAG_TEXT_SQL}, chr(1), ' '), '[\s\p{{Z}}]+', ' ', 'g')) AS shown
    FROM pages
    """,
)
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", html_text(with_references(F.col("html"))).alias("shown"))


def with_references(html: Column) -> Column:
    """Accented letters written as named, decimal and hexadecimal references; the oracle reads the raw pages."""
    for char, reference in (("ñ", "&ntilde;"), ("ó", "&#243;"), ("é", "&#xE9;"), ("ß", "&szlig;")):
        html = F.replace(html, F.lit(char), F.lit(reference))
    return html


PAGE_RULES = (("spanish", ("cion",)), ("french", ("eau",)), ("german", ("sch", "lich")))


@register.add(
    "html_section",
    rf"""
    WITH h AS (
        SELECT page_id, CASE WHEN contains(url, '?page') THEN NULL ELSE html END AS html FROM pages
    ), t AS (SELECT page_id, html, {TAG_TEXT_SQL} AS shown FROM h),
    s AS (
        SELECT page_id, html,
               regexp_extract(shown, '(?s)' || chr(1) || '[\s\p{{Z}}' || chr(1) || ']*The(.*)', 1) AS tail FROM t
    ), c AS (
        SELECT page_id, html,
               trim(split_part(trim(regexp_replace(replace(tail, chr(1), ' '), '[\s\p{{Z}}]+', ' ', 'g')), '©', 1))
                   AS section
        FROM s
    ), d AS (
        SELECT page_id, html,
               trim(CASE WHEN starts_with(section, 'The') THEN substr(section, 4) ELSE section END) AS section
        FROM c
    ), p AS (SELECT page_id, html, section, lower(strip_accents(section)) AS plain FROM d)
    SELECT page_id,
           CASE WHEN html IS NULL THEN 'ERROR' WHEN contains(plain, 'cion') THEN 'spanish'
                WHEN contains(plain, 'eau') THEN 'french'
                WHEN contains(plain, 'sch') OR contains(plain, 'lich') THEN 'german' ELSE 'Unknown' END AS label,
           coalesce(section, '') AS section
    FROM p
    """,
)
def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section between markers and its label; paged URLs stand for failed pages."""
    pages = table(spark, sf_dir, "pages").withColumn(
        "html", F.when(~F.col("url").contains("?page"), with_references(F.col("html")))
    )
    return label_pages(
        pages, ["page_id"], start="The", stop="©", rules=PAGE_RULES, label="label", section="section"
    )


@register.add(
    "json_observations",
    f"""
    SELECT event_type, CAST(ts AS DATE) AS date, count(*) AS observations,
           {sql_fixed("sum(CASE WHEN event_type = 'error' THEN NULL ELSE value END)", 4)} AS total,
           sum(CAST(props->>'k' AS BIGINT))::BIGINT AS k_total
    FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-26' AND event_type <> 'signup'
    GROUP BY ALL
    """,
)
def json_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payload text per event (empty for signups, "." for errors) to typed rows."""
    events = table(spark, sf_dir, "events")
    value = F.when(F.col("event_type") == "error", F.lit(".")).otherwise(F.col("value").cast("string"))
    item = F.array(F.struct(F.date_format("ts", "yyyy-MM-dd").alias("date"), value.alias("value")))
    none = F.filter(item, lambda x: F.lit(False))
    body = F.when(F.col("event_type") == "signup", none).otherwise(item)
    payloads = events.select(
        "event_type",
        F.from_json("props", "k bigint")["k"].alias("k"),
        F.to_json(F.struct(body.alias("observations"))).alias("payload"),
    )
    rows = observations_from_json(payloads, "payload", ("event_type", "k"), "2024-01-05", "2024-01-25")
    return rows.groupBy("event_type", "date").agg(
        F.count(F.lit(1)).alias("observations"),
        fixed(F.sum("value"), 4).alias("total"),
        F.sum("k").alias("k_total"),
    )
