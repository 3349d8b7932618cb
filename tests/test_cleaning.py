"""Column functions on awkward values."""

from __future__ import annotations

import datetime as dt
import unicodedata

import pytest
from pyspark.sql import functions as F

from tidemark.functions.dates import (
    between_flag,
    layout_pattern,
    month_sequence,
    parse_timestamp,
    since_flag,
)
from tidemark.functions.numbers import (
    clip_at_zero,
    currency_to_number,
    round_half_even,
    safe_zscore,
    to_number,
    to_number_or_zero,
)
from tidemark.functions.text import (
    KeyRule,
    canonical_key,
    classify,
    collapse_spaces,
    html_section,
    html_text,
    last_part,
    numbered_course_rules,
    strip_accents,
)


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")


def apply(spark, values, function, kind="string"):
    df = column(spark, values, kind).select("i", function(F.col("x")).alias("y"))
    return [r.y for r in sorted(df.collect())]


def test_numbers(spark):
    texts = ["12", " 1.5 ", "-3e2", "", "abc", None, "1d", "NaN", "7.", ".5", "1,200"]
    assert apply(spark, texts, to_number) == [12, 1.5, -300, None, None, None, None, None, 7, 0.5, None]
    assert apply(spark, ["x", None, "4"], to_number_or_zero) == [0, 0, 4]


def test_currency(spark):
    texts = ["$390.00", "1,200", "USD -5.5", "free", "", None, "$1.2.3"]
    assert apply(spark, texts, currency_to_number) == [390, 1200, -5.5, None, None, None, None]


def test_rounding_ties(spark):
    values = [0.125, 0.375, 2.675, -0.125, None]
    assert apply(spark, values, lambda x: round_half_even(x, 2), "double") == [0.12, 0.38, 2.68, -0.12, None]


def test_clip_keeps_null(spark):
    assert apply(spark, [-1.0, 0.0, 2.0, None], clip_at_zero, "double") == [0, 0, 2, None]


@pytest.mark.parametrize("std", [None, 0.0])
def test_flat_column_scores_zero(spark, std):
    score = lambda x: safe_zscore(x, F.lit(1.0), F.lit(std).cast("double"))
    assert apply(spark, [1.0, None], score, "double") == [0, 0]


def test_dates(spark):
    texts = ["2020-02-30", "2020-02-29", "3/7/2021", "3/7/2021 14:05", "March 5, 2019", "Mar 5, 2019", "soon", None]
    got = apply(spark, texts, lambda x: parse_timestamp(x).cast("date"))
    want = [None, dt.date(2020, 2, 29), *[dt.date(2021, 3, 7)] * 2, *[dt.date(2019, 3, 5)] * 2, None, None]
    assert got == want


def test_layout_pattern():
    assert layout_pattern("M/d/yyyy") == r"^\d{1,2}/\d{1,2}/\d{4}$"


def test_flags_are_closed_and_null_safe(spark):
    days = [dt.date(2020, 7, 31), dt.date(2020, 8, 1), dt.date(2021, 8, 31), dt.date(2021, 9, 1), None]
    assert apply(spark, days, lambda x: between_flag(x, "2020-08-01", "2021-08-31"), "date") == [0, 1, 1, 0, 0]
    assert apply(spark, days, lambda x: since_flag(x, "2021-08-31"), "date") == [0, 0, 1, 1, 0]


def test_month_sequence_can_be_empty(spark):
    days = [dt.date(2020, 1, 1), dt.date(2020, 3, 1), dt.date(2020, 4, 1)]
    got = apply(spark, days, lambda x: F.size(month_sequence(x, F.lit("2020-03-01").cast("date"))), "date")
    assert got == [3, 1, 0]


def test_canonical_keys(spark):
    rules = numbered_course_rules("level")
    names = ["  LEVEL 1 + Rescue ", "Level2 rescue", "Level 1", "Rescue", "\tLevel 2 ", None, "rescue level  1"]
    want = ["level 1", "level 2", "level 1", "rescue", "level 2", None, "level 1"]
    assert apply(spark, names, lambda x: canonical_key(x, rules)) == want


def test_later_rule_sees_earlier_result(spark):
    rules = [KeyRule("a", "a", "b c"), KeyRule("b", "c", "d")]
    assert apply(spark, ["a", "b c", "x"], lambda x: canonical_key(x, rules)) == ["d", "d", "x"]


def test_last_part(spark):
    places = ["Town, State, Land ", "Land", "", "a,", None]
    assert apply(spark, places, last_part) == ["Land", "Land", "", "", None]


def test_spaces(spark):
    assert apply(spark, [" a \n\t b c ", ""], collapse_spaces) == ["a b c", ""]


def test_strip_accents_follows_unicode(spark):
    texts = ["La Niña", "El Niño", "éàüÅøß", "Straße ﬁ", "漢字", "½ Ａｂｃ ①", "ǆ ㎏", "ﷺ", "\U0001d400x"]
    got = apply(spark, texts, strip_accents)
    for text, plain in zip(texts, got):
        base = unicodedata.normalize("NFKD", text)
        want = "".join(c for c in base if not unicodedata.combining(c))
        assert plain == want


def test_classifier_order(spark):
    rules = (("neutral", ("enso-neutral", "enso neutral")), ("girl", ("la nina",)), ("boy", ("el nino",)))
    texts = ["La Niña then ENSO-neutral", "EL NIÑO after La Nina", "el niño", "calm", ""]
    assert apply(spark, texts, lambda x: classify(x, rules, "Unknown")) == ["neutral", "girl", "boy", "Unknown", "Unknown"]


PAGE = """<html><head><title>Outlook: not this</title><script>var a = "<p>Outlook: no</p>";</script></head><body>
<!-- Outlook: hidden --><p>See the Outlook: below</p><div><p><b> Outlook: </b><br>La&nbsp;Niña
is <i>likely</i> &amp; strong.</p></div><p>Discussion: more</p></body></html>"""


def test_section(spark):
    body = PAGE.replace("<title>Outlook: not this</title>", "")
    pages = [body, "<p>nothing</p>", "<p>Outlook: to the <b>end</b></p>", None]
    got = apply(spark, pages, lambda x: html_section(x, "Outlook:", "Discussion:"))
    assert got == ["La Niña is likely & strong.", "", "to the end", None]


def test_page_text_shows_no_scripts(spark):
    (text,) = apply(spark, [PAGE], html_text)
    assert "var a" not in text and "hidden" not in text and "likely & strong." in text
