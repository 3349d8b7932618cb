"""Key normalisation, accent stripping, ordered classifiers and tag text."""

from __future__ import annotations

import html.entities
import re
import sys
import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"[\s\p{Z}]+"
# Every character that counts as white space.
SPACE_CHARS = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())


def collapse_spaces(text: Column) -> Column:
    """Runs of white space become one space; the ends are trimmed."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def clean_key(text: Column) -> Column:
    """Trimmed, lower-case grouping key."""
    return F.lower(F.trim(text, F.lit(SPACE_CHARS)))


@dataclass(frozen=True)
class KeyRule:
    """Names that match ``pattern`` and contain ``marker`` become ``key``."""

    pattern: str
    marker: str
    key: str


def numbered_course_rules(brand: str, levels: Sequence[int] = (1, 2), marker: str = "rescue") -> list[KeyRule]:
    """Fold "<brand> <level> ... <marker>" bundle names into "<brand> <level>"."""
    return [KeyRule(rf"{re.escape(brand)}\s*{n}", marker, f"{brand} {n}") for n in levels]


def canonical_key(text: Column, rules: Sequence[KeyRule] = ()) -> Column:
    """Clean a name, then apply the rules in order, each to the result so far."""
    key = clean_key(text)
    if any(_applies(later, rule.key) for i, rule in enumerate(rules) for later in rules[i + 1 :]):
        for rule in rules:
            key = F.when(_matches(key, rule), F.lit(rule.key)).otherwise(key)
        return key
    # No rule's key sets off a later rule, so the first match is final and one
    # CASE does, where nesting would repeat the key's expression in every layer.
    chain = None
    for rule in rules:
        chain = (F if chain is None else chain).when(_matches(key, rule), F.lit(rule.key))
    return key if chain is None else chain.otherwise(key)


def _matches(key: Column, rule: KeyRule) -> Column:
    return key.contains(rule.marker) & key.rlike(rule.pattern)


def _applies(rule: KeyRule, key: str) -> bool:
    return rule.marker in key and re.search(rule.pattern, key) is not None


def last_part(text: Column, separator: str = ",") -> Column:
    """Trimmed text after the last separator (all of it if there is none)."""
    return F.trim(F.substring_index(text, separator, -1))


@lru_cache(maxsize=1)
def _compatible_forms() -> tuple[str, str, dict[str, str]]:
    """Characters that decompose under NFKD, by the length of what is left without marks.

    One-to-one forms as two aligned texts, and the others (ligatures, fractions,
    signs of several letters) as a map.
    """
    single, plain, longer = [], [], {}
    for code in range(0x80, sys.maxunicode + 1):
        char = chr(code)
        if unicodedata.category(char) == "Cs" or unicodedata.combining(char):
            continue
        left = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if left == char:
            continue
        if len(left) == 1:
            single.append(char)
            plain.append(left)
        else:
            longer[char] = left
    return "".join(single), "".join(plain), longer


#: Korean syllables decompose by rule into letters; they are left whole.
HANGUL = (0xAC00, 0xD7A3)


def strip_accents(text: Column) -> Column:
    """Compatibility forms by their plain ones, combining marks dropped.

    A native expression made from the Unicode rule: free-standing marks go by a
    pattern, one-to-one forms by a foldable ``translate`` table. Forms of several
    characters (ligatures, fractions) are looked up character by character, only
    in texts that hold one.
    """
    single, plain, longer = _compatible_forms()
    longer = {c: left for c, left in longer.items() if not HANGUL[0] <= ord(c) <= HANGUL[1]}
    simple = F.translate(F.regexp_replace(text, r"\p{Mn}+", ""), single, plain)
    forms = F.str_to_map(F.lit("\u0001".join(f"{c}\u0002{left}" for c, left in longer.items())), F.lit("\u0001"), F.lit("\u0002"))
    # Such forms start above ASCII; one wide range is a cheap test where their exact list is not.
    above = f"[{min(longer)}-\\x{{10FFFF}}]"
    each = F.transform(
        F.split(simple, ""), lambda c: F.when(c < min(longer), c).otherwise(F.coalesce(F.try_element_at(forms, c), c))
    )
    return F.when(simple.rlike(above), F.array_join(each, "")).otherwise(simple)


def drop_prefix(text: Column, prefix: str) -> Column:
    return F.when(text.startswith(prefix), F.substring(text, len(prefix) + 1, 2**31 - 1)).otherwise(text)


def text_before(text: Column, marker: str) -> Column:
    return F.substring_index(text, marker, 1)


def classify(text: Column, rules: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """Label of the first rule that has a phrase in the accent-free lower-case text."""
    plain = F.lower(strip_accents(text))
    label = None
    for name, phrases in rules:
        hit = F.lit(False)
        for phrase in phrases:
            hit = hit | plain.contains(phrase)
        label = F.when(hit, F.lit(name)) if label is None else label.when(hit, F.lit(name))
    return F.lit(default) if label is None else label.otherwise(F.lit(default))


# A tag boundary in stripped text; no page holds this control character.
BOUNDARY = "\u0001"

# A reference in page text: a name, a decimal or a hexadecimal number.
REFERENCE = r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"


@lru_cache(maxsize=1)
def _named_references() -> str:
    """Names and characters of the standard library's table, for ``str_to_map``."""
    named = {n[:-1]: c for n, c in html.entities.html5.items() if n.endswith(";")}
    return "\u0001".join(f"{n}\u0002{c}" for n, c in named.items())


def decode_references(text: Column) -> Column:
    """Character references by their characters, in one pass.

    The text is split at references, so what one of them gives is never read as
    part of another. Unknown names and numbers outside Unicode stay as they are;
    a non-breaking space becomes a plain one.
    """
    named = F.str_to_map(F.lit(_named_references()), F.lit("\u0001"), F.lit("\u0002"))

    def decoded(name: Column) -> Column:
        whole = F.concat(F.lit("&"), name, F.lit(";"))
        hexadecimal = F.conv(F.substring(name, 3, 10), 16, 10)
        number = F.when(name.rlike("^#[xX]"), hexadecimal).otherwise(F.substring(name, 2, 10)).cast("int")
        # UTF-32 keeps numbers beyond 255, which ``char`` would cut.
        wide = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        by_number = F.when(valid, wide).otherwise(whole)
        return F.when(name.startswith("#"), by_number).otherwise(F.coalesce(F.try_element_at(named, name), whole))

    names = F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(1)), decoded)
    parts = F.zip_with(
        F.split(text, REFERENCE, -1), names, lambda part, char: F.concat(part, F.coalesce(char, F.lit("")))
    )
    joined = F.replace(F.array_join(parts, ""), F.lit("\u00a0"), F.lit(" "))
    return F.when(text.rlike(REFERENCE), joined).otherwise(text)


# Page parts that show no text.
HIDDEN = (
    r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<template\b.*?</template\s*>"
    r"|<!--.*?-->"
)


def _tag_text(html: Column) -> Column:
    """Text of a page with every run of tags replaced by the boundary mark."""
    shown = F.regexp_replace(html, HIDDEN, BOUNDARY)
    return decode_references(F.regexp_replace(shown, r"<[^>]*>", BOUNDARY))


def html_text(html: Column) -> Column:
    """Visible text of a page, white space collapsed."""
    return collapse_spaces(F.replace(_tag_text(html), F.lit(BOUNDARY), F.lit(" ")))


def html_section(html: Column, start: str, stop: str) -> Column:
    """Text from the tag that begins with ``start`` to the marker ``stop``.

    The start marker itself is dropped. Without a start marker the section is
    empty; without a stop marker it runs to the end of the page.
    """
    opening = BOUNDARY + r"[\s\p{Z}" + BOUNDARY + "]*" + re.escape(start)
    # DOTALL: a section may span lines.
    tail = F.regexp_extract(_tag_text(html), "(?s)" + opening + "(.*)", 1)
    shown = collapse_spaces(F.replace(tail, F.lit(BOUNDARY), F.lit(" ")))
    return F.trim(text_before(shown, stop))
