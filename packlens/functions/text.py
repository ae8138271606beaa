"""Scalar text functions as Column builders: normalisation, evidence, keys, currency, addresses, amounts.

Patterns are ASCII unless ``(?U)`` says otherwise, so the same patterns mean the same to other SQL engines.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that make a text look like an address.
ADDRESS_WORDS = ("road", "rd", "street", "st", "sector", "phase", "industrial", "nagar", "colony", "district", "dist", "india")
#: Where a locator word points to.
LOCATORS = {"seam": "seal", "crimp": "seal", "base": "bottom", "cap": "top", "lid": "top", "neck": "top"}


def settled(df: DataFrame, **made: Column) -> DataFrame:
    """Adds columns that are worked out once for each row: a generator of one row keeps what follows from repeating them."""
    row = F.explode(F.array(F.struct(*(c.alias(n) for n, c in made.items()))))
    kept = [F.col(c) for c in df.columns if c not in made]
    return df.select(*kept, row.alias("_settled")).select(*kept, *(F.col(f"_settled.{n}").alias(n) for n in made))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` inside a row's expression, the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def places(text: Column, pattern: str) -> Column:
    """struct(at, said) of all matches of a pattern, in order: the lengths of what lies between and of the matches give the places."""
    parts = F.struct(F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("said"))
    upto = lambda parts, n: F.aggregate(F.slice(parts, F.lit(1), n), F.lit(0), lambda s, x: s + F.length(x))
    at = lambda x, i: upto(x["between"], i + 1) + upto(x["said"], i)
    return once(parts, lambda x: F.transform(x["said"], lambda m, i: F.struct(at(x, i).alias("at"), m.alias("said"))))


#: Unicode's white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space at either end (``trim`` takes spaces only)."""
    return F.btrim(c, F.lit(WHITE))


def normal_text(c: Column) -> Column:
    """Recognised text: line ends as LF, runs of spaces and tabs as one space, at most one empty line, stripped."""
    one_kind = F.regexp_replace(F.translate(c, "\r", "\n"), "[ \t]{2,}|\t", " ")  # a single space stays as it is
    return strip(F.regexp_replace(one_kind, "\n{3,}", "\n\n"))


def compact(c: Column, limit: int = 220) -> Column:
    """White space as single spaces, stripped, cut at ``limit`` characters."""
    return F.left(strip(F.regexp_replace(c, r"(?U)\s+", " ")), F.lit(limit))


def found(text: Column, pattern: str, group: int) -> Column:
    """A group of the first match; null if there is none or the group is empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def line_of(text: Column, pattern: str) -> Column:
    """The evidence for a match: the line in which it begins, compact. By characters, also after an emoji."""
    flags, body = ("(?is)", pattern[4:]) if pattern.startswith("(?i)") else ("(?s)", pattern)
    before = F.regexp_extract(text, f"{flags}^(.*?)(?:{body})", 1)
    line = lambda b: F.concat(F.substring_index(b, "\n", -1), F.substring_index(F.substring(text, F.length(b) + 1, F.length(text)), "\n", 1))
    return compact(once(before, line))


def key_text(c: Column) -> Column:
    """Lower case with everything but letters a-z, digits and the rupee sign as single spaces."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9₹]+", " "))


def compact_label(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9₹]+", "")


def joined_evidence(*parts: Column) -> Column:
    """The non-empty parts, joined by bars, cut at 220 characters."""
    return F.left(F.array_join(F.filter(F.array(*(strip(p) for p in parts)), lambda x: x != ""), " | "), F.lit(220))


def currency(token: Column, tolerant: bool = False) -> Column:
    """INR for the rupee's signs; the tolerant form also takes what recognition makes of them."""
    known = ["₹", "rs", "inr", *(["r5", "re"] if tolerant else [])]
    return F.when(F.replace(F.lower(strip(token)), F.lit("."), F.lit("")).isin(known), "INR")


def is_address(c: Column) -> Column:
    words = "|".join(ADDRESS_WORDS)
    commas = F.length(c) - F.length(F.replace(c, F.lit(","), F.lit("")))
    return c.rlike(r"\b\d{6}\b") | (commas >= 2) | c.rlike(rf"(?i)\b(?:{words})\b")


def decimal(c: Column) -> Column:
    """A number of at most 14 whole and 6 decimal digits; null where it can't be read."""
    return c.try_cast("decimal(20,6)")


def plain_number(c: Column) -> Column:
    """A decimal's plain text: no point for whole numbers, no zeros at the end of others."""
    text = decimal(c).cast("string")
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def canonical_amount(c: Column) -> Column:
    """An amount read with O for 0; the cleaned text itself where it is no number."""
    clean = F.translate(c, "Oo", "00")
    return F.coalesce(plain_number(clean), clean)


def locator(c: Column) -> Column:
    low = F.lower(c)
    return F.coalesce(reduce(lambda a, kv: a.when(low == kv[0], kv[1]), LOCATORS.items(), F.when(F.lit(False), "")), low)


def word_chars(c: Column) -> Column:
    """How many letters, digits and underscores a text has."""
    return F.length(F.regexp_replace(c, r"(?U)\W+", ""))


def distinct_texts(array: Column) -> Column:
    """The non-empty texts, each once, in the order in which they come first."""
    return F.array_distinct(F.filter(array, lambda x: x.isNotNull() & (x != "")))
