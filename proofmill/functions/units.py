"""Units: families for pairing, keys and factors for comparing values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from proofmill.functions.text import filled, normalize, tokens, ustrip

#: Aliases of unit words.
ALIASES = {
    "rs": "inr",
    "rupees": "inr",
    "crores": "crore",
    "cr": "crore",
    "lakhs": "lakh",
    "mn": "million",
    "bn": "billion",
    "%": "percent",
    "percentage": "percent",
    "number": "count",
    "times": "time",
}

#: The literal replacements of a unit key, in the order that fixes the results; the
#: second form of each list is the repaired one, which rewrites whole words only.
REPLACEMENTS = [
    ("₹", "inr"), ("$", "usd"), ("rs.", "inr"), ("rs", "inr"), ("rupees", "inr"), ("rupee", "inr"),
    ("us dollars", "usd"), ("us dollar", "usd"), ("dollars", "usd"), ("dollar", "usd"),
    ("crores", "crore"), ("cr", "crore"), ("millions", "million"), ("mn", "million"),
    ("billions", "billion"), ("bn", "billion"), ("lakhs", "lakh"), ("lacs", "lakh"), ("lac", "lakh"),
]
SCALES = ("million", "billion", "crore", "lakh")

#: Currency and factor of each known key.
FACTORS = {
    "inr": ("INR", 1.0),
    "inr_lakh": ("INR", 1e5),
    "inr_million": ("INR", 1e6),
    "inr_crore": ("INR", 1e7),
    "inr_billion": ("INR", 1e9),
    "usd": ("USD", 1.0),
    "usd_million": ("USD", 1e6),
    "usd_billion": ("USD", 1e9),
}


def _choice(c: Column, values: dict) -> Column:
    pairs = [F.lit(x) for item in values.items() for x in item]
    return F.element_at(F.create_map(*pairs), c)


def unit_tokens(unit: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(tokens(normalize(unit)), lambda t: F.coalesce(_choice(t, ALIASES), t))))


def unit_family(unit_tokens_: Column) -> Column:
    """percent, time, count, currency or null."""
    has = lambda *xs: F.arrays_overlap(unit_tokens_, F.array(*map(F.lit, xs)))
    return F.when(has("percent"), "percent").when(has("time"), "time").when(has("count"), "count").when(has("inr", *SCALES), "currency")


def same_unit(unit_a: Column, unit_b: Column) -> Column:
    """True unless both units are of known, different families."""
    a, b = unit_tokens(unit_a), unit_tokens(unit_b)
    fa, fb = unit_family(a), unit_family(b)
    return F.when(filled(unit_a).isNull() | filled(unit_b).isNull() | (a == b) | fa.isNull() | fb.isNull(), True).otherwise(fa == fb)


def same_value_type(a: Column, b: Column) -> Column:
    a, b = normalize(a), normalize(b)
    return (a == "") | (b == "") | (a == b)


def unit_key(unit: Column, strict_units: bool = False) -> Column:
    """The canonical key; ``strict_units`` repairs the spellings that the plain replacements spoil."""
    key = F.lower(ustrip(F.coalesce(unit, F.lit(""))))
    if strict_units:
        key = F.regexp_replace(key, r"us\s*\$|\$|\bus dollars?\b|\bdollars?\b", " usd ")
        key = F.regexp_replace(key, r"₹|\brs\.?(?=\W|$)|\brupees?\b", " inr ")
        for old, new in REPLACEMENTS[10:]:
            key = F.regexp_replace(key, rf"\b{old}\b", new)
    else:
        for old, new in REPLACEMENTS:
            key = F.replace(key, F.lit(old), F.lit(new))
    key = F.regexp_replace(F.regexp_replace(F.regexp_replace(key, r"(?U)\s+", "_"), "_+", "_"), "^_|_$", "")
    return F.regexp_replace(key, f"^({'|'.join(SCALES)})_(inr|usd)$", "$2_$1")


def currency(key: Column) -> Column:
    return _choice(key, {k: c for k, (c, _) in FACTORS.items()})


def factor(key: Column) -> Column:
    return _choice(key, {k: f for k, (_, f) in FACTORS.items()})


def base_reason(base_a: Column, currency_a: Column, key_a: Column, base_b: Column, currency_b: Column, key_b: Column, tolerance: float = 0.02) -> Column:
    """``value_reason`` of values in their base units, with the currencies of their keys."""
    difference = F.abs(base_a - base_b) / F.greatest(F.abs(base_a), F.abs(base_b), F.lit(1e-9))
    return (
        F.when(currency_a.isNull() | currency_b.isNull(), "UNIT_UNRECOGNIZED")
        .when(currency_a != currency_b, "UNIT_INCOMPATIBLE")
        .when(base_a == base_b, F.when(key_a == key_b, "EXACT_MATCH").otherwise("UNIT_NORMALIZATION"))
        .when(difference <= tolerance, "ROUNDING")
        .otherwise("NUMERIC_DISCREPANCY")
    )


def value_reason(value_a: Column, key_a: Column, value_b: Column, key_b: Column, tolerance: float = 0.02) -> Column:
    """Why two values agree (EXACT_MATCH, UNIT_NORMALIZATION, ROUNDING) or don't (UNIT_UNRECOGNIZED, UNIT_INCOMPATIBLE, NUMERIC_DISCREPANCY)."""
    return base_reason(value_a * factor(key_a), currency(key_a), key_a, value_b * factor(key_b), currency(key_b), key_b, tolerance)


def agrees(reason: Column) -> Column:
    return reason.isin("EXACT_MATCH", "UNIT_NORMALIZATION", "ROUNDING")
