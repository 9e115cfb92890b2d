"""Text to typed values. Bad input becomes NULL, never an error."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from ledgerloom import constants as C


def missing_to_null(text: Column) -> Column:
    return F.when(~text.isin(*C.CSV_MISSING), text)


def parse_float(text: Column) -> Column:
    return text.try_cast("double")


def parse_int(text: Column) -> Column:
    """Ids may arrive as ``12.0``, so integers are read through double."""
    return text.try_cast("double").try_cast("bigint")


def parse_date(text: Column) -> Column:
    cleaned = F.initcap(F.trim(text))
    return F.coalesce(
        *[F.when(cleaned.rlike(shape), F.try_to_timestamp(cleaned, F.lit(fmt)).cast("date"))
          for fmt, shape in zip(C.DATE_FORMATS, C.DATE_SHAPES, strict=True)]
    )


def parse_money(text: Column) -> Column:
    """``€1.2bn`` / ``€100m`` / ``€500k`` / ``€5Th.`` to euros."""
    body = F.trim(F.regexp_replace(text, "€", ""))
    scale = (
        F.when(body.endswith("bn"), 1e9)
        .when(body.endswith("m"), 1e6)
        .when(body.endswith("k") | body.endswith("Th."), 1e3)
        .otherwise(1.0)
    )
    number = F.trim(F.regexp_replace(body, r"(bn|m|k|Th\.)$", ""))
    return number.try_cast("double") * scale


def parse_fee(text: Column) -> Column:
    cleaned = F.trim(text)
    plain = F.regexp_replace(cleaned, ",", "").try_cast("double")
    return F.when(
        ~F.lower(cleaned).isin(*C.NO_FEE_WORDS), F.coalesce(plain, parse_money(cleaned))
    )


def parse_height_cm(text: Column) -> Column:
    """Leading number with a point or comma; metres become centimetres."""
    digits = F.regexp_extract(F.trim(text), r"^(\d+[.,]?\d*)", 1)
    value = F.translate(digits, ",", ".").try_cast("double")
    return F.when(value < 3, F.round(value * 100, 2)).otherwise(value)


def join_citizenship(names: Column) -> Column:
    kept = F.filter(F.transform(names, lambda n: F.trim(n)), lambda n: n.isNotNull() & (n != ""))
    return F.when(F.size(kept) > 0, F.array_join(kept, ", "))


def slug(name: Column) -> Column:
    folded = F.translate(F.lower(name), C.SLUG_FROM, C.SLUG_TO)
    kept = F.regexp_replace(folded, r"[^\p{L}\p{N}\s-]", "")
    hyphenated = F.regexp_replace(F.trim(F.regexp_replace(kept, r"\s+", " ")), " ", "-")
    return F.coalesce(F.regexp_replace(hyphenated, "^-+|-+$", ""), F.lit(""))


def club_code_from_url(url: Column) -> Column:
    """First path segment, unless it is the generic landing page."""
    first = F.get(F.split(F.regexp_replace(url, "^/+|/+$", ""), "/"), F.lit(0))
    return F.when(url.contains("/") & (first != "") & (first != "startseite"), first)


def like_pattern(text: str) -> str:
    """A contains-pattern with ``%`` and ``_`` of the user's text taken literally."""
    escaped = reduce(lambda s, ch: s.replace(ch, "\\" + ch), ("\\", "%", "_"), text)
    return f"%{escaped}%"
