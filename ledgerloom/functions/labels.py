"""Classification of movements, players, fees and leagues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from ledgerloom import constants as C


def lookup(key: Column, table: dict[str, str]) -> Column:
    """Literal map lookup for the small fixed tables; unknown keys give NULL."""
    literal_map = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.try_element_at(literal_map, key)


def movement_type(fee: Column, from_name: Column, to_name: Column) -> Column:
    """paid, retired, contract_expired, youth_promotion, sent_to_reserves or free_transfer.

    For each reserve pattern the origin is tested before the destination, and an earlier
    pattern wins over a later one.
    """
    origin = F.trim(F.coalesce(from_name, F.lit("")))
    target = F.trim(F.coalesce(to_name, F.lit("")))
    label = F.when(fee > 0, "paid")
    label = label.when(F.lower(target) == "retired", "retired")
    label = label.when(F.lower(target) == "without club", "contract_expired")
    for pattern in C.RESERVE_PATTERNS:
        label = label.when(origin.rlike("(?i)" + pattern), "youth_promotion")
        label = label.when(target.rlike("(?i)" + pattern), "sent_to_reserves")
    return label.otherwise("free_transfer")


def with_loan_override(label: Column, is_loan: Column) -> Column:
    return F.when((label == "free_transfer") & is_loan, "loan").otherwise(label)


def badge_label(label: Column) -> Column:
    return F.coalesce(lookup(label, C.BADGE_LABELS), F.lit(""))


def gem_tier(roi: Column) -> Column:
    return F.when(roi >= 1000, 3).when(roi >= 500, 2).when(roi >= 100, 1).otherwise(0)


def is_gem(roi: Column) -> Column:
    return F.when(roi >= 100, 1).otherwise(0)


def is_training_eligible(roi: Column, buy_date: Column, age: Column,
                         cutoff: str = "2021-01-01", max_age: float = 23) -> Column:
    ok = roi.isNotNull() & (buy_date < F.lit(cutoff).cast("date")) & (age <= max_age)
    return F.when(ok, 1).otherwise(0)


def transfer_window(on: Column) -> Column:
    return F.when(F.month(on) >= 7, "summer").when(F.month(on) < 7, "winter")


def season(on: Column) -> Column:
    """``2023-2024``, turning over in July."""
    start = F.year(on) - F.when(F.month(on) >= 7, 0).otherwise(1)
    return F.concat_ws("-", start, start + 1)


def xg_season(on: Column) -> Column:
    return F.concat((F.year(on) - 1).cast("string"), F.lit("/"), F.year(on).cast("string"))


def position_bucket(position: Column) -> Column:
    known = F.coalesce(lookup(position, C.POSITION_BUCKETS), F.lit("Other"))
    return F.when(position.isNotNull(), known)


def citizenship_region(citizenship: Column) -> Column:
    """Region of the first listed citizenship."""
    first = F.trim(F.get(F.split(citizenship, ","), F.lit(0)))
    label = reduce(
        lambda acc, item: acc.when(first.isin(*item[1]), item[0]),
        list(C.REGIONS.items())[1:],
        F.when(first.isin(*C.REGIONS["South America"]), "South America"),
    )
    return F.when(citizenship != "", label.otherwise("Other"))


def league_tier(gem_rate: Column, cuts: tuple[float, float, float] = (3.0, 6.0, 10.0)) -> Column:
    return F.when(gem_rate < cuts[0], 1).when(gem_rate < cuts[1], 2).when(gem_rate < cuts[2], 3).otherwise(4)


def fee_bucket(fee: Column) -> Column:
    label = F.when(fee.isNull(), "unknown").when(fee <= 0, "free")
    for bound, name in C.FEE_BUCKETS:
        label = label.when(fee < bound, name)
    return label.otherwise("elite")


def league_name(code: Column, names: dict[str, str] = C.LEAGUE_NAMES) -> Column:
    return lookup(code, names)


def format_euro(amount: Column) -> Column:
    size = F.abs(amount)
    sign = F.when(amount < 0, "-").otherwise("")

    def short(unit: float, suffix: str) -> Column:
        shown = F.floor(size / F.lit(unit) * 10 + 0.5) / 10.0
        return F.concat(sign, F.lit("€"), F.format_string("%.1f", shown), F.lit(suffix))

    whole = F.concat(sign, F.lit("€"), F.format_string("%.0f", F.floor(size + 0.5).cast("double")))
    text = F.when(amount.isNull(), "").when(size >= 1e9, short(1e9, "B")).when(size >= 1e6, short(1e6, "M"))
    return text.when(size >= 1e3, short(1e3, "K")).otherwise(whole)


def is_status_marker(name: Column) -> Column:
    return F.lower(F.trim(name)).isin(*C.NON_CLUB_NAMES)


def is_reserve_name(name: Column) -> Column:
    return name.rlike("(?i)" + "|".join(C.ORPHAN_RESERVE_PATTERNS))
