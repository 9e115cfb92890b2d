"""Money and time metrics of one buy and its later sale."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DAYS_PER_YEAR = 365.25


def profit(buy_fee: Column, sell_fee: Column) -> Column:
    return sell_fee - buy_fee


def roi_pct(buy_fee: Column, sell_fee: Column) -> Column:
    return F.try_divide(sell_fee - buy_fee, buy_fee) * 100


def tenure_days(buy_date: Column, sell_date: Column) -> Column:
    return F.datediff(sell_date, buy_date).cast("bigint")


def tenure_years(buy_date: Column, sell_date: Column) -> Column:
    return F.datediff(sell_date, buy_date) / F.lit(DAYS_PER_YEAR)


def annualized_roi_pct(buy_fee: Column, sell_fee: Column, years: Column) -> Column:
    """Compound yearly return; tenure of at least seven days, clamped to +-500 percent."""
    span = F.greatest(years, F.lit(7 / DAYS_PER_YEAR))
    growth = F.pow(F.try_divide(sell_fee, buy_fee), 1.0 / span) - 1
    clamped = F.greatest(F.least(growth, F.lit(5.0)), F.lit(-5.0)) * 100
    return F.when((years > 0) & (buy_fee > 0), clamped)


def value_creation_pct(buy_fee: Column, peak_value: Column) -> Column:
    """A player without valuations counts as peak 0."""
    return F.try_divide(F.coalesce(peak_value, F.lit(0.0)) - buy_fee, buy_fee) * 100


def buying_premium_pct(sell_fee: Column, peak_value: Column) -> Column:
    return F.when(peak_value > 0, F.try_divide(sell_fee - peak_value, peak_value) * 100)


def filled_profit(own: Column, buy_fee: Column, sell_fee: Column) -> Column:
    return F.coalesce(own, sell_fee - buy_fee)


def filled_roi(own: Column, buy_fee: Column, sell_fee: Column) -> Column:
    return F.coalesce(own, F.when(buy_fee > 0, F.try_divide(sell_fee - buy_fee, buy_fee) * 100))


def age_years(date_of_birth: Column, on: Column) -> Column:
    return F.datediff(on, date_of_birth) / F.lit(DAYS_PER_YEAR)


def log_fee(fee: Column) -> Column:
    return F.when(fee > 0, F.log1p(fee))


def is_window_flip(days: Column, limit: int = 180) -> Column:
    return F.coalesce(days < limit, F.lit(False))


def per_90(amount: Column, minutes: Column) -> Column:
    return F.when(minutes > 0, F.try_divide(amount, minutes) * 90)
