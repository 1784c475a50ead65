"""Scalar column expressions. All of them stay inside code generation."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from basketry import fixed_values as fixed


def tidy_name(header: str) -> str:
    """Header text as a column name: trimmed, lower case, blanks as underscores."""
    return header.strip().lower().replace(" ", "_")


def whole_days(start, end) -> Column:
    """Whole elapsed days (not calendar days) from `start` to `end`, rounded down.

    Taken from dates and times of day, so the session's time zone plays no part.
    """
    start, end = _column(start), _column(end)
    return F.datediff(end, start) - (_clock(end) < _clock(start)).cast("int")


def _column(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _seconds(timestamp: Column) -> Column:
    return F.date_part(F.lit("SECOND"), timestamp)


def _clock(timestamp: Column) -> Column:
    return F.hour(timestamp) * 3600 + F.minute(timestamp) * 60 + _seconds(timestamp)


def half_even(value, digits: int) -> Column:
    """Rounding with ties to the even digit."""
    return F.bround(value, digits)


def at_least_zero(value) -> Column:
    return F.greatest(F.lit(0.0), value)


def exact_sum(value, digits: int = 12) -> Column:
    """Sum of a quantity held as double, independent of the order of addition.

    Values are added as decimals of `digits` fractional digits, which hold money and fractional units
    whole, so a retried or re-split task cannot change the last bits. Nulls are skipped and a group of
    nulls only sums to zero.
    """
    return F.coalesce(F.sum(value.cast(f"decimal(38,{digits})")).cast("double"), F.lit(0.0))


def share_error(actual, forecast) -> Column:
    """Absolute error as a fraction of the actual; null where the actual is zero."""
    return F.when(actual != 0, F.abs(actual - forecast) / F.abs(actual))


def second_of(timestamp) -> Column:
    """The timestamp without its fraction of a second, in any time zone."""
    timestamp = _column(timestamp)
    return timestamp - F.make_dt_interval(secs=_seconds(timestamp) % 1)


def day_text(date) -> Column:
    return F.date_format(date, "yyyy-MM-dd")


def risk_level(probability) -> Column:
    return _banded(probability, 1)


def recommended_action(probability) -> Column:
    return _banded(probability, 2)


def _banded(probability, part: int) -> Column:
    above = [band for band in fixed.RISK_BANDS if band[0] is not None]
    rest = next(band for band in fixed.RISK_BANDS if band[0] is None)
    return F.coalesce(
        *[F.when(probability > band[0], F.lit(band[part])) for band in above],
        F.lit(rest[part]),
    )


def persona() -> Column:
    """Persona from the columns Recency, Frequency and Monetary (means rounded to 2 digits)."""
    return F.coalesce(
        *[F.when(F.expr(condition), F.lit(label)) for condition, label in fixed.PERSONAS],
        F.lit(fixed.OTHER_PERSONA),
    )


def segment_name(segment_id, segments=fixed.SEGMENTS) -> Column:
    return F.coalesce(
        *[F.when(segment_id == number, F.lit(name)) for number, name, _ in segments],
        F.lit(fixed.UNKNOWN_SEGMENT),
    )


def segment_description(segment_id, segments=fixed.SEGMENTS) -> Column:
    return F.coalesce(
        *[F.when(segment_id == number, F.lit(text)) for number, _, text in segments],
        F.lit(""),
    )
