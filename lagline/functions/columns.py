"""Scalar expressions over event columns; all stay inside generated JVM code."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from lagline import schema as S


def status_band(deviation: Column) -> Column:
    """Punctuality label of a deviation in whole seconds; null stays null."""
    band = F.when(deviation.isNull(), F.lit(None).cast("string"))
    for label, upper in S.STATUS_UPPER.items():
        band = band.when(deviation <= upper, label)
    return band.otherwise(S.STATUSES[-1])


def event_type(scheduled_arrival: Column) -> Column:
    return F.when(scheduled_arrival.isNotNull(), "arrival").otherwise("departure")


def by_event_type(scheduled_departure: Column, departure: Column, arrival: Column) -> Column:
    """The departure value for departures, else the arrival value.

    Deliberately not ``coalesce``: a departure whose actual time is missing stays missing
    even if an actual arrival was recorded.
    """
    return F.when(scheduled_departure.isNotNull(), departure).otherwise(arrival)


def seconds_between(later: Column, earlier: Column) -> Column:
    """Exact difference in seconds, fractions kept."""
    return (later - earlier).cast("decimal(18,6)")


def day_offset(ts: Column, service_date: Column) -> Column:
    return F.datediff(ts.cast("date"), service_date)


def wall_clock_hour(ts: Column) -> Column:
    """Hour on the clock, 0..23; not the hour of the service day."""
    return F.hour(ts)


def minute_of_service_day(ts: Column, after_midnight: Column) -> Column:
    return (F.hour(ts) * 60 + F.minute(ts) + after_midnight.cast("int") * 1440).cast("int")


def slot(minute: Column, width: Column | int) -> Column:
    width = width if isinstance(width, Column) else F.lit(width)
    return F.floor(minute / width).cast("int")


def service_hour(minute: Column) -> Column:
    """Hour of the service day; 24 and above after midnight."""
    return slot(minute, 60)


def weekday_number(day: Column) -> Column:
    return F.weekday(day)


def weekday_name(day: Column) -> Column:
    return F.date_format(day, "EEEE")


def month_name(day: Column) -> Column:
    return F.date_format(day, "MMMM")


def period_group(day: Column) -> Column:
    return F.when(F.weekday(day) >= 5, "Weekend").otherwise("Weekday")


def day_type(weekday: Column) -> Column:
    """0 for Monday to Friday, 1 for Saturday, 2 for Sunday."""
    return F.greatest(weekday - 4, F.lit(0)).cast("int")


def month_start(day: Column) -> Column:
    return F.trunc(day, "month")


def week_start(day: Column) -> Column:
    """First day of the 7-day refresh block, counted from the first of the month."""
    return F.date_sub(day, (F.dayofmonth(day) - 1) % 7)


def in_months(day: Column, first: str, last: str | None = None) -> Column:
    """Half-open date range over whole months; prunes partitions and row groups."""
    start = F.to_date(F.lit(first))
    end = F.add_months(F.to_date(F.lit(last or first)), 1)
    return (day >= start) & (day < end)


def chronological_split(day: Column, validation_start: str, test_start: str) -> Column:
    if validation_start >= test_start:
        raise ValueError("the validation period must begin before the test period")
    return (
        F.when(day >= F.to_date(F.lit(test_start)), "test")
        .when(day >= F.to_date(F.lit(validation_start)), "validation")
        .otherwise("train")
    )


def service_class(status: Column) -> Column:
    """Five labels folded to three."""
    table = F.create_map(*[F.lit(v) for v in chain(*S.STATUS_TO_CLASS.items())])
    return F.element_at(table, status)


def is_early(status: Column) -> Column:
    return status.isin("Very Early", "Early")


def is_on_time(status: Column) -> Column:
    return status == "On Time"


def is_late(status: Column) -> Column:
    return status.isin("Late", "Very Late")


def filled(category: Column) -> Column:
    return F.coalesce(category.cast("string"), F.lit(S.MISSING))


def blend(weight: Column, corrected: Column, baseline: Column) -> Column:
    return weight * corrected + (F.lit(1.0) - weight) * baseline


def is_scientific(text: Column) -> Column:
    return text.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)[Ee][+-]?\d+$")


def has_outer_space(text: Column) -> Column:
    return text.rlike(r"(?U)^\s|\s$")


def has_control_space(text: Column) -> Column:
    return text.rlike("[\r\n\t]")


def natural_order(code: Column) -> list[Column]:
    """Sort keys: numeric codes first and by number, then the rest by text."""
    number = code.rlike(r"^\d+$")
    return [
        F.when(number, 0).otherwise(1).asc(),
        F.when(number, code.try_cast("decimal(38,0)")).asc(),
        code.asc(),
    ]


def labelled(name: Column, detail: Column) -> Column:
    return F.concat(name, F.lit(" ["), detail, F.lit("]"))


def counted_label(name: Column, n: Column) -> Column:
    return F.concat(name, F.lit(" (n="), F.format_number(n, 0), F.lit(")"))


# ---- strict parsing: a value that cannot be read is reported, a missing one is not -------


def na_to_null(text: Column) -> Column:
    return F.when(text.isin(S.NA_TOKENS), F.lit(None).cast("string")).otherwise(text)


def parse_date(text: Column) -> Column:
    """Month/day/year with or without leading zeros."""
    shaped = text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$")
    return F.when(shaped, F.try_to_date(text, "M/d/yyyy"))


def parse_timestamp(text: Column) -> Column:
    """ISO clock with a fraction of one to nine digits and a closing Z, cut to microseconds."""
    pattern = r"^(\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}\.\d{1,6})\d{0,3}Z$"
    return F.when(
        text.rlike(pattern),
        F.regexp_extract(text, pattern, 1).try_cast("timestamp_ntz"),
    )


def parse_integer(text: Column) -> Column:
    """Integral numbers in any notation; fractions and text are not numbers here."""
    whole = text.rlike(r"^\s*[+-]?\d{1,18}\s*$")
    number = F.trim(text).try_cast("double")
    integral = (number == F.floor(number)) & (F.abs(number) < F.lit(9.2e18))
    return F.when(whole, F.trim(text).try_cast("bigint")).when(integral, number.try_cast("bigint"))
