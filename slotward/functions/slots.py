"""Time parsing and the two four-hour grids."""

from pyspark.sql import Column, functions as F

from . import fixed


def parse_time(text: Column, day_first: bool = True) -> Column:
    """Parse mixed-format text; unreadable values become null."""
    first = fixed.DAY_FIRST if day_first else fixed.MONTH_FIRST
    parsed = [F.try_to_timestamp(text, F.lit(f)) for f in (first, fixed.ISO)]
    return F.coalesce(*parsed).cast("timestamp_ntz")


def slot_label(time: Column) -> Column:
    """Calendar slot: 00:00-03:59 is 02, 04:00-07:59 is 06, and so on."""
    middle = (F.hour(time) - F.hour(time) % 4 + 2).cast("string")
    return F.concat(F.date_format(time, "yyyy-MM-dd"), F.lit("_Slot-"), F.lpad(middle, 2, "0"))


def slot_floor(time: Column) -> Column:
    """Start of the calendar slot, as a timestamp."""
    hours = F.hour(time) - F.hour(time) % 4
    return F.date_trunc("day", time).cast("timestamp_ntz") + F.make_dt_interval(hours=hours)


def slot_time(label: Column) -> Column:
    """Timestamp in the middle of a labelled calendar slot."""
    text = F.concat(F.substring(label, 1, 10), F.lit(" "), F.substring(label, -2, 2), F.lit(":00:00"))
    return F.to_timestamp(text, fixed.ISO).cast("timestamp_ntz")


def shifted_slot(time: Column) -> Column:
    """Shifted grid: 02:00-05:59 is 02:00, 00:30 belongs to 22:00 of the day before."""
    two_hours = F.make_dt_interval(hours=F.lit(2))
    return slot_floor(time - two_hours) + two_hours


def time_text(time: Column) -> Column:
    return F.date_format(time, fixed.ISO)


def hours_between(later: Column, earlier: Column) -> Column:
    seconds = F.unix_timestamp(later) - F.unix_timestamp(earlier)
    return seconds / F.lit(3600.0)
