"""Display helpers: ages, dates, prompt lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def age_years(dob: Column, as_of: Column) -> Column:
    before_birthday = F.date_format(as_of, "MMdd") < F.date_format(dob, "MMdd")
    return F.year(as_of) - F.year(dob) - before_birthday.cast("int")


def format_date(at: Column) -> Column:
    return F.date_format(at, "MMM d, yyyy")


def format_datetime(at: Column) -> Column:
    return F.date_format(at, "MMM d, yyyy, h:mm a")


def event_line(with_unit: bool = True) -> Column:
    """``- [kind] label: value unit`` of an event row."""
    unit = F.when(F.coalesce(F.col("unit"), F.lit("")) != "", F.concat(F.lit(" "), F.col("unit"))).otherwise("")
    return F.concat(F.lit("- ["), F.col("kind"), F.lit("] "), F.col("label"),
                    F.when(F.col("value").isNotNull(), F.concat(F.lit(": "), F.col("value"))).otherwise(""),
                    unit if with_unit else F.lit(""))
