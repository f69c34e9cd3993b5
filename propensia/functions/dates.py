"""Dates in ``dd/MM/yyyy`` text, ages and recencies against a fixed reference date.

The reference date is always a parameter: the same row must give the same feature
on the day the model is trained and on the day it scores.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from propensia.functions.amounts import ColumnOrName, _col

# Text formats of the raw files and the mean length of a year in days.
DATE_FORMAT = "dd/MM/yyyy"
TIMESTAMP_FORMAT = "dd/MM/yyyy HH:mm:ss"
DAYS_PER_YEAR = 365.25


def fr_date(c: ColumnOrName) -> Column:
    """``'01/11/2023'`` -> date; text in any other form becomes NULL."""
    return F.try_to_date(_col(c), DATE_FORMAT)


def fr_timestamp(c: ColumnOrName) -> Column:
    return F.try_to_timestamp(_col(c), F.lit(TIMESTAMP_FORMAT))


def age_years(birth: ColumnOrName, reference: dt.date) -> Column:
    """Completed years between a date column and the reference date, as bigint."""
    days = F.datediff(F.lit(reference), _col(birth))
    return F.floor(days / DAYS_PER_YEAR).cast("bigint")


def recency_days(last: ColumnOrName, reference: dt.date) -> Column:
    return F.datediff(F.lit(reference), _col(last).cast("date"))


def months_since(start: ColumnOrName, reference: dt.date) -> Column:
    return F.months_between(F.lit(reference), _col(start))


def year_from_name(file_name: ColumnOrName) -> Column:
    """First year (20xx) in a file name, NULL when there is none."""
    base = F.substring_index(_col(file_name), "/", -1)
    return F.regexp_extract(base, r"(20\d{2})", 1).try_cast("int")
