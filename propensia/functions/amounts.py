"""Amounts: French decimal text, and sums that do not depend on arrival order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fr_decimal(c: ColumnOrName) -> Column:
    """``'5126,34'`` -> ``5126.34``; text that is no number (``NaN`` included) becomes NULL."""
    return F.nullif(F.regexp_replace(_col(c), ",", ".").try_cast("double"), F.lit(float("nan")))


def to_fr_text(c: ColumnOrName) -> Column:
    """A number with two decimals as French text (``5126.34`` -> ``'5126,34'``)."""
    return F.regexp_replace(_col(c).cast("decimal(18,2)").cast("string"), r"\.", ",")


def minor_units(c: ColumnOrName, scale: int = 2) -> Column:
    """Amount as whole minor units (cents for ``scale=2``)."""
    return F.round(_col(c) * float(10 ** scale)).try_cast("bigint")


def _parts(c: ColumnOrName, scale: int) -> tuple[Column, Column]:
    """An amount as whole units and the rest in 10**-scale, both whole numbers; NaN counts as NULL."""
    amount = F.nullif(_col(c).cast("double"), F.lit(float("nan")))
    units = F.floor(amount)
    return units, F.round((amount - units) * float(10 ** scale)).cast("bigint")


def partial_sums(c: ColumnOrName, scale: int = 6) -> dict[str, Column]:
    """What an exact sum or mean is finished from; each part of two row sets adds up to that of both."""
    units, rest = _parts(c, scale)
    return {"n_amounts": F.count(units), "units": F.sum(units), "rest": F.sum(rest)}


def total_of_parts(units: ColumnOrName, rest: ColumnOrName, scale: int = 6) -> Column:
    return (_col(units).cast("decimal(38,9)") + _col(rest).cast("decimal(38,9)") / F.lit(10 ** scale)).cast("double")


def _total(c: ColumnOrName, scale: int) -> Column:
    units, rest = _parts(c, scale)
    return total_of_parts(F.sum(units), F.sum(rest), scale)


def exact_sum(c: ColumnOrName, scale: int = 6) -> Column:
    """Sum of amounts through whole numbers, exact to ``scale`` decimals of each amount.

    A double sum depends on the order in which partial sums arrive, so a retried
    task could change a total; sums of whole units and of the decimals cannot, and
    stay in generated code. Amounts beyond bigint raise instead of vanishing.
    """
    return _total(c, scale)


def exact_mean(c: ColumnOrName, scale: int = 6) -> Column:
    """Mean of the non-NULL amounts, with the same guarantee as ``exact_sum``."""
    units, _ = _parts(c, scale)
    return F.try_divide(_total(c, scale), F.count(units).cast("double"))
