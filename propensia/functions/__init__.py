from propensia.functions.amounts import exact_mean, exact_sum, fr_decimal, minor_units, to_fr_text
from propensia.functions.dates import (
    age_years,
    fr_date,
    fr_timestamp,
    months_since,
    recency_days,
    year_from_name,
)

__all__ = [
    "age_years", "exact_mean", "exact_sum", "fr_date", "fr_decimal", "fr_timestamp",
    "minor_units", "months_since", "recency_days", "to_fr_text", "year_from_name",
]
