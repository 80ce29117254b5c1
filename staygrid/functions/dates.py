"""Calendar rules as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def age_years(dob, as_of) -> Column:
    """Completed years between two dates.

    Counts by (month, day), so someone born on 29 February turns a year older on
    1 March of a common year; ``months_between`` would say 28 February.
    """
    dob, as_of = (F.col(c) if isinstance(c, str) else c for c in (dob, as_of))
    before_birthday = (F.month(as_of) * 100 + F.dayofmonth(as_of)) < (
        F.month(dob) * 100 + F.dayofmonth(dob)
    )
    return F.year(as_of) - F.year(dob) - before_birthday.cast("int")
