"""Calendar arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def easter(year: str) -> Column:
    """Easter Sunday of the Gregorian calendar for a column of years, in whole numbers."""
    golden, century = f"({year} % 19)", f"({year} div 100)"
    epact = f"((19 * {golden} + {century} - {century} div 4 - ({century} - ({century} + 8) div 25 + 1) div 3 + 15) % 30)"
    weekday = f"((32 + 2 * ({century} % 4) + 2 * (({year} % 100) div 4) - {epact} - ({year} % 100) % 4) % 7)"
    late = f"(({golden} + 11 * {epact} + 22 * {weekday}) div 451)"
    return F.expr(f"date_add(make_date({year}, 3, 22), cast({epact} + {weekday} - 7 * {late} as int))")


def sunday_on_or_before(date: Column) -> Column:
    return F.date_sub(date, F.dayofweek(date) - 1)


def first_advent(year: str) -> Column:
    """The fourth Sunday before Christmas."""
    return F.date_sub(sunday_on_or_before(F.expr(f"make_date({year}, 12, 24)")), 21)
