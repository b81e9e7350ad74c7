"""Date columns: month names, month and year bounds, date phrases."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# English month names and their short forms.
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6,
    "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7,
    "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
}
# The wider lookup also knows this form.
MONTHS_WIDE = {**MONTHS, "sept": 9}

ISO_DAY = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"


def _lookup(names: dict[str, int], key: Column) -> Column:
    table = F.create_map(*[F.lit(v) for v in chain.from_iterable(names.items())])
    return F.try_element_at(table, key)


def month_number(c: Column) -> Column:
    """1..12 for a full or three-letter month name, with or without dots."""
    return _lookup(MONTHS, F.lower(F.regexp_replace(c, r"^\.+|\.+$", "")))


def month_number_wide(c: Column) -> Column:
    """As :func:`month_number` but also ``sept``; dots are not stripped."""
    return _lookup(MONTHS_WIDE, F.lower(c))


def month_first(y: Column, m: Column) -> Column:
    return F.make_date(y, m, F.lit(1))


def month_last(y: Column, m: Column) -> Column:
    return F.last_day(month_first(y, m))


def year_first(y: Column) -> Column:
    return F.make_date(y, F.lit(1), F.lit(1))


def year_last(y: Column) -> Column:
    return F.make_date(y, F.lit(12), F.lit(31))


def try_iso(c: Column) -> Column:
    """Date from ``YYYY-MM-DD``, null if there is no such day."""
    return F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).cast("date")


# Every form of a phrase: a text that does not look like one is not taken apart.
PHRASE = rf"^(?:{ISO_DAY}|(?:[0-9]{{1,2}}\s+)?[a-z]+\.?(?:\s+[0-9]{{4}})?|[0-9]{{4}})$"


def bind(value: Column, rule) -> Column:
    """``rule`` of a value that is computed once, however often the rule names it."""
    return F.get(F.transform(F.array(value), rule), F.lit(0))


def phrase_date(c: Column, as_of: Column) -> Column:
    """Date of a phrase in a closed list of forms, else null.

    ``YYYY-MM-DD``, ``d Month YYYY``, ``Month YYYY``, ``Month`` and ``YYYY``.  A
    missing day is the first, a missing month or year is taken from ``as_of``.
    """
    t = F.lower(F.trim(c))
    return F.when(t.rlike(PHRASE), bind(t, lambda said: _phrase(said, as_of)))


def _phrase(t: Column, as_of: Column) -> Column:
    day = F.regexp_extract(t, r"^([0-9]{1,2})\s+[a-z]+\.?\s+[0-9]{4}$", 1)
    mon = month_number_wide(F.regexp_extract(t, r"^(?:[0-9]{1,2}\s+)?([a-z]+)\.?(?:\s+[0-9]{4})?$", 1))
    year = F.regexp_extract(t, r"^(?:(?:[0-9]{1,2}\s+)?[a-z]+\.?\s+)?([0-9]{4})$", 1)
    # A cast of no digits would fail inside, at the price of an exception a row.
    y = F.coalesce(bind(year, lambda s: F.when((s != "") & (s != "0000"), s.cast("int"))), F.year(as_of))
    lead_day = F.coalesce(bind(day, lambda s: F.when(s != "", s.cast("int"))), F.lit(1))

    def named(first: Column) -> Column:
        return bind(lead_day, lambda d: F.when(d.between(1, F.dayofmonth(F.last_day(first))), F.date_add(first, d - 1)))

    return F.when(t.rlike(f"^{ISO_DAY}$"), try_iso(t)).otherwise(bind(mon, lambda m: (
        F.when(m.isNotNull(), bind(month_first(y, m), named))
         .when(t.rlike("^[0-9]{4}$") & (t != "0000"), month_first(y, F.month(as_of))))))
