"""Free-form date and time text, read as the web page's date function reads it.

``strtotime`` is a staged grammar of column expressions.  A text is made of at
most one time, any number of relative parts, and one date, in any order of
these; each stage takes its parts out, and what is left must be one of the
date forms, whole.

* times: ``14:05``, ``14:05:30``, ``2:05 pm``, ``2pm``, ``noon``, ``midnight``;
* relative parts: ``+2 days``, ``3 weeks ago``, ``next month``, ``last year``;
* dates: ``2026-05-10``, ``2026/5/10``, ``20260510``, ``5/10/2026`` (month first),
  ``10-5-2026`` and ``10.5.2026`` (day first), ``10 May 2026``, ``May 10th, 2026``,
  ``10 May``, ``May 2026``, ``today``, ``tomorrow``, ``yesterday``, ``now``, ``friday``,
  ``next friday``, ``last friday``, and ``@`` with seconds since 1970 (UTC).

A day beyond its month's end runs on into the next month, for dates and for
relative months alike.  A date without a time is at midnight; relative parts
alone keep the time of ``as_of``.  Anything else is NULL, as are forms that need
``as_of`` where none is given.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names the forms are made of.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october",
          "november", "december")
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
#: Unit: (months, days, seconds).
UNITS = {"sec": (0, 0, 1), "second": (0, 0, 1), "min": (0, 0, 60), "minute": (0, 0, 60), "hour": (0, 0, 3600),
         "day": (0, 1, 0), "week": (0, 7, 0), "fortnight": (0, 14, 0), "month": (1, 0, 0), "year": (12, 0, 0)}

_MONTH = "(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)(?:[a-z]*)"
_MONTH_NAME = "^(?:" + "|".join([*MONTHS, *(m[:3] for m in MONTHS), "sept"]) + ")$"
_DAY = "([0-9]{1,2})(?:st|nd|rd|th)?"
_WEEKDAY = "(?:(next|last|previous|this) )?(" + "|".join(f"{d}|{d[:3]}" for d in WEEKDAYS) + ")"
_UNIT = "(" + "|".join(sorted(UNITS, key=len, reverse=True)) + ")s?"
_AMOUNT = f"(?<![^ ])([+-]?[0-9]+) ?{_UNIT}( ago)?(?![^ ])"
_STEP = f"(?<![^ ])(next|last|previous|this) {_UNIT}(?![^ ])"
_TIME_12 = r"(?<![^ ])([0-9]{1,2})(?::([0-9]{2}))?(?::([0-9]{2}))? ?([ap])\.?m\.?(?![^ ])"
_TIME_24 = r"(?<![^ ])([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:\.[0-9]+)?)?(?![^ ])"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once and stands for itself in the expression."""
    return F.get(F.transform(F.array(value), body), 0)


def _part(text: Column, pattern: str, group: int) -> Column:
    """A group of the first match, NULL where it is empty or there is none."""
    found = F.regexp_extract(text, pattern, group)
    return F.when(found != "", found)


def _number(text: Column, pattern: str, group: int) -> Column:
    return _part(text, pattern, group).cast("int")


def _without(text: Column, pattern: str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, pattern, " "), " +", " "))


def _clean(text: Column) -> Column:
    """Lower case, single spaces, commas as spaces, a space for the T between date and time."""
    spaced = F.trim(F.regexp_replace(F.lower(text), "[ \t\n\r\x0b,]+", " "))
    return F.regexp_replace(spaced, "^([0-9]{4}-?[0-9]{2}-?[0-9]{2})t(?=[0-9])", "$1 ")


def _time(text: Column) -> tuple[Column, Column, Column]:
    """(what is left, seconds of the day or NULL, whether a time is there that is none)."""
    hour, minute, second = (_number(text, _TIME_12, i) for i in (1, 2, 3))
    half = _part(text, _TIME_12, 4)
    late = F.pmod(hour, F.lit(12)) + F.when(half == "p", 12).otherwise(0)
    of_12 = late * 3600 + F.coalesce(minute, F.lit(0)) * 60 + F.coalesce(second, F.lit(0))
    h24, m24, s24 = (_number(text, _TIME_24, i) for i in (1, 2, 3))
    of_24 = h24 * 3600 + m24 * 60 + F.coalesce(s24, F.lit(0))
    bad = F.when(half.isNotNull(), ~hour.between(1, 12) | (F.coalesce(minute, F.lit(0)) > 59) | (F.coalesce(second, F.lit(0)) > 59)) \
        .otherwise(F.coalesce((h24 > 23) | (m24 > 59) | (F.coalesce(s24, F.lit(0)) > 59), F.lit(False)))
    words = "(?<![^ ])(noon|midnight)(?![^ ])"
    word = _part(text, words, 1)
    of_day = F.coalesce(of_12, of_24, F.when(word == "noon", 43200).when(word == "midnight", 0))
    left = F.when(half.isNotNull(), _without(text, _TIME_12)).when(h24.isNotNull(), _without(text, _TIME_24)) \
        .when(word.isNotNull(), _without(text, words)).otherwise(text)
    return left, of_day, bad


def _scale(unit: Column, which: int) -> Column:
    out = F.lit(0)
    for name, sizes in UNITS.items():
        if sizes[which]:
            out = F.when(unit == name, sizes[which]).otherwise(out)
    return out


def _relative(text: Column) -> tuple[Column, Column, Column, Column, Column]:
    """(what is left, months, days, seconds, whether there are any) of all relative parts."""
    def all_of(pattern, group):
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    amounts = F.transform(F.arrays_zip(all_of(_AMOUNT, 1).alias("n"), all_of(_AMOUNT, 2).alias("u"), all_of(_AMOUNT, 3).alias("a")),
                          lambda x: F.struct(x["n"].try_cast("bigint").alias("n"), x["u"].alias("u"), (x["a"] != "").alias("ago")))
    signed = F.transform(amounts, lambda x: F.struct(F.when(x["ago"], -x["n"]).otherwise(x["n"]).alias("n"), x["u"].alias("u")))
    steps = F.transform(F.arrays_zip(all_of(_STEP, 1).alias("w"), all_of(_STEP, 2).alias("u")),
                        lambda x: F.struct(F.when(x["w"] == "next", 1).when(x["w"] == "this", 0).otherwise(-1).cast("bigint").alias("n"),
                                           x["u"].alias("u")))
    parts = F.concat(signed, steps)

    def total(which):
        return F.aggregate(parts, F.lit(0).cast("bigint"), lambda acc, x: acc + x["n"] * _scale(x["u"], which))
    left = _without(_without(text, _AMOUNT), _STEP)
    return left, total(0), total(1), total(2), F.size(parts) > 0


def _day(year: Column, month: Column, day: Column) -> Column:
    """The date; a day of up to 31 may run on into the next month."""
    ok = month.between(1, 12) & day.between(1, 31) & year.between(1, 9999)
    return F.when(ok, F.date_add(F.make_date(year, F.when(ok, month), F.lit(1)), day - 1))


def _month_number(short: Column) -> Column:
    return (F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), short)).cast("int")


def _date(text: Column, today: Column) -> Column:
    """The date that the whole of ``text`` is, or NULL."""
    def form(pattern, year, month, day):
        def at(g):
            return _number(text, pattern, g)
        return F.when(text.rlike(pattern), _day(at(year), at(month), at(day)))

    def named(pattern, year, month, day):
        word = _part(text, pattern.replace(_MONTH, "([a-z]+)"), month)
        m = _month_number(_part(text, pattern, month))
        y = F.year(today) if year is None else _number(text, pattern, year)
        d = F.lit(1) if day is None else _number(text, pattern, day)
        return F.when(text.rlike(pattern) & word.rlike(_MONTH_NAME), _day(y, m, d))
    weekday = f"^{_WEEKDAY}$"
    at = F.array_position(F.array(*[F.lit(d[:3]) for d in WEEKDAYS]), F.substring(_part(text, weekday, 2), 1, 3)).cast("int") - 1
    ahead = F.pmod(at - F.weekday(today), F.lit(7))
    which = F.coalesce(_part(text, weekday, 1), F.lit("this"))
    move = F.when(which == "next", F.when(ahead == 0, 7).otherwise(ahead)).when(which == "this", ahead).otherwise(ahead - 7)
    return F.coalesce(
        form("^([0-9]{4})[-/]([0-9]{1,2})[-/]([0-9]{1,2})$", 1, 2, 3), form("^([0-9]{4})([0-9]{2})([0-9]{2})$", 1, 2, 3),
        form("^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})$", 3, 1, 2), form("^([0-9]{1,2})([-.])([0-9]{1,2})\\2([0-9]{4})$", 4, 3, 1),
        named(f"^{_DAY}[ -]?{_MONTH}[ -]?([0-9]{{4}})$", 3, 2, 1), named(f"^{_MONTH} ?{_DAY} ([0-9]{{4}})$", 3, 1, 2),
        named(f"^{_MONTH} ([0-9]{{4}})$", 2, 1, None), named(f"^{_DAY} ?{_MONTH}$", None, 2, 1),
        named(f"^{_MONTH} ?{_DAY}$", None, 1, 2), F.when(text == "today", today),
        F.when(text == "tomorrow", F.date_add(today, 1)), F.when(text == "yesterday", F.date_add(today, -1)),
        F.when(text.rlike(weekday), F.date_add(today, move)))


def strtotime(text: Column, as_of: Column | None = None) -> Column:
    """The moment that a text names, seen from ``as_of``; NULL where it names none."""
    now = (F.lit(None) if as_of is None else as_of).cast("timestamp_ntz")
    today = F.to_date(now)
    clock = F.hour(now) * 3600 + F.minute(now) * 60 + F.second(now)

    def timed(clean: Column) -> Column:
        left, of_day, bad = _time(clean)
        return _let(F.struct(left.alias("left"), of_day.alias("of_day"), bad.alias("bad")), moved)

    def moved(t: Column) -> Column:
        left, months, days, seconds, some = _relative(t["left"])
        return _let(F.struct(left.alias("left"), months.cast("int").alias("months"), days.cast("int").alias("days"),
                             seconds.alias("seconds"), (some | t["of_day"].isNotNull()).alias("some")), lambda r: dated(t, r))

    def dated(t: Column, r: Column) -> Column:
        bare = (r["left"] == "") | (r["left"] == "now")
        date = F.when(bare, today).otherwise(_date(r["left"], today))
        start = F.coalesce(t["of_day"], F.when(bare, clock).otherwise(0)) + r["seconds"]
        return F.when(((r["left"] != "") | r["some"]) & ~t["bad"], _let(date, lambda d: moment(d, r, start)))

    def moment(date: Column, r: Column, start: Column) -> Column:
        # Months count from the first of the month; the day is added again and may run on.
        day = F.date_add(F.date_add(F.add_months(F.trunc(date, "MM"), r["months"]), F.dayofmonth(date) - 1), r["days"])
        return day.cast("timestamp_ntz") + F.make_dt_interval(secs=start.cast("decimal(18,6)"))

    unix = "^@(-?[0-9]{1,11})$"
    since = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(
        secs=_part(F.trim(text), unix, 1).cast("decimal(18,6)"))
    return F.when(F.trim(text).rlike(unix), since).otherwise(_let(_clean(text), timed))
