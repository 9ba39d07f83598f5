"""Timestamps from text. The shape of a text selects how it is read, so no list of formats is tried one by one.

Shapes of the date (separators ``-``, ``/``, ``.`` or blanks):

* year first: ``2010-12-01``, ``2010/12/1``, ``20101201``
* day first: ``1/12/2010``, ``01.12.10``; month first only where the second number cannot be a month
* month by name: ``1 Dec 2010``, ``1-December-10``, ``Dec 1, 2010``

A time may follow after blanks or ``T``: ``8:26``, ``08:26:00.5``, ``8:26 pm``, with ``Z``, ``UTC`` or an offset (``+02:00``),
which is taken off, so that zoned times are in UTC. Anything else is NULL, as are dates that do not exist.
Two-digit years are 1969 to 2068.
"""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# English month names.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]

_TIME = r"(?:[T\s]+(\S.*))?$"
_SEP = r"[-/.\s]\s*"
# shape -> replacement to "year|month|day|time"
_SHAPES = [
    (rf"^(\d{{4}}){_SEP}(\d{{1,2}}){_SEP}(\d{{1,2}}){_TIME}", "$1|$2|$3|$4"),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}}){_TIME}", "$1|$2|$3|$4"),
    (rf"^(\d{{1,2}}){_SEP}(\d{{1,2}}){_SEP}(\d{{4}}|\d{{2}}){_TIME}", "$3|$2|$1|$4"),
    (rf"^(\d{{1,2}}){_SEP}([A-Za-z]{{3,9}})\.?,?{_SEP}(\d{{4}}|\d{{2}}){_TIME}", "$3|$2|$1|$4"),
    (rf"^([A-Za-z]{{3,9}})\.?{_SEP}(\d{{1,2}}),?{_SEP}(\d{{4}}|\d{{2}}){_TIME}", "$3|$1|$2|$4"),
]
_CLOCK = r"^(\d{1,2}):(\d{2})(?::(\d{2}(?:\.\d{1,9})?))?\s*([AaPp][Mm])?\s*(?:(Z|UTC|GMT)|([+-])(\d{2}):?(\d{2}))?$"
_FIXED_DAY_FIRST = r"^[0-9]{2}[-/.][0-9]{2}[-/.][0-9]{4} [0-9]{2}:[0-9]{2}\z"
_FIXED_YEAR_FIRST = r"^[0-9]{4}[-/.][0-9]{2}[-/.][0-9]{2} [0-9]{2}:[0-9]{2}\z"
_CLOCK_PARTS = "$1|$2|$3|$4|$6|$7|$8"


def strict_dates(col: Column, formats: Sequence[str]) -> Column:
    """The first of the strict formats that the text has."""
    return F.coalesce(*[F.try_to_timestamp(col, F.lit(f)) for f in formats]).cast(T.TimestampNTZType())


def parse_dates(col: Column) -> Column:
    """TIMESTAMP_NTZ from a text by its shape, or NULL. Shape and time are worked out once and bound, as the many uses of
    their parts would otherwise repeat them."""
    t = F.trim(col)
    shape = F.lit(None).cast("string")
    for pattern, order in reversed(_SHAPES):
        shape = F.when(t.rlike(pattern), F.regexp_replace(t, pattern, order)).otherwise(shape)
    # Day first, unless only the other order makes a date.
    turned = t.rlike(r"^\d{1,2}\D")
    general = _bind(F.split(shape, r"\|", 4), lambda parts: _bind(_clock(parts[3]), lambda clock: _bind(
        turned, lambda may_turn: _stamp(parts, clock, may_turn))))
    return (F.when(t.rlike(_FIXED_DAY_FIRST), _at(t, 7, 4, 1)).when(t.rlike(_FIXED_YEAR_FIRST), _at(t, 1, 6, 9))
            .otherwise(general))


def _at(t: Column, year: int, month: int, day: int) -> Column:
    """A text of fixed width, read by position: the two most frequent shapes need no more than one pattern."""
    def part(start: int, width: int = 2) -> Column:
        return F.substring(t, start, width).cast("int")

    m, d = part(month), part(day)
    swap = (m > 12) & (d <= 12) if day < year else F.lit(False)  # as below: only where the day comes first
    return F.try_make_timestamp_ntz(part(year, 4), F.when(swap, d).otherwise(m), F.when(swap, m).otherwise(d), part(12), part(15),
                                    F.lit(0).cast(T.DecimalType(16, 6)))


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), use)[0]


def _clock(time: Column) -> Column:
    return F.split(F.when(time.rlike(_CLOCK), F.regexp_replace(time, _CLOCK, _CLOCK_PARTS)), r"\|")


def _stamp(parts: Column, clock: Column, may_turn: Column) -> Column:
    names = F.map_from_arrays(F.array(*[F.lit(n) for n in [*MONTHS, *[m[:3] for m in MONTHS if len(m) > 3], "sept"]]),
                              F.array(*[F.lit(n) for n in [*range(1, 13), *[i + 1 for i, m in enumerate(MONTHS) if len(m) > 3], 9]]))
    year = parts[0].try_cast("int")
    year = F.when(F.length(parts[0]) == 4, year).when(year < 69, year + 2000).otherwise(year + 1900)
    month = F.coalesce(parts[1].try_cast("int"), F.try_element_at(names, F.lower(parts[1])))
    day = parts[2].try_cast("int")
    swap = (month > 12) & (day <= 12) & may_turn
    hour = clock[0].try_cast("int")
    half = F.lower(clock[3])
    hour = F.when(half == "", hour).when((hour < 1) | (hour > 12), None).otherwise(hour % 12 + F.when(half == "pm", 12).otherwise(0))
    second = F.when(clock[2] == "", F.lit("0")).otherwise(clock[2]).try_cast(T.DecimalType(16, 6))
    zero, bare = F.lit(0), parts[3] == ""
    stamp = F.try_make_timestamp_ntz(
        year, F.when(swap, day).otherwise(month), F.when(swap, month).otherwise(day),
        F.when(bare, zero).otherwise(hour), F.when(bare, zero).otherwise(clock[1].try_cast("int")),
        F.when(bare, zero.cast(T.DecimalType(16, 6))).otherwise(second))
    minutes = clock[5].try_cast("int") * 60 + clock[6].try_cast("int")
    offset = F.coalesce(F.when(clock[4] == "-", -minutes).when(clock[4] == "+", minutes), zero)
    return stamp - F.make_dt_interval(mins=offset)
