"""Native date parsing for columns that mix several formats.

Every layout is rewritten to ISO text by an anchored replacement, which leaves other layouts alone, and read
by the built-in cast. One cast serves all layouts, so the generated code stays small enough to be compiled. Results carry no time zone.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, functions as F

_CLOCK = r"(\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?)(?: ?(?:Z|[+-]\d{2}:?\d{2}))?"
# Layouts rewritten to ISO: year first (one separator kind or none), month first, Korean.
_LAYOUTS = [
    (r"^(?=\d{4}[-/.]|\d{8}(?:$|[ T]))(\d{4})([-/.]?)(\d{1,2})\2(\d{1,2})(?:[ T]" + _CLOCK + ")?$", "$1-$3-$4 $5"),
    (r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})(?: " + _CLOCK + ")?$", "$3-$1-$2 $4"),
    (r"^(\d{4})년 ?(\d{1,2})월 ?(\d{1,2})일$", "$1-$2-$3"),
]
# English month names; the first three letters are kept.
_MONTH = (
    r"(?=(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:tember)?"
    r"|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\W)([a-z]{3})[a-z]*"
)
_NAMED_LAYOUTS = [
    (rf"(?i)^{_MONTH} (\d{{1,2}}),? (\d{{4}})$", "$2 $1 $3"),
    (rf"(?i)^(\d{{1,2}}) {_MONTH} (\d{{4}})$", "$1 $2 $3"),
]
_NAMED = r"^(?:\d{1,2} )?[A-Za-z]{3,9} (?:\d{1,2},? )?\d{4}$"
_DIGIT_START = r"^(?:\d{4}[-/.년]|\d{8}(?:$|[ T])|\d{1,2}[-/]\d)"
_COVERED_HINTS = {"YYYY-MM-DD", "YYYY/MM/DD", "YYYY.MM.DD", "YYYYMMDD"}


def _rewritten(c: Column, layouts: list[tuple[str, str]]) -> Column:
    return reduce(lambda text, layout: F.regexp_replace(text, *layout), layouts, c)


def _hint_layout(date_fmt: str) -> tuple[str, str] | None:
    """Rewriting rule for a layout written with YYYY, MM and DD; other hints name no layout."""
    fields = re.findall("YYYY|MM|DD", date_fmt)
    if sorted(fields) != ["DD", "MM", "YYYY"]:
        return None
    short = r"(\d{2})" if re.fullmatch("(?:YYYY|MM|DD)+", date_fmt) else r"(\d{1,2})"
    groups = {"YYYY": r"(\d{4})", "MM": short, "DD": short}
    pattern = "".join(groups.get(p, re.escape(p)) for p in re.split("(YYYY|MM|DD)", date_fmt))
    place = {field: i + 1 for i, field in enumerate(fields)}
    return f"^{pattern}$", f"${place['YYYY']}-${place['MM']}-${place['DD']}"


def parse_timestamp(c: Column, date_fmt: str | None = None) -> Column:
    """``timestamp_ntz`` read from text, null where no layout fits.

    Year-first dates with ``-``, ``/``, ``.`` or eight digits come first, with or without a time (a zone is
    dropped, the wall clock kept). Then ``date_fmt``, an input hint such as ``DD.MM.YYYY``; month-first
    dates; ``yyyy-MM`` (first of the month); ``yyyy년 M월 d일``; English month names. Two-digit years and
    bare times stay unread because their meaning is a guess.
    """
    layouts = list(_LAYOUTS)
    hint = _hint_layout(date_fmt) if date_fmt and date_fmt not in _COVERED_HINTS else None
    if hint is not None:
        layouts.insert(1, hint)
    starts = _DIGIT_START if hint is None else f"{_DIGIT_START}|{hint[0]}"
    # The start test keeps the replacements off other texts, and bare numbers off the cast, which would
    # take four to six digits for a year.
    return F.when(c.rlike(starts), F.trim(_rewritten(c, layouts)).try_cast("timestamp_ntz")).when(
        c.rlike(_NAMED), F.try_to_timestamp(_rewritten(c, _NAMED_LAYOUTS), F.lit("d MMM yyyy")).cast("timestamp_ntz")
    )


def date_text(ts: Column, keep_time: bool = False) -> Column:
    """Standard text of a timestamp: ``yyyy-MM-dd`` or ``yyyy-MM-dd HH:mm:ss``."""
    if keep_time:
        return F.substring(ts.cast("string"), 1, 19)
    return ts.cast("date").cast("string")


def parse_date(c: Column, date_fmt: str | None = None, keep_time: bool = False, as_type: str = "string") -> Column:
    """Date column as standard text (default), ``date`` or ``timestamp`` (without zone)."""
    ts = parse_timestamp(c, date_fmt)
    if as_type == "string":
        return date_text(ts, keep_time)
    return ts.cast("date") if as_type == "date" else ts


def month_text(ts: Column) -> Column:
    """``yyyy-MM`` label of a date or timestamp."""
    return F.substring(ts.cast("date").cast("string"), 1, 7)
