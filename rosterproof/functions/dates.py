"""Thai and Gregorian dates in text, and expiry dates of documents."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterproof.functions import fixed
from rosterproof.functions.text import alternation, ascii_digits, bind, join_thai, trim_blanks, word_pattern

_W = f"{fixed.WS}*"
_MONTHS = alternation(list(fixed.THAI_MONTHS))
_ERA = rf"(?:พ\.?ศ\.?)?{_W}"
_ISO = "([0-9]{4})-([0-9]{2})-([0-9]{2})"
_NUMERIC = rf"([0-9]{{1,2}}){_W}[/.\-]{_W}([0-9]{{1,2}}){_W}[/.\-]{_W}([0-9]{{2,4}})"
_WORDED = rf"([0-9]{{1,2}}){_W}({_MONTHS}){_W}{_ERA}([0-9]{{2,4}})"
_LONG = rf"วันที่{_W}([0-9]{{1,2}}){_W}เดือน{_W}({_MONTHS}){_W}{_ERA}([0-9]{{2,4}})"

# A date inside running text; the long "วันที่ … เดือน …" form is not one of them.
DATE_IN_TEXT = (
    rf"[0-9]{{1,2}}{_W}(?:{_MONTHS}){_W}{_ERA}[0-9]{{2,4}}"
    rf"|[0-9]{{1,2}}{_W}[/.\-]{_W}[0-9]{{1,2}}{_W}[/.\-]{_W}[0-9]{{2,4}}"
)
_LABELLED = rf"(?i){word_pattern(fixed.LABELS['expiry'])}[^\n]{{0,20}}?({DATE_IN_TEXT})"


def _int(c: Column) -> Column:
    return c.try_cast("int")


def full_year(raw: Column) -> Column:
    """Two-digit years belong to the 25xx Buddhist century; Buddhist becomes Gregorian."""
    y = bind(raw, lambda r: _int(r) + F.when(F.length(r) == 2, 2500).otherwise(0))
    return bind(y, lambda n: n - F.when(n > 2400, 543).otherwise(0))


def roll_date(y: Column, m: Column, d: Column) -> Column:
    """Date whose day may run past the month's end (31 Feb is 3 Mar)."""

    def day(p: Column) -> Column:
        y, m, d = p["y"], p["m"], p["d"]
        ok = (y != 0) & m.between(1, 12) & d.between(1, 31)
        # Years below 100 count from 1900.
        year = y + F.when(y < 100, 1900).otherwise(0)
        return F.when(ok, F.date_add(F.make_date(year, m, F.lit(1)), d - 1))

    return bind(F.struct(y.alias("y"), m.alias("m"), d.alias("d")), day)


def month_number(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for x in chain(*fixed.THAI_MONTHS.items())])
    return F.try_element_at(table, c)


def parse_date(c: Column) -> Column:
    """Date in a short string. The first pattern found decides, valid or not.

    The clean text and each part of a date are bound: repeated under a CASE they made code too
    large to compile, and were computed anew at each place.
    """
    return bind(ascii_digits(join_thai(F.coalesce(c, F.lit("")))), _first_date)


def _first_date(t: Column) -> Column:
    def group(pattern: str, i: int) -> Column:
        return F.regexp_extract(t, pattern, i)

    def worded(p: str) -> Column:
        return roll_date(full_year(group(p, 3)), month_number(group(p, 2)), _int(group(p, 1)))

    return (
        F.when(t.rlike(_ISO), roll_date(*[_int(group(_ISO, i)) for i in (1, 2, 3)]))
        .when(
            t.rlike(_NUMERIC),
            roll_date(
                full_year(group(_NUMERIC, 3)), _int(group(_NUMERIC, 2)), _int(group(_NUMERIC, 1))
            ),
        )
        .when(t.rlike(_WORDED), worded(_WORDED))
        .when(t.rlike(_LONG), worded(_LONG))
    )


def iso(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM-dd")


def labelled_date(text: Column) -> Column:
    """Raw date on the same line as an expiry label; '' when there is none."""
    return F.regexp_extract(text, _LABELLED, 1)


def latest_date(text: Column) -> Column:
    """struct(date, order, raw) of the latest date in a text; the first wins a tie."""
    found = F.transform(
        F.regexp_extract_all(text, F.lit(f"({DATE_IN_TEXT})"), F.lit(1)),
        lambda raw, i: F.struct(
            bind(ascii_digits(join_thai(raw)), _first_date).alias("date"),
            (-i).alias("order"),
            trim_blanks(raw).alias("raw"),
        ),
    )
    return F.array_max(F.filter(found, lambda x: x["date"].isNotNull()))


def add_expiry(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: struct(raw, date, method) of a document's expiry date.

    A readable date next to an expiry label wins; else the latest date in the text.
    """
    raw, day, last = (f"__{out}_{k}" for k in ("raw", "day", "last"))
    df = df.withColumn(raw, labelled_date(F.col(text)))
    df = df.withColumn(day, parse_date(F.col(raw)))
    df = df.withColumn(last, F.when(F.col(day).isNull(), latest_date(F.col(text))))

    def found(r: Column, d: Column, method: str) -> Column:
        return F.struct(r.alias("raw"), d.alias("date"), F.lit(method).alias("method"))

    pick = F.when(
        F.col(day).isNotNull(), found(trim_blanks(F.col(raw)), F.col(day), "labelled")
    ).when(
        F.col(last).isNotNull(),
        found(F.col(last)["raw"], F.col(last)["date"], "latest-date"),
    )
    return df.withColumn(out, pick).drop(raw, day, last)


def is_expired(d: Column, as_of: Column) -> Column:
    """True when the date's midnight lies before ``as_of``; null for no date."""
    return d.cast("timestamp") < as_of


def is_implausible(d: Column, as_of: Column) -> Column:
    """More than ten years before ``as_of``: rather a misread date than an expiry."""
    seconds = F.unix_timestamp(as_of) - F.unix_timestamp(d.cast("timestamp"))
    return F.coalesce(seconds / (365.25 * 24 * 3600) > 10, F.lit(False))
