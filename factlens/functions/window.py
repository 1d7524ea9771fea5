"""Date windows in words: "Q3 2024", "as of Dec 31, 2023", "last 90 days", ...

A text is cut into tokens once (`TOKEN`), each token gets a one-letter kind (`_kind`), and the text's kinds, joined, are what
the readings below look at: a reading is a pattern of kinds and the bounds that follow from the tokens it covers. All of it
is one column expression; parse_window evaluates the same expression for one text.

Kinds: D day with hyphens, E day with other marks, q and h quarter and half with their number, m month name, n digit 1 to 4,
i other number, y number of four digits, a "as of", "at" or "on", t "to", "through" or a hyphen, u "until" or another dash,
c comma, l last, p previous, r current, s this, Q quarter, Y year, M month, d days, o months, z years, x anything else.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# The names that months go by, and the words and marks that the readings know.
MONTH_NAMES = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
MONTHS = {**{m: i for i, m in enumerate(MONTH_NAMES, 1)}, **{m[:3]: i for i, m in enumerate(MONTH_NAMES, 1)}, "sept": 9}
WORDS = {
    "as of": "a", "at": "a", "on": "a", "to": "t", "through": "t", "-": "t", "until": "u", "–": "u", "→": "u", ",": "c",
    "last": "l", "previous": "p", "current": "r", "this": "s", "quarter": "Q", "year": "Y", "month": "M", "days": "d", "months": "o", "years": "z",
}
FIRST_YEAR, LAST_YEAR = 1900, 2200

#: Days first, then "q3" and "h1" (also before a number), numbers, "as of", words, single marks.
TOKEN = r"\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|[qh](?=\d)\d|\d+|as of(?![a-z])|\p{L}+|[^\s\p{L}\d]"


@dataclass(frozen=True)
class DateWindow:
    start: date | None = None
    end: date | None = None
    label: str = ""

    @property
    def is_empty(self) -> bool:
        return self.start is None and self.end is None

    @property
    def bounds(self) -> tuple[date | None, date | None]:
        return self.start, self.end


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def _kind(token: Column) -> Column:
    known = F.coalesce(_lookup(WORDS, token), F.when(_lookup(MONTHS, token).isNotNull(), F.lit("m")))
    number = F.when(token.rlike("^[1-4]$"), "n").when(F.length(token) == 4, "y").otherwise("i")
    day = F.when(token.rlike("^[0-9]+-[0-9]+-"), "D").otherwise("E")
    return F.coalesce(known, F.when(token.rlike("^[0-9]+$"), number).when(token.rlike("^[0-9]"), day).when(token.rlike("^q[1-4]$"), "q").when(token.rlike("^h[12]$"), "h"), F.lit("x"))


def tokenised(text: Column) -> Column:
    """struct(tokens, kinds): the tokens of a text in lower case and their kinds as one text."""
    return _let(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0)), lambda t: F.struct(t.alias("tokens"), F.array_join(F.transform(t, _kind), "").alias("kinds")))


def _day(token: Column) -> Column:
    return F.translate(token, "/.", "--").try_cast("date")


def _span(year: Column, first: Column | int, last: Column | int) -> Column:
    """From the first day of a year's month to the last day of another of its months."""
    of = lambda m: F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad((m if isinstance(m, Column) else F.lit(m)).cast("string"), 2, "0"), F.lit("01")).try_cast("date")
    return _bounds(of(first), F.last_day(of(last)))


def _bounds(start: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"))


class _Reading:
    """What the readings work with: a text's tokens and kinds, the text in lower case, and the day it is read on."""

    def __init__(self, found: Column, text: Column, today: Column):
        self.tokens, self.kinds, self.text, self.today = found["tokens"], found["kinds"], text, today

    def first(self, pattern: str, use: Callable[[Callable[[str], Column]], Column]) -> Column:
        """Where the pattern of kinds occurs, use(of): of(kinds) is the first token with one of these kinds inside the first
        occurrence; upper bounds may pass a number as (kinds, k) for the k-th of them from the left."""
        at, size = F.regexp_instr(self.kinds, F.lit(pattern)), F.length(F.regexp_extract(self.kinds, pattern, 0))
        own = F.slice(self.tokens, F.greatest(at, F.lit(1)), F.greatest(size, F.lit(0)))
        kinds = F.substring(self.kinds, at, size)

        def of(which: str, turn: int = 1) -> Column:
            some = F.filter(own, lambda t, i: F.lit(which).contains(F.substring(kinds, i + 1, F.lit(1))))
            return F.get(some, F.lit(turn - 1))

        return F.when(at > 0, use(of))

    def says(self, words: str) -> Column:
        return self.text.contains(words)

    def quarter_of(self, months_ago: int) -> Column:
        day = F.add_months(self.today, -months_ago)
        return _span(F.year(day), 3 * F.quarter(day) - 2, 3 * F.quarter(day))


def _digit(token: Column) -> Column:
    return F.substring(token, -1, 1).cast("int")


def _month(token: Column) -> Column:
    return _lookup(MONTHS, token)


def _quarters(r: _Reading) -> Column:
    def use(of):
        one = _digit(of("qn"))
        two = F.coalesce(_digit(of("qn", 2)), one)
        return _span(of("y"), 3 * F.least(one, two) - 2, 3 * F.greatest(one, two))

    return r.first("qt?[qn]?c?y", use)


def _halves(r: _Reading) -> Column:
    return r.first("hc?y", lambda of: _span(of("y"), 6 * _digit(of("h")) - 5, 6 * _digit(of("h"))))


def _months(r: _Reading) -> Column:
    return r.first("my", lambda of: _span(of("y"), _month(of("m")), _month(of("m"))))


def _day_or_next(r: _Reading) -> Column:
    # A day stands for itself after "as of", "on" or "at" (whatever word these end), and else lasts into the next one.
    alone = F.concat(r.text, F.lit(" ")).rlike(r"(?:as of|on|at)\s")
    return r.first("D", lambda of: _bounds(_day(of("D")), F.date_add(_day(of("D")), F.when(alone, 0).otherwise(1))))


def _named_day(r: _Reading) -> Column:
    def use(of):
        day = F.concat_ws("-", of("y"), _month(of("m")).cast("string"), of("ni")).try_cast("date")
        return _bounds(day, day)

    return r.first("am[ni]c?y", use)


def _last_units(r: _Reading) -> Column:
    def use(of):
        n, unit = of("ni").try_cast("int"), of("doz")
        start = F.when(unit == "days", F.date_sub(r.today, n)).when(unit == "months", F.trunc(F.add_months(r.today, -n), "month")).otherwise(F.add_months(r.today, -12 * n))
        return _bounds(start, r.today)

    return r.first("l[ni][doz]", use)


def _month_range(r: _Reading) -> Column:
    month = lambda of, k: _span(of("y", k), _month(of("m", k)), _month(of("m", k)))
    return r.first("my[tu]my", lambda of: _bounds(month(of, 1)["start"], month(of, 2)["end"]))


def _year(r: _Reading) -> Column:
    return r.first("y", lambda of: F.when(of("y").cast("int").between(FIRST_YEAR, LAST_YEAR), _span(of("y"), 1, 12)))


def _month_ago(r: _Reading) -> Column:
    day = F.add_months(r.today, -1)
    return F.when(r.says("last month"), _span(F.year(day), F.month(day), F.month(day)))


#: What a text may say, the most telling first, and the label that stands for its own words (None: they stay). The first
#: reading whose struct isn't null decides; one that is null leaves the text to the next.
READINGS: list[tuple[Callable[[_Reading], Column], str | None]] = [
    (lambda r: r.first("[DE][tu][DE]", lambda of: _bounds(_day(of("DE")), _day(of("DE", 2)))), None),
    (_day_or_next, None),
    (_named_day, None),
    (_quarters, None),
    (_halves, None),
    (_month_range, None),
    (_months, None),
    (_year, None),
    # A year out of range says that no window is meant, so nothing else is read into the text.
    (lambda r: F.when(r.kinds.contains("y"), _bounds(F.lit(None).cast("date"), F.lit(None).cast("date"))), ""),
    (lambda r: F.when(r.says("current quarter"), r.quarter_of(0)), "current quarter"),
    (lambda r: F.when(r.says("previous quarter") | r.says("last quarter"), r.quarter_of(3)), "previous quarter"),
    (lambda r: F.when(r.says("current year") | r.says("this year"), _span(F.year(r.today), 1, 12)), "current year"),
    (_last_units, None),
    (_month_ago, None),
    (lambda r: F.when(r.says("30 days"), _bounds(F.date_sub(r.today, 30), r.today)), None),
    (lambda r: F.when(r.says("current") | r.says("today"), _bounds(r.today, r.today)), "current"),
]


def _read(text: Column, today: Column, readings: list) -> Column:
    """struct(start, end, label) of the first reading that fits; null if none does."""

    def labelled(bounds: Column, label: str | None) -> Column:
        return _let(bounds, lambda b: F.when(b.isNotNull(), F.struct(b["start"].alias("start"), b["end"].alias("end"), (F.trim(text) if label is None else F.lit(label)).alias("label"))))

    def of(found: Column) -> Column:
        r = _Reading(found, F.lower(F.trim(text)), today)
        return F.coalesce(*[labelled(reading(r), label) for reading, label in readings])

    return _let(tokenised(text), of)


def window_column(text: Column, as_of: Column) -> Column:
    """The windows that texts name, read on the day as_of: struct(start, end, label). Null if a text names none, null bounds
    if it names days that don't exist or (label '') a year out of range."""
    return _read(text, as_of, READINGS)


def _only(text: Column, reading: Callable) -> Column:
    return _let(_read(text, F.lit(None).cast("date"), [(reading, None)]), lambda w: F.when(w.isNotNull(), _bounds(w["start"], w["end"])))


def quarter_window(text: Column) -> Column:
    """The quarters that a text names as struct(start, end), null if it names none; halves and months likewise."""
    return _only(text, _quarters)


def half_window(text: Column) -> Column:
    return _only(text, _halves)


def month_window(text: Column) -> Column:
    return _only(text, _months)


def _evaluated(made: Callable[[Column, Column], Column], text: str, day: date):
    """One text's value of a column expression. There is no table, so Spark works it out without a job."""
    spark = SparkSession.active()
    row = spark.sql("SELECT :text AS text, :day AS day", args={"text": text, "day": day})
    return row.select(made(F.col("text"), F.col("day")).alias("w")).first()["w"]


def parse_window(text: str | None, as_of: date | None = None) -> DateWindow:
    """The window that an expression names; empty if it names none. Days that don't exist raise ValueError."""
    if not text:
        return DateWindow()
    found = _evaluated(window_column, text, as_of or date.today())
    if not found or not found["label"]:
        return DateWindow()
    if found["start"] is None or found["end"] is None:
        raise ValueError(f"no such day: {text!r}")
    return DateWindow(found["start"], found["end"], found["label"])


def explorer_column(text: Column) -> Column:
    """The graph explorer's short forms as struct(start, end) of ISO texts: a quarter (which ends on a 31st there), a year, a
    month, a day or two days; null for anything else."""

    def of(found: Column) -> Column:
        tokens, kinds = found["tokens"], found["kinds"]
        at = lambda i: F.get(tokens, F.lit(i))
        iso = lambda year, month, day: F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.lit(day))
        both = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
        month = iso(at(0), at(2), "01")
        # Between two days: two points, "to", a hyphen or an arrow.
        between = F.array_join(F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 2, F.lit(0))), "")
        padded = F.forall(F.filter(tokens, lambda t: t.rlike("^[0-9]")), lambda t: F.length(t) == 10)
        return (
            F.when(kinds == "qy", both(iso(at(1), 3 * _digit(at(0)) - 2, "01"), iso(at(1), 3 * _digit(at(0)), "31")))
            .when(kinds == "y", both(iso(at(0), F.lit(1), "01"), iso(at(0), F.lit(12), "31")))
            .when(kinds.rlike("^yt[ni]$") & (F.length(at(2)) == 2) & month.try_cast("date").isNotNull(), both(month, F.last_day(month.try_cast("date")).cast("string")))
            .when(kinds.rlike("^D(.*D)?$") & padded & between.isin("", "..", "to", "-", "→"), both(at(0), F.element_at(tokens, -1)))
        )

    return _let(tokenised(F.trim(text)), of)


def explorer_window(label: str) -> tuple[str, str] | None:
    found = _evaluated(lambda text, _: explorer_column(text), label, date.today())
    return (found["start"], found["end"]) if found else None
