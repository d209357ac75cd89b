"""Date expressions.  Dates are ISO strings at the boundary.

Formats are recognised with anchored patterns and then cast, which costs a
regex per layout and no exception for text that is not a date.
"""

from pyspark.sql import Column, functions as F

from docketry import fixed_values as fv
from docketry.functions.binding import find, let
from docketry.functions.text import collapse_spaces, strip

_D = r"(3[01]|[12]\d|0[1-9]|[1-9]| [1-9])"
_M = r"(1[0-2]|0[1-9]|[1-9])"
_Y = r"((?!0000)\d{4})"
_MONTHS = (
    "january", "february", "march", "april", "may", "june", "july",
    "august", "september", "october", "november", "december",
)
_MONTH_WORD = "(" + "|".join(f"{m}|{m[:3]}" for m in _MONTHS) + ")"

_YEAR_FIRST = rf"^{_Y}([-/.]){_M}\2{_D}$"
_DAY_FIRST = rf"^{_D}([-/]){_M}\2{_Y}$"
_MONTH_FIRST = rf"^{_M}([-/]){_D}\2{_Y}$"
_DAY_WORD = rf"(?i)^{_D} {_MONTH_WORD} {_Y}$"
_WORD_DAY = rf"(?i)^{_MONTH_WORD} {_D} {_Y}$"


def _iso(year: Column, month: Column, day: Column) -> Column:
    return F.concat_ws("-", year, month, F.trim(day)).try_cast("date").cast("string")


def _month_number(word: Column) -> Column:
    # position of the three-letter name in "janfebmar...", three apart
    names = F.lit("".join(m[:3] for m in _MONTHS))
    place = F.position(F.substring(F.lower(word), 1, 3), names)
    return F.floor((place + F.lit(2)) / F.lit(3)).cast("int").cast("string")


def _read_layouts(text: Column) -> Column:
    """First layout that accepts the whole text; day-first before month-first."""

    def part(pattern, group):
        return F.regexp_extract(text, pattern, group)

    def reads(pattern, value):
        return F.when(F.rlike(text, F.lit(pattern)), value)

    return F.coalesce(
        reads(_YEAR_FIRST, _iso(part(_YEAR_FIRST, 1), part(_YEAR_FIRST, 3), part(_YEAR_FIRST, 4))),
        reads(_DAY_FIRST, _iso(part(_DAY_FIRST, 4), part(_DAY_FIRST, 3), part(_DAY_FIRST, 1))),
        reads(
            _MONTH_FIRST, _iso(part(_MONTH_FIRST, 4), part(_MONTH_FIRST, 1), part(_MONTH_FIRST, 3))
        ),
        reads(
            _DAY_WORD,
            _iso(part(_DAY_WORD, 3), _month_number(part(_DAY_WORD, 2)), part(_DAY_WORD, 1)),
        ),
        reads(
            _WORD_DAY,
            _iso(part(_WORD_DAY, 3), _month_number(part(_WORD_DAY, 1)), part(_WORD_DAY, 2)),
        ),
    )


def normalize_date(text: Column) -> Column:
    """Date text in eleven layouts, or with a date inside it -> ISO string.

    A date-like fragment that no layout accepts (two-digit year, 31 February)
    gives NULL.
    """
    unlabelled = strip(F.regexp_replace(strip(text), "(?iuU)" + fv.DATE_LABEL, ""))
    flat = collapse_spaces(F.translate(unlabelled, ",", " "))

    def without_time(t: Column) -> Column:
        timed = F.regexp_extract(t, fv.DATE_WITH_TIME, 1)
        return F.when(F.rlike(t, F.lit(fv.DATE_WITH_TIME)), timed).otherwise(t)

    def read(t: Column) -> Column:
        fragment = F.coalesce(
            *[find(t, "(?i)" + p) for p in fv.DATE_FRAGMENTS]
        )
        tidy = collapse_spaces(F.translate(fragment, ",", " "))
        return F.coalesce(_read_layouts(t), let(tidy, _read_layouts))

    return let(let(flat, without_time), read)


def date_from_text(text: Column) -> Column:
    """First recognisable date in free text, as ISO string."""
    finds = F.array(*[find(text, "(?iU)" + p) for p in fv.TEXT_DATE_PATTERNS])
    return F.get(F.array_compact(F.transform(finds, normalize_date)), F.lit(0))


def fallback_date(text: Column) -> Column:
    """Date for receipts without model output.

    The first pattern found decides, even when its text is no valid date.
    """
    fragment = F.coalesce(
        *[find(text, "(?iu)" + p) for p in fv.DATE_PATTERNS]
    )
    return normalize_date(fragment)


def date_score(predicted: Column, expected: Column) -> Column:
    """1 equal, 0.8 same day, 0.5 same month, else 0; both missing scores 1."""

    def moment(text: Column) -> Column:
        dashed = F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})(?=$|[T ])", "$1-$2-$3")
        iso = F.rlike(dashed, F.lit(r"^\d{4}-\d{2}-\d{2}([T ]\d.*)?$"))
        return F.when(iso, dashed.try_cast("timestamp_ntz"))

    def score(p: Column, e: Column) -> Column:
        return (
            F.when(p == e, 1.0)
            .when(F.to_date(p) == F.to_date(e), 0.8)
            .when(F.trunc(p, "month") == F.trunc(e, "month"), 0.5)
            .otherwise(0.0)
        )

    no_p = F.coalesce(predicted, F.lit("")) == ""
    no_e = F.coalesce(expected, F.lit("")) == ""
    return (
        F.when(no_p & no_e, 1.0)
        .when(no_p | no_e, 0.0)
        .otherwise(score(moment(predicted), moment(expected)))
    )

