"""Text expressions: cleaning, cache-key text, hashing, currency, vendor.

Python's ``\\s`` and ``\\w`` are Unicode classes, Java's are ASCII unless
``(?U)`` is set, so the classes are spelled out here once.
"""

from pyspark.sql import Column, functions as F

from docketry import fixed_values as fv
from docketry.functions.binding import find, let

# Unicode white space plus the four separators only Python counts as space.
SPACE = r"[\s\x1c-\x1f]"
_SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
_RUNS = rf"(?U){SPACE}+"


def strip(text: Column) -> Column:
    """Remove leading and trailing white space of any kind."""
    return F.btrim(text, F.lit(_SPACES))


def collapse_spaces(text: Column) -> Column:
    """Every run of white space becomes one blank."""
    return F.regexp_replace(text, _RUNS, " ")


def clean_text(text: Column) -> Column:
    """OCR clean-up that keeps case and symbols.

    Bars and underscore runs are replaced after the collapse, so they may
    leave double blanks behind; callers rely on that exact text.
    """
    flat = collapse_spaces(strip(F.coalesce(text, F.lit(""))))
    no_bars = F.replace(flat, F.lit("|"), F.lit(" "))
    return strip(F.regexp_replace(no_bars, "_{2,}", " "))


def normalize_text(text: Column) -> Column:
    """Case-free, punctuation-free text that the cache key is built from."""
    kept = F.regexp_replace(
        F.lower(F.coalesce(text, F.lit(""))), rf"(?U)[^\p{{L}}\p{{N}}_\s\x1c-\x1f.,$]", ""
    )
    return collapse_spaces(strip(kept))


def text_hash(text: Column) -> Column:
    """SHA-256 of the UTF-8 bytes, as lower-case hex."""
    return F.sha2(text, 256)


def extract_currency(text: Column) -> Column:
    """Currency code of the highest-priority symbol in the text, else NULL."""
    symbol, code = fv.CURRENCY_SYMBOLS[0]
    picked = F.when(F.contains(text, F.lit(symbol)), F.lit(code))
    for symbol, code in fv.CURRENCY_SYMBOLS[1:]:
        picked = picked.when(F.contains(text, F.lit(symbol)), F.lit(code))
    return picked


def title_case(text: Column) -> Column:
    """Upper-case the first letter of every run of letters, lower the rest.

    ``initcap`` only looks at blanks: it would leave ``7eleven`` as it is.
    """
    runs = F.regexp_extract_all(text, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(
        F.transform(
            runs,
            lambda run: F.concat(F.upper(F.substring(run, 1, 1)), F.lower(F.substr(run, F.lit(2)))),
        ),
        "",
    )


def normalize_vendor(vendor: Column) -> Column:
    """Drop punctuation and title-case; NULL when nothing is left."""
    kept = F.regexp_replace(strip(vendor), rf"(?U)[^\p{{L}}\p{{N}}_\s\x1c-\x1f]", "")
    return let(kept, lambda k: F.when(k != "", title_case(k)))


def first_group(text: Column, patterns, flags: str) -> Column:
    """Group 1 of the first pattern that matches anywhere in ``text``."""
    return F.coalesce(*[find(text, flags + pattern, 1) for pattern in patterns])


def fallback_vendor(text: Column, word_boundary: bool = False) -> Column:
    """Vendor from a "from/at" phrase, a header line or a "... receipt" phrase.

    The published pattern has no boundary before ``from|at`` ("Flat White"
    gives "White"); ``word_boundary=True`` adds it.
    """
    flags = "(?imuU)"
    phrase, header, labelled = fv.VENDOR_PATTERNS
    if word_boundary:
        phrase = r"\b" + phrase
    # the last pattern backtracks through every run of letters, so it is tried
    # only where the word it ends in occurs
    has_label = F.rlike(text, F.lit(flags + r"\s(?:receipt|invoice)"))
    found = F.coalesce(
        find(text, flags + phrase, 1),
        find(text, flags + header, 1),
        F.when(has_label, find(text, flags + labelled, 1)),
    )
    return strip(found)


def excerpt(text: Column, length: int = 100) -> Column:
    """Leading characters followed by dots, for failure reports."""
    return F.concat(F.substring(F.coalesce(text, F.lit("")), 1, length), F.lit("..."))


def random_request_id() -> Column:
    """Version-4 UUID.  Changes when a task is retried; see ``derived_request_id``."""
    return F.uuid()


def derived_request_id(*source: Column) -> Column:
    """UUID-shaped id computed from the source key: the same on every retry."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in source]
    digest = F.sha2(F.concat_ws("\x1f", *parts), 256)
    return F.regexp_replace(
        F.substring(digest, 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"
    )

