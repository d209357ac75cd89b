"""OCR-like noise for a text column.

Every random draw is computed from seed, row key and position, so a row gives the
same text under any partitioning, on every retry and in any other engine.
Narrow: no shuffle.
"""

from pyspark.sql import Column, DataFrame, functions as F

from docketry import fixed_values as fv
from docketry.functions.binding import let
from docketry.functions.draws import Draws, key_state
from docketry.functions.text import SPACE, strip

MODES = ("substitute", "missing", "extra", "case")
SUBSTITUTE_RATE = 0.3
CASE_RATE = 0.5
LAYOUT_RATE = 0.2
LAYOUT_SPACE_RATE = 0.5
_STATE = "_draws_state"


#: Places in the path of a draw.
(
    WORDS, LAYOUT, GATE, MODE, SWAP, WHICH, FIRST, SECOND, COUNT, PLACE, LINE, KIND, CUT,
) = range(13)


def _chars(word: Column) -> Column:
    return F.regexp_extract_all(word, F.lit("(?s)."), F.lit(0))


def _look_alike(char: Column, draws: Draws) -> Column:
    table = F.create_map(
        *[
            part
            for char_, others in fv.LOOK_ALIKES.items()
            for part in (F.lit(char_), F.array(*[F.lit(o) for o in others]))
        ]
    )
    return let(
        F.try_element_at(table, char),
        lambda options: F.when(
            options.isNotNull() & (draws.at(SWAP).uniform() < SUBSTITUTE_RATE),
            F.get(options, draws.at(WHICH).below(F.size(options))),
        ).otherwise(char),
    )


def substitute_characters(word: Column, draws: Draws) -> Column:
    """Swap each mapped character for a look-alike, 30 % of the time."""
    swapped = F.transform(_chars(word), lambda c, i: _look_alike(c, draws.at(i)))
    return F.array_join(swapped, "")


def remove_characters(word: Column, draws: Draws) -> Column:
    """Drop one or two characters of a word longer than two."""

    def drop(chars: Column) -> Column:
        n = F.size(chars)
        first = draws.at(FIRST).below(n)
        # second position among the n - 1 characters that remain
        rest = draws.at(SECOND).below(n - 1)
        second = F.when(rest >= first, rest + 1).otherwise(rest)
        two = draws.at(COUNT).below(2) == 1
        kept = F.filter(chars, lambda _, i: (i != first) & ~(two & (i == second)))
        return F.when(n <= 2, word).otherwise(F.array_join(kept, ""))

    return let(_chars(word), drop)


def _insert(word: Column, draws: Draws) -> Column:
    place = draws.at(PLACE).below(F.length(word) + 1)
    extra = F.get(
        F.array(*[F.lit(c) for c in fv.EXTRA_CHARACTERS]),
        draws.at(WHICH).below(len(fv.EXTRA_CHARACTERS)),
    )
    return F.concat(
        F.substr(word, F.lit(1), place), extra, F.substr(word, place + F.lit(1))
    )


def add_characters(word: Column, draws: Draws) -> Column:
    """Insert one or two stray characters anywhere."""
    return let(
        _insert(word, draws.at(1)),
        lambda once: F.when(draws.at(COUNT).below(2) == 1, _insert(once, draws.at(2)))
        .otherwise(once),
    )


def change_case(word: Column, draws: Draws) -> Column:
    """Flip the case of half the characters."""

    def flip(c: Column, i: Column) -> Column:
        flipped = F.when(c.rlike(r"\p{Ll}"), F.upper(c)).otherwise(F.lower(c))
        return F.when(draws.at(i).uniform() < CASE_RATE, flipped).otherwise(c)

    return F.array_join(F.transform(_chars(word), flip), "")


_BY_MODE = {
    "substitute": substitute_characters,
    "missing": remove_characters,
    "extra": add_characters,
    "case": change_case,
}


def ocr_noise(text: Column, draws: Draws, level: float, modes: tuple[str, ...] = MODES) -> Column:
    """Noise each word with probability ``level``; blanks collapse to one.

    A level of zero or less returns the text untouched.
    """
    if level <= 0:
        return text

    def spoil(word: Column, i: Column) -> Column:
        here = draws.at(i)

        def by(mode: Column) -> Column:
            spoiled = word
            for place, name in enumerate(modes):
                spoiled = F.when(mode == place, _BY_MODE[name](word, here.at(MODES.index(name)))).otherwise(
                    spoiled
                )
            return spoiled

        return F.when(
            here.at(GATE).uniform() < level, let(here.at(MODE).below(len(modes)), by)
        ).otherwise(word)

    return let(
        strip(text),
        lambda t: F.when(t == "", "").otherwise(
            F.array_join(F.transform(F.split(t, rf"(?U){SPACE}+"), spoil), " ")
        ),
    )


def layout_noise(text: Column, draws: Draws) -> Column:
    """Disturb a fifth of the lines: widen the gaps or break the line in two."""

    def disturb(line: Column, i: Column) -> Column:
        here = draws.at(i)
        widened = F.regexp_replace(line, r"([\p{L}\p{N}_])", "$1  ")

        def broken(words: Column) -> Column:
            cut = here.at(CUT).below(F.size(words) - 1) + 1
            parts = F.concat(
                F.array_join(F.slice(words, F.lit(1), cut), " "),
                F.lit("\n"),
                F.array_join(F.slice(words, cut + 1, F.size(words)), " "),
            )
            return F.when(F.size(words) > 2, parts).otherwise(line)

        return F.when(
            here.at(LINE).uniform() < LAYOUT_RATE,
            F.when(here.at(KIND).uniform() < LAYOUT_SPACE_RATE, widened).otherwise(
                let(F.split(strip(line), rf"(?U){SPACE}+"), broken)
            ),
        ).otherwise(line)

    return F.array_join(F.transform(F.split(text, "\n"), disturb), "\n")


def augment_text(
    rows: DataFrame,
    text_col: str,
    key_col: str | list[str],
    noise_level: float = 0.1,
    seed: int = 0,
    modes: tuple[str, ...] = MODES,
    layout: bool = False,
) -> DataFrame:
    """Replace ``text_col`` by its noised form."""
    keys = [key_col] if isinstance(key_col, str) else key_col
    kinds = dict(rows.dtypes)
    out = rows.withColumn(_STATE, key_state(seed, [(F.col(k), kinds[k]) for k in keys]))
    draws = Draws(F.col(_STATE))
    noised = ocr_noise(F.col(text_col), draws.at(WORDS), noise_level, tuple(modes))
    out = out.withColumn(text_col, noised)
    if layout:
        out = out.withColumn(text_col, layout_noise(F.col(text_col), draws.at(LAYOUT)))
    return out.drop(_STATE)
