"""Random draws that any engine can repeat: integer arithmetic on a counter.

A row has a state, folded from seed and key.  A draw is addressed by a path of
small numbers, folded to a counter; its value is a permutation polynomial of
state and counter modulo the prime ``2**31 - 1``.  Nothing depends on how rows
are dealt or in what order draws are made, and all products fit into 64 bits.
"""

from pyspark.sql import Column, functions as F

from docketry.functions.binding import let

PRIME = 2**31 - 1
#: Step of the counter, of the path and of the key; any numbers below the prime do.
COUNTER_STEP, PATH_STEP, KEY_STEP = 69_621, 1_009, 48_271


def _fifth_power(x: Column) -> Column:
    """Maps 0 .. PRIME - 1 one to one, as 5 does not divide PRIME - 1."""
    square = x * x % PRIME
    return square * square % PRIME * x % PRIME


def key_state(seed: int, keys: list[tuple[Column, str]]) -> Column:
    """The state of a row from its key columns with their types.

    Integers count as they are, other values by the first 28 bits of the MD5 of
    their text; NULL is a value of its own."""
    state = F.lit(seed % PRIME).cast("long")
    for key, kind in keys:
        if kind in ("tinyint", "smallint", "int", "bigint"):
            number = F.pmod(key.cast("long"), F.lit(PRIME))
        else:
            number = F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 7), 16, 10).cast("long")
        state = _fifth_power((state * KEY_STEP + F.coalesce(number, F.lit(PRIME - 1)) + 1) % PRIME)
    return state


class Draws:
    """Draws of one row, under a path."""

    def __init__(self, state: Column, counter: Column | int = 0):
        self.state, self.counter = state, counter

    def at(self, *path: Column | int) -> "Draws":
        counter = self.counter
        for step in path:
            counter = counter * PATH_STEP + 1
            if isinstance(counter, int) and not isinstance(step, int):
                counter = F.lit(counter % PRIME).cast("long")
            # Plain numbers are folded here, which keeps the expressions small.
            counter = (counter + step) % PRIME
        return Draws(self.state, counter)

    def number(self) -> Column:
        """0 .. PRIME - 1."""
        moved = self.counter * COUNTER_STEP
        if isinstance(moved, int):
            moved = F.lit(moved % PRIME).cast("long")
        return let((self.state + moved) % PRIME, _fifth_power)

    def uniform(self) -> Column:
        """In [0, 1)."""
        return self.number() / F.lit(float(PRIME))

    def below(self, n: Column | int) -> Column:
        """An integer in [0, n)."""
        return F.floor(self.number() * n / F.lit(float(PRIME))).cast("int")
