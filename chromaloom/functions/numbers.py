"""Numbers as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of a fraction; a double from 1 on has no more.
BITS = 52


def tenths(x: Column) -> Column:
    """A double from 1 to below 2^53 with one decimal, as C's ``%.1f`` gives it: by
    the binary value itself, a tie to the even digit. ``format_string`` rounds the
    shortest decimal up instead, so that 1.15, which lies below the tie, gives 1.2."""
    whole = x.cast("bigint")
    # each step is exact: the fraction as an integer, ten times of it below 2^56
    ten = ((x - whole) * float(1 << BITS)).cast("bigint") * 10
    digit, rest, tie = F.shiftright(ten, BITS), ten.bitwiseAND(F.lit((1 << BITS) - 1)), F.lit(1 << (BITS - 1))
    up = (rest > tie) | ((rest == tie) & (digit % 2 == 1))
    tenth = digit + up.cast("bigint")
    return F.concat((whole + (tenth == 10).cast("bigint")).cast("string"), F.lit("."), (tenth % 10).cast("string"))
