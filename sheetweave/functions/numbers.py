"""Decimal rounding by the exact value of a double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def exact_round(x: Column, digits: int) -> Column:
    """x to 0 to 4 decimal digits by its exact binary value, ties to even: 0.25 gives 0.2 and 0.35, which lies below its
    name, gives 0.3. F.round goes by the shortest decimal that names a double, and up on ties.

    Most doubles times the power lie farther from a tie than that product can be off, so the nearest whole number is that of
    the exact product too. For the others the fraction is cut into pieces of 18 bits, so each piece times a power of ten is
    exact, and so is every sum whose sign decides; that is done row by row outside of compiled code. Doubles that times the
    power reach 2^53, NaN and infinities stay as they are."""
    if not 0 <= digits <= 4:
        raise ValueError("digits from 0 to 4")
    ten, cut, half = F.lit(10.0**digits), F.lit(2.0**18), F.lit(0.5)
    size = F.abs(x.cast("double"))
    times = size * ten
    clear = (times < F.lit(2.0**50)) & (F.abs(F.abs(times - F.rint(times)) - half) > times * F.lit(2.0**-51))

    def of_fraction(p: Column) -> Column:
        # p: whole, fraction
        high = F.floor(p["f"] * cut).cast("double") / cut
        rest = (p["f"] - high) * cut
        middle = F.floor(rest * cut).cast("double") / cut
        low = rest - middle
        whole = F.floor(high * ten).cast("double")
        return F.struct(
            (p["w"] * ten + whole).alias("n"), (high * ten - whole + middle * ten / cut - half).alias("over"), (low * ten / cut).alias("low")
        )

    def rounded(q: Column) -> Column:
        beyond = q["over"] + q["low"]
        up = (beyond > 0) | ((beyond == 0) & (q["n"] % 2 == 1))
        return (q["n"] + F.when(up, 1.0).otherwise(0.0)) / ten

    parts = F.struct(F.floor(size).cast("double").alias("w"), (size - F.floor(size).cast("double")).alias("f"))
    out = F.when(clear, F.rint(times) / ten).otherwise(_let(_let(parts, of_fraction), rounded))
    plain = ~(times < F.lit(2.0**53)) | F.isnan(x)
    return F.when(plain, x.cast("double")).otherwise(F.when(x < 0, -out).otherwise(out))
