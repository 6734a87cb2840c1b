"""Verhoeff and Luhn checks and check digits as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from hushframe.functions.patterns import VERHOEFF_D, VERHOEFF_INVERSE, VERHOEFF_P

_D, _P = ([int(d) for row in rows for d in row] for rows in (VERHOEFF_D, VERHOEFF_P))


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with the value evaluated a single time, however often a lambda inside refers to it."""
    return F.transform(F.array(value), then)[0]


def _digit(text: Column, at: Column) -> Column:
    return F.substring(text, at, F.lit(1)).cast("int")


def _verhoeff(digits: Column, first: int) -> Column:
    """Fold the digits from the last on; `first` is the position of the last digit (0 with its check digit, 1 without)."""
    d, p = (F.array(*map(F.lit, t)) for t in (_D, _P))

    def fold(digits: Column) -> Column:
        step = lambda c, i: F.get(d, c * 10 + F.get(p, (i + first) % 8 * 10 + _digit(digits, F.length(digits) - i)))
        return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step)

    return once(digits, fold)


def verhoeff_ok(digits: Column) -> Column:
    """Twelve digits that begin with 2 to 9 and fold to zero."""
    return F.when(digits.rlike(r"^[2-9]\d{11}\z"), _verhoeff(digits, 0) == 0).otherwise(False)


def verhoeff_digit(digits: Column) -> Column:
    return _digit(F.lit(VERHOEFF_INVERSE), _verhoeff(digits, 1) + 1)


def _luhn(digits: Column, doubled: int) -> Column:
    """Sum of the digits, every second one from the end doubled; `doubled` is the parity of those doubled."""

    def fold(digits: Column) -> Column:
        def step(total: Column, i: Column) -> Column:
            d = _digit(digits, F.length(digits) - i)
            return total + F.when(i % 2 == doubled, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

        return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step)

    return once(digits, fold)


def luhn_ok(digits: Column) -> Column:
    """13 to 19 digits whose Luhn sum ends in zero."""
    return F.when(digits.rlike(r"^\d{13,19}\z"), _luhn(digits, 1) % 10 == 0).otherwise(False)


def luhn_digit(digits: Column) -> Column:
    return (10 - _luhn(digits, 0) % 10) % 10
