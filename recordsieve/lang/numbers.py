"""Exact decimal comparison of JSON number spellings, without size limits."""

from __future__ import annotations

import re
from decimal import Decimal
from functools import lru_cache

NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?\Z")
_PARTS = re.compile(r"(-?)([0-9]+)(?:\.([0-9]+))?(?:[eE]([+-]?[0-9]+))?")


def is_number(text: str) -> bool:
    return NUMBER.match(text) is not None


def _whole(text: str) -> int:
    """int() of any length: Python refuses texts of several thousand digits."""
    return int(text) if len(text) < 4000 else int(Decimal(text))


@lru_cache(4096)
def canonical(text: str) -> tuple[int, int, str]:
    """(sign, exponent, digits) of 0.digits * 10**exponent; zero is (0, 0, '')."""
    sign, whole, fraction, exponent = _PARTS.match(text).groups()
    digits = whole + (fraction or "")
    lead = len(digits) - len(digits.lstrip("0"))
    digits = digits.strip("0")
    if not digits:
        return 0, 0, ""
    return -1 if sign else 1, len(whole) - lead + _whole(exponent or "0"), digits


def compare(a: str, b: str) -> int:
    """-1, 0 or 1 as number a is below, equal to or above b."""
    x, y = canonical(a), canonical(b)
    if x == y:
        return 0
    if x[0] != y[0]:
        return -1 if x[0] < y[0] else 1
    return x[0] if x[1:] > y[1:] else -x[0]


def floor_at(text: str, scale: int) -> tuple[int, bool]:
    """The number times 10**scale, rounded down, and whether that is exact. The exponent has to be small."""
    sign, exponent, digits = canonical(text)
    upto = exponent + scale
    whole = _whole(digits[: max(0, upto)].ljust(max(0, upto), "0") or "0")
    exact = not digits[max(0, upto) :]
    return (whole if sign > 0 else -whole - (not exact)), exact


def as_double(text: str) -> float:
    return float(text)


def double_text(x: float) -> str:
    """17 significant digits, shortest exponent form, as C's %.17g prints."""
    return f"{x:.17g}"
