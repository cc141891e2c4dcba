"""JavaScript's numbers: conversion to and from text, 32-bit integers, operators."""

from __future__ import annotations

import math
import re

from scriptloom.js.reuse import as_float

_SPACE = " \t\n\v\f\r ﻿                　"


def to_text(x: float) -> str:
    """As JavaScript prints a number."""
    x = float(x)
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "Infinity" if x > 0 else "-Infinity"
    if x == 0:
        return "0"
    if x < 0:
        return "-" + to_text(-x)
    if x.is_integer() and x < 1e21:
        return str(int(x)) if x < 2**53 else _digits(x)
    return _digits(x)


def _digits(x: float) -> str:
    mantissa, _, exponent = repr(x).partition("e")
    whole, _, rest = mantissa.partition(".")
    rest = "" if rest == "0" else rest
    point = len(whole) + int(exponent or 0)
    digits = whole + rest
    stripped = digits.lstrip("0")
    point -= len(digits) - len(stripped)
    digits = stripped.rstrip("0")
    if len(digits) <= point <= 21:
        return digits + "0" * (point - len(digits))
    if 0 < point <= 21:
        return f"{digits[:point]}.{digits[point:]}"
    if -6 < point <= 0:
        return "0." + "0" * -point + digits
    e = point - 1
    return digits[0] + ("." + digits[1:] if len(digits) > 1 else "") + f"e{'+' if e > 0 else '-'}{abs(e)}"


def from_text(s: str) -> float:
    """Number(s)."""
    s = s.strip(_SPACE)
    if not s:
        return 0.0
    for prefix, base in (("0x", 16), ("0o", 8), ("0b", 2)):
        if s[:2].lower() == prefix:
            try:
                return float(int(s[2:].replace("_", "!"), base))
            except ValueError:
                return math.nan
    m = re.fullmatch(r"[+-]?(?:Infinity|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", s)
    return float(s.replace("Infinity", "inf")) if m else math.nan


def to_int32(x: float) -> int:
    n = to_uint32(x)
    return n - (1 << 32) if n >= 1 << 31 else n


def to_uint32(x: float) -> int:
    return 0 if math.isnan(x) or math.isinf(x) else int(x) & 0xFFFFFFFF


def divide(a: float, b: float) -> float:
    if b == 0:
        return math.nan if a == 0 or math.isnan(a) else math.copysign(math.inf, a) * math.copysign(1, b)
    return a / b


def remainder(a: float, b: float) -> float:
    if math.isnan(a) or math.isnan(b) or math.isinf(a) or b == 0:
        return math.nan
    return a if math.isinf(b) else math.fmod(a, b)


def power(a: float, b: float) -> float:
    try:
        if math.isnan(b) or (abs(a) == 1 and math.isinf(b)):
            return math.nan
        out = a**b
        return math.nan if isinstance(out, complex) else out
    except OverflowError:
        return math.inf
    except ZeroDivisionError:
        return math.inf


def binary(op: str, a: float, b: float) -> float:
    """A numeric operator on two numbers."""
    a, b = as_float(a), as_float(b)
    if op == "+":
        return a + b
    if op == "-":
        return a - b
    if op == "*":
        return a * b
    if op == "/":
        return divide(a, b)
    if op == "%":
        return remainder(a, b)
    if op == "**":
        return power(a, b)
    if op == "&":
        return float(to_int32(a) & to_int32(b))
    if op == "|":
        return float(to_int32(a) | to_int32(b))
    if op == "^":
        return float(to_int32(a) ^ to_int32(b))
    if op == "<<":
        return float(to_int32(to_int32(a) << (to_uint32(b) & 31)))
    if op == ">>":
        return float(to_int32(a) >> (to_uint32(b) & 31))
    if op == ">>>":
        return float(to_uint32(a) >> (to_uint32(b) & 31))
    raise ValueError(op)
