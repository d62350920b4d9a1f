"""Scalar functions as column expressions: step, smooth steps, their slopes, soft-plus parameters, quantisers, bit fields.

Each smooth step and slope is written once as SQL text that Spark and DuckDB both read, with ``x`` as its argument.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_POS = "CASE WHEN x >= 0 THEN 1.0D ELSE 0.0D END"
_SIGN = "CASE WHEN x >= 0 THEN 1.0D ELSE -1.0D END"


def _sigmoid(a: float) -> str:
    return f"(1 / (1 + exp(-{a}D * x)))"


def smooth_step(kind: str, alpha: float = 2.0, beta: float = 1.0, w: float = 1.0, c: float = 0.01, n: int = 4, period: float = 8.0) -> str:
    """The smooth form of the unit step of a given kind, as SQL over x."""
    a = alpha
    waves = " + ".join(f"sin({(2 * i - 1) * 2 * math.pi / period}D * x) / {2 * i - 1}" for i in range(1, n)) or "0"
    return {
        "piecewise_quadratic": f"CASE WHEN x > {1 / a}D THEN 1.0D WHEN abs(x) <= {1 / a}D THEN -{a * a / 2}D * x * x * sign(x) + {a}D * x + 0.5D ELSE 0.0D END",
        "piecewise_exp": f"{_POS} - exp(-{a}D * abs(x)) / 2 * ({_SIGN})",
        "sigmoid": _sigmoid(a),
        "soft_sign": f"({a}D * x / (1 + abs({a}D * x)) + 1) / 2",
        "atan": f"atan({math.pi / 2 * a}D * x) / {math.pi}D + 0.5D",
        "sign_log_abs": f"({_SIGN}) * ln({a}D * abs(x) + 1)",
        "piecewise_leaky_relu": f"CASE WHEN x < -{w}D THEN {c}D * x + {c * w}D WHEN x > {w}D THEN {c}D * x + {1 - c * w}D ELSE x / {2 * w}D + 0.5D END",
        "squarewave_fourier": f"0.5D + {2 / math.pi}D * ({waves})",
        "s2nn": f"CASE WHEN x < 0 THEN {_sigmoid(a)} ELSE {beta}D * ln(abs(x + 1) + 0.00001D) + 0.5D END",
        "q_pseudo_spike": f"{_POS} - ({_SIGN}) * (0.5D * power(1 + {2 / (a - 1) if a != 1 else math.inf}D * abs(x), {1 - a}D))",
    }[kind]


def slope(kind: str, alpha: float = 2.0, beta: float = 1.0, w: float = 1.0, c: float = 0.01, n: int = 4, period: float = 8.0) -> str:
    """The stand-in derivative of a kind, as SQL over x."""
    a = alpha
    s = _sigmoid(a)
    waves = " + ".join(f"cos({(2 * i - 1) * 2 * math.pi / period}D * x)" for i in range(1, n)) or "0"
    return {
        "piecewise_quadratic": f"CASE WHEN abs(x) > {1 / a}D THEN 0.0D ELSE {a}D - {a * a}D * abs(x) END",
        "piecewise_exp": f"{a / 2}D * exp(-{a}D * abs(x))",
        "sigmoid": f"{a}D * (1 - {s}) * {s}",
        "soft_sign": f"1 / ({2 * a}D * power({1 / a}D + abs(x), 2))",
        "atan": f"{a / 2}D / (1 + power({math.pi / 2 * a}D * x, 2))",
        "atan_plain": f"1 / (1 + power({math.pi / 2 * a}D * x, 2))",
        "sign_log_abs": f"1 / ({1 / a}D + abs(x))",
        "erf": f"{a / math.sqrt(math.pi)}D * exp(-power({a}D * x, 2))",
        "piecewise_leaky_relu": f"CASE WHEN abs(x) < {w}D THEN {1 / w}D ELSE {c}D END",
        "squarewave_fourier": f"{4 / period}D * ({waves})",
        "s2nn": f"CASE WHEN x < 0 THEN {a}D * {s} * (1 - {s}) ELSE {beta}D / (x + 1) END",
        "q_pseudo_spike": f"power(1 + {2 / (a - 1) if a != 1 else math.inf}D * abs(x), -{a}D)",
    }[kind]


KINDS = ("piecewise_quadratic", "piecewise_exp", "sigmoid", "soft_sign", "atan", "sign_log_abs", "piecewise_leaky_relu", "squarewave_fourier", "s2nn")
SLOPES = (*KINDS, "atan_plain", "erf", "q_pseudo_spike")


def duck(sql: str) -> str:
    """The same text for DuckDB, whose doubles have no suffix."""
    import re

    return re.sub(r"(\d(?:\.\d+)?(?:e-?\d+)?)D\b", r"\1::DOUBLE", sql)


def erf_step(x: Column, alpha: float = 2.0) -> Column:
    """erfc(-alpha x) / 2; no engine function for it, so an Arrow batch at a time."""

    @F.pandas_udf("double")
    def step(s: pd.Series) -> pd.Series:
        return s.map(lambda v: math.erfc(-alpha * v) / 2, na_action="ignore")

    return step(x)


def heaviside(x: Column) -> Column:
    return F.when(x >= 0, 1).otherwise(0)


def softplus(x: Column) -> Column:
    return F.log1p(F.exp(x))


def learned_tau(raw: Column) -> Column:
    """1 + softplus(raw); raw = ln(tau0 - 1) at the start, which makes it 1 + ln(tau0)."""
    return F.lit(1.0) + softplus(raw)


def rounded(x: Column, digits: int) -> Column:
    """round() that keeps the sign of what rounds to zero, as round() in SQL does: -0.0 of small negative numbers. It shows in arrays, which compare by their text."""
    r = F.round(x, digits)
    return F.when(r == 0, x * F.lit(0.0)).otherwise(r)


def step_quantise(x: Column, step: float) -> Column:
    """round(x / step) * step with halves to even."""
    return F.rint(x / F.lit(step)) * F.lit(step)


def quantise_8bit(x: Column, scale: float, descale: bool = False) -> Column:
    out = F.greatest(F.least(step_quantise(x, 2.0 / scale), F.lit(255.0 / scale)), F.lit(-256.0 / scale))
    return out * F.lit(float(scale)) if descale else out


def bits(x: Column, mask: int, shift: int) -> Column:
    """(x & mask) >> shift of an unsigned field held in a long."""
    return F.shiftright(x.cast("bigint").bitwiseAND(F.lit(mask).cast("bigint")), shift)


def pack_bits(flags: Column) -> Column:
    """An array of 0/1 as bytes (array of int), eight to a byte, first flag in the lowest bit; the end is filled with zeros."""
    n = F.ceil(F.size(flags) / 8).cast("int")
    byte = lambda k: F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0), lambda s, b: s + F.coalesce(F.get(flags, k * 8 + b), F.lit(0)) * F.pow(F.lit(2), b).cast("int"))
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), byte))


def unpack_bits(packed: Column, size: Column) -> Column:
    one = lambda i: F.floor(F.get(packed, F.floor(i / 8).cast("int")) / F.pow(F.lit(2), i % 8)).cast("int") % 2
    return F.when(size == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), size - 1), one))


def mel(hz: Column) -> Column:
    return F.lit(2595.0) * F.log10(F.lit(1.0) + hz / F.lit(700.0))


def hz(mels: Column) -> Column:
    return F.lit(700.0) * (F.pow(F.lit(10.0), mels / F.lit(2595.0)) - 1)
