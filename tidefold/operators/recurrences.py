"""Ordered recurrences: spiking neurons, decayed log-sum-exp, synapse and trace filters, recurrent cells.

All run as streaming scans, the keys of a window in lockstep (functions.ordered), in exact double arithmetic. The steps of filters, traces
and averages compose: a key of more than ``hot_rows`` rows is cut into blocks that lie in many tasks (functions.blocks).
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import HOT_ROWS, affine, affine_scan, block_scan, largest
from ..functions.ordered import lockstep

KEYS, ORDER = ("sample",), ("t", "event_id")
Charge = Callable[[float, float], float]


def neuron(df: DataFrame, charge: Charge, theta: float = 1.0, v_reset: float | None = 0.0, v0: float | None = None, x: str = "x", emit: Callable[[float], float] | None = None, keys=KEYS, order=ORDER, fire: Callable[[float], float] | None = None) -> DataFrame:
    """v = charge(v, x); s = v >= theta; then v = v_reset on a spike, or v - theta if v_reset is None. Adds spike and v (after the reset).

    ``emit`` replaces the output s by a function of the charged v (an activation output); the spike still resets. ``fire`` is a surrogate in the step's place:
    s = fire(v - theta), any number, is the output and resets in proportion. A null input counts as 0. Charges, emit and fire take numbers and numpy arrays."""
    first = (0.0 if v_reset is None else v_reset) if v0 is None else v0

    def one(state, value):
        v = charge(state[0], value)
        s = 1 if v >= theta else 0
        if fire is not None:
            out = fire(v - theta)
            v = v - out * theta if v_reset is None else (1 - out) * v + out * v_reset
            return (v,), (s, v, out)
        out = float(s) if emit is None else emit(v)
        if s:
            v = v - theta if v_reset is None else v_reset
        return (v,), (s, v, out)

    def many(state, value):
        v = charge(state[0], value)
        s = v >= theta
        if fire is not None:
            out = fire(v - theta)
            v = v - out * theta if v_reset is None else (1 - out) * v + out * v_reset
            return (v,), (s, v, out)
        out = s if emit is None else emit(v)
        return (np.where(s, v - theta if v_reset is None else v_reset, v),), (s, np.where(s, v - theta if v_reset is None else v_reset, v), out)

    return lockstep(df, keys, order, [x], [first], many, "spike int, v double, out double", one)


# charges


def integrate() -> Charge:
    return lambda v, x: v + x


def leaky(tau: float = 2.0, decay_input: bool = True, v_reset: float | None = 0.0) -> Charge:
    rest = v_reset or 0.0
    if decay_input:
        return lambda v, x: v + (x - (v - rest)) / tau
    return lambda v, x: v - (v - rest) / tau + x


def parametric(w: float, decay_input: bool = True, v_reset: float | None = 0.0) -> Charge:
    """A leak of sigmoid(w); w = -ln(tau - 1) starts it at 1 / tau."""
    rate, rest = 1 / (1 + math.exp(-w)), v_reset or 0.0
    if decay_input:
        return lambda v, x: v + (x - (v - rest)) * rate
    return lambda v, x: v - (v - rest) * rate + x


def learnable(tau: float = 2.0) -> Charge:
    """v / tau + x; meant for the soft reset."""
    return lambda v, x: v / tau + x


def quadratic(tau: float = 2.0, v_c: float = 0.8, a0: float = 1.0, v_rest: float = 0.0) -> Charge:
    return lambda v, x: v + (x + a0 * (v - v_rest) * (v - v_c)) / tau


def exponential(tau: float = 2.0, delta: float = 1.0, theta_rh: float = 0.8, v_rest: float = 0.0) -> Charge:
    return lambda v, x: v + (x + v_rest - v + delta * np.exp(np.minimum((v - theta_rh) / delta, 700.0))) / tau


def linear(a: float, b: float, c: float = 0.0) -> Charge:
    return lambda v, x: a * v + b * x + c


def adaptive(df: DataFrame, tau: float = 2.0, tau_w: float = 2.0, a: float = 0.0, b: float = 0.0, v_rest: float = 0.0, theta: float = 1.0, v_reset: float = 0.0, x: str = "x", keys=KEYS, order=ORDER) -> DataFrame:
    """A leaky neuron with a current w that is subtracted: w += (a (v - v_rest) - w) / tau_w + b s. Adds spike, v, w."""

    def one(state, value):
        v, w = state
        v = v + (value - (v - v_rest) - w) / tau
        s = 1 if v >= theta else 0
        w = w + (a * (v - v_rest) - w) / tau_w + b * s
        if s:
            v = v_reset
        return (v, w), (s, v, w)

    def many(state, value):
        v, w = state
        v = v + (value - (v - v_rest) - w) / tau
        s = v >= theta
        w = w + (a * (v - v_rest) - w) / tau_w + b * s
        v = np.where(s, v_reset, v)
        return (v, w), (s, v, w)

    return lockstep(df, keys, order, [x], [v_reset, 0.0], many, "spike int, v double, w double", one)


def _later(left, right, decay: float):
    """Two neighbouring runs of weighted keys: steps, sums of values and of weights, and the exponent that both are shifted by. Each step decays what came before."""
    (n, p, q, o), (m, r, s, u) = left, right
    with np.errstate(over="ignore"):
        faded = o + decay * m
        top = np.maximum(faded, u)
        a, b = np.exp(faded - top), np.exp(u - top)
    return n + m, a * p + b * r, a * q + b * s, top


def wkv(df: DataFrame, decay: float, first: float, k: str = "k", v: str = "v", keys=KEYS, order=ORDER, floor: float = -1e38, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Weighted key-value average along a key with exponents shifted by their maximum. ``decay`` is w = -exp(time decay); ``first`` is the bonus u. Adds y.

    The sums over earlier rows compose, so a key may lie in many tasks (functions.blocks). Null keys and values count as 0."""

    def step(state, key, value, exp=np.exp, most=np.maximum):
        p, q, o = state
        top = most(o, first + key)
        a, b = exp(o - top), exp(first + key - top)
        y = (a * p + b * value) / (a * q + b)
        top = most(decay + o, key)
        a, b = exp(decay + o - top), exp(key - top)
        return (a * p + b * value, a * q + b, top), (y,)

    if largest(df, keys) <= hot_rows:
        return lockstep(df, keys, order, [k, v], [0.0, 0.0, floor], step, "y double", lambda s, key, value: step(s, key, value, math.exp, max))

    def single(key, value):
        key, value = np.nan_to_num(key), np.nan_to_num(value)
        return np.ones_like(key), value, np.ones_like(key), key

    names = ["__n", "__p", "__q", "__o"]
    out = block_scan(df, keys, order, [k, v], single, lambda x, y: _later(x, y, decay), (0.0, 0.0, 0.0, floor), [f"_{c}" for c in names], before=True)
    now = F.coalesce(F.col(k), F.lit(0.0)) + F.lit(first)
    top = F.greatest("___o", now)
    a, b = F.exp(F.col("___o") - top), F.exp(now - top)
    y = (a * F.col("___p") + b * F.coalesce(F.col(v), F.lit(0.0))) / (a * F.col("___q") + b)
    return out.select(*df.columns, y.alias("y"))


def synapse(df: DataFrame, tau: float = 100.0, spike: str = "spike", keys=KEYS, order=ORDER, hot_rows: int = HOT_ROWS) -> DataFrame:
    """i = i - (1 - s) i / tau + s. Adds current. A large key is filtered in blocks."""

    def step(state, s):
        i = state[0] - (1 - s) * state[0] / tau + s
        return (i,), (i,)

    if largest(df, keys) <= hot_rows:
        return lockstep(df, keys, order, [spike], [0.0], step, "current double", step)
    return affine_scan(df, keys, order, [spike], lambda s: [(1 - (1 - s) / tau, s)], ["current"], [0.0])


def traces(df: DataFrame, tau_pre: float, tau_post: float, pre: str, post: str, f_pre: tuple[float, float] = (1.0, -1.0), f_post: tuple[float, float] = (0.0, 1.0), rate: float = 0.1, w0: float = 0.5, keys=KEYS, order=ORDER, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Spike traces tr += s - tr / tau of both sides, and a weight that moves with the spikes: w += rate (f_pre(w) s_pre + f_post(w) s_post). Adds tr_pre, tr_post, weight.

    f_pre, f_post: (c, d) for c + d w."""

    def step(state, a, b):
        x, y, w = state
        x, y = x + (-x / tau_pre + a), y + (-y / tau_post + b)
        w = w + ((f_pre[0] + f_pre[1] * w) * a + (f_post[0] + f_post[1] * w) * b) * rate
        return (x, y, w), (x, y, w)

    if largest(df, keys) <= hot_rows:
        return lockstep(df, keys, order, [pre, post], [0.0, 0.0, w0], step, "tr_pre double, tr_post double, weight double", step)

    def steps(a, b):
        moved = (1 + rate * (f_pre[1] * a + f_post[1] * b), rate * (f_pre[0] * a + f_post[0] * b))
        return [(1 - 1 / tau_pre, a), (1 - 1 / tau_post, b), moved]

    return affine_scan(df, keys, order, [pre, post], steps, ["tr_pre", "tr_post", "weight"], [0.0, 0.0, w0])


def normalised(df: DataFrame, k: float = 0.9, weight: float = 0.1, channels: int = 5, spike: str = "spike", channel_sum: str = "total", keys=KEYS, order=ORDER, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Cross-channel normalisation: a trace x = k x + k1 (sum of spikes over channels), k1 = (1 - k) / channels^2; out = s - weight x. Adds norm_out."""
    k1 = (1 - k) / channels**2

    def step(state, total):
        x = k * state[0] + k1 * total
        return (x,), (x,)

    if largest(df, keys) <= hot_rows:
        out = lockstep(df, keys, order, [channel_sum], [0.0], step, "__x double", step)
    else:
        out = affine_scan(df, keys, order, [channel_sum], lambda total: [(k, k1 * total)], ["__x"], [0.0])
    return out.select(*df.columns, (F.coalesce(F.col(spike), F.lit(0)) - F.lit(weight) * F.col("__x")).alias("norm_out"))


def ema(df: DataFrame, momentum: float = 0.1, value: str = "scale", keys=KEYS, order=ORDER, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Exponential moving average that starts at the first value. Adds ema. A null changes nothing; before the first value the average is null."""

    def step(state, x):
        m = np.where(np.isnan(state[0]), x, np.where(np.isnan(x), state[0], (1 - momentum) * state[0] + momentum * x))
        return (m,), (m,)

    def single(x):
        some = ~np.isnan(x)
        return np.where(some, 1 - momentum, 1.0), np.where(some, momentum * x, 0.0), x

    def combine(left, right):
        return (*affine(left[:2], right[:2]), np.where(np.isnan(left[2]), right[2], left[2]))

    if largest(df, keys) <= hot_rows:
        out = lockstep(df, keys, order, [value], [float("nan")], step, "__m double", null=float("nan"))
    else:
        out = block_scan(df, keys, order, [value], single, combine, (1.0, 0.0, float("nan")), ["__a", "__b", "__first"])
        out = out.withColumn("__m", F.col("__a") * F.col("__first") + F.col("__b"))
    return out.select(*df.columns, F.nanvl("__m", F.lit(None).cast("double")).alias("ema"))


def feedback(df: DataFrame, combine: Callable[[float, float], float], charge: Charge, theta: float = 1.0, x: str = "x", keys=KEYS, order=ORDER) -> DataFrame:
    """A neuron whose last output is combined with each input (element-wise recurrence). Adds spike."""

    def one(state, value):
        v, y = state
        v = charge(v, combine(value, y))
        s = 1 if v >= theta else 0
        return (0.0 if s else v, float(s)), (s,)

    def many(state, value):
        v, y = state
        v = charge(v, combine(value, y))
        s = v >= theta
        return (np.where(s, 0.0, v), s), (s,)

    return lockstep(df, keys, order, [x], [0.0, 0.0], many, "spike int", one)


def linear_feedback(df: DataFrame, weight: np.ndarray, bias: np.ndarray, charge: Charge, theta: float = 1.0, x: str = "xs", keys=KEYS, order=ORDER) -> DataFrame:
    """Vector inputs and the last outputs, concatenated, pass a linear map before the neurons. Adds ys (spikes as doubles)."""
    n = len(bias)

    def many(state, value):
        v, y = state
        v = charge(v, np.concatenate([value, y], axis=1) @ weight.T + bias)
        y = (v >= theta).astype(float)
        return (np.where(y > 0, 0.0, v), y), (y,)

    return lockstep(df, keys, order, [x], [np.zeros(n), np.zeros(n)], many, "ys array<double>")


def _fire(a: np.ndarray) -> np.ndarray:
    return (a >= 0).astype(float)


def vanilla_cell(df: DataFrame, w_in: np.ndarray, w_hid: np.ndarray, bias: np.ndarray, x: str = "xs", keys=KEYS, order=ORDER) -> DataFrame:
    """h = fire(w_in x + w_hid h + bias). Adds hs."""

    def many(state, value):
        h = _fire(value @ w_in.T + state[0] @ w_hid.T + bias)
        return (h,), (h,)

    return lockstep(df, keys, order, [x], [np.zeros(len(bias))], many, "hs array<double>")


def lstm_cell(df: DataFrame, w_in: np.ndarray, w_hid: np.ndarray, bias: np.ndarray, x: str = "xs", keys=KEYS, order=ORDER) -> DataFrame:
    """Gates i, f, g, o all fire; c = f c + i g; h = o c. Adds hs."""
    n = len(bias) // 4

    def many(state, value):
        h, c = state
        a = value @ w_in.T + h @ w_hid.T + bias
        i, f, g, o = (_fire(a[:, k * n : k * n + n]) for k in range(4))
        c = c * f + i * g
        return (c * o, c), (c * o,)

    return lockstep(df, keys, order, [x], [np.zeros(n), np.zeros(n)], many, "hs array<double>")


def gru_cell(df: DataFrame, w_in: np.ndarray, w_hid: np.ndarray, bias: np.ndarray, x: str = "xs", keys=KEYS, order=ORDER) -> DataFrame:
    """r, z fire; n = fire(w x + r (w h)); h = (1 - z) n + z h. Adds hs."""
    n = len(bias) // 3

    def many(state, value):
        h = state[0]
        a, b = value @ w_in.T + bias, h @ w_hid.T
        r, z = _fire(a[:, :n] + b[:, :n]), _fire(a[:, n : 2 * n] + b[:, n : 2 * n])
        h = (1 - z) * _fire(a[:, 2 * n :] + r * b[:, 2 * n :]) + z * h
        return (h,), (h,)

    return lockstep(df, keys, order, [x], [np.zeros(n)], many, "hs array<double>")


def bidirectional(df: DataFrame, cell: Callable[..., DataFrame], keys=KEYS, t: str = "t", tie: str = "event_id", **weights) -> DataFrame:
    """The cell in both directions of time; adds hs (forward) and hs_back."""
    ahead = cell(df, keys=keys, order=(t, tie), **weights)
    turned = ahead.withColumns({"__t": -F.col(t), "__e": -F.col(tie)}).withColumnRenamed("hs", "__hs")
    back = cell(turned, keys=keys, order=("__t", "__e"), **weights)
    return back.withColumnRenamed("hs", "hs_back").withColumnRenamed("__hs", "hs").drop("__t", "__e")


def learning_rate(seen: Column, warmup: float, total: float, first: float, last: float) -> Column:
    """Rate after ``seen`` tokens: linear from last to first over ``warmup``, then along a cosine that reaches last at ``total``."""
    f = last / first
    progress = (seen - warmup) / F.lit(float(max(1, total - warmup)))
    cosine = F.lit(0.5 + f / 2) + F.lit(0.5 - f / 2) * F.cos(F.lit(math.pi) * progress)
    return F.lit(first) * F.when(seen < warmup, F.lit(f) + F.lit(1 - f) * seen / F.lit(float(warmup))).otherwise(cosine)
