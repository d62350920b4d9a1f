"""Spike encoders and event-driven neurons as expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import uniform


def latency(x: Column, steps: int, log: bool = False) -> Column:
    """The step at which a value in 0..1 fires, half to even: early for large values."""
    if log:
        alpha = math.exp(steps - 1.0) - 1.0
        return F.rint(F.lit(steps - 1.0) - F.ln(F.lit(alpha) * x + 1)).cast("int")
    return F.rint(F.lit(steps - 1.0) * (F.lit(1.0) - x)).cast("int")


def spike_at(step: Column, steps: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda t: (t == step).cast("int"))


def poisson(x: Column, seed: int, *ident: Column) -> Column:
    """1 where a hashed uniform number of the row is at most x."""
    return (uniform(seed, *ident) <= x).cast("int")


def weighted_phase(x: Column, k: int) -> Column:
    """The first k binary digits of x in 0 .. 1 - 2^-k, most significant first; null outside."""
    n = F.floor(x * (2**k)).cast("bigint")
    digits = F.transform(F.sequence(F.lit(k - 1), F.lit(0), F.lit(-1)), lambda b: (F.floor(n / F.pow(F.lit(2.0), b)) % 2).cast("int"))
    return F.when((x >= 0) & (x <= 1 - 2.0**-k), digits)


def periodic(spikes: Column, t: Column) -> Column:
    """spikes[t mod length]."""
    return F.element_at(spikes, (t % F.size(spikes)).cast("int") + 1)


def gaussian_tuning(x: Column, m: int, low: float, high: float, latest: int = 50) -> Column:
    """Spike times of m neurons with Gaussian receptive fields: latest * (1 - y) half to even; -1 if at or over latest."""
    sigma2 = (1 / 1.5 * (high - low) / (m - 2)) ** 2

    def time(i: Column) -> Column:
        mu = F.lit(low) + (i * 2 - 3) / F.lit(2.0) * F.lit((high - low) / (m - 2))
        y = F.exp(-(x - mu) * (x - mu) / 2 / F.lit(sigma2))
        t = F.rint(F.lit(float(latest)) * (1 - y))
        return F.when(t >= latest, -1).otherwise(t).cast("int")

    return F.transform(F.sequence(F.lit(1), F.lit(m)), time)


def psp_scale(tau: float = 15.0, tau_s: float = 15.0 / 4, theta: float = 1.0) -> float:
    peak = tau * tau_s * math.log(tau / tau_s) / (tau - tau_s)
    return theta / (math.exp(-peak / tau) - math.exp(-peak / tau_s))


def tempotron(spikes: DataFrame, row: str, time: str, weight: Column, steps: int, tau: float = 15.0, tau_s: float = 15.0 / 4, theta: float = 1.0) -> DataFrame:
    """row, v_max, t_max (first step of the peak), spike (t_max, or -t_max under the threshold). A negative spike time is no spike.

    The potential is linear in the weights: those of one row and time are summed before the steps are laid out, so any number of spikes
    makes (distinct times) x steps rows."""
    v0 = psp_scale(tau, tau_s, theta)
    summed = spikes.groupBy(F.col(row), F.col(time).alias("__s")).agg(F.sum(weight).alias("__w"))
    at = summed.select(row, "__s", "__w", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("t"))
    d = F.col("t") - F.col("__s")
    psp = F.when((F.col("__s") >= 0) & (d >= 0), (F.exp(-d / F.lit(tau)) - F.exp(-d / F.lit(tau_s))) * F.lit(v0) * F.col("__w")).otherwise(0.0)
    v = at.groupBy(row, "t").agg(F.sum(psp).alias("v"))
    peak = v.groupBy(row).agg(F.max(F.struct("v", (-F.col("t")).alias("m"))).alias("b"))
    return peak.select(row, F.col("b.v").alias("v_max"), (-F.col("b.m")).alias("t_max"), F.when(F.col("b.v") >= theta, -F.col("b.m")).otherwise(F.col("b.m")).alias("spike"))


def tempotron_loss(out: DataFrame, target: Column, theta: float = 1.0) -> DataFrame:
    """sum of ((v_max - theta) where firing differs from target)^2 over rows."""
    fired = (F.col("v_max") >= theta).cast("int")
    return out.agg((F.sum(F.when(fired != target, F.pow(F.col("v_max") - theta, 2)).otherwise(0.0)) / F.count("*")).alias("loss"))


def threshold_margin(label: Column, item: Column, low: float = 0.9, high: float = 1.1) -> Column:
    return F.when(label == item, F.lit(high)).otherwise(F.lit(low))
