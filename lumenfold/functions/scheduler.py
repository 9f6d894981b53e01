"""Memory model of spaced repetition as column expressions (own versioned specification, days as the unit of time).

Stability S is the time after which recall is 0.9, difficulty D lies in 1..10, grades are 1 (forgotten) to 4 (easy).
Exact due times of other schedulers are not claimed.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

VERSION = "days-1"
#: The published default weights.
W = (0.212, 1.2931, 2.3065, 8.2956, 6.4133, 0.8334, 3.0194, 0.001, 1.8722, 0.1666, 0.796, 1.4835, 0.0614, 0.2629, 1.6483, 0.6014, 1.8729, 0.5425, 0.0912, 0.0658, 0.1542)
RETENTION = 0.9
FACTOR = 0.9 ** (-1 / W[20]) - 1


def params_hash(w: tuple[float, ...] = W, retention: float = RETENTION) -> str:
    """FNV-1a of 32 bits over the parameters, so that states of other parameters are told apart."""
    h = 0x811C9DC5
    for c in json.dumps([VERSION, list(w), retention], separators=(",", ":")):
        h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
    return f"{h:08x}"


def recall(days: Column, stability: Column) -> Column:
    return F.pow(1 + FACTOR * days / stability, F.lit(-W[20]))


def interval(stability: Column, retention: float = RETENTION) -> Column:
    """Days until recall falls to the wanted retention, at least one."""
    return F.greatest(F.lit(1), F.floor(stability / FACTOR * (retention ** (-1 / W[20]) - 1) + 0.5)).cast("long")


def first_stability(g: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in W[:4]]), g.cast("int"))


def _clamp(d: Column) -> Column:
    return F.greatest(F.lit(1.0), F.least(F.lit(10.0), d))


def first_difficulty(g: Column) -> Column:
    return _clamp(W[4] - F.exp(W[5] * (g - 1)) + 1)


def next_difficulty(d: Column, g: Column) -> Column:
    moved = d - W[6] * (g - 3) * (10 - d) / 9
    return _clamp(W[7] * first_difficulty(F.lit(4)) + (1 - W[7]) * moved)


def next_stability(s: Column, d: Column, g: Column, days: Column) -> Column:
    r = recall(days, s)
    bonus = F.when(g == 2, W[15]).when(g == 4, W[16]).otherwise(1.0)
    passed = s * (1 + F.exp(F.lit(W[8])) * (11 - d) * F.pow(s, F.lit(-W[9])) * (F.exp(W[10] * (1 - r)) - 1) * bonus)
    lapsed = F.least(s, W[11] * F.pow(d, F.lit(-W[12])) * (F.pow(s + 1, F.lit(W[13])) - 1) * F.exp(W[14] * (1 - r)))
    same = F.exp(W[17] * (g - 3 + W[18])) * F.pow(s, F.lit(-W[19]))
    same_day = s * F.when(g >= 3, F.greatest(F.lit(1.0), same)).otherwise(same)
    return F.when(days <= 0, same_day).when(g >= 2, passed).otherwise(lapsed)


def score_rating(score: Column) -> Column:
    """Grade from a score in 0..1."""
    return F.when(score >= 0.92, 4).when(score >= 0.7, 3).when(score >= 0.4, 2).when(score.isNotNull(), 1)


def begin(g: int) -> tuple[float, float]:
    """Stability and difficulty after a first review, for one item at a time (streams)."""
    return W[g - 1], min(10.0, max(1.0, W[4] - math.exp(W[5] * (g - 1)) + 1))


def advance(s: float, d: float, g: int, days: float) -> tuple[float, float]:
    """Stability and difficulty after a further review, as ``next_stability`` and ``next_difficulty``."""
    r = (1 + FACTOR * days / s) ** -W[20]
    if days <= 0:
        same = math.exp(W[17] * (g - 3 + W[18])) * s ** -W[19]
        new = s * (max(1.0, same) if g >= 3 else same)
    elif g >= 2:
        new = s * (1 + math.exp(W[8]) * (11 - d) * s ** -W[9] * (math.exp(W[10] * (1 - r)) - 1) * {2: W[15], 4: W[16]}.get(g, 1.0))
    else:
        new = min(s, W[11] * d ** -W[12] * ((s + 1) ** W[13] - 1) * math.exp(W[14] * (1 - r)))
    moved = d - W[6] * (g - 3) * (10 - d) / 9
    return new, min(10.0, max(1.0, W[7] * begin(4)[1] + (1 - W[7]) * moved))
