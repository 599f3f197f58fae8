"""The scoring formulas as column expressions. Literals are doubles throughout."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from perigee.functions.constants import FALLBACK_KNOTS


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    """Into [low, high]; null, NaN and infinities go to low."""
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(bad, F.lit(float(low))).otherwise(F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), x)))


def cosine(dot: Column, a: Column, b: Column) -> Column:
    return F.when((a > 0) & (b > 0), clamp(dot / (a * b), 0.0, 1.0)).otherwise(F.lit(0.0))


def crowding(nearest: Column, top_sum: Column, peers: Column) -> Column:
    """65 % of the nearest similarity and 35 % of the mean of the five highest; zeros of peers count."""
    return F.when(peers > 0, F.lit(0.65) * nearest + F.lit(0.35) * top_sum / F.least(F.lit(5), peers)).otherwise(F.lit(0.0))


def relative_standing(crowd: Column, distinct: Column) -> Column:
    return F.when(crowd.isNull(), None).when(distinct.isNull(), crowd).otherwise(F.lit(0.62) * crowd + F.lit(0.38) * distinct)


def fallback_score(nearest: Column) -> Column:
    """A piecewise linear curve over the nearest similarity, for fields too small to be described."""
    out = None
    for (x0, y0), (x1, y1) in zip(FALLBACK_KNOTS, FALLBACK_KNOTS[1:], strict=False):
        y = F.lit(y0) + (nearest - F.lit(x0)) / F.lit(x1 - x0) * F.lit(y1 - y0)
        out = F.when(nearest <= x1, y) if out is None else out.when(nearest <= x1, y)
    return out.otherwise(F.lit(FALLBACK_KNOTS[-1][1]))


def beyond_top(value: Column, top: Column, middle: Column) -> Column:
    """The standing of a value above all of its field, for rows scored outside their batch."""
    spread = F.greatest(F.lit(1e-9), F.abs(top - middle))
    return F.lit(0.9) + F.lit(0.1) * (F.lit(1.0) - F.exp(-F.greatest(F.lit(0.0), value - top) / spread))


def raw_novelty(base: Column, phrase: Column, bridge: Column, penalty: Column) -> Column:
    return clamp(base + F.lit(7.0) * (phrase - F.lit(0.5)) + F.lit(3.0) * (bridge - F.lit(0.35)) - penalty)


def completeness(abstract_tokens: Column) -> Column:
    return F.when(abstract_tokens >= 50, F.lit(1.0)).when(abstract_tokens > 0, F.lit(0.65)).otherwise(F.lit(0.35))


def confidence(peers: Column, complete: Column) -> Column:
    return F.least(F.lit(1.0), F.log1p(peers.cast("double")) / F.lit(math.log1p(60))) * complete


def shrunk(raw: Column, conf: Column) -> Column:
    return clamp(F.lit(50.0) + (F.lit(0.25) + F.lit(0.75) * conf) * (raw - F.lit(50.0)))


def career(h_index: Column, cited: Column, recent: Column, works: Column, has_id: Column) -> Column:
    """An author's track record, 0 to 100."""
    part = lambda x, cap: F.least(F.lit(1.0), F.log1p(F.greatest(F.lit(0.0), F.coalesce(x.cast("double"), F.lit(0.0)))) / F.lit(math.log1p(cap)))
    return F.lit(100.0) * (F.lit(0.45) * part(h_index, 80) + F.lit(0.25) * part(cited, 100_000) + F.lit(0.15) * part(recent, 30) + F.lit(0.1) * part(works, 300) + F.lit(0.05) * F.when(has_id, F.lit(1.0)).otherwise(F.lit(0.35)))


def role_weight(position: Column, corresponding: Column) -> Column:
    return F.when(F.coalesce(corresponding, F.lit(False)) | position.isin("first", "last"), F.lit(1.0)).otherwise(F.lit(0.86))


def discovery(novelty: Column, authorship: Column) -> Column:
    return clamp(F.lit(0.72) * F.greatest(novelty, authorship) + F.lit(0.28) * F.least(novelty, authorship))
