"""Column functions over costs, priors and packed values; costs are nats, stored values thousandths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def prior_milli(count: Column, total: Column) -> Column:
    """Price of a word by its count, truncated: ln total - ln(count + 1/2), not below 0."""
    return F.floor(F.round(F.greatest(F.ln(F.greatest(total, F.lit(1)).cast("double")) - F.ln(count + F.lit(0.5)), F.lit(0.0)) * 1000, 6)).cast("int")


def floor_milli(total: Column) -> Column:
    """The prior of a word that the counts never saw, in steps of a tenth of a nat."""
    return (F.round(F.round((F.ln(F.greatest(total, F.lit(1)).cast("double")) - F.ln(F.lit(0.5))) * 10, 6)) * 100).cast("int")


def unseen(prior: Column, floor: Column, span: int = 1700) -> Column:
    """Whether a prior is at the floor, or within ``span`` of it: a word hardly ever seen."""
    return prior + span >= floor


def quantise(prior: Column, step: int = 50) -> Column:
    return F.floor((prior + step // 2) / step).cast("int")


def dequantise(code: Column, step: int = 50) -> Column:
    return (code * step).cast("int")


def nats_milli(p: Column) -> Column:
    """Half-even, as probabilities are written."""
    return F.bround(F.round(-F.ln(F.least(p, F.lit(1.0))) * 1000, 6), 0).cast("int")


def pmi8_milli(pmi: Column) -> Column:
    """Clamped to 8 either way, moved above 0."""
    return F.bround(F.round((F.greatest(F.lit(-8.0), F.least(F.lit(8.0), pmi)) + 8.0) * 1000, 6), 0).cast("int")


def quant05(x: Column) -> Column:
    """A log ratio as a byte of steps of 0.05, half away from zero."""
    return F.greatest(F.lit(0), F.least(F.lit(255), F.round(F.round(x / 0.05, 9)) + 128)).cast("int")


def dequant05(b: Column) -> Column:
    return b * 0.05 - 6.4


def logit(k: Column, n: Column, prior: Column, weight: float = 5.0) -> Column:
    p = (k + weight * prior) / (n + weight)
    return F.ln(p / (1 - p))


def key_cost(d2: Column, sigma: float = 0.45, most: float = 6.0, base: float = 0.5) -> Column:
    """Gaussian price of hitting a key at a squared distance."""
    return F.least(d2 / (2 * sigma * sigma), F.lit(most)) + base


def touch_cost(d2: Column, d2_typed: Column, sigma: float = 0.6, most: float = 6.0, base: float = 0.5, reach2: float = 6.25) -> Column:
    """Price of another key at a touch point, beyond the typed key's; null out of reach."""
    return F.when(d2 <= reach2, base + F.least(F.greatest(d2 - d2_typed, F.lit(0.0)) / (2 * sigma * sigma), F.lit(most)))


def column_cost(dx: Column, sigma: float = 0.6, most: float = 6.0, finger: float = 0.4) -> Column:
    """One-row keyboard: only the horizontal distance counts."""
    return finger + F.least(dx * dx / (2 * sigma * sigma), F.lit(most))


def contextual(prior: Column, pair: Column, fit: Column, share: float = 0.5) -> Column:
    """A prior mixed with what the context says; ``pair`` null where the pair is unknown."""
    known = F.coalesce(F.exp(-pair), F.lit(0.0))
    return -F.ln(share * known + (1 - share) * F.exp(F.coalesce(fit, F.lit(0.0)) - prior))


def point_segment2(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Squared distance from a point to a segment."""
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / size))).otherwise(0.0)
    return F.pow(px - ax - t * dx, F.lit(2)) + F.pow(py - ay - t * dy, F.lit(2))


def softmax(xs: Column) -> Column:
    top = F.array_max(xs)
    e = F.transform(xs, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def any_reading(bits: Column, mask: int) -> Column:
    """Whether some reading of a word has all the bits of a mask."""
    return F.exists(bits, lambda r: r.bitwiseAND(F.lit(mask)) == mask)


def all_readings(bits: Column, mask: int) -> Column:
    return F.forall(bits, lambda r: r.bitwiseAND(F.lit(mask)) == mask)


def fold_readings(bits: Column) -> Column:
    """All the bits that some reading has."""
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, r: a.bitwiseOR(r))


def smoothed_ratios(row: Column, shares: Column, alpha: float = 20.0) -> Column:
    """ln((x + alpha p) / (n + alpha) / p) of each outcome of a count vector."""
    n = F.aggregate(row, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(row, shares, lambda x, p: F.ln((x + alpha * p) / (n + alpha) / p))
