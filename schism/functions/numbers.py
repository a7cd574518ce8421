
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sign_label(c, negative: float = -0.02, positive: float = 0.02, low: float = -1.0, high: float = 1.0) -> Column:
    """M1: half-open bins [low, negative) NEGATIVE, [negative, positive) NEUTRAL, [positive, high) POSITIVE; all else NEUTRAL."""
    return bin_label(c, [(low, negative, "NEGATIVE"), (negative, positive, "NEUTRAL"), (positive, high, "POSITIVE")])


def bin_label(c, bins, default: str = "NEUTRAL", last: bool = False) -> Column:
    """M1: label of the first (or last) half-open bin that holds the value."""
    c, out = _c(c), F.lit(default)
    for lo, hi, label in bins if last else reversed(bins):
        out = F.when((c >= lo) & (c < hi), F.lit(label)).otherwise(out)
    return out


def equal_width_bin(c, lo, hi, n: int = 10, widen: bool = True) -> Column:
    """Number (from 1) of the equal-width bin; the last one is closed; a single-valued range is widened by a half, or else lies in the last bin."""
    c, lo, hi = _c(c), _c(lo), _c(hi)
    if not widen:
        return F.least(F.floor(F.try_divide(c - lo, (hi - lo) / n)).cast("int") + 1, F.lit(n))
    left = F.when(lo == hi, lo - 0.5).otherwise(lo)
    right = F.when(lo == hi, hi + 0.5).otherwise(hi)
    return F.least(F.floor((c - left) / ((right - left) / n)).cast("int") + 1, F.lit(n))


def scalar_attitude(negative, neutral, positive) -> Column:
    """A5: 0 if neutral is most likely, else the larger of the two with its sign; a tie is negative."""
    neg, neu, pos = _c(negative), _c(neutral), _c(positive)
    return F.when(neu > F.greatest(neg, pos), 0.0).when(pos > neg, pos).otherwise(-neg)


def softmax(scores) -> Column:
    """M12 over an array."""
    s = _c(scores)
    e = F.transform(s, lambda x: F.exp(x - F.array_max(s)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def polarization(n_pos, n_neg, mean_pos, mean_neg) -> Column:
    """(1 - D) d from counts and means of the two sides; 0 without values; the mean of an empty side is 0."""
    p, n = _c(n_pos).cast("double"), _c(n_neg).cast("double")
    spread = F.abs(F.coalesce(_c(mean_pos), F.lit(0.0)) - F.coalesce(_c(mean_neg), F.lit(0.0))) / 2
    return F.coalesce((1 - F.try_divide(F.abs(p - n), p + n)) * spread, F.lit(0.0))


def entity_mu(pos, neg) -> Column:
    """2 min(p, n) / (p + n); 0 without signs."""
    p, n = _c(pos).cast("double"), _c(neg).cast("double")
    return F.coalesce(F.try_divide(2 * F.least(p, n), p + n), F.lit(0.0))


def entity_score(ssa, mu) -> Column:
    """A18."""
    return _c(ssa) / (1 - _c(mu) + 1e-9)


def association(na, nb, both, total, zero_when_apart: bool = False) -> Column:
    """M2 (zero_when_apart: M3): distance (ln max - ln both) / (ln total - ln min) of two neighbour sets.

    No overlap counts as ln both = 0, or gives 0; a missing node gives 0."""
    a, b, c, n = (_c(x).cast("double") for x in (na, nb, both, total))
    up = F.ln(F.greatest(a, b)) - F.coalesce(F.ln(F.when(c > 0, c)), F.lit(0.0))
    out = F.coalesce(F.try_divide(up, F.ln(n) - F.ln(F.least(a, b))), F.lit(0.0))
    missing = (F.coalesce(a, F.lit(0.0)) <= 0) | (F.coalesce(b, F.lit(0.0)) <= 0)
    return F.when(missing | (F.lit(zero_when_apart) & (F.coalesce(c, F.lit(0.0)) <= 0)), 0.0).otherwise(out)


def jaccard(a, b) -> Column:
    """Of two arrays; null for two empty ones."""
    return F.try_divide(F.size(F.array_intersect(_c(a), _c(b))).cast("double"), F.size(F.array_union(_c(a), _c(b))).cast("double"))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b) -> Column:
    """M5; null for a zero vector."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def centroids(df: DataFrame, key: str, vector: str) -> DataFrame:
    """M6: element-wise mean per key; sums are combined before the shuffle."""
    long = df.select(key, F.posexplode(vector).alias("pos", "x")).groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return long.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("centroid"))


def day_sequence(start: str, end: str) -> Column:
    """Days from start to end, as yyyyMMdd."""
    return F.transform(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)), F.expr("interval 1 day")), lambda d: F.date_format(d, "yyyyMMdd"))


def density(edges, nodes, directed: bool = False) -> Column:
    """M9: 0 below two nodes or without edges."""
    m, n = _c(edges).cast("double"), _c(nodes).cast("double")
    return F.coalesce(F.try_divide(m * (1 if directed else 2), n * (n - 1)), F.lit(0.0))
