"""Vector and likelihood functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def log_likelihood_ratio(total: Column, part: Column, prior: Column, share: float = 0.8) -> Column:
    """Of a read with k-mer weight ``total`` and weight ``part`` in a cluster: normal approximations at ``share`` against ``prior``.

    Null unless the part is over what the prior would give.
    """
    spread_here, spread_by_chance = share * (1 - share), prior * (1 - prior)
    off_here, off_by_chance = part - total * share, part - total * prior
    fit = (off_by_chance * off_by_chance / spread_by_chance - off_here * off_here / spread_here) / total
    ratio = (F.log(spread_by_chance / spread_here) + fit) / 2
    return F.when((off_by_chance > 0) & (total > 0) & (spread_by_chance > 0), ratio)
