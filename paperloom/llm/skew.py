"""Lookups by a key that may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than 1/SHARE of the rows is hot, so there are fewer than SHARE hot keys.
SHARE = 2000


def split_lookup(left: DataFrame, right: DataFrame, key: str, n: str, how: str = "inner") -> DataFrame:
    """``left`` with the columns of ``right`` (but ``n``), by ``key``.

    ``right`` has each key once and the number of its rows in ``left`` as
    ``n``. Keys with more than 1/SHARE of the rows are fewer than SHARE, a
    bound that no input exceeds: they are broadcast and their rows stay where
    they are. All other rows meet by a shuffle in which no key is hot. ``how``
    is inner or left; null keys match nothing. Both inputs are read twice.
    """
    extra = [c for c in right.columns if c not in (key, n)]
    if set(extra) & set(left.columns):
        raise ValueError(f"columns on both sides: {sorted(set(extra) & set(left.columns))}")
    total = right.agg(F.sum(n)).first()[0] or 0
    limit = total / SHARE
    hot = right.filter(F.col(n) > limit)
    mark = F.broadcast(hot.select(key))
    names = [*left.columns, *extra]
    few = left.join(F.broadcast(hot.drop(n)), key, "inner").select(*names)
    rest = left.join(mark, key, "left_anti").join(right.filter(F.col(n) <= limit).drop(n), key, how).select(*names)
    return few.unionByName(rest)
