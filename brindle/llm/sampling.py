"""Bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PARTS = 1 << 40


def bounded_sample(df: DataFrame, turn: str, rows: int) -> DataFrame:
    """At most `rows` distinct rows of df, those with the least values of the hash column `turn`.

    Of many more rows, a threshold on the hash leaves about twice as many as are asked for
    before anything is sorted, so that what each task sends on does not grow with their number."""
    df = df.distinct()
    n = df.count()
    if n > 2 * rows:
        df = df.where(F.pmod(F.col(turn), F.lit(_PARTS)) < _PARTS * 2 * rows // n)
    spread = F.pmod(F.col(turn), F.lit(_PARTS))
    return df.orderBy(spread, *df.columns).limit(rows)
