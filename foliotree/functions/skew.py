"""Joins whose left side may have hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def shuffle_width(df: DataFrame) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


# Rows a narrow table may have to be broadcast.
SMALL_ROWS = 200_000

# Sub-keys of a hot key per average shuffle partition that it fills.
SPLITS_PER_SHARE = 4


def hot_counts(counts: DataFrame, key: str, shares: int) -> DataFrame:
    """From rows per key (``key``, ``__n``): the keys that hold more than 1/``shares`` of all rows, with their splits.

    Fewer than ``shares`` keys can qualify, so the result is safe to broadcast
    whatever the size of the data. Splits are finer than the shares, so that the
    sub-keys of a hot key spread evenly although they are placed by hash.
    """
    total = counts.agg(F.sum("__n").alias("__t")).scalar()
    return counts.where(F.col("__n") * shares > total).select(
        key, F.ceil(F.col("__n") * shares * SPLITS_PER_SHARE / total).cast("int").alias("__splits")
    )


def hot_keys(df: DataFrame, key: str, shares: int | None = None) -> DataFrame:
    """:func:`hot_counts` of ``df``. Only the key column is read, and the counts are combined before the shuffle."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n"))
    return hot_counts(counts, key, shares or shuffle_width(df))


def join_hot(left: DataFrame, right: DataFrame, key: str, spread_by: list[str], how: str = "inner",
             hot: DataFrame | None = None) -> DataFrame:
    """``left.join(right, key, how)`` where few left keys may hold most left rows.

    Rows of a hot key are spread by the hash of the columns ``spread_by`` over as
    many sub-keys as average shuffle partitions they would fill; only the right
    rows of those keys are repeated. (A hash and not a random number: a task that
    is run again must send its rows to the same place.) Null keys match nothing
    but would all meet in one partition of an outer or anti join, so they are
    spread too. ``how`` is inner, left, left_semi or left_anti.

    The result does not depend on which keys count as hot. ``hot`` may hand in the
    hot keys of a table that ``left`` comes from, where finding them in ``left``
    would run its plan once more.
    """
    shares = shuffle_width(left)
    hot = hot_keys(left, key, shares) if hot is None else hot
    spread = F.xxhash64(*spread_by)
    salted = left.join(F.broadcast(hot), key, "left").withColumn(
        "__salt",
        F.when(F.col(key).isNull(), F.pmod(spread, F.lit(shares)))
        .when(F.col("__splits").isNotNull(), F.pmod(spread, F.col("__splits")))
        .otherwise(F.lit(0))
        .cast("int"),
    )
    repeated = right.join(F.broadcast(hot), key, "left").withColumn(
        "__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__splits"), F.lit(1)) - 1))
    )
    return salted.drop("__splits").join(repeated.drop("__splits"), [key, "__salt"], how).drop("__salt")
