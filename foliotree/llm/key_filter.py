"""A bounded filter of keys in front of a join.

Keys are folded to a table of at most ``SLOTS`` numbers of 64 bits, which is
broadcast whatever the number of keys. A key that was put in is always found;
of the others some are, the more the fuller the table is. So rows that are not
found need no join, and the others are joined exactly: the plan is the same at
every size, and a full table only sends more rows through the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: At most so many rows of an int and a long: about 1.5 MB of data.
SLOTS = 1 << 17


def _slot(key: Column, slots: int) -> Column:
    return F.pmod(key, F.lit(slots)).cast("int")


def _bit(key: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(key, 58).cast("int"))


def folded(keys: DataFrame, *columns: Column, slots: int = SLOTS) -> DataFrame:
    """``__slot, __bits`` of the rows of ``keys``, which are identified by ``columns``."""
    key = F.xxhash64(*columns)
    return keys.select(_slot(key, slots).alias("__slot"), _bit(key).alias("__bit")).groupBy("__slot").agg(F.bit_or("__bit").alias("__bits"))


def flagged(rows: DataFrame, table: DataFrame, flag: str, *columns: Column, slots: int = SLOTS) -> DataFrame:
    """``rows`` with the boolean ``flag``: whether the row's key may be in ``table``, which was made with as many ``slots``."""
    key = F.xxhash64(*columns)
    bits = F.broadcast(table.select(F.col("__slot").alias("__of"), "__bits"))
    return rows.join(bits, _slot(key, slots) == F.col("__of"), "left").withColumn(
        flag, F.coalesce(F.col("__bits").bitwiseAND(_bit(key)) != 0, F.lit(False))).drop("__of", "__bits")
