"""Ordered running totals that stay distributed when one key holds most rows.

A window partitioned by a hot key (one consumer's whole backlog, one busy channel)
runs in a single task. ``running_total`` instead range-partitions the rows by
(key, order) into slices, sums locally inside each (key, slice), and adds the totals
of the earlier slices of the same key: two passes, no unbounded window partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.plans.stage import stage


def _slices(df: DataFrame, slices: int | None) -> int:
    if slices:
        return slices
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    value: Column,
    out: str,
    slices: int | None = None,
) -> DataFrame:
    """Add ``out`` = inclusive running sum of ``value`` per ``keys`` in ``order``.

    ``order`` must be a total order within a key. Range bounds are sampled, so the
    row-to-slice mapping is fixed by staging the sliced rows once: every later branch
    (slice totals, the join back) and every recomputation reads the same slices.
    """
    cols = df.columns
    sliced = (
        df.withColumn("_rt_value", value.cast("bigint"))
        .repartitionByRange(_slices(df, slices), *[F.col(k) for k in keys], *order)
        .withColumn("_rt_slice", F.spark_partition_id())
    )
    part = Window.partitionBy(*keys, "_rt_slice")
    local = (sliced
             .withColumn("_rt_local", F.sum("_rt_value").over(
                 part.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
             .withColumn("_rt_total", F.sum("_rt_value").over(part)))
    local = stage(local, "running-total")
    # one row per (key, slice): bounded by keys + slices, never by rows
    totals = local.select(*keys, "_rt_slice", "_rt_total").distinct()
    before_w = Window.partitionBy(*keys).orderBy("_rt_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_rt_slice", F.coalesce(F.sum("_rt_total").over(before_w), F.lit(0)).alias("_rt_offset")
    )
    return local.join(offsets, [*keys, "_rt_slice"]).select(
        *cols, (F.col("_rt_local") + F.col("_rt_offset")).cast("bigint").alias(out)
    )


def ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str,
            slices: int | None = None) -> DataFrame:
    """Add ``out`` = 1-based position of each row within its key in ``order`` (a distributed row_number)."""
    return running_total(df, keys, order, F.lit(1), out, slices)


FIRST_K_SALTS = 16


def first_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str = "_pos") -> DataFrame:
    """Keep the first ``k`` rows per key in ``order`` (a total order) and number them.

    Two steps, each planned with a map-side group limit: the first k of every map task meet in one of
    FIRST_K_SALTS tasks per key, and the first k of those in one, which so sorts at most FIRST_K_SALTS * k rows
    however many map tasks there are. The salt changes which task sees a row, never the result.
    """
    salted = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(FIRST_K_SALTS)))
    near = Window.partitionBy(*keys, "_salt").orderBy(*order)
    some = salted.withColumn(out, F.row_number().over(near)).where(F.col(out) <= k).drop(out, "_salt")
    w = Window.partitionBy(*keys).orderBy(*order)
    return some.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)


def running_max_before(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    values: dict[str, Column],
    slices: int | None = None,
) -> DataFrame:
    """For each ``out -> value``, add ``out`` = max of ``value`` over the earlier rows of
    the key (exclusive). Same two-pass slicing as ``running_total``; max is associative,
    so a slice's carry is the max of all earlier slices of the key."""
    cols = df.columns
    names = list(values)
    sliced = df
    for n, v in values.items():
        sliced = sliced.withColumn(f"_v_{n}", v)
    sliced = (sliced.repartitionByRange(_slices(df, slices), *[F.col(k) for k in keys], *order)
              .withColumn("_rt_slice", F.spark_partition_id()))
    part = Window.partitionBy(*keys, "_rt_slice")
    before = part.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    for n in names:
        sliced = (sliced.withColumn(f"_l_{n}", F.max(f"_v_{n}").over(before))
                  .withColumn(f"_t_{n}", F.max(f"_v_{n}").over(part)))
    local = stage(sliced, "running-max")
    totals = local.select(*keys, "_rt_slice", *[f"_t_{n}" for n in names]).distinct()
    earlier = Window.partitionBy(*keys).orderBy("_rt_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, "_rt_slice", *[F.max(f"_t_{n}").over(earlier).alias(f"_c_{n}") for n in names])
    j = local.join(carry, [*keys, "_rt_slice"])
    return j.select(*cols, *[F.greatest(f"_l_{n}", f"_c_{n}").alias(n) for n in names])
