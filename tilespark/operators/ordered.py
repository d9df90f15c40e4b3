"""Order-dependent columns over whole tables without a one-task window.

Rows are dealt into consecutive ranges of a key. Windows run inside a range;
what must cross a seam (the last row before it, the sums before it) is aggregated to one
row a range, carried along those few rows, and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilespark.shared import settle

RANGE = "_range"


def _starts(df: DataFrame, key: str, ranges: int) -> list:
    """The first key of each range but the first: as many values as there are ranges."""
    rows = df.select(key).repartitionByRange(ranges, key).groupBy(F.spark_partition_id().alias("p")).agg(F.min(key).alias("start")).collect()
    return sorted({r["start"] for r in rows if r["start"] is not None})[1:]


def into_ranges(df: DataFrame, key: str, ranges: int | None = None) -> DataFrame:
    """``df`` with the number of its key's range; null keys are in the first.

    The table is settled first: it is read for the range starts, for what crosses the
    seams and for the rows themselves, and is not to be worked out three times.
    """
    df = settle(df)
    starts = _starts(df, key, ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if not starts:
        return df.withColumn(RANGE, F.lit(0))
    bounds = F.array(*[F.lit(s).cast(df.schema[key].dataType) for s in starts])
    halves = F.array(*[F.lit(1 << k) for k in reversed(range(len(starts).bit_length()))])
    find = F.aggregate(halves, F.lit(0), lambda at, step: F.when((at + step <= len(starts)) & (F.get(bounds, at + step - 1) <= F.col(key)), at + step).otherwise(at))
    return df.withColumn(RANGE, F.when(F.col(key).isNull(), F.lit(0)).otherwise(find))


def _carried(per_range: DataFrame, *columns: Column) -> DataFrame:
    """One small row a range, with columns over the ranges before it."""
    return F.broadcast(per_range.select(RANGE, *columns))


def previous(ranged: DataFrame, columns: list[str], key: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """``prev_<column>``: values of the row before, in order of key and ties; null for the first row."""
    order = Window.partitionBy(RANGE).orderBy(key, *ties)
    last = ranged.groupBy(RANGE).agg(F.max_by(F.struct(*columns), F.struct(key, *ties)).alias("last"))
    seam = _carried(last, F.lag("last").over(Window.orderBy(RANGE)).alias("_seam"))
    row = F.struct(*columns)
    joined = ranged.join(seam, RANGE)
    before = F.coalesce(F.lag(row).over(order), F.col("_seam"))
    return joined.withColumn("_before", before).select(*ranged.columns, *[F.col(f"_before.{c}").alias(f"prev_{c}") for c in columns])


def running_sum(ranged: DataFrame, value: str, name: str, key: str, ties: tuple[str, ...] = (), inclusive: bool = True) -> DataFrame:
    """Sum of ``value`` over all rows up to this one (or before it)."""
    order = Window.partitionBy(RANGE).orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, 0)
    sums = ranged.groupBy(RANGE).agg(F.sum(value).alias("s"))
    ahead = F.coalesce(F.sum("s").over(Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead")
    total = F.sum(value).over(order) + F.col("_ahead")
    return ranged.join(_carried(sums, ahead), RANGE).withColumn(name, total if inclusive else total - F.col(value)).drop("_ahead")


def last_known(ranged: DataFrame, column: str, name: str, key: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """The latest value of ``column`` that is not null, at this row or before it."""
    order = Window.partitionBy(RANGE).orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, 0)
    known = ranged.groupBy(RANGE).agg(F.max_by(column, F.when(F.col(column).isNotNull(), F.struct(key, *ties))).alias("known"))
    seam = _carried(known, F.last("known", ignorenulls=True).over(Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)).alias("_seam"))
    return ranged.join(seam, RANGE).withColumn(name, F.coalesce(F.last(column, ignorenulls=True).over(order), F.col("_seam"))).drop("_seam")
