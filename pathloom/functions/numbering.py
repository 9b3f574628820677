"""Dense global row numbers without bringing all rows into one partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import checkpointed


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until df has no column of that name in any case."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def numbered(df: DataFrame, order: list[Column], name: str, within: tuple[str, ...] = ()) -> DataFrame:
    """df with name: 0, 1, 2, ... in the given order, which must be total; within: anew for each of these groups.

    Rows are dealt by ranges of (group, order) and numbered within their range; the sizes of the group's ranges
    before are added. So one group that holds most rows is still spread over ranges, and what is added is a row
    for each group and range. A column of df that has the name already is replaced."""
    range_, size, at, offset, rank, *copies = free_names(df, "range", "size", "at", "offset", "rank", *[f"in_{c}" for c in within])
    groups = [F.col(c) for c in within]
    dealt = checkpointed(df.repartitionByRange(*groups, *order).withColumn(range_, F.spark_partition_id()))
    sizes = dealt.groupBy(range_, *within).agg(F.count("*").alias(size))
    before = F.sum(size).over(Window.partitionBy(*within).orderBy(range_).rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(F.col(range_).alias(at), *[F.col(c).alias(x) for c, x in zip(within, copies, strict=True)], F.coalesce(before, F.lit(0)).alias(offset))
    place = F.row_number().over(Window.partitionBy(range_, *within).orderBy(*order)) - 1
    same = F.col(range_) == F.col(at)
    for c, x in zip(within, copies, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(x))
    joined = dealt.withColumn(rank, place).join(offsets if within else F.broadcast(offsets), same)
    kept = [c for c in df.columns if c.lower() != name.lower()]
    return joined.select(*kept, (F.col(offset) + F.col(rank)).cast("long").alias(name))


def running_totals(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """df with, for each (name, column) of sums, the total of column over all rows up to this one in the given
    total order. Like numbered(): totals within ranges, plus the totals of the ranges before."""
    range_, *parts = free_names(df, "range", *[f"of_{n}" for n in sums], *[f"before_{n}" for n in sums])
    of, before = parts[: len(sums)], parts[len(sums) :]
    dealt = checkpointed(df.repartitionByRange(*order).withColumn(range_, F.spark_partition_id()))
    of_range = dealt.groupBy(range_).agg(*[F.sum(c).alias(x) for c, x in zip(sums.values(), of, strict=True)])
    w = Window.orderBy(range_).rowsBetween(Window.unboundedPreceding, -1)  # over a row for each range
    offsets = of_range.select(range_, *[F.coalesce(F.sum(x).over(w), F.lit(0)).alias(b) for x, b in zip(of, before, strict=True)])
    upto = Window.partitionBy(range_).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.join(F.broadcast(offsets), range_)
    for (n, c), b in zip(sums.items(), before, strict=True):
        out = out.withColumn(n, F.sum(c).over(upto) + F.col(b))
    return out.select(*df.columns, *sums)
