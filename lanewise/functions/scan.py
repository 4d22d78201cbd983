"""Running sums over groups of any size, in two levels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanewise.operators.storage import saved

#: How running sums are written: as differences, which are small.
COUNTERS = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false", "compression": "zstd"}


def running_sums(rows: DataFrame, by: list[str], order: list[Column], sums: dict[str, str], partitions: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """``rows`` with a column for each of ``sums`` (name -> a long column): its sum within the group up to and including the row.

    ``order`` must leave no ties. Rows are dealt by ranges of (by, order), so that neither a large
    group nor equal leading values meet in one task; sums inside a range need no other
    rows, and the totals of earlier ranges, one small row for each group and range, are added.
    With empty ``by`` all rows are one group. Nulls count as 0. With ``keep`` only those columns and the sums are
    returned and written to the shared folder, in between as four bytes each: for counters of 0 and 1 alone, which a task can't add up beyond that.
    """
    spark = rows.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = list(rows.columns if keep is None else dict.fromkeys([*by, *keep]))
    wide, narrow = (T.LongType(), pa.int64()) if keep is None else (T.IntegerType(), pa.int32())
    schema = T.StructType([*[rows.schema[c] for c in held], *[T.StructField(c, wide) for c in sums], T.StructField("range_", T.IntegerType())])
    names, columns = list(sums), list(sums.values())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        last, carried = None, np.zeros(len(columns), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            keys = list(zip(*(b[c].to_pylist() for c in by), strict=True)) if by else [()] * b.num_rows
            starts = np.array([i for i in range(b.num_rows) if i == 0 or keys[i] != keys[i - 1]])
            values = np.stack([b[c].fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns], axis=1)
            total = np.cumsum(values, axis=0)
            before = np.repeat(np.where(starts[:, None] > 0, total[starts - 1], 0), np.diff(np.r_[starts, b.num_rows]), axis=0)
            total = total - before
            if keys[0] == last:
                total[: starts[1] if len(starts) > 1 else b.num_rows] += carried
            last, carried = keys[-1], total[-1].copy()
            yield pa.RecordBatch.from_arrays([*[b[c] for c in held], *[pa.array(total[:, i]).cast(narrow) for i in range(len(columns))], pa.array(np.full(b.num_rows, part, np.int32))], [*held, *names, "range_"])

    inner = saved(rows.repartitionByRange(n, *by, *order).sortWithinPartitions(*by, *order).mapInArrow(work, schema), "scan", **COUNTERS)
    # Where nothing is negative a range's last sum is its largest; in general it is the sum of its values.
    earlier = Window.partitionBy(*by, *([] if by else [F.lit(0)])).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    totals = inner.groupBy(*by, "range_").agg(*[(F.sum(F.coalesce(F.col(c), F.lit(0))) if keep is None else F.max(n).cast("long")).alias(f"in_{n}") for n, c in sums.items()])
    totals = totals.select("range_", *[F.col(c).alias(f"by_{c}") for c in by], *[F.coalesce(F.sum(f"in_{n}").over(earlier), F.lit(0)).alias(f"before_{n}") for n in names])
    met = F.lit(True)
    for c in by:
        met = met & F.col(c).eqNullSafe(F.col(f"by_{c}"))
    out = inner.join(totals.withColumnRenamed("range_", "of_range_"), met & (F.col("range_") == F.col("of_range_")))
    return out.select(*(held if keep is None else keep), *[(F.col(n) + F.col(f"before_{n}")).alias(n) for n in names])
