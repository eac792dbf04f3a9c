"""Dense 0-based numbering of rows within a key, without one task per key.

``row_number() over (partition by key order by ...)`` sends every row of a key
to one task; a log partition holding a third of all records would then be
numbered by a single core.  Instead:

1. range-partition on (key, order) and sort inside each range partition, so a
   hot key is split over many partitions while rows stay in global order;
2. tag each row with its partition id and ``monotonically_increasing_id``
   (partition id << 33 | position in partition);
3. aggregate the (partition, key) runs: first id and length.  Range
   partitions hold contiguous key slices, so there are at most
   ``partitions + keys`` runs;
4. a running sum of run lengths per key (ordered by partition) gives each
   run's base; ``offset = base + id - first id``.

The ranged rows are written with ``checkpoint()`` (reliable, in the cluster's
checkpoint folder) so both uses see identical ids and a lost executor cannot
change them.  How the run table is joined is left to the optimizer, which
knows its measured size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lagscope.session import checkpoint_dir


def number_within_key(df: DataFrame, keys: list[str], order: list[str], out: str,
                      num_partitions: int | None = None) -> DataFrame:
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (
        df.repartitionByRange(n, *keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_rid", F.monotonically_increasing_id())
        .checkpoint(eager=True)
    )
    runs = ranged.groupBy("_pid", *keys).agg(
        F.min("_rid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, 0)
    runs = runs.select("_pid", *keys, "_first", (F.sum("_n").over(w) - F.col("_n")).alias("_base"))
    return (
        ranged.join(runs, ["_pid", *keys])
        .withColumn(out, F.col("_base") + F.col("_rid") - F.col("_first"))
        .drop("_pid", "_rid", "_first", "_base")
    )
