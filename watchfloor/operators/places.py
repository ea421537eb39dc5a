"""Places of rows in an order of their own, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from watchfloor.session import cut_lineage


def numbered(rows: DataFrame, order: list[str], number: str = "number") -> DataFrame:
    """``rows`` with ``number``: their place from 0 in ``order``, which must tell rows apart.

    Rows are dealt into ranges of the order; places are counted inside a range and moved on by the sizes of the ranges before
    it, of which there is one row each.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut_lineage(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = F.coalesce(F.sum("_size").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1
    joined = dealt.withColumn("_inside", inside).join(sizes.select("_part", before.alias("_before")), "_part")
    return joined.select(*rows.columns, (F.col("_before") + F.col("_inside")).alias(number))
