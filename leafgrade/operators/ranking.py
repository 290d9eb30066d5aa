"""Places of rows in an order, without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import stored


def placed(rows: DataFrame, group: list[str], order: list[str], name: str = "place") -> DataFrame:
    """Adds `name`: the 0-based place of each row in its group, by `order`.

    Rows are dealt by range of (group, order) and counted where they are; the counts of each task (a few
    rows) give the first place of each group's part there. So a group may fill any number of tasks.
    """
    keys = [F.asc_nulls_first(c) for c in (*group, *order)]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # Task and place in it are only fixed once they are written.
    dealt = stored(dealt.select("*", F.spark_partition_id().alias("part__"), F.monotonically_increasing_id().alias("at__")), "placed")
    same = [f"g{i}__" for i in range(len(group))]
    parts = dealt.groupBy("part__", *[F.col(c).alias(g) for c, g in zip(group, same, strict=True)]).agg(F.count("*").alias("n__"), F.min("at__").alias("least__"))
    before = F.sum("n__").over(Window.partitionBy(*same).orderBy("part__")) - F.col("n__")
    first = parts.select(F.col("part__").alias("p__"), *same, (before - F.col("least__")).alias("shift__"))
    on = F.col("part__") == F.col("p__")
    for c, g in zip(group, same, strict=True):
        on &= F.col(c).eqNullSafe(F.col(g))
    return dealt.join(first, on).select(*rows.columns, (F.col("at__") + F.col("shift__")).alias(name))
