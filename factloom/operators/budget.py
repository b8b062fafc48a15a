"""A greedy budget as a fold: rows are taken in order while they fit, and one that does not fit is passed over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def within(rows: DataFrame, group: str, order: list[str], size: str, max_rows: int, max_size: int) -> DataFrame:
    """rows that fit, with place (from 1 in their group) and more (how many rows of the group do not).

    No group is gathered whole: whether a row fits depends only on what came before, and both limits only tighten, so once a row of some size is
    passed over no later one of that size fits. Hence of each size only the first ``max_rows`` (and ``max_size`` / size) can fit, which
    leaves at most ``max_rows`` x ``max_size`` rows of a group for the fold. ``order`` must tell a group's rows apart; sizes are whole
    numbers of 0 or more; a null size fits as 0; a null group is a group.
    """
    need = F.coalesce(F.col(size).cast("long"), F.lit(0))
    sized = rows.select(F.col(group).alias("_group"), need.alias("_size"), F.struct(*order).alias("_order"), F.struct("*").alias("_row"))
    nth = F.row_number().over(W.partitionBy("_group", "_size").orderBy("_order"))
    able = sized.where(F.col("_size") <= max_size).withColumn("_nth", nth).where(F.col("_nth") <= max_rows).where(F.col("_nth") * F.col("_size") <= max_size)
    one = F.struct("_order", "_size", "_row")
    listed = able.groupBy("_group").agg(F.array_sort(F.collect_list(one), lambda a, b: F.when(a["_order"] < b["_order"], -1).when(a["_order"] > b["_order"], 1).otherwise(0)).alias("all"))
    start = F.struct(F.lit(0).alias("used"), F.slice("all", 1, 0).alias("kept")).cast(f"struct<used:bigint,kept:{listed.schema['all'].dataType.simpleString()}>")

    def take(acc: Column, row: Column) -> Column:
        fits = (F.size(acc["kept"]) < max_rows) & (acc["used"] + row["_size"] <= max_size)
        return F.when(fits, F.struct((acc["used"] + row["_size"]).alias("used"), F.concat(acc["kept"], F.array(row)).alias("kept"))).otherwise(acc)

    told = listed.select("_group", F.aggregate("all", start, take, lambda acc: acc["kept"]).alias("kept"))
    totals = sized.groupBy("_group").agg(F.count("*").alias("total"))
    both = told.alias("a").join(totals.alias("b"), F.col("a._group").eqNullSafe(F.col("b._group")))
    placed = both.select(F.posexplode("kept").alias("at", "k"), (F.col("total") - F.size("kept")).alias("more"))
    return placed.select("k._row.*", (F.col("at") + 1).alias("place"), "more")
