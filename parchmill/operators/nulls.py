"""Permutation and resampling nulls on hash order.

A shuffle is an order by SHA-256 of (seed, replicate, key): the same on every run, engine and partitioning. Structure
(slots, cells, contexts) stays apart from values, and only values move. Cells with one member can't move; leave them out
before replicates multiply the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parchmill.operators.corpus import hash_order


def replicates(df: DataFrame, n: int) -> DataFrame:
    """Every row n times, with ``rep`` from 1; each task makes its own copies, nothing is shuffled."""
    return df.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(n))))


def shuffled(df: DataFrame, n: int, cell: list[str], slot: str, values: list[str], seed: str, stay: list[str] | None = None, many: bool = False) -> DataFrame:
    """(rep, cell..., slot, stay..., values...): the values of each cell moved to other slots of it, jointly, n times.

    One sort by cell and replicate gives the places; values are brought back by their place, so slots and the columns that
    ``stay`` with them keep their meaning. ``slot`` is unique in the table; rows with a null in a cell column are left out.
    The slots are as many as the rows, which an estimate from small files doesn't see; they are never broadcast.
    Hashes are made after the exchange. With ``many`` cells of bounded size the exchange is of the rows alone and each task makes
    the replicates of its cells; else of the replicates.
    """
    c = Window.partitionBy(*cell)
    slots = df.select(*cell, slot, *(stay or []), F.row_number().over(c.orderBy(slot)).alias("_at")).hint("merge")
    moved = df.select(*cell, slot, *values)
    moved = replicates(moved.repartition(*cell), n) if many else replicates(moved, n).repartition("rep", *cell)
    order = Window.partitionBy("rep", *cell).orderBy(hash_order(seed, F.col("rep"), F.col(slot)))
    moved = moved.select("rep", *cell, *values, F.row_number().over(order).alias("_at"))
    return moved.join(slots, [*cell, "_at"]).drop("_at")


def drawn(df: DataFrame, n: int, cell: list[str], key: str, take: str | Column, seed: str) -> DataFrame:
    """(rep, row...): from each cell the first ``take`` rows in hash order, n times: draws without replacement."""
    order = Window.partitionBy("rep", *cell).orderBy(hash_order(seed, F.col("rep"), F.col(key)))
    take = F.col(take) if isinstance(take, str) else take
    return replicates(df, n).withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= take).drop("_k")


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the first 32 bits of the hash of the parts."""
    return F.conv(F.substring(hash_order(*parts), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def against(observed: DataFrame, null: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., observed, null_mean, null_sd, delta, p, p_two, q05, q95).

    ``p``: add-one upper p of the observed value among the replicates; ``p_two``: of its distance from their mean, to both sides;
    ``q05`` and ``q95``: quantiles of the replicates (the least value that such a share of them doesn't exceed). The values of a
    group's replicates, a number each, are held together.
    """
    j = null.join(observed.withColumnRenamed(value, "_o"), by) if by else null.join(F.broadcast(observed.withColumnRenamed(value, "_o")))  # without by: a single row
    g = j.groupBy(*by, "_o").agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"), ((1 + F.count_if(F.col(value) >= F.col("_o") - 1e-12)) / (1 + F.count("*"))).alias("p"), F.sort_array(F.collect_list(value)).alias("v"))
    two = (1 + F.size(F.filter("v", lambda x: F.abs(x - F.col("m")) >= F.abs(F.col("_o") - F.col("m")) - 1e-9))) / (1 + F.size("v"))
    quantile = lambda q: F.try_element_at("v", F.greatest(F.lit(1), F.ceil(F.lit(q) * F.size("v"))).cast("int"))
    return g.select(*by, F.round("_o", 6).alias("observed"), F.round("m", 6).alias("null_mean"), F.round("s", 6).alias("null_sd"), F.round(F.col("_o") - F.col("m"), 6).alias("delta"), F.round("p", 6).alias("p"), F.round(two, 6).alias("p_two"), F.round(quantile(0.05), 6).alias("q05"), F.round(quantile(0.95), 6).alias("q95"))
