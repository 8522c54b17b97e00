"""Alignment of witnesses and matching of records: joins with a defined result for what has no partner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def align(a: DataFrame, b: DataFrame, keys: list[str], compared: list[str]) -> DataFrame:
    """Full join on ``keys``: keys, status (common, left_only, right_only) and ``differs_<column>`` for common rows."""
    left = a.select(*keys, F.lit(1).alias("_a"), *[F.col(c).alias(f"_a_{c}") for c in compared])
    right = b.select(*keys, F.lit(1).alias("_b"), *[F.col(c).alias(f"_b_{c}") for c in compared])
    both = left.join(right, keys, "full")
    status = F.when(F.col("_b").isNull(), "left_only").when(F.col("_a").isNull(), "right_only").otherwise("common")
    return both.select(*keys, status.alias("status"), *[(F.col("_a").isNotNull() & F.col("_b").isNotNull() & ~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}"))).alias(f"differs_{c}") for c in compared])


def zip_words(a: DataFrame, b: DataFrame, keys: list[str], words: str) -> DataFrame:
    """Pairs of words at the same ordinal of lines that have as many; (keys, ordinal, left, right). Other lines are gaps."""
    both = a.select(*keys, F.col(words).alias("_a")).join(b.select(*keys, F.col(words).alias("_b")), keys)
    return both.where(F.size("_a") == F.size("_b")).select(*keys, F.posexplode(F.arrays_zip("_a", "_b")).alias("ordinal", "_p")).select(*keys, "ordinal", F.col("_p._a").alias("left"), F.col("_p._b").alias("right"))


def nearest(targets: DataFrame, candidates: DataFrame, by: list[str], target: str, candidate: str) -> DataFrame:
    """For each target the candidate of its group with the nearest number, the smaller of two equally near ones.

    Targets and candidates are distinct numbers per group; groups are joined on ``by``, so both sides should be distinct.
    """
    j = targets.join(candidates, by)
    order = Window.partitionBy(*by, target).orderBy(F.abs(F.col(candidate) - F.col(target)), candidate)
    return j.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def band_pairs(df: DataFrame, key: str, number: str, width: int, by: Column | None = None) -> DataFrame:
    """Pairs (a, b) with number_a < number_b <= number_a + width, by an equi-join on ranges of ``width``.

    Each row meets its own range and the next one, so no pair of far ranges is built.
    """
    base = df.select(F.col(key).alias("a"), F.col(number).alias("na"), (by if by is not None else F.lit(0)).alias("_by")).withColumn("_r", F.floor(F.col("na") / width))
    other = df.select(F.col(key).alias("b"), F.col(number).alias("nb"), (by if by is not None else F.lit(0)).alias("_by")).withColumn("_r", F.explode(F.array(F.floor(F.col("nb") / width), F.floor(F.col("nb") / width) - 1)))
    return base.join(other, ["_by", "_r"]).where(f"na < nb AND nb <= na + {width}").select("a", "b", "na", "nb")


def closure(edges: DataFrame, source: str, target: str, steps: int = 32) -> DataFrame:
    """(node, root, depth): where each chain of a child-to-parent table ends; null root for a cycle. Doubles the stride each step."""
    from parchmill.session import materialize

    hop = edges.groupBy(F.col(source).alias("node")).agg(F.min(target).alias("root")).withColumn("depth", F.lit(1).cast("long"))
    hop = materialize(hop, "hops")
    for _ in range(steps):
        far = hop.select(F.col("node").alias("root"), F.col("root").alias("_further"), F.col("depth").alias("_more"))
        moved = hop.join(far, "root", "left")
        if moved.where("_further IS NOT NULL").isEmpty():
            return hop
        hop = materialize(moved.select("node", F.coalesce("_further", "root").alias("root"), (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth")), "hops")
        cyclic = hop.where("depth > 4294967296")
        if not cyclic.isEmpty():
            return hop.select("node", F.when(F.col("depth") <= 4294967296, F.col("root")).alias("root"), "depth")
    return hop
