"""Statistics of count tables, as aggregations and windows over exploded rows.

Empty sets: the entropy of nothing is 0, an overlap of two empty sets 0, a statistic with a zero denominator null unless
said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def entropy_bits(counts: DataFrame, count: str, *by: str) -> DataFrame:
    """(by..., n, types, bits) of a count table: log2 N - sum(c log2 c) / N."""
    n = F.sum(count)
    return counts.groupBy(*by).agg(n.alias("n"), F.count("*").alias("types"), (F.log2(n) - F.sum(F.col(count) * F.log2(count)) / n).alias("bits"))


def conditional_bits(pairs: DataFrame, before: str, count: str, *by: str) -> DataFrame:
    """(by..., pairs, bits): entropy of a sign given the one before it, from pair counts."""
    left = pairs.groupBy(*by, before).agg(F.sum(count).alias("l"), F.sum(F.col(count) * F.log2(count)).alias("s"))
    return left.groupBy(*by).agg(F.sum("l").alias("pairs"), (F.sum(F.col("l") * F.log2("l") - F.col("s")) / F.sum("l")).alias("bits"))


def sign_pairs(word: Column) -> Column:
    """Adjacent signs of a word or line as two-sign strings."""
    return F.when(F.length(word) > 1, F.transform(F.sequence(F.lit(1), F.length(word) - 1), lambda i: F.substring(word, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, c, ca, cb, n): cells of a cross table with their margins."""
    cells = df.groupBy(a, b).agg(F.count("*").alias("c"))
    rows = cells.groupBy(a).agg(F.sum("c").alias("ca"))
    cols = cells.groupBy(b).agg(F.sum("c").alias("cb"))
    total = cells.agg(F.sum("c").alias("n"))
    return cells.join(rows, a).join(cols, b).join(F.broadcast(total))  # total is a single row


def midrank(by: list[str], order: Column, value: Column) -> Column:
    """Average rank of ties."""
    rank = F.rank().over(Window.partitionBy(*by).orderBy(order))
    ties = F.count("*").over(Window.partitionBy(*by, value))
    return rank + (ties - 1) / F.lit(2.0)


def bm25(tf: Column, df: Column, n: Column, length: Column, mean: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    return F.log1p((n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))
