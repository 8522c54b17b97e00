"""Sinks that never overwrite: deterministic JSON lines, put-if-absent tables, checksums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical(df: DataFrame, *columns: str) -> Column:
    """A row as JSON with the columns in the order of their names; nulls are left out, so equal rows give equal text."""
    return F.to_json(F.struct(*sorted(columns or df.columns)))


def digest(df: DataFrame, *columns: str) -> Column:
    return F.sha2(canonical(df, *columns), 256)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a row, sorted; fails if the path exists."""
    df.select(canonical(df).alias("value")).sort("value").write.mode("errorifexists").text(path)


def put_if_absent(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """The rows to append: those of ``new`` whose key ``old`` lacks, one of each key (the least)."""
    rest = [c for c in new.columns if c != key]
    first = new.groupBy(key).agg(F.min(F.struct(*rest)).alias("_r")).select(key, "_r.*") if rest else new.distinct()
    return first.join(old.select(key), key, "left_anti")


def pruned(df: DataFrame, *names: str) -> DataFrame:
    """Without the named columns, nested ones too."""
    from pyspark.sql.types import StructType

    def keep(c: Column, t: StructType) -> Column:
        return F.struct(*[(keep(c[f.name], f.dataType) if isinstance(f.dataType, StructType) else c[f.name]).alias(f.name) for f in t if f.name not in names])

    return df.select(*[(keep(F.col(f.name), f.dataType) if isinstance(f.dataType, StructType) else F.col(f.name)).alias(f.name) for f in df.schema if f.name not in names])
