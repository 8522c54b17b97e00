"""Frozen protocols: variants of a query run one after another, every attempt recorded, evaluation sealed behind gates.

What an operator costs is decided by its plan; here is only what must happen in order: the record of a run is written
before it starts, a failed run stays on record, a comparison refuses missing variants, a report may hold named figures only.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.types import ArrayType, DataType, StructType

RUNS = "protocol STRING, variant STRING, state STRING, seconds DOUBLE, rows LONG, digest STRING, error STRING"


def protocol_hash(protocol: dict) -> str:
    """SHA-256 of the protocol as JSON with sorted keys; not a number raises."""
    return hashlib.sha256(json.dumps(protocol, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()).hexdigest()


def run_variants(spark: SparkSession, protocol: dict, variants: dict[str, Callable[[], DataFrame]], done: DataFrame | None = None, budget: float = 3600.0) -> DataFrame:
    """The runs table after every variant was tried once; variants on record in ``done`` are not tried again.

    Each variant runs in a job group of its own, which is cancelled when the budget is used up (state ``timeout``).
    """
    import threading

    key = protocol_hash(protocol)
    before = {r["variant"] for r in done.where(f"protocol = '{key}'").collect()} if done is not None else set()
    out, left = [], budget
    for name, make in variants.items():
        if name in before:
            continue
        if left <= 0:
            out.append(Row(key, name, "skipped", 0.0, None, None, "no budget left"))
            continue
        start, expired = time.time(), threading.Event()
        spark.sparkContext.setJobGroup(f"{key[:12]}-{name}", name, interruptOnCancel=True)

        def expire() -> None:
            expired.set()
            spark.sparkContext.cancelJobGroup(f"{key[:12]}-{name}")

        timer = threading.Timer(left, expire)
        timer.start()
        try:
            n, d = summary(make())
            out.append(Row(key, name, "done", time.time() - start, n, d, None))
        except Exception as e:  # a failed run stays on record
            out.append(Row(key, name, "timeout" if expired.is_set() else "failed", time.time() - start, None, None, str(e)[:500]))
        finally:
            timer.cancel()
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        left -= time.time() - start
    table = spark.createDataFrame(out, RUNS)
    return table if done is None else done.unionByName(table)


def summary(df: DataFrame) -> tuple[int, str]:
    """(rows, digest) of a table, the same for any order of its rows: the sum of the rows' hashes."""
    from pyspark.sql import functions as F

    from parchmill.sources.sinks import canonical

    r = df.select(F.xxhash64(canonical(df)).cast("decimal(38,0)").alias("h")).agg(F.count("*"), F.sum("h")).first()
    return r[0], hashlib.sha256(str(r[1]).encode()).hexdigest()


def compared(runs: DataFrame, variants: list[str]) -> DataFrame:
    """The finished runs, if they are of one protocol and every variant is there once; raises otherwise."""
    rows = runs.where("state = 'done'").collect()
    if len({r["protocol"] for r in rows}) != 1 or sorted(r["variant"] for r in rows) != sorted(variants):
        raise ValueError("the runs don't hold every variant of one protocol once")
    return runs.where("state = 'done'")


def sealed(gates: DataFrame, evaluate: Callable[[], DataFrame]) -> DataFrame | None:
    """The evaluation if all boolean columns of the single row ``gates`` are true; else it isn't even planned."""
    row = gates.first()
    return evaluate() if row is not None and all(v for v in row.asDict().values() if isinstance(v, bool)) else None


def nested_names(schema: StructType) -> set[str]:
    def walk(t: DataType) -> set[str]:
        if isinstance(t, StructType):
            return {n for f in t for n in {f.name} | walk(f.dataType)}
        return walk(t.elementType) if isinstance(t, ArrayType) else set()

    return walk(schema)


def guarded(report: DataFrame, allowed: set[str], forbidden: set[str]) -> DataFrame:
    """The report, if its columns are those allowed and no name at any depth is forbidden; raises otherwise."""
    if set(report.columns) != allowed or nested_names(report.schema) & forbidden:
        raise ValueError(f"columns {sorted(set(report.columns) ^ allowed)} or names {sorted(nested_names(report.schema) & forbidden)} may not be reported")
    return report


def markdown(df: DataFrame, title: str, most: int = 1000) -> str:
    """A small table as markdown, sorted; refuses to leave rows out."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    cell = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = sorted("| " + " | ".join(map(cell, r)) + " |" for r in rows)
    return "\n".join([f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *lines, ""])


def sidecar(data: bytes, name: str) -> str:
    """One line: digest and file name."""
    return f"{hashlib.sha256(data).hexdigest()}  {name}\n"
