"""Iterative operators: k-means, greedy pair merging, back-off probabilities, exhaustive inventories.

Loops run on the driver, the data stays in tables: k-means sends centres, merging works on distinct words with counts and
sends one pair a step.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmill.session import materialize


def kmeans(df: DataFrame, key: str, vector: str, k: int, iterations: int = 50, seed: str = "408") -> tuple[DataFrame, int]:
    """((key, cluster), rounds) by Lloyd's rounds on vectors of unit length, until none changes its cluster.

    The first centres are the k rows first in hash order. Each round sums k vectors; a cluster left empty keeps its centre.
    """
    rows = materialize(df.select(F.col(key).alias("_key"), F.col(vector).cast("array<double>").alias("_v")).where("_v IS NOT NULL"), "vectors")
    first = rows.orderBy(F.sha2(F.concat(F.lit(seed + "|"), F.col("_key").cast("string")), 256)).limit(k).collect()
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    centres = unit(np.array([r["_v"] for r in first]))
    kind = rows.schema["_key"].dataType.simpleString()

    def assign(c: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                v = unit(b["_v"].flatten().to_numpy().reshape(len(b), -1)) if len(b) else np.zeros((0, c.shape[1]))
                near = ((v[:, None, :] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([b["_key"], pa.array(near.astype(np.int32))], ["_key", "cluster"])

        return run

    def sums(c: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n, moved = np.zeros(c.shape), np.zeros(len(c), np.int64), 0.0
            for b in batches:
                if len(b):
                    v = unit(b["_v"].flatten().to_numpy().reshape(len(b), -1))
                    d = ((v[:, None, :] - c[None]) ** 2).sum(axis=2)
                    near = d.argmin(axis=1)
                    np.add.at(total, near, v)
                    n += np.bincount(near, minlength=len(c))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(c))), pa.array(n), pa.array(list(total), pa.list_(pa.float64()))], ["cluster", "n", "total"])

        return run

    rounds = 0
    for rounds in range(1, iterations + 1):
        parts = rows.mapInArrow(sums(centres), "cluster long, n long, total array<double>")
        new = centres.copy()
        total, n = np.zeros_like(centres), np.zeros(len(centres))
        for r in parts.toLocalIterator():  # k rows a task
            total[r["cluster"]] += r["total"]
            n[r["cluster"]] += r["n"]
        new[n > 0] = total[n > 0] / n[n > 0, None]
        if np.allclose(new, centres, atol=1e-12):
            break
        centres = new
    return rows.mapInArrow(assign(centres), f"_key {kind}, cluster int").withColumnRenamed("_key", key), rounds


def _merge(signs: list[str], a: str, b: str) -> list[str]:
    out, i = [], 0
    while i < len(signs):
        if i + 1 < len(signs) and signs[i] == a and signs[i + 1] == b:
            out.append(a + b)
            i += 2
        else:
            out.append(signs[i])
            i += 1
    return out


def merge_pairs(types: DataFrame, steps: int, mode: str = "frequency", least: float = 0.001) -> list[dict]:
    """Greedy merges of adjacent signs over (word, n): each step the pair with the greatest count and, of equal ones, the greatest pair.

    ``mode`` determinism takes only pairs whose first sign is followed by the second in at least nine of ten cases and that
    make up at least ``least`` of all signs. Words stay distributed; the pair counts of a step are grouped there, and only
    the best pair comes back.
    """
    words = materialize(types.select(F.filter(F.split("word", ""), lambda s: s != "").alias("signs"), F.col("n").cast("long").alias("n")), "words")
    done: list[tuple[str, str]] = []
    out = []

    def counts(merges: list[tuple[str, str]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pairs, signs = Counter(), Counter()
            for b in batches:
                for s, n in zip(b["signs"].to_pylist(), b["n"].to_pylist()):
                    for x, y in merges:
                        s = _merge(s, x, y)
                    for x in s:
                        signs[x] += n
                    for x, y in zip(s, s[1:]):
                        pairs[x, y] += n
            rows = [(x, y, n) for (x, y), n in pairs.items()] + [(x, None, n) for x, n in signs.items()]
            yield pa.RecordBatch.from_pydict({"a": [r[0] for r in rows], "b": [r[1] for r in rows], "n": [r[2] for r in rows]}, schema=pa.schema([("a", pa.string()), ("b", pa.string()), ("n", pa.int64())]))

        return run

    for step in range(1, steps + 1):
        c = words.mapInArrow(counts(done), "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
        c = materialize(c, "pairs")
        total = c.where("b IS NULL").agg(F.sum("n")).first()[0] or 0
        p = c.where("b IS NOT NULL")
        if mode == "determinism":
            before = p.groupBy("a").agg(F.sum("n").alias("t"))
            p = p.join(before, "a").where((F.col("n") >= 0.9 * F.col("t")) & (F.col("n") >= least * total))
        best = p.orderBy(F.desc("n"), F.desc("a"), F.desc("b")).first()
        if best is None:
            break
        done.append((best["a"], best["b"]))
        out.append({"step": step, "pair": f"{best['a']}+{best['b']}", "n": best["n"], "signs": total})
    return out
