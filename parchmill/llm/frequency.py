"""Frequency of every distinct term: exact, by heavy-light aggregation.

Terms that hold a large share of the tokens would make hot groups. They are found first, by local counts of which every
task reports those above a share of its own tokens (a term above that share overall is above it in some task). The heavy
terms, at most ``HEAVY``, go to every task, which counts them in an array and reports one row each; only the remaining
terms are shuffled, summed up per batch beforehand. Both count tables together hold every term once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmill.session import materialize

HEAVY = 1024
SHARE = 1 / 2048


def _detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n) of the terms above ``SHARE`` of the tokens of a stretch of at least 2^20 tokens, or of the whole task."""
    held, size = [], 0

    def report() -> pa.RecordBatch:
        counts = pc.value_counts(pa.chunked_array(held).combine_chunks())
        heavy = counts.filter(pc.greater(counts.field("counts"), SHARE * size))
        return pa.RecordBatch.from_arrays([heavy.field("values"), heavy.field("counts")], ["term", "n"])

    for b in batches:
        flat = b["terms"].flatten()
        held.append(flat)
        size += len(flat)
        if size >= 1 << 20:
            yield report()
            held, size = [], 0
    if size:
        yield report()


def _counter(heavy: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(heavy, pa.string())
        occurrences, holding, rows = np.zeros(len(heavy), np.int64), np.zeros(len(heavy), np.int64), 0
        for b in batches:
            rows += len(b)
            lists = b["terms"]
            flat = lists.flatten()
            if not len(flat):
                continue
            parent = np.repeat(np.arange(len(b)), np.diff(lists.offsets.to_numpy()) if lists.null_count == 0 else pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
            coded = flat.dictionary_encode()
            code, words = coded.indices.to_numpy(), coded.dictionary
            occ = np.bincount(code, minlength=len(words))
            pairs = np.unique(parent.astype(np.int64) * len(words) + code)
            rec = np.bincount(pairs % len(words), minlength=len(words))
            at = pc.fill_null(pc.index_in(words, known), -1).to_numpy() if heavy else np.full(len(words), -1)
            is_heavy = at >= 0
            np.add.at(occurrences, at[is_heavy], occ[is_heavy])
            np.add.at(holding, at[is_heavy], rec[is_heavy])
            light = ~is_heavy
            yield pa.RecordBatch.from_arrays([words.filter(pa.array(light)), pa.array(occ[light]), pa.array(rec[light]), pa.array(np.zeros(light.sum(), bool))], ["term", "occurrences", "records", "heavy"])
        seen = occurrences > 0
        yield pa.RecordBatch.from_arrays([known.filter(pa.array(seen)), pa.array(occurrences[seen]), pa.array(holding[seen]), pa.array(np.ones(seen.sum(), bool))], ["term", "occurrences", "records", "heavy"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([0]), pa.array([rows]), pa.array([True])], ["term", "occurrences", "records", "heavy"])

    return run


def frequencies(records: DataFrame, rare_at_most: int = 2, common_share: tuple[int, int] = (8, 100)) -> DataFrame:
    """(term, occurrences, records, mark) for each distinct term of ``records``, whose column ``terms`` is array<string>.

    Each row is one record; bring deliveries of a key to one row before. Null elements are no terms, a null or empty array
    is a record without terms and counts in the total. mark: ``rare`` if at most ``rare_at_most`` records hold the term,
    else ``common`` if more than ``common_share`` (a fraction) of all records do, else null. No records give no rows.
    Terms are compared as they are, without limit of length.
    """
    lists = materialize(records.select(F.filter(F.coalesce("terms", F.array().cast("array<string>")), lambda t: t.isNotNull()).alias("terms")), "terms")
    detected = lists.mapInArrow(_detect, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    # Long terms are never heavy, so what goes to the tasks is bounded in bytes too.
    heavy = [r["term"] for r in detected.where("length(term) <= 256").orderBy(F.desc("n"), "term").limit(HEAVY).collect()]
    counted = lists.mapInArrow(_counter(heavy), "term string, occurrences long, records long, heavy boolean")
    sums = [F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records")]
    light = counted.where("NOT heavy").groupBy("term").agg(*sums)
    dense = counted.where("heavy").groupBy("term").agg(*sums)
    table = materialize(light.unionAll(dense), "frequencies")
    total = table.where("term IS NULL").first()
    n = total["records"] if total else 0
    mark = F.when(F.col("records") <= rare_at_most, "rare").when(F.col("records") * common_share[1] > common_share[0] * n, "common")
    return table.where("term IS NOT NULL").withColumn("mark", mark)
