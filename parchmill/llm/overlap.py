"""Same or near-same records across splits, by winnowing fingerprints.

Near-same means that the sets of terms agree, so both records are written in one canonical order (by a hash of the term)
before fingerprinting; a common stretch there is a stretch of consecutive terms of both. Two sets of at least
``min_terms`` = 8 terms with a Jaccard similarity of 3/4 or more differ in d terms of their union and share i >= 3d, and
at least 7 where d = 2, so the union in order has a run of at least ceil(i / (d + 1)) >= 3 shared terms. Winnowing over
two-term fingerprints with windows of two keeps a fingerprint of every stretch of three terms, the same one in both
records. So no pair is lost.

The minimum of a window prefers fingerprints with few heavy terms, then the smaller hash: any total order keeps the
guarantee, and this one leaves fingerprints of heavy terms only where three of them stand together.

Records with the same terms are one class. Seeds are joined between classes of different splits under the length and
position limits that the similarity allows; lengths of a pair differ by a third at most, so the join goes by fingerprint and
band of length, which splits the fingerprints that very many records hold. The seeds of a pair are chained (the longest
rising sequence of places in both), each seed of the chain is extended to both sides as long as the terms agree, and what lies
between the stretches is aligned; the terms so covered are what both records share. ``coverage`` gives the best covered share
of every record.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmill.functions.text import terms
from parchmill.session import materialize

#: Terms above this share of the records count as heavy, at most HEAVY of them; they only steer which fingerprint is kept.
HEAVY_SHARE, HEAVY = 0.002, 1024


def _winnower(heavy: np.ndarray):
    """(class, n, left, right, fp, pos) of the kept two-term fingerprints of each hashed sequence; pos from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b["hashes"]
            h = lists.flatten().to_numpy()
            sizes = pc.list_value_length(lists).to_numpy().astype(np.int64)
            if not len(h):
                continue
            row, first = np.repeat(np.arange(len(b)), sizes), np.cumsum(sizes) - sizes
            burden = np.isin(h, heavy).astype(np.int8)
            with np.errstate(over="ignore"):
                fp = (h[:-1] * np.int64(-7046029254386353131)) ^ (h[1:] + np.int64(0x632BE59BD9B4E01))
            burden = burden[:-1] + burden[1:]
            gram = np.flatnonzero(row[:-1] == row[1:])
            window = gram[:-1][np.diff(gram) == 1]
            window = window[row[window] == row[window + 2]]
            second = (burden[window + 1] < burden[window]) | ((burden[window + 1] == burden[window]) & (fp[window + 1] < fp[window]))
            kept = np.unique(window + second)
            of = pa.array(row[kept])
            yield pa.RecordBatch.from_arrays([*[b[c].take(of) for c in ("class", "n", "left", "right")], pa.array(fp[kept]), pa.array((kept - first[row[kept]]).astype(np.int32))], ["class", "n", "left", "right", "fp", "pos"])

    return run


def chain(seeds: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest sequence of seeds that rises in both places."""
    ends: list[int] = []
    at: list[int] = []
    before: list[int] = []
    seeds = sorted(set(seeds), key=lambda s: (s[0], -s[1]))
    for k, (_, r) in enumerate(seeds):
        i = bisect_left(ends, r)
        before.append(at[i - 1] if i else -1)
        ends[i:] = [r, *ends[i + 1 :]]
        at[i:] = [k, *at[i + 1 :]]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(seeds[k])
        k = before[k]
    return out[::-1]


def extended(left: list[int], right: list[int], chained: list[tuple[int, int]]) -> tuple[int, int]:
    """(terms aligned, stretches of consecutive ones) of two sequences in canonical order along a chain of two-term seeds.

    From each seed the stretch grows to both sides while the terms agree; the gaps before, between and behind the stretches
    are aligned for themselves.
    """
    shared = stretches = i = j = 0

    def gap(x: int, y: int) -> None:
        nonlocal shared, stretches
        place = {t: k for k, t in enumerate(right[j:y], j)}
        last, before = j - 1, (-2, -2)
        for k in range(i, x):
            at = place.get(left[k], -1)
            if at > last:
                shared, last = shared + 1, at
                stretches += (k - 1, at - 1) != before
                before = (k, at)

    for x, y in chained:
        if x < i or y < j:
            continue  # within the stretch before
        a, b = x, y
        while a > i and b > j and left[a - 1] == right[b - 1]:
            a, b = a - 1, b - 1
        gap(a, b)
        i, j = x, y
        while i < len(left) and j < len(right) and left[i] == right[j]:
            i, j = i + 1, j + 1
        shared, stretches = shared + i - a, stretches + 1
    gap(len(left), len(right))
    return shared, stretches


def _aligner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for seeds, left, right in zip(b["seeds"].to_pylist(), b["ls"].to_pylist(), b["rs"].to_pylist()):
            chained = chain([(s["lp"], s["rp"]) for s in seeds])
            rows.append((*extended(left, right, chained), len(left), len(right), len(chained)))
        shared, stretches, ln, rn, n = zip(*rows) if rows else ((),) * 5
        yield pa.RecordBatch.from_arrays([b["left_class"], b["right_class"], pa.array(shared, pa.int32()), pa.array(ln, pa.int32()), pa.array(rn, pa.int32()), pa.array(n, pa.int64()), pa.array(stretches, pa.int32())], ["left_class", "right_class", "shared", "left_n", "right_n", "seeds", "stretches"])


def classes(df: DataFrame, key: str, tokens: str, side: Column, keep: dict[str, Column], min_terms: int) -> tuple[DataFrame, DataFrame]:
    """(members: class, key, side, *keep; classes: class, seq, n, left, right) of records with at least ``min_terms`` terms.

    ``side``: true, false or null (excluded). The class is the least key with the same set of terms.
    """
    row = F.max(F.struct(F.col(tokens).alias("_tokens"), side.alias("_side"), *[c.alias(n) for n, c in keep.items()])).alias("_row")
    records = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(row).where("_row._side IS NOT NULL")
    ordered = F.transform(F.array_sort(F.transform(F.array_distinct(terms(F.col("_row._tokens"))), lambda t: F.struct(F.xxhash64(t).alias("h"), t.alias("t")))), lambda x: x["t"])
    rows = records.select("_key", F.col("_row._side").alias("side"), *[F.col(f"_row.{n}").alias(n) for n in keep], ordered.alias("seq")).where(F.size("seq") >= min_terms)
    rows = materialize(rows.withColumn("_h", F.sha2(F.to_json("seq"), 256)), "records")
    # One side each, so a class of a third of all records is summed up before the shuffle.
    groups = materialize(rows.groupBy("_h").agg(F.min("_key").alias("class"), F.max("side").alias("left"), F.min("side").alias("_all"), F.first("seq").alias("seq")), "classes")
    members = rows.join(groups.select("_h", "class"), "_h").select("class", F.col("_key").alias(key), "side", *keep)
    return members, groups.select("class", "seq", F.size("seq").alias("n"), "left", (~F.col("_all")).alias("right"))


def similar_classes(groups: DataFrame) -> DataFrame:
    """(left_class, right_class, shared, left_n, right_n, seeds, stretches) of classes on different sides, Jaccard at least 3/4.

    ``seeds``: length of the chain; ``stretches``: runs of consecutive terms that make up what is shared. Classes with records
    on both sides are linked with themselves, without seeds.
    """
    counts = groups.select(F.explode("seq").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n = groups.count()
    heavy = [r["h"] for r in counts.where(F.col("df") > HEAVY_SHARE * n).orderBy(F.desc("df"), "term").limit(HEAVY).select(F.xxhash64("term").alias("h")).collect()]
    hashed = groups.select("class", "n", "left", "right", F.transform("seq", lambda t: F.xxhash64(t)).alias("hashes"))
    kind = dict(groups.dtypes)["class"]
    seeds = materialize(hashed.mapInArrow(_winnower(np.array(heavy, np.int64)), f"class {kind}, n int, left boolean, right boolean, fp long, pos int"), "seeds")
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(4 / 3)) + 1e-9).cast("int")
    a = seeds.where("left").select("fp", band.alias("band"), F.col("class").alias("left_class"), F.col("n").alias("ln"), F.col("pos").alias("lp"))
    # Lengths within 4/3 of each other lie in the same band or in neighbouring ones.
    b = seeds.where("right").select("fp", F.explode(F.array(band - 1, band, band + 1)).alias("band"), F.col("class").alias("right_class"), F.col("n").alias("rn"), F.col("pos").alias("rp"))
    fits = (F.col("left_class") != F.col("right_class")) & (4 * F.least("ln", "rn") >= 3 * F.greatest("ln", "rn"))
    room = F.least("lp", "rp") + F.least(F.col("ln") - F.col("lp"), F.col("rn") - F.col("rp"))
    pairs = a.join(b, ["fp", "band"]).where(fits & (7 * room >= 3 * (F.col("ln") + F.col("rn")))).groupBy("left_class", "right_class").agg(F.collect_list(F.struct("lp", "rp")).alias("seeds"))
    seqs = groups.select("class", F.transform("seq", lambda t: F.xxhash64(t)).alias("seq"))
    both = pairs.join(seqs.select(F.col("class").alias("left_class"), F.col("seq").alias("ls")), "left_class").join(seqs.select(F.col("class").alias("right_class"), F.col("seq").alias("rs")), "right_class")
    out = f"left_class {kind}, right_class {kind}, shared int, left_n int, right_n int, seeds long, stretches int"
    aligned = both.mapInArrow(_aligner, out).where("7 * shared >= 3 * (left_n + right_n)")
    same = groups.where("left AND right").select(F.col("class").alias("left_class"), F.col("class").alias("right_class"), F.col("n").alias("shared"), F.col("n").alias("left_n"), F.col("n").alias("right_n"), F.lit(None).cast("long").alias("seeds"), F.lit(1).alias("stretches"))
    return aligned.unionByName(same)


def cross_split_overlaps(df: DataFrame, key: str, tokens: str, side: Column, keep: dict[str, Column] | None = None, min_terms: int = 8) -> tuple[DataFrame, DataFrame]:
    """(links between classes as ``similar_classes``, members as ``classes``): the whole result without expanding copies.

    ``side`` is true for training records, false for evaluation records, null for neither. Terms are tokens trimmed and
    lower-cased; null and blank tokens are none. Records with fewer than ``min_terms`` distinct terms, with null tokens or
    a null key are left out. Deliveries of a key count once. ``min_terms`` must be at least 8 (the guarantee rests on it).
    Tables may be empty and have any other columns.
    """
    if min_terms < 8:
        raise ValueError("winnowing finds every pair only for records of at least 8 terms")
    members, groups = classes(df, key, tokens, side, keep or {}, min_terms)
    members = materialize(members, "members")
    return materialize(similar_classes(groups), "links"), members


def expand(links: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """All pairs of records of linked classes: (left_key, right_key, shared, left_n, right_n)."""
    a = members.where("side").select(F.col("class").alias("left_class"), F.col(key).alias("left_key"))
    b = members.where("NOT side").select(F.col("class").alias("right_class"), F.col(key).alias("right_key"))
    return links.join(a, "left_class").join(b, "right_class").select("left_key", "right_key", "shared", "left_n", "right_n")


def coverage(links: DataFrame, members: DataFrame, keep: list[str]) -> DataFrame:
    """Evaluation records with the greatest share of their terms that one training record covers (null: none overlaps), and how many classes overlap."""
    best = links.groupBy(F.col("right_class").alias("class")).agg(F.max(F.col("shared") / F.col("right_n")).alias("coverage"), F.count("*").alias("links"))
    return members.where("NOT side").join(best, "class", "left").select(*keep, "class", "coverage", F.coalesce("links", F.lit(0).cast("long")).alias("links"))
