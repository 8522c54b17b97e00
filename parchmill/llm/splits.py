"""Splits that keep related records together.

Records that share an entity (an author, a source, a page) are tied, and ties chain. The graph has the entities as nodes:
a record with several entities ties its first to each other one, and equal ties count once, so an entity that a third of
all records name is one node with as many edges as it has different companions. Components come from alternating
large-star and small-star steps. Every record gets the component of its first entity; whole components then go to splits
by a hash of the component, through ranges in proportion to the wanted shares of records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmill.session import materialize

SLOTS = 4096


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the undirected graph with edges (u, v); the component is its least node.

    Nulls and loops are ignored, repeated edges count once, no edges give no rows. Each step costs two joins on a node,
    whose smaller side has one row a node; a node with very many edges is split by adaptive execution. After each round
    the edges are written to the shared folder. The rounds end when the edges stay the same (logarithmic in practice).
    """
    edges = materialize(edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _signature(edges)
    while True:
        ways = _both_ways(edges)
        least = ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = ways.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small-star: every edge is (larger, smaller) now; smaller neighbours and the node itself go to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = _signature(edges)
        if now == before:
            break
        before = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def tied_groups(df: DataFrame, key: str, entities: dict[str, Column], keep: dict[str, Column] | None = None) -> DataFrame:
    """(key, component, *keep), a row for each key.

    ``entities``: the named columns that tie records, already brought to one spelling; null ties nothing. ``keep``: columns
    to carry along. Deliveries of one key count once (of differing ones the greatest stands). A record without entities is
    a component of its own. Null keys are one record. Other columns are ignored; an empty table gives no rows.
    """
    kept = keep or {}
    row = F.max(F.struct(*[F.when(c.isNotNull(), F.concat(F.lit(n + ":"), c.cast("string"))).alias(f"_e{i}") for i, (n, c) in enumerate(entities.items())], *[c.alias(f"_k{i}") for i, c in enumerate(kept.values())])).alias("_row")
    es = [f"_e{i}" for i in range(len(entities))]
    records = df.groupBy(F.col(key).alias("_key")).agg(row).select("_key", "_row.*")
    records = materialize(records.select("_key", F.coalesce(*es).alias("_hub"), F.array_compact(F.array(*es)).alias("_all"), *[f"_k{i}" for i in range(len(kept))]), "records")
    ties = records.where("size(_all) > 1").select("_hub", "_all").distinct()
    found = components(ties.select(F.col("_hub").alias("u"), F.explode("_all").alias("v")))
    alone = F.concat(F.lit("record:"), F.coalesce(F.col("_key").cast("string"), F.lit("")))
    joined = records.join(found, F.col("_hub") == F.col("node"), "left")
    return joined.select(F.col("_key").alias(key), F.coalesce("component", "_hub", alone).alias("component"), *[F.col(f"_k{i}").alias(n) for i, n in enumerate(kept)])


def broken_ties(groups: DataFrame, split: str) -> DataFrame:
    """The rows of ``tied_groups`` whose component has more than one non-null ``split``."""
    groups = materialize(groups, "groups")
    bad = groups.groupBy("component").agg(F.min(split).alias("_a"), F.max(split).alias("_b")).where("_a <> _b").select("component")
    return groups.join(bad, "component", "left_semi")


def assign(groups: DataFrame, shares: dict[str, float], apart: float | None = None) -> DataFrame:
    """``groups`` with a column ``assigned``: whole components to splits, about in proportion to ``shares`` by rows.

    The hash of a component picks one of 4,096 slots; the slots' row counts, which are all the driver sees, set where the
    ranges of the splits end, so a split misses its share by no more than half of the slots at its ends, each about as large as its
    largest component. With ``apart``, components of more than that share of the rows go to the split of the largest share
    whatever their hash, and the ranges make up for it. An empty table gives no rows.
    """
    groups = materialize(groups, "groups")
    sizes = groups.groupBy("component").agg(F.count("*").alias("n")).withColumn("slot", F.pmod(F.xxhash64("component"), F.lit(SLOTS)).cast("int"))
    total = sum(shares.values())
    shares = {k: v / total for k, v in shares.items()}
    most, rows = max(shares, key=shares.get), groups.count()
    bound = rows if apart is None else max(1.0, apart * rows)
    slots = {r["slot"]: r["n"] for r in sizes.where(F.col("n") <= bound).groupBy("slot").agg(F.sum("n").alias("n")).collect()}
    small = sum(slots.values())
    want = {k: max(0.0, v * rows - (rows - small if k == most else 0)) for k, v in shares.items()}
    scale = small / sum(want.values()) if sum(want.values()) else 0
    splits, ends, at = list(want), [], 0.0
    for k in splits:
        at += want[k] * scale
        ends.append(at)
    of, seen, k = [], 0, 0
    for s in range(SLOTS):
        n = slots.get(s, 0)
        while k < len(splits) - 1 and seen + n / 2 > ends[k]:
            k += 1
        of.append(splits[k])
        seen += n
    placed = F.when(F.col("n") > bound, F.lit(most)).otherwise(F.element_at(F.array(*map(F.lit, splits)), _slot_split(of, splits)))
    return groups.join(sizes.select("component", placed.alias("assigned")), "component")


def _slot_split(of: list[str], splits: list[str]) -> Column:
    """The 1-based index of the slot's split: the number of range starts at or below the slot."""
    starts = [next((s for s, x in enumerate(of) if splits.index(x) >= k), len(of)) for k in range(1, len(splits))]
    return sum((F.when(F.col("slot") >= s, 1).otherwise(0) for s in starts), F.lit(1))
