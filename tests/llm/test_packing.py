import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parchmill.llm import packing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60), st.integers(50, 120))
def test_fill_keeps_every_item_once(sizes, capacity):
    a = np.array(sizes, np.int64)
    out = packing.fill(a, lambda i: range(len(a)), capacity)
    assert sorted(i for c in out for i in c) == list(range(len(a)))
    assert all(a[c].sum() <= capacity for c in out)
    assert sum(a[c].sum() < capacity / 2 for c in out) <= 1


def test_containers(spark):
    g = random.Random(4)
    texts = [" ".join(f"w{g.randrange(200)}" for _ in range(g.randrange(1, 60))) for _ in range(400)] + ["é" * 700, "x" * 2000, "y" * 1000, None, "", "z" * 999, "same", "same"]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "id LONG, text STRING, piece INT, shard STRING")
    out = packing.pack(df, "id", "text", capacity=1000, shard_bytes=20_000)
    r = out.toPandas()
    sizes = {i: len(t.encode()) for i, t in enumerate(texts) if t}
    assert r.groupby("id")["tokens"].sum().to_dict() == sizes
    assert r.groupby(["shard", "container"])["tokens"].sum().max() <= 1000
    assert not r.duplicated(["shard", "container", "slot"]).any()
    assert set(r[r.pieces > 1].id) == {i for i, n in sizes.items() if n > 1000}
    for i, rows in r.sort_values("piece").groupby("id"):
        at = 0
        for start, n in rows[["start", "tokens"]].itertuples(index=False):
            assert start == at
            at += n
    used = r["tokens"].sum() / (1000 * len(r[["shard", "container"]].drop_duplicates()))
    assert used > 0.9
    assert packing.pack(df.limit(0), "id", "text").count() == 0
    assert packing.pack(df.where(F.col("text").isNull()), "id", "text").count() == 0


def test_related_texts_come_together(spark):
    texts = [f"alpha{i % 5} beta{i % 5} gamma{i % 5} filler{i}" for i in range(100)]
    df = spark.createDataFrame(list(enumerate(texts)), "id LONG, text STRING")
    r = packing.pack(df, "id", "text", capacity=20 * len(texts[0])).toPandas()
    kinds = r.assign(kind=r.id % 5).groupby("container")["kind"].nunique()
    assert kinds.mean() < 2


def test_shards_are_cut_by_bytes():
    cells = {(0, 0): 40, (0, 1): 50, (1, 0): 30, (2, 0): 350, (2, 5): 10}
    assert packing.shards_of(cells, 100) == [(0, 0, 0, 1), (0, 1, 0, 1), (1, 0, 1, 1), (2, 0, 2, 4), (2, 5, 6, 1)]
    assert packing.shards_of({}, 100) == []


def test_neighbours_lie_in_the_same_shard(spark):
    """Recall of the ten texts most like a text among all, by how many of them its own shard holds."""
    g = random.Random(3)
    topics = [[f"t{k}w{i}" for i in range(60)] for k in range(12)]
    common = [f"c{i}" for i in range(80)]
    texts = [" ".join(g.choice(topics[i % 12] if g.random() < 0.6 else common) for _ in range(g.randrange(30, 120))) for i in range(1200)]
    rows_ = [(i, t, len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows_, "_key LONG, _text STRING, _n LONG").mapInArrow(packing._features(), "_key long, _n long, terms array<int>, tf array<int>, words long").cache()
    df, n = np.zeros(packing.TERMS, np.int64), len(texts)
    held = {r["_key"]: r for r in docs.collect()}
    for r in held.values():
        df[r["terms"]] += 1
    idf = np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)
    mean = float(np.mean([r["words"] for r in held.values()]))
    shard = {r["_key"]: r["shard"] for r in packing.deal(docs, idf, mean, sum(r[2] for r in rows_) // 8).select("_key", "shard").collect()}
    assert len(shard) == n and 8 <= len(set(shard.values())) <= 20
    weights = {k: dict(zip(r["terms"], packing._weight(np.array(r["terms"]), np.array(r["tf"], float), np.full(len(r["tf"]), r["words"] / mean), idf).tolist())) for k, r in held.items()}
    same = 0
    for k in range(0, n, 60):
        score = {j: sum(w[t] for t in weights[k] if t in w) for j, w in weights.items() if j != k}
        same += sum(shard[j] == shard[k] for j in sorted(score, key=lambda j: -score[j])[:10])
    assert same >= 0.7 * 10 * len(range(0, n, 60))
