"""What the second round's findings were about: memory, disk and time at larger sizes."""

from parchmill.operators import nulls
from tests.conftest import rows


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_slots_are_never_broadcast(spark, tmp_path):
    spark.createDataFrame([(i, i % 3, f"w{i}") for i in range(60)], "slot INT, cell INT, word STRING").write.parquet(f"{tmp_path}/t")
    s = nulls.shuffled(spark.read.parquet(f"{tmp_path}/t"), 3, ["cell"], "slot", ["word"], "s")
    assert "BroadcastExchange" not in plan(s) and s.count() == 180


def test_recut_pages_joins_no_places(spark):
    from parchmill.plans import chance
    from tests.conftest import DATA

    joins = [x for x in plan(chance.recut_pages(spark, f"{DATA}/sf0.001")).splitlines() if "Join" in x]
    assert len(joins) == 2 and sum("SortMergeJoin" in x for x in joins) >= 1  # with the slots, and of the two figures


def test_batches_of_tokens_are_bounded():
    import pyarrow as pa
    from pyspark.sql.types import LongType, StringType, StructType

    from parchmill.functions import plugins

    class Table:
        schema = StructType().add("id", LongType()).add("text", StringType())
        columns = schema.names

        def mapInArrow(self, run, schema):
            self.run = run

    text = "word " * 4000
    b = pa.RecordBatch.from_pydict({"id": list(range(6)), "text": ["a b", None, text, "", text, "c"]})
    for keep, most in ((None, 3 * plugins.BATCH_BYTES), (["id"], 400_000)):
        t = Table()
        plugins.tokenized(t, "text", str.split, keep=keep)
        out = list(t.run(iter([b])))
        assert sum(len(x) for x in out) == 8003 and max(x.nbytes for x in out) < most
        assert [i for x in out for i in x["pos"].to_pylist()] == [0, 1, *range(4000), *range(4000), 0]
        assert out[0].schema.names == [*(keep or ["id", "text"]), "pos", "token"]


def test_tails_of_many_strata():
    import time

    import numpy as np
    import pandas as pd

    from parchmill.functions.similarity import hypergeometric_tail

    g = np.random.default_rng(7)
    n = g.integers(2, 60, 3000)
    m1, k = g.integers(1, n), g.integers(1, n)
    mean, var = m1 * k / n, m1 * k * (n - m1) * (n - k) / n / n / np.maximum(n - 1, 1)
    a = np.floor(mean).astype(int)
    began = time.time()
    low, high = hypergeometric_tail(pd.DataFrame({"a": a, "m1": m1, "k": k, "n": n}))
    assert time.time() - began < 5
    # For so many strata the sum is nearly normal; both tails hold what is observed.
    z = (a.sum() + 0.5 - mean.sum()) / var.sum() ** 0.5
    assert abs(low - 0.5 * (1 + np.vectorize(__import__("math").erf)(z / 2**0.5))) < 2e-3 and 1 < low + high < 1.02
    x = pd.DataFrame({"a": a, "m1": m1, "k": k, "n": n})[:40]
    dist = [1.0]
    for r in x.itertuples():
        from math import comb

        lo, hi = max(0, r.m1 + r.k - r.n), min(r.m1, r.k)
        dist = np.convolve(dist, [0.0] * lo + [comb(r.k, i) * comb(r.n - r.k, r.m1 - i) / comb(r.n, r.m1) for i in range(lo, hi + 1)])
    s = int(x["a"].sum())
    assert np.allclose(hypergeometric_tail(x), (dist[: s + 1].sum(), dist[s:].sum()), atol=1e-9)


def test_placed_runs_draw_as_the_plain_search():
    import time

    import numpy as np

    from parchmill.plans.extras import placed_runs

    def plain(words, sizes, g):
        free, out = np.ones(words, bool), []
        for n in sizes:
            starts = [s for s in range(len(free) - n + 1) if free[s : s + n].all()]
            if not starts:
                break
            s = starts[int(g.integers(len(starts)))]
            free[s : s + n] = False
            out.append((s, n))
        return out

    for seed in range(40):
        g = np.random.default_rng(seed)
        words, sizes = int(g.integers(0, 400)), g.integers(1, 7, int(g.integers(0, 120))).tolist()
        assert placed_runs(words, sizes, np.random.default_rng(seed)) == plain(words, sizes, np.random.default_rng(seed))
    began = time.time()
    assert len(placed_runs(1_000_000, [1, 2, 3] * 2000, np.random.default_rng(1))) == 6000 and time.time() - began < 20


def test_scores_are_not_exchanged(spark, monkeypatch):
    from parchmill.operators import ranking
    from parchmill.plans import statistics
    from tests.conftest import DATA, against_sql

    monkeypatch.setattr(ranking, "HELD", 1, raising=True)  # a group for each query
    p = plan(statistics.bm25_scores(spark, f"{DATA}/sf0.001"))
    assert p.index("MapInArrow") < p.index("CartesianProduct") < p.index("Exchange")
    assert against_sql(spark, statistics.bm25_scores, statistics.SQL["agg15_bm25"]) == ([], [], 0)


def test_only_best_scores_are_gathered(spark, monkeypatch):
    from parchmill.operators import ranking
    from parchmill.plans import base, statistics
    from tests.conftest import DATA, against_sql

    monkeypatch.setattr(ranking, "BEST", 1, raising=True)
    pages = base.pages(spark, f"{DATA}/sf0.001")
    n = rows(ranking.best(pages, "lop_id % 50 = 0", 2))
    scores = [(r["query"], r["score"]) for r in statistics.bm25_scores(spark, f"{DATA}/sf0.001").where("rank <= 2").distinct().collect()]
    assert set(scores) <= {(q, s) for q, s, _ in n} and len(n) < 200
    assert against_sql(spark, statistics.reciprocal_rank, statistics.SQL["agg16_reciprocal_rank"]) == ([], [], 0)


def test_best_order_in_parts_is_that_of_whole_leaves(spark, monkeypatch):
    import numpy as np

    from parchmill.functions.similarity import lcs_length
    from parchmill.operators import chain
    from parchmill.plans import extras
    from tests.conftest import DATA

    g = np.random.default_rng(8)
    for n, letters in ((2, "ab"), (9, "abc"), (40, "abcd"), (120, "abcdefgh")):
        words = ["".join(g.choice(list(letters), int(g.integers(1, 7)))) for _ in range(n - 1)] + ["ab" * 40]
        types, kind = np.unique(words, return_inverse=True)
        s = np.array([[2 * lcs_length(a, b) / (len(a) + len(b)) for b in types.tolist()] for a in types.tolist()])
        for sign in (1, -1):
            w = chain.Words(types.tolist(), sign)
            assert all((w.row(k) == sign * s[k]).all() for k in range(w.size))
            assert sign * max(chain.greatest(w, kind, i) for i in chain.starts(n, 6)) == extras.best_chain(s, kind, sign)
    whole = rows(extras.best_order(spark, f"{DATA}/sf0.001"))
    monkeypatch.setattr(extras, "LEAF", 3, raising=True)
    monkeypatch.setattr(chain, "HELD", 0, raising=True)
    assert rows(extras.best_order(spark, f"{DATA}/sf0.001")) == whole


def test_best_order_of_a_long_leaf(spark, tmp_path):
    import time

    from pyspark.sql import functions as F

    from parchmill.plans import extras
    from tests.conftest import DATA

    l = spark.read.parquet(f"{DATA}/sf0.001/eligible_lines.parquet").where("physical_folio IS NOT NULL")
    l = l.crossJoin(spark.range(300).select(F.col("id").alias("copy"))).withColumn("line_id", F.concat(F.col("line_id").cast("string"), F.lit("-"), F.col("copy"))).withColumn("physical_folio", F.lit("f1"))
    l.drop("copy").write.parquet(f"{tmp_path}/eligible_lines.parquet")
    began = time.time()
    (r,) = extras.best_order(spark, str(tmp_path)).collect()
    assert r["lines"] > 30_000 and r["least"] <= r["observed"] <= r["greatest"] and time.time() - began < 120
