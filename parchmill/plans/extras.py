"""Queries on gates, orders, budgets, sealed evaluation, placebos and plug-ins (rows of the inventory that the other modules lack)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parchmill.functions import plugins
from parchmill.operators import chain, corpus, nulls, runs, stats
from parchmill.plans import base
from parchmill.plans.chance import _SLOTS, _slots
from parchmill.plans.statistics import _line_words, _r
from parchmill.session import table


def annotations(spark, sf_dir):
    """NRM-11: free comments of pages read into flags: damage, a gap and its size, doubt."""
    c = table(spark, sf_dir, "ivtff_pages").select("file", "page_id", F.explode("comments").alias("c")).distinct()
    words = {"two": 2, "three": 3, "four": 4}
    size = F.coalesce(F.try_to_number(F.regexp_extract("c", r"gap of ([0-9]+)", 1), F.lit("99")).cast("long"), *[F.when(F.col("c").contains(f"gap of {w}"), F.lit(n).cast("long")) for w, n in words.items()])
    return c.groupBy(F.col("c").rlike("hole|stain|blot|scraped").alias("damaged"), size.alias("gap"), F.col("c").contains("unsure").alias("unsure")).agg(F.count("*").alias("n"))


def candidate_pages(spark, sf_dir):
    """FLT-06: pages of two witnesses in the same class of language and hand with running text in both, by class."""
    l = base.loci(spark, sf_dir).where("locus_type LIKE 'P%' AND var_l IS NOT NULL AND var_h IS NOT NULL").where(F.size(corpus.clean_words(F.col("text"))) > 0)
    p = l.where("file IN ('zed_eva.ivtff', 'gel_eva.ivtff')").groupBy("page_id", "var_l", "var_h").agg(F.countDistinct("file").alias("w"), F.count("*").alias("lines")).where("w = 2")
    return p.groupBy("var_l", "var_h").agg(F.count("*").alias("pages"), F.sum("lines").alias("lines"))


def sealed_evaluation(spark, sf_dir):
    """FLT-08, FLT-11: held-out figures, planned only if the gates on discovery pass; only these columns may be reported."""
    l = base.lines(spark, sf_dir).withColumn("n", F.size("words").cast("long"))
    gates = l.where("split = 'discovery'").agg((F.count("*") >= 50).alias("lines"), (F.sum("n") >= 300).alias("tokens"))
    out = runs.sealed(gates, lambda: l.where("split = 'holdout'").groupBy("currier").agg(F.count("*").alias("lines"), F.sum("n").alias("tokens")))
    out = out if out is not None else spark.createDataFrame([], "currier STRING, lines LONG, tokens LONG")
    return runs.guarded(out, {"currier", "lines", "tokens"}, {"words", "text"})


def calibrated_gate(spark, sf_dir):
    """FLT-10: an effect against a quarter of a control's effect, and a corrected level, per class."""
    w = _line_words(spark, sf_dir).where("currier IS NOT NULL AND split IS NOT NULL").withColumn("q", F.col("word").startswith("q").cast("double"))
    e = w.groupBy("currier").agg(F.avg(F.when(F.col("pos") == 0, F.col("q"))).alias("first"), F.avg(F.when(F.col("pos") > 0, F.col("q"))).alias("rest"), F.count("*").alias("n"))
    e = e.withColumn("effect", F.abs(F.col("first") - F.col("rest"))).withColumn("se", F.sqrt(F.col("rest") * (1 - F.col("rest")) / F.col("n")))
    control = e.agg(F.max("rest").alias("c"))
    k = e.join(F.broadcast(control))  # a single row
    return k.select("currier", "n", _r("effect").alias("effect"), (F.col("effect") >= 0.25 * F.col("c")).alias("large"), (F.col("effect") > 2.5758 * F.col("se")).alias("sure"), ((F.col("effect") >= 0.25 * F.col("c")) & (F.col("effect") > 2.5758 * F.col("se"))).alias("passed"))


def dependency_levels(spark, sf_dir):
    """SRT-02: order of items with dependencies: the number of steps before each, then the key."""
    return spark.sql("""WITH RECURSIVE d(item, level) AS (SELECT 'r' || r_regionkey, 0 FROM {r} UNION ALL
        SELECT e.item, d.level + 1 FROM d JOIN (SELECT 'n' || n_nationkey AS item, 'r' || n_regionkey AS needs FROM {n} UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM {s}) e ON e.needs = d.item)
        SELECT level, CAST(count(*) AS BIGINT) AS items FROM d GROUP BY level""", r=table(spark, sf_dir, "region"), n=table(spark, sf_dir, "nation"), s=table(spark, sf_dir, "supplier"))


def budgets(spark, sf_dir, total: int = 64_000, least: int = 2_000):
    """SRT-04: room shared among the texts of a contributor: a base for each large text, the rest in order of the ids."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL AND contributor_id IS NOT NULL").select("contributor_id", "doc_id", F.length("text").cast("long").alias("n"))
    order = Window.partitionBy("contributor_id").orderBy("doc_id")
    d = d.withColumn("base", F.least("n", F.lit(least).cast("long")))
    # What is left after all bases goes to the first texts in order, as far as they need it.
    d = d.withColumn("spare", F.greatest(F.lit(total).cast("long") - F.sum("base").over(Window.partitionBy("contributor_id")), F.lit(0).cast("long"))).withColumn("want", F.sum(F.col("n") - F.col("base")).over(order))
    given = F.greatest(F.lit(0).cast("long"), F.least(F.col("n") - F.col("base"), F.col("spare") - (F.col("want") - (F.col("n") - F.col("base")))))
    return d.groupBy("contributor_id").agg(F.sum(F.col("base") + given).alias("room"), F.count_if(F.col("base") + given < F.col("n")).alias("cut"))


def global_shuffle(spark, sf_dir):
    """NUL-01: signs shuffled over each split while the words keep their lengths; words that are still in the split's vocabulary."""
    w = _slots(_line_words(spark, sf_dir).where("split IS NOT NULL AND word RLIKE '^[a-z]+$'"), "split")
    s = w.select("split", F.col("slot").alias("word_slot"), F.posexplode(F.filter(F.split("word", ""), lambda x: x != "")).alias("i", "sign")).withColumn("slot", F.concat("word_slot", F.lit("#"), F.lpad(F.col("i").cast("string"), 10, "0")))
    m = nulls.shuffled(s.select("split", "slot", "sign"), 3, ["split"], "slot", ["sign"], "signs")
    again = m.groupBy("rep", "split", F.substring_index("slot", "#", 2).alias("word_slot")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot", "sign"))), lambda x: x["sign"]), "").alias("word"))
    known = w.select("split", "word").distinct().withColumn("known", F.lit(1)).hint("merge")  # a vocabulary is never broadcast
    return again.join(known, ["split", "word"], "left").groupBy("split", "rep").agg(F.count("*").alias("words"), F.count("known").alias("known"))


def picked_nulls(spark, sf_dir):
    """NUL-07: for each page a page of its class picked by hash, many times; overlap of their words, without smoothing."""
    p = base.pages(spark, sf_dir).where("size(words) > 0").select("corpus_id", "lop_id", F.array_distinct("words").alias("w"))
    numbered = p.withColumn("k", F.row_number().over(Window.partitionBy("corpus_id").orderBy("lop_id")))
    n = numbered.groupBy("corpus_id").agg(F.max("k").alias("n"))
    picks = nulls.replicates(numbered.join(n, "corpus_id"), 10).withColumn("pick", (F.floor(nulls.uniform("pick", F.col("rep"), F.col("lop_id")) * F.col("n")) + 1).cast("int")).select("rep", "corpus_id", "w", "pick")
    j = picks.join(numbered.select("corpus_id", F.col("k").alias("pick"), F.col("w").alias("other")), ["corpus_id", "pick"])
    return j.groupBy("corpus_id", "rep").agg(F.count("*").alias("pages"), _r(F.avg(stats.jaccard(F.col("w"), F.col("other")))).alias("overlap"))


class Starts:
    """The places where a run of ``n`` words begins of which all are free, with counts by block: a draw reads the counts and one block."""

    def __init__(self, free: np.ndarray, n: int):
        used = np.concatenate([[0], np.cumsum(~free)])
        self.n, self.block = n, max(64, int(len(free) ** 0.5))
        self.ok = used[n:] == used[:-n] if n <= len(free) else np.zeros(0, bool)
        self.counts = np.add.reduceat(self.ok.astype(np.int64), np.arange(0, len(self.ok), self.block)) if len(self.ok) else np.zeros(0, np.int64)
        self.total = int(self.counts.sum())

    def at(self, k: int) -> int:
        """The k-th of them, from 0."""
        ends = np.cumsum(self.counts)
        b = int(np.searchsorted(ends, k, side="right"))
        low = b * self.block
        return low + int(np.flatnonzero(self.ok[low : low + self.block])[k - (ends[b] - self.counts[b])])

    def take(self, s: int, n: int) -> None:
        """The words from s to s + n are free no longer."""
        gone = max(0, s - self.n + 1) + np.flatnonzero(self.ok[max(0, s - self.n + 1) : s + n])
        self.ok[gone] = False
        np.subtract.at(self.counts, gone // self.block, 1)
        self.total -= len(gone)


def placed_runs(words: int, sizes: list[int], g: np.random.Generator) -> list[tuple[int, int]]:
    """(start, size) of runs drawn one after the other, each from all places that are still free for it, until one has none."""
    free, starts, out = np.ones(words, bool), {}, []
    for n in sizes:
        if n not in starts:
            starts[n] = Starts(free, n)
        if not starts[n].total:
            break
        s = starts[n].at(int(g.integers(starts[n].total)))
        free[s : s + n] = False
        for x in starts.values():
            x.take(s, n)
        out.append((s, n))
    return out


def placebo_runs(spark, sf_dir):
    """VER-02: one run of running text for each label place of a page, as long as the label, never two at the same words."""
    w = base.words(spark, sf_dir).where("file = 'zed_eva.ivtff'")
    label = F.col("locus_type").startswith("L")
    labels = w.where(label).groupBy("page_id", "locus_id").agg(F.count("*").alias("n"))
    pages = w.where(~label).groupBy("page_id").agg(F.count("*").alias("words")).join(labels.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("locus_id", "n"))).alias("ls")), "page_id")

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        import zlib

        r = rows.iloc[0]
        g = np.random.default_rng([408, zlib.crc32(r["page_id"].encode())])
        sizes = [int(x["n"]) for x in r["ls"]]
        taken = placed_runs(int(r["words"]), [sizes[i] for i in g.permutation(len(sizes))], g)
        return pd.DataFrame({"page_id": [r["page_id"]], "labels": [len(sizes)], "placed": [len(taken)], "words_used": [sum(n for _, n in taken)]})

    return pages.groupBy("page_id").applyInPandas(place, "page_id STRING, labels LONG, placed LONG, words_used LONG")


def best_chain(s: np.ndarray, kind: np.ndarray, sign: int, restarts: int = 6, seed: int = 408) -> float:
    """Greatest (``sign`` 1) or least (-1) sum of similarities of neighbours over orders of items of the given kinds.

    Each restart goes greedily from a drawn item, then reverses stretches (two-opt) until no reversal is better.
    """
    n, w = len(kind), sign * s
    if n < 2:
        return 0.0
    g, best = np.random.default_rng(seed), -np.inf
    for _ in range(restarts):
        left = np.ones(n, bool)
        o = np.empty(n, np.int64)
        o[0] = g.integers(n)
        left[o[0]] = False
        for k in range(1, n):
            o[k] = np.where(left, w[kind[o[k - 1]]][kind], -np.inf).argmax()
            left[o[k]] = False
        t = kind[o]
        better = True
        while better:
            better = False
            for i in range(n - 1):
                while True:
                    # Of reversing i to j only the edges at both ends change; at an end of the chain there is none.
                    gain = np.zeros(n - i - 1)
                    if i:
                        gain += w[t[i - 1]][t[i + 1 :]] - w[t[i - 1], t[i]]
                    gain[:-1] += w[t[i]][t[i + 2 :]] - w[t[i + 1 : -1], t[i + 2 :]]
                    j = int(gain.argmax())
                    if gain[j] <= 1e-12:
                        break
                    t[i : i + j + 2] = t[i : i + j + 2][::-1].copy()
                    better = True
        best = max(best, float(w[t[:-1], t[1:]].sum()))
    return sign * best


#: Leaves of more lines are ordered in a task for each restart and direction.
LEAF = 256


def best_order(spark, sf_dir, restarts: int = 6):
    """VER-04: greatest and least sum of similarities of neighbours that an order of a leaf's line beginnings can have (greedy, then two-opt)."""
    firsts = base.lines(spark, sf_dir).where("folio IS NOT NULL AND size(words) > 0").select("folio", "line_id", F.element_at("words", 1).alias("w"))
    leaves = firsts.groupBy("folio").agg(F.sort_array(F.collect_list(F.struct("line_id", "w"))).alias("l")).select("folio", F.transform("l", lambda x: x["w"]).alias("ws"))
    tasks = max(2 * restarts, 4 * spark.sparkContext.defaultParallelism)
    whole = leaves.where(F.size("ws") <= LEAF).withColumn("part", F.lit(-1)).repartition(tasks)
    # A leaf's parts come to different tasks, as rows are dealt in turn.
    parts = leaves.where(F.size("ws") > LEAF).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(2 * restarts - 1)))).repartition(tasks)

    def run(batches):
        from parchmill.functions.similarity import lcs_length

        for b in batches:
            for folio, ws, part in zip(b["folio"], b["ws"], b["part"]):
                types, kind = np.unique(list(ws), return_inverse=True)  # each pair of distinct words is compared once
                types, n = types.tolist(), len(kind)
                observed = least = greatest = None
                if part < 1:
                    observed = float(np.array([2 * lcs_length(x, y) / (len(x) + len(y)) for x, y in zip(ws[:-1], ws[1:])]).sum())
                if part < 0:
                    w = chain.Words(types)
                    s = np.array([w.row(k) for k in range(w.size)])
                    least, greatest = best_chain(s, kind, -1, restarts), best_chain(s, kind, 1, restarts)
                else:
                    start = chain.starts(n, restarts)[part // 2]
                    if part % 2:
                        least = -chain.greatest(chain.Words(types, -1), kind, start)
                    else:
                        greatest = chain.greatest(chain.Words(types), kind, start)
                yield pd.DataFrame({"folio": [folio], "lines": [n]} | {k: [None if v is None else round(v, 6)] for k, v in (("observed", observed), ("least", least), ("greatest", greatest))})

    found = parts.unionAll(whole).mapInPandas(run, "folio STRING, lines LONG, observed DOUBLE, least DOUBLE, greatest DOUBLE")
    return found.groupBy("folio").agg(F.max("lines").alias("lines"), F.max("observed").alias("observed"), F.min("least").alias("least"), F.max("greatest").alias("greatest"))


def calibration(spark, sf_dir):
    """VER-05: how often a shuffled corpus passes for extreme among shuffles of its own: close to the level if the test is sound."""
    w = _slots(_line_words(spark, sf_dir).where("split IS NOT NULL"), "split")
    s = nulls.shuffled(w, 20, ["split", "line_id"], "slot", ["word"], "calibrate")
    after = F.lead("word").over(Window.partitionBy("rep", "line_id").orderBy("slot"))
    r = s.withColumn("after", after).where("after IS NOT NULL").groupBy("split", "rep").agg(F.count_if(F.col("after") == F.col("word")).alias("repeats"))
    rank = F.rank().over(Window.partitionBy("split").orderBy(F.desc("repeats")))  # 20 rows a split
    return r.withColumn("rank", rank).groupBy("split").agg(F.count("*").alias("runs"), F.count_if(F.col("rank") <= 1).alias("rejected"))


def binnings(spark, sf_dir):
    """VER-09: thirds of a line by floor, nearest and ceiling: how many words change their third."""
    w = _line_words(spark, sf_dir)
    n = F.count("*").over(Window.partitionBy("line_id"))
    i = F.col("pos").cast("double")
    low = F.least(F.lit(2), F.floor(3 * i / F.col("n")))
    near = F.least(F.lit(2), F.floor(3 * i / F.col("n") + 0.5))
    high = F.least(F.lit(2), F.ceil(3 * i / F.col("n")))
    return w.withColumn("n", n).groupBy("split").agg(F.count("*").alias("words"), F.count_if(low != near).alias("nearest"), F.count_if(low != high).alias("ceiling"))


def plugged_tokenizer(spark, sf_dir):
    """UDF-01, UDF-03: a caller's tokenizer over the documents, in Arrow batches."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return plugins.tokenized(d, "text", lambda t: t.split(), keep=["doc_id"]).groupBy("doc_id").agg(F.count("*").alias("tokens"))


def variant_runs(spark, sf_dir):
    """ORC-01, SET-03: the space policies as variants of one protocol, each run once and compared."""
    loci = base.loci(spark, sf_dir)
    make = {p: (lambda p=p: loci.select("locus_id", F.size(corpus.policy_words(F.col("text"), p)).alias("n"))) for p in corpus.POLICIES}
    r = runs.run_variants(spark, {"query": "policies", "variants": sorted(make)}, make)
    return runs.compared(r, list(make)).select("variant", "state", "rows")


QUERIES = {
    "nrm11_annotations": annotations,
    "flt06_candidate_pages": candidate_pages,
    "flt08_sealed_evaluation": sealed_evaluation,
    "flt10_calibrated_gate": calibrated_gate,
    "srt02_dependency_levels": dependency_levels,
    "srt04_budgets": budgets,
    "nul01_global_shuffle": global_shuffle,
    "nul07_picked_nulls": picked_nulls,
    "ver02_placebo_runs": placebo_runs,
    "ver04_best_order": best_order,
    "ver05_calibration": calibration,
    "ver09_binnings": binnings,
    "udf01_plugged_tokenizer": plugged_tokenizer,
    "orc01_variant_runs": variant_runs,
}

SQL = {
    "nrm11_annotations": r"""WITH c AS (SELECT DISTINCT file, page_id, unnest(comments) AS c FROM ivtff_pages)
SELECT regexp_matches(c, 'hole|stain|blot|scraped') AS damaged, coalesce(TRY_CAST(regexp_extract(c, 'gap of ([0-9]+)', 1) AS BIGINT), CASE WHEN contains(c, 'gap of two') THEN 2 END, CASE WHEN contains(c, 'gap of three') THEN 3 END, CASE WHEN contains(c, 'gap of four') THEN 4 END) AS gap,
contains(c, 'unsure') AS unsure, count(*) AS n FROM c WHERE c IS NOT NULL GROUP BY ALL""",
    "flt06_candidate_pages": f"""WITH {base.LOCI}, p AS (SELECT page_id, var_l, var_h, count(DISTINCT file) AS w, count(*) AS lines FROM loc WHERE locus_type LIKE 'P%' AND var_l IS NOT NULL AND var_h IS NOT NULL AND len({base.CLEAN}) > 0 AND file IN ('zed_eva.ivtff', 'gel_eva.ivtff') GROUP BY ALL HAVING count(DISTINCT file) = 2)
SELECT var_l, var_h, count(*) AS pages, CAST(sum(lines) AS BIGINT) AS lines FROM p GROUP BY ALL""",
    "flt08_sealed_evaluation": f"WITH {base.LINES}, g AS (SELECT count(*) >= 50 AND sum(len(words)) >= 300 AS ok FROM li WHERE split = 'discovery') SELECT currier, count(*) AS lines, CAST(sum(len(words)) AS BIGINT) AS tokens FROM li, g WHERE split = 'holdout' AND ok GROUP BY currier",
    "flt10_calibrated_gate": f"""WITH {base.LINE_WORDS}, e AS (SELECT currier, avg(CASE WHEN pos = 0 THEN CAST(word LIKE 'q%' AS INTEGER) END) AS f, avg(CASE WHEN pos > 0 THEN CAST(word LIKE 'q%' AS INTEGER) END) AS r, count(*) AS n FROM lw WHERE currier IS NOT NULL AND split IS NOT NULL GROUP BY currier),
k AS (SELECT *, abs(f - r) AS effect, sqrt(r * (1 - r) / n) AS se, max(r) OVER () AS c FROM e) SELECT currier, n, round(effect, 6) AS effect, effect >= 0.25 * c AS large, effect > 2.5758 * se AS sure, effect >= 0.25 * c AND effect > 2.5758 * se AS passed FROM k""",
    "srt02_dependency_levels": "SELECT 0 AS level, count(*) AS items FROM region UNION ALL SELECT 1, count(*) FROM nation UNION ALL SELECT 2, count(*) FROM supplier",
    "srt04_budgets": """WITH d AS (SELECT contributor_id, doc_id, length(text) AS n, least(length(text), 2000) AS base FROM documents WHERE text IS NOT NULL AND contributor_id IS NOT NULL),
s AS (SELECT *, greatest(64000 - sum(base) OVER (PARTITION BY contributor_id), 0) AS spare, sum(n - base) OVER (PARTITION BY contributor_id ORDER BY doc_id) AS want FROM d),
g AS (SELECT contributor_id, n, base + greatest(0, least(n - base, spare - (want - (n - base)))) AS room FROM s) SELECT contributor_id, CAST(sum(room) AS BIGINT) AS room, count(*) FILTER (WHERE room < n) AS cut FROM g GROUP BY contributor_id""",
    "nul01_global_shuffle": f"""WITH {_SLOTS}, v AS (SELECT split, slot, word FROM a WHERE regexp_full_match(word, '[a-z]+')),
s AS (SELECT split, slot, slot || '#' || lpad(CAST(i - 1 AS VARCHAR), 10, '0') AS at_, substr(word, i, 1) AS sign FROM (SELECT split, slot, word, CAST(unnest(generate_series(1, length(word))) AS BIGINT) AS i FROM v)), o AS (SELECT split, slot, at_, row_number() OVER (PARTITION BY split ORDER BY at_) AS k FROM s),
m AS (SELECT rep, split, sign, row_number() OVER (PARTITION BY rep, split ORDER BY sha256(concat_ws('|', 'signs', rep, at_))) AS k FROM s, (SELECT unnest([1, 2, 3]) AS rep)),
w AS (SELECT rep, split, slot, string_agg(sign, '' ORDER BY at_) AS word FROM m JOIN o USING (split, k) GROUP BY ALL)
SELECT w.split, rep, count(*) AS words, count(u.word) AS known FROM w LEFT JOIN (SELECT DISTINCT split, word FROM v) u ON u.split = w.split AND u.word = w.word GROUP BY ALL""",
    "nul07_picked_nulls": f"""WITH {base.PAGES}, p AS (SELECT corpus_id, lop_id, list_distinct(words) AS w, row_number() OVER (PARTITION BY corpus_id ORDER BY lop_id) AS k, count(*) OVER (PARTITION BY corpus_id) AS n FROM pg WHERE len(words) > 0),
c AS (SELECT rep, corpus_id, w, CAST(floor(CAST('0x' || substr(sha256(concat_ws('|', 'pick', rep, lop_id)), 1, 8) AS BIGINT) / 4294967296.0 * n) AS BIGINT) + 1 AS pick FROM p, (SELECT unnest(generate_series(1, 10)) AS rep))
SELECT c.corpus_id, CAST(rep AS INTEGER) AS rep, count(*) AS pages, round(avg(len(list_intersect(c.w, p.w)) / len(list_distinct(list_concat(c.w, p.w)))), 6) AS overlap FROM c JOIN p ON p.corpus_id = c.corpus_id AND p.k = c.pick GROUP BY ALL""",
    "ver05_calibration": f"""WITH {_SLOTS}, s0 AS (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY slot) AS k FROM a), rp AS (SELECT unnest(generate_series(1, 20)) AS rep),
m AS (SELECT rep, line_id, word, row_number() OVER (PARTITION BY rep, line_id ORDER BY sha256(concat_ws('|', 'calibrate', rep, slot))) AS k FROM a, rp),
x AS (SELECT rep, s0.split, m.word, lead(m.word) OVER (PARTITION BY rep, line_id ORDER BY k) AS after FROM m JOIN s0 USING (line_id, k)),
r AS (SELECT split, rep, count(*) FILTER (WHERE after = word) AS c FROM x WHERE after IS NOT NULL GROUP BY ALL), q AS (SELECT split, rank() OVER (PARTITION BY split ORDER BY c DESC) AS k FROM r)
SELECT split, count(*) AS runs, count(*) FILTER (WHERE k <= 1) AS rejected FROM q GROUP BY split""",
    "ver09_binnings": f"""WITH {base.LINE_WORDS}, a AS (SELECT split, pos, count(*) OVER (PARTITION BY line_id) AS n FROM lw), t AS (SELECT split, least(2, floor(3 * pos / n)) AS l, least(2, floor(3 * pos / n + 0.5)) AS m, least(2, ceil(3 * pos / n)) AS h FROM a)
SELECT split, count(*) AS words, count(*) FILTER (WHERE l <> m) AS nearest, count(*) FILTER (WHERE l <> h) AS ceiling FROM t GROUP BY split""",
    "orc01_variant_runs": f"WITH {base.LOCI} SELECT unnest(['join', 'split', 'strict']) AS variant, 'done' AS state, count(*) AS rows FROM loc",
}
