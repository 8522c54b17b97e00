"""Queries on nulls by permutation and resampling (NUL, AGG-18, VER-03, VER-06)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parchmill.operators import corpus, nulls, stats
from parchmill.plans import base
from parchmill.plans.statistics import _line_words, _page_words, _r
from parchmill.session import table

#: Replicates of a null; ORDER_REPS where words move within lines, LABEL_REPS where lines' labels move.
REPS, ORDER_REPS, LABEL_REPS = 10, 39, 200


def _slot(*parts):
    """One key for a place, in the order of its numbers whatever their size."""
    return F.concat_ws("#", *[F.lpad(F.col(p).cast("string"), 19, "0") for p in parts])


def _slot_sql(*parts: str) -> str:
    return " || '#' || ".join(f"lpad(CAST({p} AS VARCHAR), 19, '0')" for p in parts)


def _slots(w, *cell):
    """Words with their places as slots."""
    return w.withColumn("slot", _slot("line_id", "pos")).select(*cell, "line_id", "slot", "word")


def _repeat_rate(df, by, line="line_id"):
    after = F.lead("word").over(Window.partitionBy(*by, line).orderBy("slot"))
    return df.withColumn("_after", after).where("_after IS NOT NULL").groupBy(*by).agg(F.avg((F.col("_after") == F.col("word")).cast("double")).alias("rate"))


def within_lines(spark, sf_dir, reps: int = ORDER_REPS):
    """NUL-02, AGG-18: adjacent repeats against words shuffled within their line, per split."""
    w = _slots(_line_words(spark, sf_dir).where("split IS NOT NULL"), "split")
    null = nulls.shuffled(w, reps, ["split", "line_id"], "slot", ["word"], "408")
    return nulls.against(_repeat_rate(w, ["split"]), _repeat_rate(null, ["rep", "split"]), ["split"], "rate")


def labels_in_leaf(spark, sf_dir, reps: int = LABEL_REPS):
    """NUL-03: lines whose hand is that of the line before, against hands shuffled within the leaf."""
    l = base.lines(spark, sf_dir).where("folio IS NOT NULL AND hand IS NOT NULL AND split IS NOT NULL").select("folio", F.col("line_id").alias("slot"), F.col("hand").alias("word"))
    null = nulls.shuffled(l, reps, ["folio"], "slot", ["word"], "quire")
    rate = lambda d, by: _repeat_rate(d.withColumn("line_id", F.col("folio")), by)
    return nulls.against(rate(l, []), rate(null, ["rep"]), [], "rate")


#: The cell within which a position may move: page, stratum, length, paragraph start, place in the line.
CELL = ("page", "currier", "hand", "illustration", "len", "initial", "place")


def within_cells(spark, sf_dir, window: int = 10, reps: int = REPS):
    """NUL-04, AGG-18: share of positions with a family of edit distance one or less among the ten before them on the page, against families shuffled within ``CELL``, per class."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit(""))
    p = table(spark, sf_dir, "zg_positions").where("valid AND trim(zl_family) <> ''").groupBy(F.lower(F.trim("page_id")).alias("page"), "locus_number", "ordinal")
    p = p.agg(F.max(F.struct("loaded_at", F.trim("zl_family").alias("word"), blank("stratum.currier").alias("currier"), blank("stratum.hand").alias("hand"), blank("stratum.illustration").alias("illustration"), F.coalesce("paragraph_initial", F.lit(False)).alias("initial"), blank("line_position").alias("place"))).alias("r"))
    w = p.select("page", F.concat("page", F.lit("#"), _slot("locus_number", "ordinal")).alias("slot"), "r.*").withColumn("len", F.length("word")).drop("loaded_at")

    def rate(d, by):
        before = F.collect_list("word").over(Window.partitionBy(*by, "page").orderBy("slot").rowsBetween(-window, -1))
        hit = F.exists("context", lambda c: F.levenshtein("word", c, 1) >= 0)
        return d.withColumn("context", before).where(F.size("context") == window).groupBy(*by, "currier").agg(F.avg(hit.cast("double")).alias("rate"))

    null = nulls.shuffled(w.select(*CELL, "slot", "word"), reps, list(CELL), "slot", ["word"], "cell")
    return nulls.against(rate(w, []), rate(null, ["rep"]), ["currier"], "rate")


def joint_tuples(spark, sf_dir):
    """NUL-05: positions of which the next has the same family in both copies' readings, both readings moved together within (page, line position)."""
    p = table(spark, sf_dir, "zg_positions").where("valid AND zl_family IS NOT NULL AND gc_family IS NOT NULL").groupBy(F.lower(F.trim("page_id")).alias("page"), "locus_number", "ordinal").agg(F.max(F.struct("loaded_at", F.trim("line_position").alias("place"), F.trim("zl_family").alias("a"), F.trim("gc_family").alias("b"))).alias("r"))
    w = p.select("page", "locus_number", "r.place", F.concat("r.a", F.lit("/"), "r.b").alias("word"), F.concat("page", F.lit("#"), _slot("locus_number", "ordinal")).alias("slot"))

    def rate(d, by):
        after = F.lead("word").over(Window.partitionBy(*by, "page").orderBy("slot"))
        return d.withColumn("after", after).where("after IS NOT NULL").groupBy(*by).agg(F.avg((F.substring("after", 1, 1) == F.substring("word", 1, 1)).cast("double")).alias("rate"))

    null = nulls.shuffled(w, REPS, ["page", "place"], "slot", ["word"], "joint")
    return nulls.against(rate(w, []), rate(null, ["rep"]), [], "rate")


def recut_pages(spark, sf_dir):
    """NUL-06: overlap of adjacent pages against words shuffled over the corpus and cut to the pages' sizes."""
    w = _page_words(spark, sf_dir).select("corpus_id", "lop_id", "page_ord", _slot("lop_id", "pos").alias("slot"), "word")

    def overlap(d, by):
        pages = d.groupBy(*by, "corpus_id", "page_ord", "lop_id").agg(F.collect_set("word").alias("types"))
        after = F.lead("types").over(Window.partitionBy(*by, "corpus_id").orderBy("page_ord", "lop_id"))
        return pages.withColumn("after", after).where("after IS NOT NULL").groupBy(*by, "corpus_id").agg(F.avg(stats.jaccard(F.col("types"), F.col("after"))).alias("rate"))

    null = nulls.shuffled(w, REPS, ["corpus_id"], "slot", ["word"], "recut", ["lop_id", "page_ord"], many=True)
    return nulls.against(overlap(w, []), overlap(null, ["rep"]), ["corpus_id"], "rate")


def stratified_draws(spark, sf_dir):
    """NUL-08, VER-11: words beginning with q among as many words drawn per (split, length) as stand first in lines."""
    w = _slots(_line_words(spark, sf_dir).where("split IS NOT NULL"), "split", "pos").withColumn("len", F.length("word"))
    k = w.groupBy("split", "len").agg(F.count_if(F.col("pos") == 0).alias("k"))
    d = nulls.drawn(w.join(k.where("k > 0"), ["split", "len"]), REPS, ["split", "len"], "slot", "k", "strata")
    share = F.avg(F.col("word").startswith("q").cast("double")).alias("rate")
    return nulls.against(w.where("pos = 0").groupBy("split").agg(share), d.groupBy("rep", "split").agg(share), ["split"], "rate")


def matched_resample(spark, sf_dir):
    """NUL-09, NUL-13: distinct words among label words, against draws with replacement from running words of the same length."""
    w = base.words(spark, sf_dir).where("file = 'zed_eva.ivtff'").withColumn("len", F.length("word"))
    label = F.col("locus_type").startswith("L")
    labels = w.where(label).select("locus_id", "pos", "len", "word")
    pool = w.where(~label).select("len", "word", F.row_number().over(Window.partitionBy("len").orderBy("locus_id", "pos")).alias("k"))
    sizes = pool.groupBy("len").agg(F.max("k").alias("n"))
    kept = labels.join(sizes, "len")
    draws = nulls.replicates(kept, REPS).withColumn("k", (F.floor(nulls.uniform("match", F.col("rep"), F.col("locus_id"), F.col("pos")) * F.col("n")) + 1).cast("int")).select("rep", "len", "k").join(pool, ["len", "k"])
    share = (F.countDistinct("word") / F.count("*")).alias("rate")
    return nulls.against(kept.agg(share), draws.groupBy("rep").agg(share), [], "rate")


def subset_draws(spark, sf_dir):
    """NUL-10: mean length of ten lines per leaf drawn without replacement, against the first ten lines."""
    l = base.lines(spark, sf_dir).where("folio IS NOT NULL").select("folio", "line_id", F.size("words").alias("n"))
    first = l.withColumn("k", F.row_number().over(Window.partitionBy("folio").orderBy("line_id"))).where("k <= 10")
    d = nulls.drawn(l, REPS, ["folio"], "line_id", F.lit(10), "subset")
    return nulls.against(first.agg(F.avg("n").alias("rate")), d.groupBy("rep").agg(F.avg("n").alias("rate")), [], "rate")


def paired_units(spark, sf_dir):
    """NUL-11, NUL-12: first and last sign of a word moved together within lines; lines whose first word ends as the second begins."""
    w = _slots(_line_words(spark, sf_dir).where("split IS NOT NULL"), "split").withColumn("first", F.substring("word", 1, 1)).withColumn("last", F.substring("word", -1, 1))

    def rate(d, by):
        after = F.lead("first").over(Window.partitionBy(*by, "line_id").orderBy("slot"))
        return d.withColumn("after", after).where("after IS NOT NULL").groupBy(*by, "split").agg(F.avg((F.col("after") == F.col("last")).cast("double")).alias("rate"))

    return nulls.against(rate(w, []), rate(nulls.shuffled(w, REPS, ["split", "line_id"], "slot", ["first", "last"], "units"), ["rep"]), ["split"], "rate")


def target_reassignment(spark, sf_dir):
    """NUL-14: pages assigned to one another within a corpus in hash order; pages that keep their own place."""
    p = base.pages(spark, sf_dir).select("corpus_id", F.col("lop_id").alias("slot"), F.col("lop_id").alias("target"))
    s = nulls.shuffled(p, REPS, ["corpus_id"], "slot", ["target"], "target")
    return s.groupBy("corpus_id", "rep").agg(F.count("*").alias("pages"), F.count_if(F.col("slot") == F.col("target")).alias("kept"))


def reweighted(spark, sf_dir):
    """NUL-15: expected share of short words when each word is reweighted by how much likelier it is after its neighbour."""
    w = _slots(_line_words(spark, sf_dir), "split")
    after = w.withColumn("after", F.lead("word").over(Window.partitionBy("line_id").orderBy("slot"))).where("after IS NOT NULL AND split IS NOT NULL")
    pair = after.groupBy("split", "word", "after").agg(F.count("*").alias("c"))
    left, right = (pair.groupBy("split", k).agg(F.sum("c").alias(n)) for k, n in (("word", "cl"), ("after", "cr")))
    j = pair.join(left, ["split", "word"]).join(right, ["split", "after"]).withColumn("q", F.col("c") / F.col("cl") / F.col("cr"))
    return j.groupBy("split").agg(_r(F.sum(F.when(F.length("after") <= 4, F.col("q")).otherwise(0.0)) / F.sum("q")).alias("expected"), F.count("*").alias("pairs"))


def rotations(spark, sf_dir):
    """VER-03: lines turned by an offset drawn per line and replicate, order kept; first words that are the same as on the line itself."""
    w = _line_words(spark, sf_dir).where("split IS NOT NULL").select("split", "line_id", F.col("pos").cast("long").alias("pos"), "word")
    n = w.groupBy("line_id").agg(F.count("*").alias("n"))
    t = nulls.replicates(w.join(n, "line_id"), REPS)
    offset = F.floor(nulls.uniform("turn", F.col("rep"), F.col("line_id")) * F.col("n"))
    turned = t.withColumn("pos", F.pmod(F.col("pos") + offset, F.col("n"))).where("pos = 0")
    return turned.groupBy("split", "rep").agg(F.count("*").alias("lines"), F.countDistinct("word").alias("types"))


def mutation_sweep(spark, sf_dir):
    """VER-06: words found in the vocabulary after a share of their signs is replaced, by share."""
    w = _line_words(spark, sf_dir).groupBy("word").agg(F.count("*").alias("n")).where("word RLIKE '^[a-z]+$'")
    swept = w.withColumn("percent", F.explode(F.array(*map(F.lit, (0, 10, 30)))))
    signs = F.filter(F.split("word", ""), lambda s: s != "")
    changed = F.transform(signs, lambda s, i: F.when(F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit("m"), "word", i.cast("string")), 256), 1, 8), 16, 10).cast("double") / 4294967296.0 * 100 < F.col("percent"), F.lit("o")).otherwise(s))
    m = swept.select("percent", "n", F.array_join(changed, "").alias("mutated"))
    return m.join(w.select(F.col("word").alias("mutated"), F.lit(1).alias("known")), "mutated", "left").groupBy("percent").agg(F.count("*").alias("types"), F.count("known").alias("known"))


QUERIES = {
    "nul02_within_lines": within_lines,
    "nul03_labels_in_leaf": labels_in_leaf,
    "nul04_within_cells": within_cells,
    "nul05_joint_tuples": joint_tuples,
    "nul06_recut_pages": recut_pages,
    "nul08_stratified_draws": stratified_draws,
    "nul09_matched_resample": matched_resample,
    "nul10_subset_draws": subset_draws,
    "nul11_paired_units": paired_units,
    "nul14_target_reassignment": target_reassignment,
    "nul15_reweighted": reweighted,
    "ver03_rotations": rotations,
    "ver06_mutation_sweep": mutation_sweep,
}

_REPS = f"SELECT unnest(generate_series(1, {REPS})) AS rep"
_AGAINST = "round(o, 6) AS observed, round(avg(rate), 6) AS null_mean, round(stddev_pop(rate), 6) AS null_sd, round(o - avg(rate), 6) AS delta, round((1 + count(*) FILTER (WHERE rate >= o - 1e-12)) / (1 + count(*)), 6) AS p, o AS _o, avg(rate) AS _m, list_sort(list(rate) FILTER (WHERE rate IS NOT NULL)) AS _v"
_WHOLE = """SELECT * EXCLUDE (_o, _m, _v), round((1 + len(list_filter(_v, lambda x: abs(x - _m) >= abs(_o - _m) - 1e-9))) / (1 + len(_v)), 6) AS p_two,
round(_v[CAST(greatest(1, ceil(0.05::DOUBLE * len(_v))) AS BIGINT)], 6) AS q05, round(_v[CAST(greatest(1, ceil(0.95::DOUBLE * len(_v))) AS BIGINT)], 6) AS q95 FROM ({})"""


def _shuffled(source: str, cell: str, values: str, seed: str, reps: int = REPS) -> str:
    return f"""s0 AS (SELECT *, row_number() OVER (PARTITION BY {cell} ORDER BY slot) AS at_ FROM {source}), rp AS (SELECT unnest(generate_series(1, {reps})) AS rep),
m0 AS (SELECT rep, {cell}, {values}, row_number() OVER (PARTITION BY rep, {cell} ORDER BY sha256(concat_ws('|', '{seed}', rep, slot))) AS at_ FROM {source}, rp),
mv AS (SELECT rep, {', '.join('s0.' + c.strip() for c in cell.split(','))}, s0.slot, {', '.join('m0.' + v.strip() for v in values.split(','))} FROM m0 JOIN s0 USING ({cell}, at_))"""


_SLOTS = f"{base.LINE_WORDS}, a AS (SELECT split, line_id, {_slot_sql('line_id', 'pos')} AS slot, word, pos FROM lw WHERE split IS NOT NULL)"
_PAGE_SLOTS = f"{base.PAGE_WORDS}, a AS (SELECT corpus_id, lop_id, page_ord, length(word) AS len, {_slot_sql('lop_id', 'pos')} AS slot, word FROM pw"

SQL = {
    "nul02_within_lines": f"""WITH {_SLOTS}, {_shuffled('a', 'split, line_id', 'word', '408', ORDER_REPS)},
o AS (SELECT split, avg(CAST(x = word AS INTEGER)) AS o FROM (SELECT split, word, lead(word) OVER (PARTITION BY line_id ORDER BY slot) AS x FROM a) WHERE x IS NOT NULL GROUP BY split),
n AS (SELECT rep, split, avg(CAST(x = word AS INTEGER)) AS rate FROM (SELECT rep, split, word, lead(word) OVER (PARTITION BY rep, line_id ORDER BY slot) AS x FROM mv) WHERE x IS NOT NULL GROUP BY ALL)
SELECT split, {_AGAINST} FROM n JOIN o USING (split) GROUP BY split, o""",
    "nul03_labels_in_leaf": f"""WITH {base.LINES}, a AS (SELECT folio, line_id AS slot, hand AS word FROM li WHERE folio IS NOT NULL AND hand IS NOT NULL AND split IS NOT NULL), {_shuffled('a', 'folio', 'word', 'quire', LABEL_REPS)},
o AS (SELECT avg(CAST(x = word AS INTEGER)) AS o FROM (SELECT word, lead(word) OVER (PARTITION BY folio ORDER BY slot) AS x FROM a) WHERE x IS NOT NULL),
n AS (SELECT rep, avg(CAST(x = word AS INTEGER)) AS rate FROM (SELECT rep, word, lead(word) OVER (PARTITION BY rep, folio ORDER BY slot) AS x FROM mv) WHERE x IS NOT NULL GROUP BY rep)
SELECT {_AGAINST} FROM n, o GROUP BY o""",
    "nul04_within_cells": f"""WITH p AS (SELECT lower(trim(page_id)) AS page, locus_number, ordinal, max(struct_pack(t := loaded_at, word := trim(zl_family), currier := coalesce(trim(stratum.currier), ''), hand := coalesce(trim(stratum.hand), ''), illustration := coalesce(trim(stratum.illustration), ''), initial := coalesce(paragraph_initial, false), place := coalesce(trim(line_position), ''))) AS r FROM zg_positions WHERE valid AND trim(zl_family) <> '' GROUP BY ALL),
a AS (SELECT page, page || '#' || {_slot_sql('locus_number', 'ordinal')} AS slot, r.word AS word, r.currier AS currier, r.hand AS hand, r.illustration AS illustration, r.initial AS initial, r.place AS place, length(r.word) AS len FROM p), {_shuffled('a', ', '.join(CELL), 'word', 'cell')},
oc AS (SELECT currier, word, list(word) OVER (PARTITION BY page ORDER BY slot ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS c FROM a),
o AS (SELECT currier, avg(CAST(len(list_filter(c, lambda x: levenshtein(word, x) <= 1)) > 0 AS INTEGER)) AS o FROM oc WHERE len(c) = 10 GROUP BY currier),
nc AS (SELECT rep, currier, word, list(word) OVER (PARTITION BY rep, page ORDER BY slot ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS c FROM mv),
n AS (SELECT rep, currier, avg(CAST(len(list_filter(c, lambda x: levenshtein(word, x) <= 1)) > 0 AS INTEGER)) AS rate FROM nc WHERE len(c) = 10 GROUP BY ALL)
SELECT currier, {_AGAINST} FROM n JOIN o USING (currier) GROUP BY currier, o""",
    "nul05_joint_tuples": f"""WITH p AS (SELECT lower(trim(page_id)) AS page, locus_number, ordinal, max(struct_pack(t := loaded_at, place := trim(line_position), a := trim(zl_family), b := trim(gc_family))) AS r FROM zg_positions WHERE valid AND zl_family IS NOT NULL AND gc_family IS NOT NULL GROUP BY ALL),
a AS (SELECT page, r.place AS place, page || '#' || {_slot_sql('locus_number', 'ordinal')} AS slot, r.a || '/' || r.b AS word FROM p), {_shuffled('a', 'page, place', 'word', 'joint')},
o AS (SELECT avg(CAST(substr(x, 1, 1) = substr(word, 1, 1) AS INTEGER)) AS o FROM (SELECT word, lead(word) OVER (PARTITION BY page ORDER BY slot) AS x FROM a) WHERE x IS NOT NULL),
n AS (SELECT rep, avg(CAST(substr(x, 1, 1) = substr(word, 1, 1) AS INTEGER)) AS rate FROM (SELECT rep, word, lead(word) OVER (PARTITION BY rep, page ORDER BY slot) AS x FROM mv) WHERE x IS NOT NULL GROUP BY rep)
SELECT {_AGAINST} FROM n, o GROUP BY o""",
    "nul06_recut_pages": f"""WITH {_PAGE_SLOTS}), {_shuffled('a', 'corpus_id', 'word', 'recut')},
q AS (SELECT corpus_id, page_ord, lop_id, list_distinct(list(word)) AS t FROM a GROUP BY ALL), qn AS (SELECT corpus_id, t, lead(t) OVER (PARTITION BY corpus_id ORDER BY page_ord, lop_id) AS x FROM q),
o AS (SELECT corpus_id, avg(len(list_intersect(t, x)) / len(list_distinct(list_concat(t, x)))) AS o FROM qn WHERE x IS NOT NULL GROUP BY corpus_id),
z AS (SELECT rep, mv.corpus_id, page_ord, lop_id, list_distinct(list(mv.word)) AS t FROM mv JOIN a USING (slot) GROUP BY ALL), zn AS (SELECT rep, corpus_id, t, lead(t) OVER (PARTITION BY rep, corpus_id ORDER BY page_ord, lop_id) AS x FROM z),
n AS (SELECT rep, corpus_id, avg(len(list_intersect(t, x)) / len(list_distinct(list_concat(t, x)))) AS rate FROM zn WHERE x IS NOT NULL GROUP BY ALL)
SELECT corpus_id, {_AGAINST} FROM n JOIN o USING (corpus_id) GROUP BY corpus_id, o""",
    "nul08_stratified_draws": f"""WITH {_SLOTS}, b AS (SELECT *, length(word) AS len FROM a), k AS (SELECT split, len, count(*) FILTER (WHERE pos = 0) AS k FROM b GROUP BY ALL), rp AS ({_REPS}),
d AS (SELECT rep, split, word, k, row_number() OVER (PARTITION BY rep, split, len ORDER BY sha256(concat_ws('|', 'strata', rep, slot))) AS r FROM b JOIN k USING (split, len), rp),
o AS (SELECT split, avg(CAST(word LIKE 'q%' AS INTEGER)) AS o FROM b WHERE pos = 0 GROUP BY split), n AS (SELECT rep, split, avg(CAST(word LIKE 'q%' AS INTEGER)) AS rate FROM d WHERE r <= k GROUP BY ALL)
SELECT split, {_AGAINST} FROM n JOIN o USING (split) GROUP BY split, o""",
    "nul09_matched_resample": f"""WITH {base.WORDS}, z AS (SELECT *, length(word) AS len FROM w WHERE file = 'zed_eva.ivtff'), l AS (SELECT * FROM z WHERE locus_type LIKE 'L%'),
q AS (SELECT len, word, row_number() OVER (PARTITION BY len ORDER BY locus_id, pos) AS k FROM z WHERE NOT locus_type LIKE 'L%'), s AS (SELECT len, max(k) AS n FROM q GROUP BY len), kp AS (SELECT * FROM l JOIN s USING (len)), rp AS ({_REPS}),
d AS (SELECT rep, len, CAST(floor(CAST('0x' || substr(sha256(concat_ws('|', 'match', rep, locus_id, pos)), 1, 8) AS BIGINT) / 4294967296.0 * n) AS BIGINT) + 1 AS k FROM kp, rp),
o AS (SELECT count(DISTINCT word) / count(*) AS o FROM kp), n AS (SELECT rep, count(DISTINCT word) / count(*) AS rate FROM d JOIN q USING (len, k) GROUP BY rep) SELECT {_AGAINST} FROM n, o GROUP BY o""",
    "nul10_subset_draws": f"""WITH {base.LINES}, l AS (SELECT folio, line_id, len(words) AS n FROM li WHERE folio IS NOT NULL), rp AS ({_REPS}),
o AS (SELECT avg(n) AS o FROM (SELECT n, row_number() OVER (PARTITION BY folio ORDER BY line_id) AS k FROM l) WHERE k <= 10),
n AS (SELECT rep, avg(n) AS rate FROM (SELECT rep, n, row_number() OVER (PARTITION BY rep, folio ORDER BY sha256(concat_ws('|', 'subset', rep, line_id))) AS k FROM l, rp) WHERE k <= 10 GROUP BY rep) SELECT {_AGAINST} FROM n, o GROUP BY o""",
    "nul11_paired_units": f"""WITH {_SLOTS}, u AS (SELECT split, line_id, slot, substr(word, 1, 1) AS f, substr(word, -1) AS l FROM a), {_shuffled('u', 'split, line_id', 'f, l', 'units')},
o AS (SELECT split, avg(CAST(x = l AS INTEGER)) AS o FROM (SELECT split, l, lead(f) OVER (PARTITION BY line_id ORDER BY slot) AS x FROM u) WHERE x IS NOT NULL GROUP BY split),
n AS (SELECT rep, split, avg(CAST(x = l AS INTEGER)) AS rate FROM (SELECT rep, split, l, lead(f) OVER (PARTITION BY rep, line_id ORDER BY slot) AS x FROM mv) WHERE x IS NOT NULL GROUP BY ALL)
SELECT split, {_AGAINST} FROM n JOIN o USING (split) GROUP BY split, o""",
    "nul14_target_reassignment": f"WITH {base.PAGES}, a AS (SELECT corpus_id, lop_id AS slot, lop_id AS target FROM pg), {_shuffled('a', 'corpus_id', 'target', 'target')} SELECT corpus_id, CAST(rep AS INTEGER) AS rep, count(*) AS pages, count(*) FILTER (WHERE slot = target) AS kept FROM mv GROUP BY ALL",
    "nul15_reweighted": f"""WITH {_SLOTS}, x AS (SELECT split, word, lead(word) OVER (PARTITION BY line_id ORDER BY slot) AS after FROM a), p AS (SELECT split, word, after, count(*) AS c FROM x WHERE after IS NOT NULL GROUP BY ALL),
q AS (SELECT split, after, c / sum(c) OVER (PARTITION BY split, word) / sum(c) OVER (PARTITION BY split, after) AS q FROM p) SELECT split, round(sum(CASE WHEN length(after) <= 4 THEN q ELSE 0 END) / sum(q), 6) AS expected, count(*) AS pairs FROM q GROUP BY split""",
    "ver03_rotations": f"""WITH {_SLOTS}, c AS (SELECT *, count(*) OVER (PARTITION BY line_id) AS n FROM a), rp AS ({_REPS}),
t AS (SELECT rep, split, word, (pos + CAST(floor(CAST('0x' || substr(sha256(concat_ws('|', 'turn', rep, line_id)), 1, 8) AS BIGINT) / 4294967296.0 * n) AS BIGINT)) % n AS p FROM c, rp)
SELECT split, CAST(rep AS INTEGER) AS rep, count(*) AS lines, count(DISTINCT word) AS types FROM t WHERE p = 0 GROUP BY ALL""",
    "ver06_mutation_sweep": f"""WITH {base.LINE_WORDS}, w AS (SELECT DISTINCT word FROM lw WHERE regexp_full_match(word, '[a-z]+')), s AS (SELECT word, unnest([0, 10, 30]) AS percent FROM w),
m AS (SELECT percent, array_to_string(list_transform(generate_series(1, length(word)), lambda i: CASE WHEN CAST('0x' || substr(sha256(concat_ws('|', 'm', word, i - 1)), 1, 8) AS BIGINT) / 4294967296.0 * 100 < percent THEN 'o' ELSE substr(word, i, 1) END), '') AS mutated FROM s)
SELECT percent, count(*) AS types, count(*) FILTER (WHERE mutated IN (SELECT word FROM w)) AS known FROM m GROUP BY percent""",
}
SQL = {k: _WHOLE.format(v) if "AS _v" in v else v for k, v in SQL.items()}
