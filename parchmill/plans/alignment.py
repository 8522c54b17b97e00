"""Queries that join witnesses, pages and lines (JON)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parchmill.operators import align, corpus, stats
from parchmill.plans import base
from parchmill.plans.statistics import _line_words, _page_words, _r
from parchmill.session import table

FIRST, SECOND, THIRD = "zed_eva.ivtff", "gel_eva.ivtff", "tak_eva.ivtff"


def _witness(spark, sf_dir, file):
    return base.loci(spark, sf_dir).where(F.col("file") == file).withColumn("words", corpus.clean_words(F.col("text")))


def witnesses(spark, sf_dir):
    """JON-01: places of two witnesses: common or in one only, and where type, locator or hand differ."""
    a = align.align(_witness(spark, sf_dir, FIRST), _witness(spark, sf_dir, SECOND), ["page_id", "number"], ["locus_type", "locator", "var_h"])
    return a.groupBy("status").agg(F.count("*").alias("places"), *[F.count_if(f"differs_{c}").alias(c) for c in ("locus_type", "locator", "var_h")])


def shared_words(spark, sf_dir):
    """JON-02: words both witnesses read at a place, by the register of the place."""
    a, b = (_witness(spark, sf_dir, f).select("page_id", "number", F.substring("locus_type", 1, 1).alias("register"), F.array_distinct("words").alias(n)) for f, n in ((FIRST, "wa"), (SECOND, "wb")))
    j = a.join(b.drop("register"), ["page_id", "number"]).where("wa IS NOT NULL AND wb IS NOT NULL")
    return j.groupBy("register").agg(F.count("*").alias("places"), F.sum(F.size(F.array_intersect("wa", "wb")).cast("long")).alias("shared"), F.sum(F.size(F.array_union("wa", "wb")).cast("long")).alias("either"))


def occurrence_audit(spark, sf_dir):
    """JON-03: each place of the first witness against two others, with a status instead of dropping what fails."""
    a, b, c = (_witness(spark, sf_dir, f).select("page_id", "number", F.size("words").alias(f"n{i}"), F.col("locus_type").alias(f"t{i}")) for i, f in enumerate((FIRST, SECOND, THIRD)))
    j = a.join(b, ["page_id", "number"], "left").join(c, ["page_id", "number"], "left")
    status = F.when(F.col("n1").isNull() & F.col("n2").isNull(), "missing").when(F.col("n1").isNull() | F.col("n2").isNull(), "one_missing").when((F.col("t0") != F.col("t1")) | (F.col("t0") != F.col("t2")), "type_differs").when((F.col("n0") != F.col("n1")) | (F.col("n0") != F.col("n2")), "out_of_step").otherwise("aligned")
    return j.groupBy(status.alias("status")).agg(F.count("*").alias("places"), F.sum(F.col("n0").cast("long")).alias("words"))


def zipped_words(spark, sf_dir):
    """JON-04: words of two witnesses zipped by ordinal; lines with unequal counts are gaps."""
    z = align.zip_words(_witness(spark, sf_dir, FIRST), _witness(spark, sf_dir, SECOND), ["page_id", "number"], "words")
    return z.where("left <> right").groupBy("left", "right").agg(F.count("*").alias("n"))


def peer_expectation(spark, sf_dir):
    """JON-05: words that labels share with running text of the page, against the mean over other pages of the same stratum."""
    w = base.words(spark, sf_dir).where(F.col("file") == FIRST).where("var_l IS NOT NULL")
    types = w.select("page_id", F.concat_ws("/", "var_l", "var_i").alias("stratum"), F.col("locus_type").startswith("L").alias("label"), "word").distinct()
    labels = types.where("label").select("page_id", "stratum", "word")
    running = types.where("NOT label").select(F.col("page_id").alias("other"), "stratum", "word")
    pages = types.where("NOT label").groupBy("stratum").agg(F.countDistinct("page_id").alias("pages"))
    hits = labels.join(running, ["stratum", "word"]).groupBy("page_id", "stratum").agg(F.count_if(F.col("page_id") == F.col("other")).alias("own"), F.count_if(F.col("page_id") != F.col("other")).alias("peers"))
    out = labels.groupBy("page_id", "stratum").agg(F.count("*").alias("labels")).join(hits, ["page_id", "stratum"], "left").join(pages, "stratum").where("pages > 1")
    own, peers = F.coalesce("own", F.lit(0)), F.coalesce("peers", F.lit(0))
    return out.groupBy("stratum").agg(F.count("*").alias("pages"), F.sum(own).alias("observed"), _r(F.sum(peers / (F.col("pages") - 1))).alias("expected"))


def band_pairs(spark, sf_dir):
    """JON-06: pairs of pages of a corpus up to three apart, and those that share no word."""
    p = base.pages(spark, sf_dir).withColumn("head", F.array_distinct("words"))
    pairs = align.band_pairs(p, "lop_id", "page_ord", 3, F.col("corpus_id"))
    heads = p.select("lop_id", "corpus_id", "head")
    j = pairs.join(heads.withColumnsRenamed({"lop_id": "a", "head": "ha"}), "a").join(heads.select(F.col("lop_id").alias("b"), F.col("head").alias("hb")), "b")
    return j.groupBy("corpus_id").agg(F.count("*").alias("pairs"), F.count_if(~F.arrays_overlap("ha", "hb")).alias("apart"))


def distant_overlap(spark, sf_dir):
    """JON-07: overlap with a distant page, for each page the first in hash order of those more than 20 places away."""
    p = base.pages(spark, sf_dir).withColumn("types", F.array_distinct("words")).select("corpus_id", "lop_id", "page_ord", "types")
    n = p.groupBy("corpus_id").agg(F.max("page_ord").alias("last"), F.min("page_ord").alias("first"))
    # Pages are numbered within a corpus, so the pick is a number drawn by hash and no pair of pages is built.
    h = F.conv(F.substring(F.sha2(F.concat(F.lit("far|"), F.col("lop_id").cast("string")), 256), 1, 8), 16, 10).cast("long")
    below, above = F.greatest(F.col("page_ord") - 21 - F.col("first") + 1, F.lit(0)), F.greatest(F.col("last") - F.col("page_ord") - 21 + 1, F.lit(0))
    pick = F.pmod(h, F.greatest(below + above, F.lit(1)))
    t = p.join(n, "corpus_id").withColumn("below", below).withColumn("room", below + above).where("room > 0").withColumn("pick", pick)
    t = t.withColumn("other", F.when(F.col("pick") < F.col("below"), F.col("first") + F.col("pick")).otherwise(F.col("page_ord") + 21 + F.col("pick") - F.col("below")).cast("int"))
    q = p.groupBy("corpus_id", F.col("page_ord").alias("other")).agg(F.min(F.struct("lop_id", "types")).alias("r"))
    return t.join(q, ["corpus_id", "other"]).groupBy("corpus_id").agg(F.count("*").alias("pages"), _r(F.avg(stats.jaccard(F.col("types"), F.col("r.types")))).alias("distant"))


def matched_control(spark, sf_dir):
    """JON-08: words at line beginnings matched with others of the same leading sign and length; the rest counted."""
    w = _line_words(spark, sf_dir).withColumn("lead", corpus.gallows_prefix(F.col("word"))).withColumn("len", F.length("word"))
    first = w.where("pos = 0").groupBy("lead", "len").agg(F.count("*").alias("targets"))
    rest = w.where("pos > 0").groupBy("lead", "len").agg(F.count("*").alias("pool"))
    return first.join(rest, ["lead", "len"], "left").groupBy(F.col("pool").isNotNull().alias("matched")).agg(F.count("*").alias("cells"), F.sum("targets").alias("targets"), F.coalesce(F.sum("pool"), F.lit(0)).alias("pool"))


def nearest_length(spark, sf_dir):
    """JON-09: for each label length of a page the nearest length of its running words, ties to the smaller."""
    w = base.words(spark, sf_dir).withColumn("len", F.length("word"))
    label = F.col("locus_type").startswith("L")
    a = w.where(label).select("file", "page_id", F.col("len").alias("target")).distinct()
    b = w.where(~label).select("file", "page_id", F.col("len").alias("candidate")).distinct()
    return align.nearest(a, b, ["file", "page_id"], "target", "candidate").select("file", "page_id", F.col("target").cast("long").alias("target"), F.col("candidate").cast("long").alias("candidate"))


def cross_slot_pairs(spark, sf_dir):
    """JON-10: pairs of equal words at different pages of a leaf, and those at the same slot of their line."""
    w = _line_words(spark, sf_dir).where("folio IS NOT NULL").groupBy("folio", "page_id", "word", "pos").agg(F.count("*").alias("c"))
    # Pairs are counted from group sizes: all pairs of a word in a leaf less those within a page.
    g = w.groupBy("folio", "word", "page_id").agg(F.sum("c").alias("p")).groupBy("folio", "word").agg(F.sum("p").alias("t"), F.sum(F.col("p") * F.col("p")).alias("s"))
    slots = w.groupBy("folio", "word", "pos").agg(F.sum("c").alias("t"), F.sum(F.col("c") * F.col("c")).alias("s"))
    half = lambda d: d.groupBy("folio").agg(F.sum(F.expr("(t * t - s) DIV 2")).alias("pairs"))
    return half(g).join(half(slots).withColumnRenamed("pairs", "same_slot"), "folio")


def unseen_types(spark, sf_dir):
    """JON-11: types of the held-out lines that training lacks, and those whose word without its first sign it has."""
    w = _line_words(spark, sf_dir)
    train = w.where("split = 'discovery'").select("word").distinct()
    new = w.where("split IN ('validation', 'holdout')").select("split", "word").distinct().join(train, "word", "left_anti")
    core = new.withColumn("core", F.expr("substring(word, 2)")).join(train.select(F.col("word").alias("core")), "core", "left_semi").groupBy("split").agg(F.count("*").alias("core_seen"))
    return new.groupBy("split").agg(F.count("*").alias("unseen")).join(core, "split", "left").select("split", "unseen", F.coalesce("core_seen", F.lit(0)).alias("core_seen"))


def strata(spark, sf_dir):
    """JON-12: strata of leaf and word length with lines of both language classes."""
    w = _line_words(spark, sf_dir).where("currier IN ('A', 'B')").withColumn("len", F.length("word").cast("long"))
    g = w.groupBy("illustration", "len").agg(F.count_if(F.col("currier") == "A").alias("a"), F.count_if(F.col("currier") == "B").alias("b"))
    return g.where("a > 0 AND b > 0 AND illustration IS NOT NULL")


def alias_roots(spark, sf_dir):
    """JON-13: pages chained to the page before them in their corpus, and the page each chain starts from."""
    p = base.pages(spark, sf_dir)
    before = F.lag("lop_id").over(Window.partitionBy("corpus_id").orderBy("page_ord", "lop_id"))
    chain = p.select("lop_id", before.alias("parent")).where("parent IS NOT NULL")
    return align.closure(chain, "lop_id", "parent").select(F.col("node").alias("lop_id"), "root", "depth")


def fallback_lookup(spark, sf_dir):
    """JON-14: the page of a line by its id, by its id and a 1, or not at all."""
    l = base.lines(spark, sf_dir).select("line_id", "page_id")
    p = base.loci(spark, sf_dir).select(F.lower("page_id").alias("known")).distinct()
    j = l.join(p, F.col("page_id") == F.col("known"), "left").join(p.withColumnRenamed("known", "other"), F.concat("page_id", F.lit("1")) == F.col("other"), "left")
    how = F.when(F.col("known").isNotNull(), "exact").when(F.col("other").isNotNull(), "first_part").otherwise("none")
    return j.groupBy(how.alias("how")).agg(F.count("*").alias("lines"))


def revenue_by_nation(spark, sf_dir):
    """Star join of six tables with filters and an aggregate, as Catalyst orders it."""
    t = {n: table(spark, sf_dir, n) for n in ("customer", "orders", "lineitem", "supplier", "nation", "region")}
    j = t["customer"].join(t["orders"], F.col("c_custkey") == F.col("o_custkey")).join(t["lineitem"], F.col("l_orderkey") == F.col("o_orderkey")).join(t["supplier"], (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))).join(t["nation"], F.col("s_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


QUERIES = {
    "jon01_witnesses": witnesses,
    "jon02_shared_words": shared_words,
    "jon03_occurrence_audit": occurrence_audit,
    "jon04_zipped_words": zipped_words,
    "jon05_peer_expectation": peer_expectation,
    "jon06_band_pairs": band_pairs,
    "jon07_distant_overlap": distant_overlap,
    "jon08_matched_control": matched_control,
    "jon09_nearest_length": nearest_length,
    "jon10_cross_slot_pairs": cross_slot_pairs,
    "jon11_unseen_types": unseen_types,
    "jon12_strata": strata,
    "jon13_alias_roots": alias_roots,
    "jon14_fallback_lookup": fallback_lookup,
    "jon_star_revenue": revenue_by_nation,
}

_WORDS_OF = f"{base.LOCI}, wi AS (SELECT *, {base.CLEAN} AS words FROM loc)"
_GAL = "|".join(corpus.GALLOWS)

SQL = {
    "jon01_witnesses": f"""WITH {base.LOCI}, j AS (SELECT CASE WHEN b.page_id IS NULL THEN 'left_only' WHEN a.page_id IS NULL THEN 'right_only' ELSE 'common' END AS status,
a.page_id IS NOT NULL AND b.page_id IS NOT NULL AS c, a.locus_type IS DISTINCT FROM b.locus_type AS t, a.locator IS DISTINCT FROM b.locator AS l, a.var_h IS DISTINCT FROM b.var_h AS h
FROM (SELECT * FROM loc WHERE file = '{FIRST}') a FULL JOIN (SELECT * FROM loc WHERE file = '{SECOND}') b ON a.page_id = b.page_id AND a.number = b.number)
SELECT status, count(*) AS places, count(*) FILTER (WHERE c AND t) AS locus_type, count(*) FILTER (WHERE c AND l) AS locator, count(*) FILTER (WHERE c AND h) AS var_h FROM j GROUP BY status""",
    "jon02_shared_words": f"""WITH {_WORDS_OF}, j AS (SELECT substr(a.locus_type, 1, 1) AS register, a.words AS x, b.words AS y FROM wi a JOIN wi b ON a.file = '{FIRST}' AND b.file = '{SECOND}' AND a.page_id = b.page_id AND a.number = b.number AND a.words IS NOT NULL AND b.words IS NOT NULL)
SELECT register, count(*) AS places, CAST(sum(len(list_intersect(x, y))) AS BIGINT) AS shared, CAST(sum(len(list_distinct(list_concat(x, y)))) AS BIGINT) AS either FROM j GROUP BY register""",
    "jon03_occurrence_audit": f"""WITH {_WORDS_OF}, j AS (SELECT len(a.words) AS n0, len(b.words) AS n1, len(c.words) AS n2, b.page_id IS NULL OR b.text IS NULL AS m1, c.page_id IS NULL OR c.text IS NULL AS m2, a.locus_type AS t0, b.locus_type AS t1, c.locus_type AS t2
FROM (SELECT * FROM wi WHERE file = '{FIRST}') a LEFT JOIN (SELECT * FROM wi WHERE file = '{SECOND}') b ON a.page_id = b.page_id AND a.number = b.number LEFT JOIN (SELECT * FROM wi WHERE file = '{THIRD}') c ON a.page_id = c.page_id AND a.number = c.number)
SELECT CASE WHEN m1 AND m2 THEN 'missing' WHEN m1 OR m2 THEN 'one_missing' WHEN t0 <> t1 OR t0 <> t2 THEN 'type_differs' WHEN n0 <> n1 OR n0 <> n2 THEN 'out_of_step' ELSE 'aligned' END AS status, count(*) AS places, CAST(sum(n0) AS BIGINT) AS words FROM j GROUP BY 1""",
    "jon04_zipped_words": f"""WITH {_WORDS_OF}, j AS (SELECT a.words AS x, b.words AS y FROM wi a JOIN wi b ON a.file = '{FIRST}' AND b.file = '{SECOND}' AND a.page_id = b.page_id AND a.number = b.number AND len(a.words) = len(b.words)),
z AS (SELECT unnest(x) AS "left", unnest(y) AS "right" FROM j) SELECT "left", "right", count(*) AS n FROM z WHERE "left" <> "right" GROUP BY ALL""",
    "jon05_peer_expectation": f"""WITH {base.WORDS}, t AS (SELECT DISTINCT page_id, concat_ws('/', var_l, var_i) AS stratum, locus_type LIKE 'L%' AS label, word FROM w WHERE file = '{FIRST}' AND var_l IS NOT NULL),
p AS (SELECT stratum, count(DISTINCT page_id) AS pages FROM t WHERE NOT label GROUP BY stratum),
h AS (SELECT l.page_id, l.stratum, count(r.word) FILTER (WHERE r.page_id = l.page_id) AS own, count(r.word) FILTER (WHERE r.page_id <> l.page_id) AS peers FROM t l LEFT JOIN t r ON NOT r.label AND r.stratum = l.stratum AND r.word = l.word WHERE l.label GROUP BY ALL)
SELECT h.stratum, count(*) AS pages, CAST(sum(own) AS BIGINT) AS observed, round(sum(peers / (pages - 1)), 6) AS expected FROM h JOIN p ON h.stratum = p.stratum WHERE pages > 1 GROUP BY h.stratum""",
    "jon06_band_pairs": f"""WITH {base.PAGES} SELECT a.corpus_id, count(*) AS pairs, count(*) FILTER (WHERE len(list_intersect(a.words, b.words)) = 0) AS apart
FROM pg a JOIN pg b ON a.corpus_id = b.corpus_id AND a.page_ord < b.page_ord AND b.page_ord <= a.page_ord + 3 GROUP BY a.corpus_id""",
    "jon07_distant_overlap": f"""WITH {base.PAGES}, p AS (SELECT corpus_id, lop_id, page_ord, list_distinct(words) AS types FROM pg), n AS (SELECT corpus_id, max(page_ord) AS last, min(page_ord) AS first FROM p GROUP BY corpus_id),
r AS (SELECT p.*, first, greatest(page_ord - 21 - first + 1, 0) AS below, greatest(last - page_ord - 21 + 1, 0) AS above, CAST('0x' || substr(sha256('far|' || lop_id), 1, 8) AS BIGINT) AS h FROM p JOIN n USING (corpus_id)),
t AS (SELECT *, CASE WHEN h % (below + above) < below THEN first + h % (below + above) ELSE page_ord + 21 + h % (below + above) - below END AS other FROM r WHERE below + above > 0),
q AS (SELECT corpus_id, page_ord AS other, min(struct_pack(i := lop_id, types := types)) AS r FROM p GROUP BY ALL)
SELECT corpus_id, count(*) AS pages, round(avg(len(list_intersect(types, r.types)) / greatest(len(list_distinct(list_concat(types, r.types))), 1)), 6) AS distant FROM t JOIN q USING (corpus_id, other) GROUP BY corpus_id""",
    "jon08_matched_control": f"""WITH {base.LINE_WORDS}, a AS (SELECT pos, regexp_extract(word, '^({_GAL})', 1) AS lead, length(word) AS len FROM lw), f AS (SELECT lead, len, count(*) AS targets FROM a WHERE pos = 0 GROUP BY ALL), r AS (SELECT lead, len, count(*) AS pool FROM a WHERE pos > 0 GROUP BY ALL)
SELECT pool IS NOT NULL AS matched, count(*) AS cells, CAST(sum(targets) AS BIGINT) AS targets, CAST(coalesce(sum(pool), 0) AS BIGINT) AS pool FROM f LEFT JOIN r USING (lead, len) GROUP BY 1""",
    "jon09_nearest_length": f"""WITH {base.WORDS}, a AS (SELECT DISTINCT file, page_id, length(word) AS target FROM w WHERE locus_type LIKE 'L%'), b AS (SELECT DISTINCT file, page_id, length(word) AS candidate FROM w WHERE NOT locus_type LIKE 'L%')
SELECT file, page_id, target, min(struct_pack(d := abs(candidate - target), c := candidate)).c AS candidate FROM a JOIN b USING (file, page_id) GROUP BY ALL""",
    "jon10_cross_slot_pairs": f"""WITH {base.LINE_WORDS}, w AS (SELECT line_id, folio, page_id, pos, word FROM lw WHERE folio IS NOT NULL)
SELECT a.folio, count(*) FILTER (WHERE b.line_id IS NOT NULL) AS pairs, count(*) FILTER (WHERE a.pos = b.pos) AS same_slot FROM w a LEFT JOIN w b ON a.folio = b.folio AND a.word = b.word AND a.page_id < b.page_id GROUP BY a.folio""",
    "jon11_unseen_types": f"""WITH {base.LINE_WORDS}, t AS (SELECT DISTINCT word FROM lw WHERE split = 'discovery'), n AS (SELECT DISTINCT split, word FROM lw WHERE split IN ('validation', 'holdout') AND word NOT IN (SELECT word FROM t))
SELECT split, count(*) AS unseen, count(*) FILTER (WHERE substr(word, 2) IN (SELECT word FROM t)) AS core_seen FROM n GROUP BY split""",
    "jon12_strata": f"WITH {base.LINE_WORDS} SELECT illustration, length(word) AS len, count(*) FILTER (WHERE currier = 'A') AS a, count(*) FILTER (WHERE currier = 'B') AS b FROM lw WHERE illustration IS NOT NULL GROUP BY ALL HAVING a > 0 AND b > 0",
    "jon13_alias_roots": f"""WITH {base.PAGES}, c AS (SELECT lop_id, row_number() OVER o AS k, first_value(lop_id) OVER o AS root FROM pg WINDOW o AS (PARTITION BY corpus_id ORDER BY page_ord, lop_id))
SELECT lop_id, root, k - 1 AS depth FROM c WHERE k > 1""",
    "jon14_fallback_lookup": f"""WITH {base.LINES}, p AS (SELECT DISTINCT lower(page_id) AS known FROM loci)
SELECT CASE WHEN page_id IN (SELECT known FROM p) THEN 'exact' WHEN page_id || '1' IN (SELECT known FROM p) THEN 'first_part' ELSE 'none' END AS how, count(*) AS lines FROM li GROUP BY 1""",
    "jon_star_revenue": """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name""",
}
