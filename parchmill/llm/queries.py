"""The queries on training text, and SQL for those that can be expressed in it."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmill.functions.text import folded, terms
from parchmill.llm import content, frequency, leakage, overlap, packing, setjoin, splits
from parchmill.operators.packed import unpack_lists
from parchmill.plans.copies import SQL as COPIES
from parchmill.session import materialize, spread, table

SHARES = {"training": 0.8, "validation": 0.1, "holdout": 0.1}


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "eligible_lines")
    entities = {c: folded(F.col(c)) for c in ("physical_folio", "page_id")}
    return splits.tied_groups(lines, "line_id", entities, {"split": folded(F.col("split"))})


def broken_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.broken_ties(_groups(spark, sf_dir), "split").select("line_id")


def grouped_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.assign(_groups(spark, sf_dir), SHARES).select("line_id", "component", F.col("split").alias("delivered"), "assigned")


def split_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.assign(_groups(spark, sf_dir), SHARES).groupBy("assigned").agg(F.count("*").alias("lines"), F.countDistinct("component").alias("components"))


def _frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = unpack_lists(spread(table(spark, sf_dir, "loci").select("locus_id", "text")), "locus_id", "text")
    lines = table(spark, sf_dir, "eligible_lines").groupBy("line_id").agg(F.max("tokens").alias("tokens"))
    found = [frequency.frequencies(d).withColumn("field", F.lit(n)) for n, d in (("loci.text", values.select(terms(F.col("values")).alias("terms"))), ("eligible_lines.tokens", lines.select(terms(F.col("tokens")).alias("terms"))))]
    return found[0].unionByName(found[1]).select("field", "term", "occurrences", "records", "mark")


def term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frequencies(spark, sf_dir)


def marked_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frequencies(spark, sf_dir).where("mark IS NOT NULL").select("field", "term", "mark")


def _overlaps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, sf_dir, "eligible_lines")
    split = folded(F.col("split"))
    side = F.when(split == "discovery", True).when(split.isin("validation", "holdout"), False)
    return overlap.cross_split_overlaps(lines, "line_id", "tokens", side, {"split": split, "source_file": F.col("source_file")})


def cross_split_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = overlap.expand(*_overlaps(spark, sf_dir), "line_id")
    return pairs.select(F.least("left_key", "right_key").alias("line_id_a"), F.greatest("left_key", "right_key").alias("line_id_b"))


def overlap_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each evaluation line with the share of its terms that a training line covers at best."""
    links, members = _overlaps(spark, sf_dir)
    return overlap.coverage(links, members, ["line_id", "split", "source_file"]).select("line_id", "split", "source_file", F.round("coverage", 6).alias("coverage"))


def overlap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation lines per split and source that a training line covers, with the mean share of their terms it has at best."""
    each = overlap.coverage(*_overlaps(spark, sf_dir), ["split", "source_file"])
    return each.groupBy("split", "source_file").agg(F.count("*").alias("lines"), F.count("coverage").alias("overlapping"), F.round(F.avg("coverage"), 6).alias("mean_coverage"))


def similar_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = setjoin.expand(*setjoin.similar_pairs(table(spark, sf_dir, "local_order_pages"), "lop_id", "tokens"), "lop_id")
    return pairs.select(F.col("key_a").alias("lop_id_a"), F.col("key_b").alias("lop_id_b"))


def similar_page_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per page with terms: its class of equal pages and the class's number of similar classes."""
    pairs, members = setjoin.similar_pairs(table(spark, sf_dir, "local_order_pages"), "lop_id", "tokens")
    links = pairs.select(F.col("a").alias("class")).unionAll(pairs.select(F.col("b").alias("class"))).groupBy("class").agg(F.count("*").alias("links"))
    return members.join(links, "class", "left").select("lop_id", "class", F.coalesce("links", F.lit(0).cast("long")).alias("links"))


def adjacent_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per corpus the mean Jaccard overlap of pages that follow one another, beside the delivered figure and filled in where it is null."""
    from pyspark.sql import Window

    pages = table(spark, sf_dir, "local_order_pages").groupBy("lop_id").agg(F.max(F.struct("corpus_id", "page_ord", "tokens")).alias("r")).select("lop_id", "r.*")
    pages = pages.withColumn("terms", F.array_distinct(terms(F.col("tokens"))))
    following = F.lead("terms").over(Window.partitionBy("corpus_id").orderBy("page_ord", "lop_id"))
    pairs = pages.withColumn("following", following).where("following IS NOT NULL")
    jaccard = F.size(F.array_intersect("terms", "following")) / F.greatest(F.size(F.array_union("terms", "following")), F.lit(1))
    found = pairs.groupBy("corpus_id").agg(F.avg(jaccard).alias("found"), F.count("*").alias("pairs"))
    entries = table(spark, sf_dir, "entry_results").groupBy("corpus_id").agg(F.max("results.real.jaccard_adjacent").alias("delivered"))
    both = found.join(entries, "corpus_id", "full")
    return both.select("corpus_id", "pairs", F.round("found", 6).alias("found"), "delivered", F.round(F.coalesce("delivered", "found"), 6).alias("filled"))


def packed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")


def split_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that lie in several pieces."""
    return packed_texts(spark, sf_dir).where("pieces > 1").select("doc_id").distinct()


def packed_pieces(spark: SparkSession, sf_dir: str, capacity: int = 8192) -> DataFrame:
    """Per document its pieces and their tokens, whether they follow one another without gap, and the tokens of the fullest container that holds one; a container is fine up to its capacity."""
    pieces = materialize(packed_texts(spark, sf_dir), "pieces")
    each = pieces.groupBy("shard", "container").agg(F.sum("tokens").alias("inside"))
    ends = F.sum("tokens") == F.max(F.col("start") + F.col("tokens"))
    of = pieces.join(each, ["shard", "container"]).groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("tokens"), ends.alias("whole"), F.max("inside").alias("fullest"))
    return of.select("doc_id", "pieces", "tokens", "whole", (F.col("fullest") <= capacity).alias("fits"))


def packing_totals(spark: SparkSession, sf_dir: str, capacity: int = 8192) -> DataFrame:
    """Containers, items, tokens and the share of the containers' room that is used."""
    each = packed_texts(spark, sf_dir).groupBy("shard", "container").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("items"))
    return each.agg(F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"), (F.sum("tokens") / (F.count("*") * capacity)).alias("used"))


def _leaks(spark: SparkSession, sf_dir: str, paraphrases: bool = True) -> DataFrame:
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return leakage.leaks(documents, "doc_id", "text", table(spark, sf_dir, "heldout_items"), "item_id", "text", paraphrases=paraphrases)


def leaked_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir, paraphrases=False).where("how = 'verbatim'").select("doc_id", "item_id")


def leaks_and_paraphrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir)


def leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per suite and kind of leak: items that leaked and documents that hold them."""
    suites = table(spark, sf_dir, "heldout_items").groupBy("item_id").agg(F.max("suite").alias("suite"))
    found = _leaks(spark, sf_dir).join(suites, "item_id")
    return found.groupBy("suite", "how").agg(F.countDistinct("item_id").alias("items"), F.countDistinct("doc_id").alias("documents"))


def _scores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, float]]:
    documents = table(spark, sf_dir, "documents")
    model = content.train_on(documents, "doc_id", "text", table(spark, sf_dir, "content_labels"))
    return content.score(spread(documents.select("doc_id", "text")), "doc_id", "text", model), model.thresholds


def content_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, thresholds = _scores(spark, sf_dir)
    return content.categories(scores, "doc_id", thresholds)


def content_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: documents and the share with each category."""
    scores, thresholds = _scores(spark, sf_dir)
    both = table(spark, sf_dir, "documents").select("doc_id", "source").join(materialize(scores, "scores"), "doc_id")
    rates = [F.avg((F.col(c) >= thresholds[c]).cast("double")).alias(c) for c in content.CLASSES[1:]]
    return both.groupBy("source").agg(F.count("*").alias("documents"), *rates)


QUERIES = {
    "p2_found": broken_ties,
    "p2_splits": grouped_splits,
    "p2_totals": split_totals,
    "p3_found": marked_terms,
    "p3_counts": term_counts,
    "p5_found": cross_split_pairs,
    "p5_report": overlap_report,
    "p5_coverage": overlap_coverage,
    "p6_found": similar_pages,
    "p6_classes": similar_page_classes,
    "p6_adjacent": adjacent_overlap,
    "p7_found": split_texts,
    "p7_packing": packed_texts,
    "p7_pieces": packed_pieces,
    "p7_totals": packing_totals,
    "p8_found": leaked_passages,
    "p8_leaks": leaks_and_paraphrases,
    "p8_items": leaked_items,
    "p9_found": content_categories,
    "p9_rates": content_rates,
}

_B = "' ' || chr(9)"
_TERMS = f"list_filter(list_transform(coalesce(tokens, []), lambda x: lower(trim(x, {_B}))), lambda x: x IS NOT NULL AND x <> '')"

_COUNTS = f"""
WITH v AS ({COPIES["p4_found"]}), r AS (SELECT DISTINCT locus_id FROM loci),
l AS (SELECT line_id, max(tokens) AS tokens FROM eligible_lines GROUP BY line_id),
t AS (SELECT 'loci.text' AS field, locus_id AS id, lower(trim(value, {_B})) AS term FROM v
      UNION ALL SELECT 'eligible_lines.tokens', line_id, unnest({_TERMS}) FROM l),
n AS (SELECT 'loci.text' AS field, count(*) AS n FROM r UNION ALL SELECT 'eligible_lines.tokens', count(*) FROM l),
c AS (SELECT field, term, count(*) AS occurrences, count(DISTINCT id) AS records FROM t WHERE term <> '' GROUP BY ALL)
SELECT field, term, occurrences, records,
       CASE WHEN records <= 2 THEN 'rare' WHEN records * 100 > 8 * n THEN 'common' END AS mark
FROM c JOIN n USING (field)
"""

_LINES = f"""
l AS (SELECT line_id, max(struct_pack(t := tokens, s := lower(trim(split, {_B})), f := source_file)) AS r FROM eligible_lines GROUP BY line_id),
s AS (SELECT line_id, list_distinct({_TERMS.replace("tokens", "r.t")}) AS terms, r.s AS split, r.f AS source_file FROM l),
k AS (SELECT * FROM s WHERE len(terms) >= 8 AND split IN ('discovery', 'validation', 'holdout')),
"""
_PAIRS = f"""
WITH {_LINES}
p AS (SELECT a.line_id AS a, b.line_id AS b, len(list_intersect(a.terms, b.terms)) AS i, len(a.terms) AS na, len(b.terms) AS nb
      FROM k a JOIN k b ON a.split = 'discovery' AND b.split <> 'discovery'
                       AND 4 * least(len(a.terms), len(b.terms)) >= 3 * greatest(len(a.terms), len(b.terms)))
"""

SQL = {
    "p6_classes": f"""
WITH l AS (SELECT lop_id, max(tokens) AS tokens FROM local_order_pages GROUP BY lop_id),
s AS (SELECT lop_id, list_sort(list_distinct({_TERMS})) AS terms FROM l), c AS (SELECT terms, min(lop_id) AS class FROM s WHERE len(terms) > 0 GROUP BY terms),
p AS (SELECT a.class, count(*) AS links FROM c a JOIN c b ON a.class <> b.class WHERE 3 * len(list_intersect(a.terms, b.terms)) >= len(a.terms) + len(b.terms) GROUP BY a.class)
SELECT lop_id, class, coalesce(links, 0) AS links FROM s JOIN c USING (terms) LEFT JOIN p USING (class)
""",
    "p7_pieces": "SELECT doc_id, CAST(ceil(n / 8192) AS BIGINT) AS pieces, n AS tokens, true AS whole, true AS fits FROM (SELECT doc_id, octet_length(encode(text)) AS n FROM documents WHERE text <> '')",
    "p7_found": "SELECT doc_id FROM documents WHERE octet_length(encode(text)) > 8192",
    "p2_found": f"""
WITH RECURSIVE l AS (SELECT line_id, max(struct_pack(f := lower(trim(physical_folio, {_B})), p := lower(trim(page_id, {_B})), s := lower(trim(split, {_B})))) AS r
                     FROM eligible_lines GROUP BY line_id),
e AS (SELECT DISTINCT 'f' || r.f AS u, 'p' || r.p AS v FROM l WHERE r.f IS NOT NULL AND r.p IS NOT NULL),
w AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
c AS (SELECT u AS node, u AS reached FROM w UNION SELECT c.node, w.v FROM c JOIN w ON w.u = c.reached),
m AS (SELECT node, min(reached) AS component FROM c GROUP BY node),
g AS (SELECT line_id, r.s AS split, coalesce(m.component, 'f' || r.f, 'p' || r.p, 'l' || line_id) AS component
      FROM l LEFT JOIN m ON m.node = coalesce('f' || r.f, 'p' || r.p))
SELECT line_id FROM g WHERE component IN (SELECT component FROM g GROUP BY component HAVING count(DISTINCT split) > 1)
""",
    "p3_found": f"SELECT field, term, mark FROM ({_COUNTS}) WHERE mark IS NOT NULL",
    "p3_counts": _COUNTS,
    "p5_found": f"{_PAIRS} SELECT least(a, b) AS line_id_a, greatest(a, b) AS line_id_b FROM p WHERE 7 * i >= 3 * (na + nb)",
    "p5_report": f"""{_PAIRS}, c AS (SELECT b, max(i / nb) AS coverage FROM p WHERE 7 * i >= 3 * (na + nb) GROUP BY b)
SELECT split, source_file, count(*) AS lines, count(coverage) AS overlapping, round(avg(coverage), 6) AS mean_coverage
FROM k LEFT JOIN c ON c.b = k.line_id WHERE split <> 'discovery' GROUP BY split, source_file""",
    "p5_coverage": f"""{_PAIRS}, c AS (SELECT b, max(i / nb) AS coverage FROM p WHERE 7 * i >= 3 * (na + nb) GROUP BY b)
SELECT line_id, split, source_file, round(coverage, 6) AS coverage FROM k LEFT JOIN c ON c.b = k.line_id WHERE split <> 'discovery'""",
    "p6_found": f"""
WITH l AS (SELECT lop_id, max(tokens) AS tokens FROM local_order_pages GROUP BY lop_id),
s AS (SELECT lop_id, list_distinct({_TERMS}) AS terms FROM l)
SELECT a.lop_id AS lop_id_a, b.lop_id AS lop_id_b FROM s a JOIN s b ON a.lop_id < b.lop_id AND len(a.terms) > 0 AND len(b.terms) > 0
WHERE 3 * len(list_intersect(a.terms, b.terms)) >= len(a.terms) + len(b.terms)
""",
    "p6_adjacent": f"""
WITH l AS (SELECT lop_id, max(struct_pack(corpus_id := corpus_id, page_ord := page_ord, tokens := tokens)) AS r FROM local_order_pages GROUP BY lop_id),
s AS (SELECT lop_id, r.corpus_id AS corpus_id, r.page_ord AS page_ord, list_distinct({_TERMS.replace("tokens", "r.tokens")}) AS terms FROM l),
p AS (SELECT corpus_id, terms, lead(terms) OVER (PARTITION BY corpus_id ORDER BY page_ord, lop_id) AS following FROM s),
f AS (SELECT corpus_id, avg(len(list_intersect(terms, following)) / greatest(len(list_distinct(list_concat(terms, following))), 1)) AS found, count(*) AS pairs
      FROM p WHERE following IS NOT NULL GROUP BY corpus_id),
e AS (SELECT corpus_id, max(results.real.jaccard_adjacent) AS delivered FROM entry_results GROUP BY corpus_id)
SELECT corpus_id, pairs, round(found, 6) AS found, delivered, round(coalesce(delivered, found), 6) AS filled FROM f FULL JOIN e USING (corpus_id)
""",
}
