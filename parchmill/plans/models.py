"""Queries on generators, iterative operators, similarities and checks of the statistics (GEN, ITR, STR-01..03, VER)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parchmill.functions import similarity
from parchmill.operators import corpus, generate, iterate
from parchmill.plans import base
from parchmill.plans.statistics import _line_words, _r, _strata, _STRATA
from parchmill.session import table

FIXED = 2000


def known_text(spark, sf_dir):
    """GEN-01: counts of the words of the known plain text."""
    return generate.plaintext(spark, FIXED).groupBy("word").agg(F.count("*").alias("n"), F.min("pos").alias("first"))


def syllable_words(spark, sf_dir):
    """GEN-02: independent words from a table of syllables."""
    return generate.syllables(spark, FIXED, "syllables").groupBy(F.length("word").cast("long").alias("length")).agg(F.count("*").alias("n"), F.countDistinct("word").alias("types"))


def random_words(spark, sf_dir):
    """GEN-02: words of independent signs."""
    return generate.random_words(spark, FIXED, "aeiodkt", (3, 4, 5, 6), "m0").groupBy(F.length("word").cast("long").alias("length")).agg(F.count("*").alias("n"))


def _habit(spark, sf_dir):
    """The habit of the first witness: transitions between signs, summed over all its words; only these counts, signs by signs, come to the driver."""
    c = base.words(spark, sf_dir).where("file = 'zed_eva.ivtff'").groupBy("word").agg(F.count("*").alias("n"))
    path = F.concat(F.array(F.lit("")), F.filter(F.split("word", ""), lambda s: s != ""), F.array(F.lit("")))
    steps = c.select("n", F.explode(F.arrays_zip(F.slice(path, 1, F.size(path) - 1).alias("a"), F.slice(path, 2, F.size(path) - 1).alias("b"))).alias("s")).groupBy("s.a", "s.b").agg(F.sum("n").alias("n"))
    return generate.Habit({(r["a"], r["b"]): r["n"] for r in steps.toLocalIterator()})


def generated(spark, sf_dir):
    """GEN-03, GEN-04, GEN-08: figures of two generators over a grid of configurations, and their distance from the corpus."""
    habit = _habit(spark, sf_dir)
    rows = [(f"citing-{p}-{q}", "citing", p, q) for p in (0.05, 0.2, 0.4) for q in (0.3, 0.6, 0.9)] + [(f"topical-{p}-{q}", "topical", p, q) for p in (0.2, 0.5, 0.8) for q in (0.2, 0.4, 0.6)]
    configs = spark.createDataFrame(rows, "config STRING, engine STRING, p DOUBLE, q DOUBLE")

    def make(c, g):
        if c["engine"] == "citing":
            return generate.self_citing(habit, g, FIXED, c["p"], c["q"])
        return generate.topical(habit, g, [100] * (FIXED // 100), c["p"], 20, c["q"])

    w = generate.grid(configs, make)
    figures = w.groupBy("config").agg((F.countDistinct("word") / F.count("*")).alias("ttr"), F.avg(F.length("word")).alias("mean_length"))
    ref = base.words(spark, sf_dir).where("file = 'zed_eva.ivtff'").agg((F.countDistinct("word") / F.count("*")).alias("t"), F.avg(F.length("word")).alias("l"))
    d = F.sqrt(F.pow((F.col("ttr") - F.col("t")) / F.col("t"), F.lit(2)) + F.pow((F.col("mean_length") - F.col("l")) / F.col("l"), F.lit(2)))
    return figures.join(F.broadcast(ref)).select("config", _r("ttr").alias("ttr"), _r("mean_length").alias("mean_length"), _r(d).alias("distance"))  # ref is a single row


def layers(spark, sf_dir):
    """GEN-05: words split at the leftmost gallows sign into left, core and right."""
    g = "|".join(corpus.GALLOWS)
    part = lambda i: F.regexp_extract("word", f"^(.*?)({g})(.*)$", i)
    w = base.words(spark, sf_dir).groupBy("word").agg(F.count("*").alias("n"))
    return w.groupBy(part(2).alias("core")).agg(F.count("*").alias("types"), F.sum("n").alias("tokens"), F.countDistinct(part(1)).alias("lefts"), F.countDistinct(part(3)).alias("rights"))


#: Signs by rank, groups of signs, first and last forms of the ciphers.
SIGNS = "oeyaidklrtsnqgpmfhbcxzuvjw"
GROUPS = ("ol", "dy", "chy", "ar", "or", "ain", "shey", "qo", "kee", "ty")
LEFT, RIGHT = ("qo", "o", "ch", "sh", "d"), ("dy", "y", "in", "ol", "r")


def ciphers(spark, sf_dir):
    """GEN-06: document words enciphered by letter rank: into signs, into groups, into one of three weighted homophones a letter (drawn by hash), both also abbreviated, and with forms of their own for the first and the last letter."""
    w = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    letters = w.select("n", F.explode(F.regexp_extract_all("word", F.lit("."), F.lit(0))).alias("letter")).groupBy("letter").agg(F.sum("n").alias("n"))
    ranked = "".join(r["letter"] for r in letters.orderBy(F.desc("n"), "letter").limit(26).collect())
    word, short = F.col("word"), generate.abbreviated(F.col("word"))
    kinds = {"signs": generate.by_rank(word, ranked, SIGNS), "groups": generate.by_rank(word, ranked, GROUPS), "abbreviated": generate.by_rank(short, ranked, GROUPS), "homophones": generate.homophones(word, ranked, GROUPS), "abbreviated_homophones": generate.homophones(short, ranked, GROUPS), "affixes": generate.with_affixes(word, ranked, SIGNS, LEFT, RIGHT)}
    e = w.select("n", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("cipher")) for k, c in kinds.items()])).alias("e")).select("n", "e.*")
    return e.groupBy("kind").agg(F.sum("n").alias("tokens"), F.countDistinct("cipher").alias("types"), F.sum(F.length("cipher") * F.col("n")).alias("signs"))


def numeral_rings(spark, sf_dir):
    """GEN-07: numerals on rings of the sizes 10, 15 and 5."""
    return generate.numerals(spark, [10, 15, 5]).groupBy("system", "ring").agg(F.count("*").alias("n"), F.sum(F.length("word").cast("long")).alias("signs"))


def clusters(spark, sf_dir):
    """ITR-01: k-means clusters of the embeddings against their labels."""
    e = table(spark, sf_dir, "embeddings")
    found, rounds = iterate.kmeans(e, "vec_id", "embedding", 8)
    return found.join(e.select("vec_id", "label"), "vec_id").groupBy("cluster", "label").agg(F.count("*").alias("n"))


def merges(spark, sf_dir, steps: int = 8):
    """ITR-02: greedy merges of signs by frequency."""
    types = base.words(spark, sf_dir).groupBy("word").agg(F.count("*").alias("n"))
    return spark.createDataFrame(iterate.merge_pairs(types, steps), "step LONG, pair STRING, n LONG, signs LONG")


def backoff(spark, sf_dir):
    """ITR-03: probabilities of words after two words, backed off within each Currier class.

    p0 = (2c + 1) / (2T + V) of a word, p1 = (c + p0) / (C + 1) after the word before it, p2 = (c + p1) / (C + 1) after both.
    """
    order = Window.partitionBy("line_id").orderBy("pos")
    w = _line_words(spark, sf_dir).where("split = 'discovery' AND currier IS NOT NULL").withColumn("before", F.lag("word", 1, "<BOS>").over(order)).withColumn("second", F.lag("word", 2, "<BOS>").over(order)).select("currier", "second", "before", "word")
    triples = w.groupBy("currier", "second", "before", "word").agg(F.count("*").alias("c2"))
    pairs = triples.groupBy("currier", "before", "word").agg(F.sum("c2").alias("c1"))
    words = pairs.groupBy("currier", "word").agg(F.sum("c1").alias("c0"))
    totals = words.groupBy("currier").agg(F.sum("c0").alias("t"), F.count("*").alias("v"))
    after_two = triples.groupBy("currier", "second", "before").agg(F.sum("c2").alias("n2"))
    after_one = pairs.groupBy("currier", "before").agg(F.sum("c1").alias("n1"))
    j = triples.join(pairs, ["currier", "before", "word"]).join(after_one, ["currier", "before"]).join(after_two, ["currier", "second", "before"]).join(words, ["currier", "word"]).join(totals, "currier")
    p0 = (2 * F.col("c0") + 1) / (2 * F.col("t") + F.col("v"))
    p1 = (F.col("c1") + p0) / (F.col("n1") + 1)
    p2 = (F.col("c2") + p1) / (F.col("n2") + 1)
    return j.select("currier", "second", "before", "word", F.round(p0, 9).alias("p0"), F.round(p1, 9).alias("p1"), F.round(p2, 9).alias("p2"))


def inventories(spark, sf_dir):
    """ITR-04: every sign as prefix with every unordered pair of signs as suffixes, scored on held-out types."""
    w = _line_words(spark, sf_dir).where("word RLIKE '^[a-z]{3,}$'")
    train = w.where("split = 'discovery'").select("word").distinct()
    test = w.where("split IN ('validation', 'holdout')").select("word").distinct().join(train, "word", "left_anti")
    core = F.expr("substring(word, 2, length(word) - 2)")
    hits = test.select(F.substring("word", 1, 1).alias("p"), F.substring("word", -1, 1).alias("s"), core.alias("core")).join(train.select(F.col("word").alias("core")), "core", "left_semi").groupBy("p", "s").agg(F.count("*").alias("hits"))
    seen = test.groupBy(F.substring("word", 1, 1).alias("p"), F.substring("word", -1, 1).alias("s")).agg(F.count("*").alias("n")).join(hits, ["p", "s"], "left").na.fill(0, ["hits"])
    pairs = seen.select("p", F.col("s").alias("s1"), F.col("n").alias("n1"), F.col("hits").alias("h1")).join(seen.select("p", F.col("s").alias("s2"), F.col("n").alias("n2"), F.col("hits").alias("h2")), "p").where("s1 < s2")  # at most 26 rows a prefix
    return pairs.select("p", "s1", "s2", (F.col("n1") + F.col("n2")).alias("n"), (F.col("h1") + F.col("h2")).alias("hits")).transform(_placed)


def _placed(scores):
    """Rank by hits and the share of inventories with fewer; there are at most 26 x 325 of them."""
    rank = F.rank().over(Window.orderBy(F.desc("hits")))
    return scores.withColumn("rank", rank).withColumn("percentile", F.round(1 - F.cume_dist().over(Window.orderBy(F.desc("hits"))), 6))


def edit_classes(spark, sf_dir):
    """STR-01, STR-02: adjacent words by capped edit distance, with the mean similarity."""
    w = _line_words(spark, sf_dir).where("word RLIKE '^[a-z]+$'").withColumn("after", F.lead("word").over(Window.partitionBy("line_id").orderBy("pos"))).where("after IS NOT NULL")
    d = F.levenshtein("word", "after", 1)
    return w.groupBy("split", F.when(d < 0, F.lit(2)).otherwise(d).alias("edit_class")).agg(F.count("*").alias("n"), _r(F.avg(similarity.edit_similarity(F.col("word"), F.col("after")))).alias("similarity"))


def lcs_classes(spark, sf_dir):
    """STR-03: adjacent words by the longest common subsequence."""
    w = _line_words(spark, sf_dir).withColumn("after", F.lead("word").over(Window.partitionBy("line_id").orderBy("pos"))).where("after IS NOT NULL")
    pairs = w.groupBy("word", "after").agg(F.count("*").alias("n"))  # each distinct pair once
    s = pairs.withColumn("s", similarity.lcs_similarity("word", "after"))
    return s.groupBy(F.floor(F.col("s") * 10).cast("long").alias("tenth")).agg(F.count("*").alias("pairs"), F.sum("n").alias("n"))


def exact_tails(spark, sf_dir):
    """VER-01: exact tails of a sign's count in labels over strata, by convolved hypergeometric distributions."""
    s = _strata(spark, sf_dir).select("unit", "a", (F.col("a") + F.col("b")).alias("m1"), (F.col("a") + F.col("c")).alias("k"), "n")

    def tails(rows: pd.DataFrame) -> pd.DataFrame:
        low, high = similarity.hypergeometric_tail(rows)
        return pd.DataFrame({"unit": [rows["unit"].iloc[0]], "strata": [len(rows)], "lower": [round(low, 6)], "upper": [round(high, 6)]})

    return s.groupBy("unit").applyInPandas(tails, "unit STRING, strata LONG, lower DOUBLE, upper DOUBLE")


def affix_similarity(spark, sf_dir):
    """VER-07: shared beginnings and shared ends of adjacent words, alone and together in relation to the longer word."""
    w = _line_words(spark, sf_dir).withColumn("after", F.lead("word").over(Window.partitionBy("line_id").orderBy("pos"))).where("after IS NOT NULL")
    start, end = similarity.shared_prefix(F.col("word"), F.col("after")), similarity.shared_prefix(F.reverse("word"), F.reverse("after"))
    longest = F.greatest(F.length("word"), F.length("after"))
    both = F.least(start + end, F.least(F.length("word"), F.length("after")))
    return w.groupBy("split", start.cast("long").alias("prefix"), end.cast("long").alias("suffix")).agg(F.count("*").alias("n"), _r(F.avg(both / longest)).alias("affixes"))


def circular_gaps(spark, sf_dir):
    """VER-08: equal words of a line by their circular distance."""
    w = _line_words(spark, sf_dir).select("line_id", "pos", "word")
    n = w.groupBy("line_id").agg(F.count("*").alias("size"))
    p = w.join(w.select("line_id", "word", F.col("pos").alias("q")), ["line_id", "word"]).where("pos < q").join(n, "line_id")
    return p.groupBy(F.least(F.col("q") - F.col("pos"), F.col("size") - (F.col("q") - F.col("pos"))).cast("long").alias("gap")).agg(F.count("*").alias("n"))


def binomial_tails(spark, sf_dir):
    """VER-10: hands whose share of lines beginning with q is more than overall, by binomial tails."""
    l = base.lines(spark, sf_dir).where("hand IS NOT NULL AND size(words) > 0").withColumn("q", F.element_at("words", 1).startswith("q").cast("int"))
    t = l.agg(F.avg("q").alias("p"))
    g = l.groupBy("hand").agg(F.sum("q").alias("k"), F.count("*").alias("n"))
    return g.join(F.broadcast(t)).select("hand", "k", "n", _r(similarity.binomial_upper("k", "n", "p")).alias("upper"))  # t is a single row


def estimators(spark, sf_dir):
    """VER-12: the pooled log odds uncorrected, with a half added to every cell, and with cells moved towards their expectation, side by side."""
    s = _strata(spark, sf_dir).where("a + c < n")
    k = (F.col("a") + F.col("b")) * (F.col("a") + F.col("c")) / F.col("n") * (F.col("c") + F.col("d")) * (F.col("b") + F.col("d")) / F.col("n") / F.pow("n", F.lit(2))
    a, b, c, d, n = (F.col(x) for x in "abcdn")
    ways = [("uncorrected", a * d / n, b * c / n), ("flat", (a + 0.5) * (d + 0.5) / (n + 2), (b + 0.5) * (c + 0.5) / (n + 2))] + [(f"kappa {x}", a * d / n + x * k, b * c / n + x * k) for x in (0.5, 1.0, 2.0)]
    each = s.select("unit", F.explode(F.array(*[F.struct(F.lit(w).alias("estimator"), r.cast("double").alias("r"), q.cast("double").alias("q")) for w, r, q in ways])).alias("e")).select("unit", "e.*")
    g = each.groupBy("unit", "estimator").agg(F.sum("r").alias("r"), F.sum("q").alias("q"))
    return g.select("unit", "estimator", _r(F.when((F.col("r") > 0) & (F.col("q") > 0), F.log(F.col("r") / F.col("q")))).alias("log_or"))


def design_variants(spark, sf_dir):
    """VER-13: sizes of the registers when counted by tokens, by types, by first words and by words that occur once on their page; by length of the words (10: or longer)."""
    w = base.words(spark, sf_dir).withColumn("label", F.col("locus_type").startswith("L")).withColumn("first", F.row_number().over(Window.partitionBy("locus_id").orderBy("pos")) == 1)
    c = w.groupBy("file", "page_id", "label", "word").agg(F.count("*").alias("c"), F.count_if("first").alias("f"))
    return c.groupBy("file", "label", F.least(F.length("word"), F.lit(10)).alias("length")).agg(F.sum("c").alias("tokens"), F.count("*").alias("types"), F.sum("f").alias("first"), F.count_if(F.col("c") == 1).alias("once"))


def kept_slots(spark, sf_dir):
    """VER-14, VER-09: places of labels when empty ones keep theirs, beside those when they don't."""
    l = base.loci(spark, sf_dir).where("locus_type LIKE 'L%'").withColumn("full", F.size(corpus.clean_words(F.col("text"))) > 0)
    o = Window.partitionBy("file", "page_id").orderBy("number", "locus_id")
    k = l.withColumn("slot", F.row_number().over(o)).withColumn("closed", F.sum(F.coalesce(F.col("full"), F.lit(False)).cast("long")).over(o)).where("full")
    return k.groupBy("file").agg(F.count("*").alias("labels"), F.count_if(F.col("slot") != F.col("closed")).alias("shifted"), F.max(F.col("slot") - F.col("closed")).alias("most"))


QUERIES = {
    "gen01_known_text": known_text,
    "gen02_syllable_words": syllable_words,
    "gen02_random_words": random_words,
    "gen03_generated": generated,
    "gen05_layers": layers,
    "gen06_ciphers": ciphers,
    "gen07_numeral_rings": numeral_rings,
    "itr01_clusters": clusters,
    "itr02_merges": merges,
    "itr03_backoff": backoff,
    "itr04_inventories": inventories,
    "str01_edit_classes": edit_classes,
    "str03_lcs_classes": lcs_classes,
    "ver01_exact_tails": exact_tails,
    "ver07_affix_similarity": affix_similarity,
    "ver08_circular_gaps": circular_gaps,
    "ver10_binomial_tails": binomial_tails,
    "ver12_estimators": estimators,
    "ver13_design_variants": design_variants,
    "ver14_kept_slots": kept_slots,
}

_AFTER = f"WITH {base.LINE_WORDS}, a AS (SELECT split, line_id, word, lead(word) OVER (PARTITION BY line_id ORDER BY pos) AS after FROM lw"


def _pick(parts: tuple[str, ...], u: str) -> str:
    import numpy as np

    weights = 1 / np.arange(1, len(parts) + 1)
    ends = np.cumsum(weights) / weights.sum()
    return "CASE " + " ".join(f"WHEN {u} < {float(e)!r}::DOUBLE THEN '{p}'" for p, e in zip(parts[:-1], ends)) + f" ELSE '{parts[-1]}' END"


def _u(*parts: str) -> str:
    return f"(CAST('0x' || substr(sha256(concat_ws('|', {', '.join(parts)})), 1, 8) AS BIGINT) / 4294967296.0)"


_SYLLABLES = " || ".join(_pick(p, _u("'syllables'", f"'{k}{n}'", "id")) for k in range(2) for n, p in (("onset", generate.ONSETS), ("nucleus", generate.NUCLEI), ("coda", generate.CODAS)))
_PLAIN = " ".join(generate.SENTENCES).split()
_G = "|".join(corpus.GALLOWS)
_RING = list(generate.SYSTEMS.items())

SQL = {
    "gen01_known_text": f"WITH t AS (SELECT unnest(generate_series(0, {FIXED - 1})) AS pos) SELECT {_PLAIN!r}[pos % {len(_PLAIN)} + 1] AS word, count(*) AS n, min(pos) AS first FROM t GROUP BY 1",
    "gen02_syllable_words": f"WITH t AS (SELECT unnest(generate_series(0, {FIXED - 1})) AS id), w AS (SELECT {_SYLLABLES} AS word FROM t) SELECT length(word) AS length, count(*) AS n, count(DISTINCT word) AS types FROM w GROUP BY 1",
    "gen02_random_words": f"WITH t AS (SELECT unnest(generate_series(0, {FIXED - 1})) AS id) SELECT CAST([3, 4, 5, 6][CAST(floor({_u(chr(39) + 'm0' + chr(39), chr(39) + 'length' + chr(39), 'id')} * 4) AS BIGINT) + 1] AS BIGINT) AS length, count(*) AS n FROM t GROUP BY 1",
    "gen05_layers": f"""WITH {base.WORDS}, c AS (SELECT word, count(*) AS n FROM w GROUP BY word), p AS (SELECT n, regexp_extract(word, '^(.*?)({_G})(.*)$', 1) AS l, regexp_extract(word, '^(.*?)({_G})(.*)$', 2) AS core, regexp_extract(word, '^(.*?)({_G})(.*)$', 3) AS r FROM c)
SELECT core, count(*) AS types, CAST(sum(n) AS BIGINT) AS tokens, count(DISTINCT l) AS lefts, count(DISTINCT r) AS rights FROM p GROUP BY core""",
    "gen06_ciphers": f"""WITH w AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents WHERE lang = 'en') GROUP BY word),
l AS (SELECT letter, row_number() OVER (ORDER BY sum(n) DESC, letter) - 1 AS k FROM (SELECT unnest(regexp_extract_all(word, '.')) AS letter, n FROM w) GROUP BY letter),
x AS (SELECT unnest(['signs', 'groups', 'homophones', 'affixes', 'abbreviated', 'abbreviated_homophones']) AS kind),
a AS (SELECT word, n, kind, CASE WHEN kind LIKE 'abbr%' THEN substr(word, 1, 1) || regexp_replace(substr(word, 2), '[aeiou]', '', 'g') ELSE word END AS plain FROM w, x),
s AS (SELECT word, n, kind, plain, unnest(generate_series(1, length(plain))) AS i, unnest(regexp_extract_all(plain, '.')) AS letter FROM a),
u AS (SELECT *, CASE WHEN kind LIKE '%homophones' THEN CAST('0x' || substr(sha256(concat_ws('|', 'homophone', plain, i - 1)), 1, 8) AS BIGINT) / 4294967296.0 END AS u FROM s JOIN l USING (letter)),
c AS (SELECT kind, word, n, string_agg(CASE WHEN kind = 'signs' OR kind = 'affixes' AND i > 1 AND i < length(plain) THEN substr('{SIGNS}', k + 1, 1)
  WHEN kind = 'affixes' AND i = 1 THEN {list(LEFT)}[k % {len(LEFT)} + 1] WHEN kind = 'affixes' THEN {list(RIGHT)}[k % {len(RIGHT)} + 1]
  ELSE {list(GROUPS)}[(k + CASE WHEN u IS NULL OR u < 3/6::DOUBLE THEN 0 WHEN u < 5/6::DOUBLE THEN 26 ELSE 52 END) % {len(GROUPS)} + 1] END, '' ORDER BY i) AS cipher FROM u GROUP BY ALL)
SELECT kind, CAST(sum(n) AS BIGINT) AS tokens, count(DISTINCT cipher) AS types, CAST(sum(length(cipher) * n) AS BIGINT) AS signs FROM c GROUP BY kind""",
    "gen07_numeral_rings": "WITH r(system, n, word) AS (VALUES " + ", ".join(f"('{s}', {n}, '{f(n)}')" for s, f in _RING for n in range(1, 31)) + "), k AS (SELECT system, CASE WHEN n <= 10 THEN 0 WHEN n <= 25 THEN 1 ELSE 2 END AS ring, word FROM r) SELECT system, ring, count(*) AS n, CAST(sum(length(word)) AS BIGINT) AS signs FROM k GROUP BY ALL",
    "itr03_backoff": f"""WITH {base.LINE_WORDS}, a AS (SELECT currier, lag(word, 2, '<BOS>') OVER o AS second, lag(word, 1, '<BOS>') OVER o AS before, word FROM lw WHERE split = 'discovery' AND currier IS NOT NULL WINDOW o AS (PARTITION BY line_id ORDER BY pos)),
c2 AS (SELECT currier, second, before, word, count(*) AS c2 FROM a GROUP BY ALL), c1 AS (SELECT currier, before, word, count(*) AS c1 FROM a GROUP BY ALL), c0 AS (SELECT currier, word, count(*) AS c0 FROM a GROUP BY ALL),
t AS (SELECT currier, count(*) AS t, count(DISTINCT word) AS v FROM a GROUP BY ALL), n2 AS (SELECT currier, second, before, count(*) AS n2 FROM a GROUP BY ALL), n1 AS (SELECT currier, before, count(*) AS n1 FROM a GROUP BY ALL),
p AS (SELECT *, (2 * c0 + 1) / (2 * t + v) AS p0 FROM c2 JOIN c1 USING (currier, before, word) JOIN c0 USING (currier, word) JOIN t USING (currier) JOIN n1 USING (currier, before) JOIN n2 USING (currier, second, before))
SELECT currier, second, before, word, round(p0, 9) AS p0, round((c1 + p0) / (n1 + 1), 9) AS p1, round((c2 + (c1 + p0) / (n1 + 1)) / (n2 + 1), 9) AS p2 FROM p""",
    "itr04_inventories": f"""WITH {base.LINE_WORDS}, w AS (SELECT DISTINCT split, word FROM lw WHERE regexp_full_match(word, '[a-z]{{3,}}')), tr AS (SELECT DISTINCT word FROM w WHERE split = 'discovery'),
te AS (SELECT DISTINCT word FROM w WHERE split IN ('validation', 'holdout') AND word NOT IN (SELECT word FROM tr)),
s AS (SELECT substr(word, 1, 1) AS p, substr(word, -1) AS s, count(*) AS n, count(*) FILTER (WHERE substr(word, 2, length(word) - 2) IN (SELECT word FROM tr)) AS h FROM te GROUP BY ALL),
i AS (SELECT a.p, a.s AS s1, b.s AS s2, a.n + b.n AS n, a.h + b.h AS hits FROM s a JOIN s b ON a.p = b.p AND a.s < b.s)
SELECT *, rank() OVER (ORDER BY hits DESC) AS rank, round(1 - cume_dist() OVER (ORDER BY hits DESC), 6) AS percentile FROM i""",
    "str01_edit_classes": f"{_AFTER} WHERE regexp_full_match(word, '[a-z]+')) SELECT split, CAST(least(levenshtein(word, after), 2) AS INTEGER) AS edit_class, count(*) AS n, round(avg(1 - levenshtein(word, after) / greatest(length(word), length(after))), 6) AS similarity FROM a WHERE after IS NOT NULL GROUP BY ALL",
    "ver07_affix_similarity": f"{_AFTER}), p AS (SELECT split, word, after, (SELECT count(*) FROM unnest(generate_series(1, least(length(word), length(after)))) AS g(i) WHERE substr(word, 1, i) = substr(after, 1, i)) AS prefix, (SELECT count(*) FROM unnest(generate_series(1, least(length(word), length(after)))) AS g(i) WHERE right(word, i) = right(after, i)) AS suffix FROM a WHERE after IS NOT NULL) SELECT split, prefix, suffix, count(*) AS n, round(avg(least(prefix + suffix, length(word), length(after)) / greatest(length(word), length(after))), 6) AS affixes FROM p GROUP BY ALL",
    "ver08_circular_gaps": f"WITH {base.LINE_WORDS}, a AS (SELECT line_id, pos, word, count(*) OVER (PARTITION BY line_id) AS size FROM lw) SELECT least(y.pos - x.pos, x.size - (y.pos - x.pos)) AS gap, count(*) AS n FROM a x JOIN a y ON x.line_id = y.line_id AND x.word = y.word AND x.pos < y.pos GROUP BY 1",
    "ver10_binomial_tails": f"""WITH {base.LINES}, l AS (SELECT hand, CAST(words[1] LIKE 'q%' AS INTEGER) AS q FROM li WHERE hand IS NOT NULL AND len(words) > 0), t AS (SELECT avg(q) AS p FROM l), g AS (SELECT hand, CAST(sum(q) AS BIGINT) AS k, count(*) AS n FROM l GROUP BY hand),
i AS (SELECT hand, k, n, p, unnest(generate_series(k, n)) AS i FROM g, t)
SELECT hand, k, n, round(CASE WHEN k = 0 OR p >= 1 THEN 1.0::DOUBLE ELSE sum(CASE WHEN p <= 0 THEN 0 ELSE exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(p) + (n - i) * ln(1 - p)) END) END, 6) AS upper FROM i GROUP BY hand, k, n, p""",
    "ver12_estimators": f"""WITH {_STRATA}, x AS (SELECT *, (a + b) * (a + c) / n * (c + d) * (b + d) / n / (n * n) AS k FROM st WHERE a + c < n),
ev AS (SELECT unit, 'uncorrected' AS estimator, a * d / n AS r, b * c / n AS q FROM x UNION ALL SELECT unit, 'flat', (a + 0.5::DOUBLE) * (d + 0.5::DOUBLE) / (n + 2), (b + 0.5::DOUBLE) * (c + 0.5::DOUBLE) / (n + 2) FROM x
      UNION ALL SELECT unit, 'kappa ' || kappa, a * d / n + kappa * k, b * c / n + kappa * k FROM x, (SELECT unnest([0.5, 1.0, 2.0])::DOUBLE AS kappa)),
g AS (SELECT unit, estimator, sum(r) AS r, sum(q) AS q FROM ev GROUP BY ALL) SELECT unit, estimator, round(CASE WHEN r > 0 AND q > 0 THEN ln(r / q) END, 6) AS log_or FROM g""",
    "ver13_design_variants": f"""WITH {base.WORDS}, f AS (SELECT *, row_number() OVER (PARTITION BY locus_id ORDER BY pos) = 1 AS first FROM w), c AS (SELECT file, page_id, locus_type LIKE 'L%' AS label, word, count(*) AS c, count(*) FILTER (WHERE first) AS f FROM f GROUP BY ALL)
SELECT file, label, CAST(least(length(word), 10) AS INTEGER) AS length, CAST(sum(c) AS BIGINT) AS tokens, count(*) AS types, CAST(sum(f) AS BIGINT) AS first, count(*) FILTER (WHERE c = 1) AS once FROM c GROUP BY ALL""",
    "ver14_kept_slots": f"""WITH {base.LOCI}, l AS (SELECT file, page_id, number, locus_id, coalesce(len({base.CLEAN}) > 0, false) AS f FROM loc WHERE locus_type LIKE 'L%'),
k AS (SELECT *, row_number() OVER o AS slot, sum(CAST(f AS BIGINT)) OVER o AS closed FROM l WINDOW o AS (PARTITION BY file, page_id ORDER BY number, locus_id))
SELECT file, count(*) AS labels, count(*) FILTER (WHERE slot <> closed) AS shifted, CAST(max(slot - closed) AS BIGINT) AS most FROM k WHERE f GROUP BY file""",
}
