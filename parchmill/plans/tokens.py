"""Queries on scans, normalisation, tokenising and splits (SRC, NRM, FLT, STR)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parchmill.operators import corpus
from parchmill.plans import base
from parchmill.session import table


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def page_words(spark, sf_dir):
    """SRC-04: words per witness and page, running text only; pages without words are dropped."""
    w = base.words(spark, sf_dir).where("locus_type LIKE 'P%'")
    return w.groupBy("file", "page_id").agg(F.count("*").alias("n"), F.countDistinct("word").alias("types"))


def family_scan(spark, sf_dir):
    """SRC-05: tokens and types of the permissive reading."""
    w = base.loci(spark, sf_dir).select("file", F.explode(corpus.family_words(F.col("text"))).alias("word"))
    return w.groupBy("file").agg(F.count("*").alias("tokens"), F.countDistinct("word").alias("types"))


def label_blocks(spark, sf_dir):
    """SRC-06: blocks of a page; a label after running text starts a new one."""
    order = Window.partitionBy("file", "page_id").orderBy("number", "locus_id")
    kind = base.loci(spark, sf_dir).select("file", "page_id", "number", "locus_id", (F.substring("locus_type", 1, 1) == "L").alias("label"))
    starts = kind.withColumn("before", F.lag("label").over(order)).withColumn("start", (F.col("label") & ~F.coalesce("before", F.lit(False))).cast("long"))
    blocks = starts.withColumn("block", F.sum("start").over(order))
    return blocks.groupBy("file", "page_id", "block").agg(F.count("*").alias("loci"), F.count_if("label").alias("labels"))


def marked_bodies(spark, sf_dir):
    """SRC-07: text between a start and an end marker; the whole text where a marker is missing."""
    body = F.regexp_extract("text", r"(?s)Home \| Manuscripts \| Contact\s*(.*?)\s*Cookie settings", 1)
    return _documents(spark, sf_dir).where("text IS NOT NULL").select("doc_id", F.length(F.when(body != "", body).otherwise(F.col("text"))).cast("long").alias("chars"), (body != "").alias("marked"))


def untagged_words(spark, sf_dir):
    """SRC-08: tags stripped, then words of letters; distinct words of 3 to 12 letters per language."""
    w = _documents(spark, sf_dir).select("lang", F.explode(corpus.latin_words(F.regexp_replace("text", "<[^<>]*>", " "), 3)).alias("word"))
    return w.where("length(word) <= 12").groupBy("lang").agg(F.countDistinct("word").alias("types"), F.count("*").alias("tokens"))


def _text_lines(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("line", "content"))


def entries(spark, sf_dir):
    """SRC-09: entries of a text between heading lines, with at least 30 words."""
    order = Window.partitionBy("doc_id").orderBy("line")
    lines = _text_lines(spark, sf_dir).withColumn("heading", F.col("content").rlike(r"^\s*(Section|Table) [0-9]+").cast("long"))
    numbered = lines.withColumn("entry", F.sum("heading").over(order)).withColumn("n", F.size(corpus.latin_words(F.col("content"))).cast("long"))
    return numbered.groupBy("doc_id", "entry").agg(F.sum("n").alias("n")).where("n >= 30")


def chunks(spark, sf_dir, size: int = 155):
    """SRC-10: chunks of a fixed number of words; the rest of a text is dropped."""
    w = _documents(spark, sf_dir).select("doc_id", F.posexplode(corpus.latin_words(F.col("text"))).alias("pos", "word"))
    return w.groupBy("doc_id", F.floor(F.col("pos") / size).alias("chunk")).agg(F.count("*").alias("n"), F.countDistinct("word").alias("types")).where(F.col("n") == size)


def quoted_lines(spark, sf_dir):
    """SRC-11: lines outside of quoted or listed passages; the state of the last marker line holds until an empty line."""
    order = Window.partitionBy("doc_id").orderBy("line")
    marker = F.when(F.col("content").rlike(r"^\s*([>@]|- )"), F.lit(True)).when(F.col("content").rlike(r"^\s*$"), F.lit(False))
    state = _text_lines(spark, sf_dir).withColumn("inside", F.coalesce(F.last(marker, ignorenulls=True).over(order), F.lit(False)))
    return state.where("NOT inside AND trim(content) <> ''").groupBy("doc_id").agg(F.count("*").alias("lines"))


def last_wins(spark, sf_dir):
    """SRC-12: of several rows for a code the last one stands."""
    p = table(spark, sf_dir, "zg_positions").where("zl_source IS NOT NULL AND gc_source IS NOT NULL AND zl_source <> '' AND gc_source <> ''")
    return p.groupBy("zl_source").agg(F.max(F.struct("loaded_at", "position_index", "gc_source")).alias("r"), F.count("*").alias("rows")).select("zl_source", F.col("r.gc_source").alias("gc_source"), "rows")


def json_fields(spark, sf_dir):
    """SRC-13: a member of a JSON column by an explicit schema."""
    k = F.from_json("props", "k BIGINT")["k"]
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k).alias("k"), F.count(k).alias("with_k"), F.count("*").alias("n"))


def pinned_texts(spark, sf_dir):
    """SRC-15, STR-07: digest and byte length of every text, as a manifest pins them."""
    return _documents(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"))


def policies(spark, sf_dir):
    """NRM-01: components kept and excluded under each space policy."""
    loci = base.loci(spark, sf_dir)
    stacked = [loci.select(F.lit(p).alias("policy"), F.size(corpus.policy_parts(F.col("text"), p)).cast("long").alias("parts"), F.size(corpus.policy_words(F.col("text"), p)).cast("long").alias("kept")) for p in corpus.POLICIES]
    return stacked[0].unionAll(stacked[1]).unionAll(stacked[2]).groupBy("policy").agg(F.sum("kept").alias("kept"), (F.sum("parts") - F.sum("kept")).alias("excluded"))


def views(spark, sf_dir):
    """NRM-02: lengths of the lines under each view of doubtful spaces."""
    loci = base.loci(spark, sf_dir)
    return loci.groupBy("file").agg(*[F.sum(F.length(corpus.view_text(F.col("text"), s)).cast("long")).alias(s) for s in ("boundary", "join", "retain")])


def exclusion_reasons(spark, sf_dir):
    """NRM-03: components by the reason that excludes them."""
    c = base.loci(spark, sf_dir).select("file", F.explode(corpus.components(F.col("text"))).alias("c"))
    return c.groupBy("file", F.coalesce("c.reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"), F.countDistinct("c.source").alias("types"))


def clean_tokens(spark, sf_dir):
    """NRM-04: clean words with their places."""
    return base.words(spark, sf_dir).select("locus_id", "pos", "word")


def code_families(spark, sf_dir):
    """NRM-05: families from codes against the delivered ones."""
    p = table(spark, sf_dir, "zg_positions").select(F.trim("zl_source").alias("source"), F.trim("zl_family").alias("family"))
    found = p.withColumn("found", corpus.code_family(F.col("source")))
    return found.groupBy(F.length("found").cast("long").alias("signs")).agg(F.count("*").alias("n"), F.count_if(F.col("found").eqNullSafe(F.col("family"))).alias("agree"))


def letter_words(spark, sf_dir):
    """NRM-06: words of letters per language."""
    w = _documents(spark, sf_dir).select("lang", F.explode(corpus.latin_words(F.col("text"), 2)).alias("word"))
    return w.groupBy("lang").agg(F.count("*").alias("tokens"), F.countDistinct("word").alias("types"), F.sum(F.length("word").cast("long")).alias("letters"))


def units(spark, sf_dir):
    """NRM-07: glyph units by longest match."""
    u = base.words(spark, sf_dir).select(F.explode(corpus.glyph_units(F.col("word"))).alias("unit"))
    return u.groupBy("unit").agg(F.count("*").alias("n"))


def joined_symbols(spark, sf_dir):
    """NRM-08: symbols of the lines joined with one space."""
    s = base.loci(spark, sf_dir).select("file", F.array_join(corpus.clean_words(F.col("text")), " ").alias("line")).where("line <> ''")
    return s.select("file", F.explode(F.split("line", "")).alias("symbol")).where("symbol <> ''").groupBy("file", "symbol").agg(F.count("*").alias("n"))


def name_tokens(spark, sf_dir):
    """NRM-09: name words of the item kinds: parentheses dropped, four letters or more, a plural s trimmed."""
    t = F.lower(F.regexp_replace("text", r"\([^)]*\)", ""))
    w = table(spark, sf_dir, "heldout_items").select("suite", F.explode(F.regexp_extract_all(t, F.lit("[a-z]+"), F.lit(0))).alias("w")).where("length(w) >= 4 AND NOT w RLIKE '^[ivxlcdm]+$'")
    trimmed = F.when((F.length("w") > 4) & F.col("w").endswith("s"), F.expr("substring(w, 1, length(w) - 1)")).otherwise(F.col("w"))
    return w.groupBy("suite", trimmed.alias("name")).agg(F.count("*").alias("n"))


def gallows(spark, sf_dir):
    """NRM-10: leading signs and the words left without them."""
    w = base.words(spark, sf_dir)
    lead = corpus.gallows_prefix(F.col("word"))
    return w.groupBy(lead.alias("lead")).agg(F.count("*").alias("n"), F.countDistinct(F.expr(f"regexp_replace(word, '^({'|'.join(corpus.GALLOWS)})', '')")).alias("rests"))


def line_reasons(spark, sf_dir):
    """NRM-12: lines by the sorted set of reasons against them."""
    reasons = F.array_sort(F.array_distinct(F.filter(F.transform(corpus.components(F.col("text")), lambda c: c["reason"]), lambda r: r.isNotNull())))
    return base.loci(spark, sf_dir).where("text IS NOT NULL").groupBy(F.array_join(reasons, ",").alias("reasons")).agg(F.count("*").alias("lines"))


def truncated(spark, sf_dir, n: int = 500):
    """NRM-13: the first n words of each corpus over its pages in order."""
    order = Window.partitionBy("corpus_id").orderBy("page_ord", "lop_id").rowsBetween(Window.unboundedPreceding, -1)
    p = base.pages(spark, sf_dir).withColumn("n", F.size("words").cast("long")).withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0).cast("long")))
    return p.where(F.col("before") < n).select("corpus_id", "lop_id", F.least("n", F.lit(n).cast("long") - F.col("before")).alias("taken"))


def hash_split(spark, sf_dir):
    """FLT-01: pages held out by the first byte of a hash, in two and in three parts."""
    p = base.loci(spark, sf_dir).select("page_id").distinct()
    b = corpus.hash_byte(F.col("page_id"), "v1")
    three = F.when(b < 154, "train").when(b < 205, "tune").otherwise("test")
    return p.select("page_id", (b < 51).alias("held_out"), three.alias("part"))


def alternate_pages(spark, sf_dir):
    """FLT-02: pages of a corpus in order, every second one for fitting; stratum by page side."""
    order = Window.partitionBy("corpus_id").orderBy("page_ord", "lop_id")
    p = base.pages(spark, sf_dir).withColumn("k", F.row_number().over(order) - 1)
    return p.groupBy("corpus_id", (F.col("k") % 2 == 0).alias("fit")).agg(F.count("*").alias("pages"), F.sum(F.size("words").cast("long")).alias("tokens"), F.count_if(F.col("page_id").endswith("r")).alias("recto"))


def registers(spark, sf_dir):
    """FLT-03: label words and running words of pages that have both."""
    w = base.words(spark, sf_dir)
    label = F.col("locus_type").startswith("L")
    return w.groupBy("file", "page_id").agg(F.count_if(label).alias("labels"), F.count_if(~label).alias("running")).where("labels > 0 AND running > 0")


def single_valued(spark, sf_dir):
    """FLT-04: pages whose hand is known and the same on all lines."""
    return base.loci(spark, sf_dir).groupBy("file", "page_id").agg(F.countDistinct("var_h").alias("hands"), F.min("var_h").alias("hand"), F.count("*").alias("loci"), F.count("var_h").alias("known")).where("hands = 1 AND known = loci AND hand IN ('1', '2', '3', '4', '5')").select("file", "page_id", "hand", "loci")


def admission(spark, sf_dir):
    """FLT-05: every place of two witnesses; a place is admitted if both have a line without reasons against it."""
    l = base.loci(spark, sf_dir).withColumn("bad", F.exists(corpus.components(F.col("text")), lambda c: c["reason"].isNotNull()) | F.col("text").isNull())
    one, two = (l.where(F.col("file") == f).select("page_id", "number", F.col("bad").alias(n)) for f, n in (("zed_eva.ivtff", "bad_a"), ("gel_eva.ivtff", "bad_b")))
    both = one.join(two, ["page_id", "number"], "full")
    status = F.when(F.col("bad_b").isNull(), "first_only").when(F.col("bad_a").isNull(), "second_only").when(F.col("bad_a") | F.col("bad_b"), "excluded").otherwise("admitted")
    return both.groupBy(status.alias("status")).agg(F.count("*").alias("places"))


def gates(spark, sf_dir):
    """FLT-07: named conditions on the inventory and their conjunction."""
    inv = base.lines(spark, sf_dir).agg(F.count("*").alias("lines"), F.countDistinct("folio").alias("folios"), F.sum(F.size("words").cast("long")).alias("tokens"), F.count_if(F.col("split").isNull()).alias("unsplit"))
    return inv.select("lines", "folios", "tokens", (F.col("lines") >= 100).alias("enough_lines"), (F.col("folios") >= 10).alias("enough_folios"), (F.col("unsplit") * 50 <= F.col("lines")).alias("few_unsplit"), ((F.col("lines") >= 100) & (F.col("folios") >= 10) & (F.col("unsplit") * 50 <= F.col("lines"))).alias("passed"))


def patterns(spark, sf_dir):
    """FLT-09: texts by pattern predicates (links, file paths, addresses, control characters)."""
    d = _documents(spark, sf_dir)
    rules = {"links": r"https?://", "mentions": r"(^|\s)@[a-z_]+[0-9]*", "tags": r"<[a-z]+>", "folios": r"\bf[0-9]+[rv][0-9]?\b", "controls": r"[\x{00}-\x{08}\x{0e}-\x{1f}]"}
    return d.groupBy("source").agg(*[F.count_if(F.col("text").rlike(p)).alias(n) for n, p in rules.items()])


#: Signs by density, which rises and then falls in a well-formed word; all other signs are passed over.
DENSITY = {
    "3": ("t", "p", "k", "f", "cth", "cph", "ckh", "cfh"),
    "2": ("ch", "sh", "ee"),
    "1": ("d", "l", "r", "s", "n", "x", "i", "m", "g"),
}


def unimodal(spark, sf_dir):
    """STR-04: words whose sequence of densities rises and then falls."""
    w = base.words(spark, sf_dir).groupBy("word").agg(F.count("*").alias("n"))
    pools = {d: "|".join(sorted(signs, key=len, reverse=True)) for d, signs in DENSITY.items()}
    found = F.regexp_extract_all("word", F.lit("|".join(pools.values())), F.lit(0))
    density = lambda s: F.coalesce(*[F.when(s.rlike(f"^({p})$"), F.lit(d)) for d, p in pools.items()])
    digits = F.array_join(F.transform(found, density), "")
    return w.groupBy(digits.rlike("^1*2*3*2*1*$").alias("unimodal")).agg(F.count("*").alias("types"), F.sum("n").alias("tokens"))


#: The signs that others are made of, and the parts of each composed sign under two models.
PRIMITIVES = "acehilosy"
PAIR = {"d": "ey", "f": "id", "g": "cd", "k": "il", "m": "id", "n": "i", "p": "qd", "q": "ie", "r": "si", "t": "ql"}
MODELS = {"PAIR": PAIR, "OPTIONAL_E": {**PAIR, "f": "ide", "p": "qde"}}


def expanded(sign: str, parts: dict[str, str], above: tuple = ()) -> str:
    """A sign as primitives; unknown signs and signs that contain themselves are refused."""
    if sign in PRIMITIVES:
        return sign
    if sign in above or sign not in parts:
        raise ValueError(f"{sign} contains itself" if sign in above else f"{sign} is no known sign")
    return "".join(expanded(p, parts, (*above, sign)) for p in parts[sign])


def sign_counts(spark, sf_dir):
    """STR-05: lines by the remainder of three of their primitives, under each model; lines with signs outside of the inventory are counted apart."""
    known = "".join(sorted({*PRIMITIVES, *PAIR}))
    lines = base.words(spark, sf_dir).groupBy("locus_id").agg(F.array_join(F.array_sort(F.collect_list("word")), "").alias("signs"))
    fine = F.col("signs").rlike(f"^[{known}]*$")
    total = lambda parts: sum((F.lit(len(expanded(x, parts))) * (F.length("signs") - F.length(F.replace("signs", F.lit(x), F.lit("")))) for x in known), F.lit(0))
    each = lines.select(F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.when(fine, total(p) % 3).alias("residue")) for m, p in MODELS.items()])).alias("m")).select("m.*")
    return each.groupBy("model", "residue").agg(F.count("*").alias("n"))


def split_classes(spark, sf_dir):
    """STR-06: words that are a known word, or one with a known beginning and a known rest, once or in several ways."""
    w = base.lines(spark, sf_dir).select(F.explode("words").alias("word")).where("length(word) >= 2 AND word RLIKE '^[a-z]+$'").groupBy("word").agg(F.count("*").alias("n"))
    known = w.where("n >= 3").select(F.col("word").alias("part"))
    cuts = w.select("word", F.explode(F.expr("transform(sequence(1, length(word) - 1), i -> struct(substring(word, 1, i) AS head, substring(word, i + 1) AS tail))")).alias("c")).select("word", "c.head", "c.tail")
    ways = cuts.join(known.withColumnRenamed("part", "head"), "head").join(known.withColumnRenamed("part", "tail"), "tail").groupBy("word").agg(F.count("*").alias("ways"))
    kind = F.when(F.col("n") >= 3, "known").when(F.col("ways") == 1, "unique").when(F.col("ways") > 1, "ambiguous").otherwise("none")
    return w.join(ways, "word", "left").groupBy(kind.alias("kind")).agg(F.count("*").alias("types"), F.sum("n").alias("tokens"))


def folios(spark, sf_dir):
    """STR-08: leaf of a page id; ids of another form are counted apart."""
    leaf = F.regexp_extract("page_id", r"^(f[0-9]+)[rv][0-9]*$", 1)
    return base.loci(spark, sf_dir).groupBy(F.when(leaf != "", leaf).alias("folio")).agg(F.countDistinct("page_id").alias("pages"), F.count("*").alias("loci"))


QUERIES = {
    "src04_page_words": page_words,
    "src05_family_scan": family_scan,
    "src06_label_blocks": label_blocks,
    "src07_marked_bodies": marked_bodies,
    "src08_untagged_words": untagged_words,
    "src09_entries": entries,
    "src10_chunks": chunks,
    "src11_quoted_lines": quoted_lines,
    "src12_last_wins": last_wins,
    "src13_json_fields": json_fields,
    "src15_pinned_texts": pinned_texts,
    "nrm01_policies": policies,
    "nrm02_views": views,
    "nrm03_exclusion_reasons": exclusion_reasons,
    "nrm04_clean_tokens": clean_tokens,
    "nrm05_code_families": code_families,
    "nrm06_letter_words": letter_words,
    "nrm07_units": units,
    "nrm08_joined_symbols": joined_symbols,
    "nrm09_name_tokens": name_tokens,
    "nrm10_gallows": gallows,
    "nrm12_line_reasons": line_reasons,
    "nrm13_truncated": truncated,
    "flt01_hash_split": hash_split,
    "flt02_alternate_pages": alternate_pages,
    "flt03_registers": registers,
    "flt04_single_valued": single_valued,
    "flt05_admission": admission,
    "flt07_gates": gates,
    "flt09_patterns": patterns,
    "str04_unimodal": unimodal,
    "str05_sign_counts": sign_counts,
    "str06_split_classes": split_classes,
    "str08_folios": folios,
}


def _replaced(c: str, *steps: tuple[str, str]) -> str:
    for p, by in steps:
        c = "regexp_replace({}, '{}', '{}', 'g')".format(c, p.replace("'", "''"), by.replace("'", "''"))
    return c


_LETTERS = r"list_filter(list_transform(regexp_extract_all(lower(replace({t}, '’', '''')), '[\p{{L}}'']+'), lambda w: replace(w, '''', '')), lambda w: length(w) >= {n})"
_BARE = _replaced("text", ("<[-~]>", "."), ("<[^>]*>", ""))
_FLAT = f"list_reduce(list_prepend({_BARE}, list_transform(generate_series(0, length({_BARE}) - length(replace({_BARE}, '{{', ''))), lambda i: '')), lambda a, b: regexp_replace(a, '\\{{([^{{}}]*)\\}}', '\\1', 'g'))"
_PARTS = f"list_filter(string_split_regex(regexp_replace({_FLAT}, '\\s+', '', 'g'), '\\.'), lambda w: w <> '')"
def _reason(w: str) -> str:
    return "CASE " + " ".join("WHEN regexp_matches({}, '{}') THEN '{}'".format(w, p.replace("'", "''"), n) for n, p in corpus.REASONS) + " END"


_LINES_OF = r"SELECT doc_id, CAST(unnest(generate_series(0, len(ls) - 1)) AS INTEGER) AS line, unnest(ls) AS content FROM (SELECT doc_id, string_split_regex(text, '\r\n|\n|\r') AS ls FROM documents WHERE text IS NOT NULL)"


def _policy_sql(policy: str) -> str:
    comma, alternative = corpus.POLICIES[policy]
    bare = _replaced("text", ("<->", "."), (r"<[^>]*>", ""), (r"\[([^:\]]*):[^\]]*\]", alternative.replace("$", "\\")), (r"[{}]", ""), (",", comma), (r"\s+", ""))
    parts = f"list_filter(string_split_regex({bare}, '\\.'), lambda w: w <> '')"
    kept = f"list_filter({parts}, lambda w: regexp_full_match(w, '(@(12[89]|1[3-9][0-9]|2[0-4][0-9]|25[0-5]);|[A-Za-z''])+'))"
    return f"SELECT '{policy}' AS policy, CAST(coalesce(sum(len({kept})), 0) AS BIGINT) AS kept, CAST(sum(len({parts})) - sum(len({kept})) AS BIGINT) AS excluded FROM loc"


def _view_sql(space: str) -> str:
    c = _replaced("text", (r"<[^>]*>", ""), (r"\[([^:\]]*):[^\]]*\]", r"\1"), (r"\{([^{}]*)\}", r"\1"))
    return {"boundary": f"replace({c}, ',', '.')", "join": f"replace({c}, ',', '')", "retain": c}[space]


_GALLOWS = "|".join(corpus.GALLOWS)
_DIGITS = _replaced("word", *[("|".join(sorted(s, key=len, reverse=True)), d) for d, s in DENSITY.items()], ("[^123]", ""))

SQL = {
    "src04_page_words": f"WITH {base.WORDS} SELECT file, page_id, count(*) AS n, count(DISTINCT word) AS types FROM w WHERE locus_type LIKE 'P%' GROUP BY ALL",
    "src05_family_scan": f"WITH {base.LOCI}, t AS (SELECT file, unnest(list_filter(string_split_regex({_replaced('text', ('<![^>]*>', ''), ('{[^}]*}', ''), (chr(91) + '@,;!?' + chr(39) + chr(34) + '<>0-9]', ''))}, '[.\\s]+'), lambda x: x <> '')) AS word FROM loc) SELECT file, count(*) AS tokens, count(DISTINCT word) AS types FROM t GROUP BY file",
    "src06_label_blocks": f"""WITH {base.LOCI}, k AS (SELECT file, page_id, number, locus_id, substr(locus_type, 1, 1) = 'L' AS label FROM loc),
s AS (SELECT *, CAST(label AND NOT coalesce(lag(label) OVER o, false) AS BIGINT) AS start FROM k WINDOW o AS (PARTITION BY file, page_id ORDER BY number, locus_id)),
b AS (SELECT *, CAST(sum(start) OVER (PARTITION BY file, page_id ORDER BY number, locus_id) AS BIGINT) AS block FROM s)
SELECT file, page_id, block, count(*) AS loci, count(*) FILTER (WHERE label) AS labels FROM b GROUP BY ALL""",
    "src07_marked_bodies": r"""WITH b AS (SELECT doc_id, text, regexp_extract(text, '(?s)Home \| Manuscripts \| Contact\s*(.*?)\s*Cookie settings', 1) AS body FROM documents WHERE text IS NOT NULL)
SELECT doc_id, length(CASE WHEN body <> '' THEN body ELSE text END) AS chars, body <> '' AS marked FROM b""",
    "src08_untagged_words": f"WITH w AS (SELECT lang, unnest({_LETTERS.format(t=_replaced('text', ('<[^<>]*>', ' ')), n=3)}) AS word FROM documents) SELECT lang, count(DISTINCT word) AS types, count(*) AS tokens FROM w WHERE length(word) <= 12 GROUP BY lang",
    "src09_entries": f"""WITH l AS ({_LINES_OF}),
e AS (SELECT doc_id, CAST(sum(CAST(regexp_matches(content, '^\\s*(Section|Table) [0-9]+') AS BIGINT)) OVER (PARTITION BY doc_id ORDER BY line) AS BIGINT) AS entry, len({_LETTERS.format(t='content', n=1)}) AS n FROM l)
SELECT doc_id, entry, CAST(sum(n) AS BIGINT) AS n FROM e GROUP BY ALL HAVING sum(n) >= 30""",
    "src10_chunks": f"""WITH d AS (SELECT doc_id, {_LETTERS.format(t='text', n=1)} AS ws FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, unnest(generate_series(0, len(ws) - 1)) // 155 AS chunk, unnest(ws) AS word FROM d)
SELECT doc_id, chunk, count(*) AS n, count(DISTINCT word) AS types FROM w GROUP BY ALL HAVING count(*) = 155""",
    "src11_quoted_lines": f"""WITH l AS ({_LINES_OF}),
m AS (SELECT *, CASE WHEN regexp_matches(content, '^\\s*([>@]|- )') THEN true WHEN regexp_matches(content, '^\\s*$') THEN false END AS mark FROM l),
s AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS inside FROM m)
SELECT doc_id, count(*) AS lines FROM s WHERE NOT inside AND trim(content) <> '' GROUP BY doc_id""",
    "src12_last_wins": "SELECT zl_source, max(struct_pack(t := loaded_at, p := position_index, g := gc_source)).g AS gc_source, count(*) AS rows FROM zg_positions WHERE zl_source <> '' AND gc_source <> '' GROUP BY zl_source",
    "src13_json_fields": "SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k, count(json_extract(props, '$.k')) AS with_k, count(*) AS n FROM events GROUP BY event_type",
    "src15_pinned_texts": "SELECT doc_id, sha256(text) AS sha256, CAST(octet_length(encode(text)) AS BIGINT) AS bytes FROM documents",
    "nrm01_policies": f"WITH {base.LOCI} " + " UNION ALL ".join(map(_policy_sql, corpus.POLICIES)),
    "nrm02_views": f"WITH {base.LOCI} SELECT file, " + ", ".join(f"CAST(sum(length({_view_sql(s)})) AS BIGINT) AS {s}" for s in ("boundary", "join", "retain")) + " FROM loc GROUP BY file",
    "nrm03_exclusion_reasons": f"WITH {base.LOCI}, c AS (SELECT file, unnest({_PARTS}) AS p FROM loc) SELECT file, coalesce({_reason('p')}, 'accepted') AS reason, count(*) AS n, count(DISTINCT p) AS types FROM c GROUP BY ALL",
    "nrm04_clean_tokens": f"WITH {base.WORDS} SELECT locus_id, pos, word FROM w",
    "nrm05_code_families": """WITH p AS (SELECT trim(zl_source) AS s, trim(zl_family) AS f FROM zg_positions),
q AS (SELECT f, CASE WHEN regexp_full_match(s, '([A-Z][0-9a-z])+') THEN array_to_string(list_transform(regexp_extract_all(s, '[A-Z][0-9a-z]'), lambda x: substr(x, 1, 1)), '') END AS found FROM p)
SELECT length(found) AS signs, count(*) AS n, count(*) FILTER (WHERE found IS NOT DISTINCT FROM f) AS agree FROM q GROUP BY 1""",
    "nrm06_letter_words": f"WITH w AS (SELECT lang, unnest({_LETTERS.format(t='text', n=2)}) AS word FROM documents) SELECT lang, count(*) AS tokens, count(DISTINCT word) AS types, CAST(sum(length(word)) AS BIGINT) AS letters FROM w GROUP BY lang",
    "nrm07_units": f"WITH {base.WORDS}, u AS (SELECT unnest(regexp_extract_all(word, '{'|'.join(corpus.UNITS)}|.')) AS unit FROM w) SELECT unit, count(*) AS n FROM u GROUP BY unit",
    "nrm08_joined_symbols": f"WITH {base.LOCI}, s AS (SELECT file, unnest(regexp_extract_all(array_to_string({base.CLEAN}, ' '), '.')) AS symbol FROM loc) SELECT file, symbol, count(*) AS n FROM s GROUP BY ALL",
    "nrm09_name_tokens": r"""WITH w AS (SELECT suite, unnest(regexp_extract_all(lower(regexp_replace(text, '\([^)]*\)', '', 'g')), '[a-z]+')) AS w FROM heldout_items)
SELECT suite, CASE WHEN length(w) > 4 AND w LIKE '%s' THEN substr(w, 1, length(w) - 1) ELSE w END AS name, count(*) AS n FROM w WHERE length(w) >= 4 AND NOT regexp_full_match(w, '[ivxlcdm]+') GROUP BY ALL""",
    "nrm10_gallows": f"WITH {base.WORDS} SELECT regexp_extract(word, '^({_GALLOWS})', 1) AS lead, count(*) AS n, count(DISTINCT regexp_replace(word, '^({_GALLOWS})', '')) AS rests FROM w GROUP BY 1",
    "nrm12_line_reasons": f"WITH {base.LOCI}, r AS (SELECT array_to_string(list_sort(list_distinct(list_filter(list_transform({_PARTS}, lambda w: {_reason('w')}), lambda x: x IS NOT NULL))), ',') AS reasons FROM loc WHERE text IS NOT NULL) SELECT reasons, count(*) AS lines FROM r GROUP BY reasons",
    "nrm13_truncated": f"""WITH {base.PAGES}, p AS (SELECT corpus_id, lop_id, len(words) AS n, coalesce(sum(len(words)) OVER (PARTITION BY corpus_id ORDER BY page_ord, lop_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pg)
SELECT corpus_id, lop_id, CAST(least(n, 500 - before) AS BIGINT) AS taken FROM p WHERE before < 500""",
    "flt01_hash_split": f"WITH {base.LOCI}, b AS (SELECT DISTINCT page_id, CAST('0x' || substr(sha256('v1:' || page_id), 1, 2) AS INTEGER) AS b FROM loc) SELECT page_id, b < 51 AS held_out, CASE WHEN b < 154 THEN 'train' WHEN b < 205 THEN 'tune' ELSE 'test' END AS part FROM b",
    "flt02_alternate_pages": f"""WITH {base.PAGES}, p AS (SELECT *, row_number() OVER (PARTITION BY corpus_id ORDER BY page_ord, lop_id) - 1 AS k FROM pg)
SELECT corpus_id, k % 2 = 0 AS fit, count(*) AS pages, CAST(sum(len(words)) AS BIGINT) AS tokens, count(*) FILTER (WHERE page_id LIKE '%r') AS recto FROM p GROUP BY ALL""",
    "flt03_registers": f"WITH {base.WORDS} SELECT file, page_id, count(*) FILTER (WHERE locus_type LIKE 'L%') AS labels, count(*) FILTER (WHERE NOT locus_type LIKE 'L%') AS running FROM w GROUP BY ALL HAVING labels > 0 AND running > 0",
    "flt04_single_valued": f"WITH {base.LOCI} SELECT file, page_id, min(var_h) AS hand, count(*) AS loci FROM loc GROUP BY file, page_id HAVING count(DISTINCT var_h) = 1 AND count(var_h) = count(*) AND min(var_h) IN ('1', '2', '3', '4', '5')",
    "flt05_admission": f"""WITH {base.LOCI}, b AS (SELECT file, page_id, number, text IS NULL OR len(list_filter({_PARTS}, lambda w: {_reason('w')} IS NOT NULL)) > 0 AS bad FROM loc),
j AS (SELECT x.bad AS a, y.bad AS b FROM (SELECT * FROM b WHERE file = 'zed_eva.ivtff') x FULL JOIN (SELECT * FROM b WHERE file = 'gel_eva.ivtff') y ON x.page_id = y.page_id AND x.number = y.number)
SELECT CASE WHEN b IS NULL THEN 'first_only' WHEN a IS NULL THEN 'second_only' WHEN a OR b THEN 'excluded' ELSE 'admitted' END AS status, count(*) AS places FROM j GROUP BY 1""",
    "flt07_gates": f"""WITH {base.LINES}, i AS (SELECT count(*) AS lines, count(DISTINCT folio) AS folios, CAST(sum(len(words)) AS BIGINT) AS tokens, count(*) FILTER (WHERE split IS NULL) AS unsplit FROM li)
SELECT lines, folios, tokens, lines >= 100 AS enough_lines, folios >= 10 AS enough_folios, unsplit * 50 <= lines AS few_unsplit, lines >= 100 AND folios >= 10 AND unsplit * 50 <= lines AS passed FROM i""",
    "flt09_patterns": r"""SELECT source, count(*) FILTER (WHERE regexp_matches(text, 'https?://')) AS links, count(*) FILTER (WHERE regexp_matches(text, '(^|\s)@[a-z_]+[0-9]*')) AS mentions,
count(*) FILTER (WHERE regexp_matches(text, '<[a-z]+>')) AS tags, count(*) FILTER (WHERE regexp_matches(text, '\bf[0-9]+[rv][0-9]?\b')) AS folios, count(*) FILTER (WHERE regexp_matches(text, '[\x00-\x08\x0e-\x1f]')) AS controls FROM documents GROUP BY source""",
    "str04_unimodal": f"WITH {base.WORDS}, c AS (SELECT word, count(*) AS n FROM w GROUP BY word) SELECT regexp_full_match({_DIGITS}, '1*2*3*2*1*') AS unimodal, count(*) AS types, CAST(sum(n) AS BIGINT) AS tokens FROM c GROUP BY 1",
    "str05_sign_counts": f"""WITH RECURSIVE {base.WORDS}, parts(model, sign, place, part) AS (VALUES {', '.join(f"('{m}', '{x}', {i}, '{p}')" for m, t in MODELS.items() for x, ps in t.items() for i, p in enumerate(ps))}),
e(model, sign, part) AS (SELECT model, sign, part FROM parts UNION ALL SELECT e.model, e.sign, p.part FROM e JOIN parts p ON p.sign = e.part AND p.model = e.model),
n AS (SELECT model, sign, count(*) FILTER (WHERE contains('{PRIMITIVES}', part)) AS k FROM e GROUP BY ALL UNION ALL SELECT model, x, 1 FROM (SELECT unnest(['PAIR', 'OPTIONAL_E']) AS model), (SELECT unnest(regexp_extract_all('{PRIMITIVES}', '.')) AS x)),
s AS (SELECT model, locus_id, unnest(regexp_extract_all(word, '.')) AS sign FROM w, (SELECT unnest(['PAIR', 'OPTIONAL_E']) AS model)),
t AS (SELECT model, locus_id, sum(k) AS total, count(*) = count(k) AS fine FROM s LEFT JOIN n USING (model, sign) GROUP BY ALL)
SELECT model, CAST(CASE WHEN fine THEN total % 3 END AS INTEGER) AS residue, count(*) AS n FROM t GROUP BY ALL""",
    "str06_split_classes": f"""WITH {base.LINE_WORDS}, w AS (SELECT word, count(*) AS n FROM lw WHERE length(word) >= 2 AND regexp_full_match(word, '[a-z]+') GROUP BY word),
k AS (SELECT word AS part FROM w WHERE n >= 3),
c AS (SELECT word, substr(word, 1, i) AS head, substr(word, i + 1) AS tail FROM (SELECT word, unnest(generate_series(1, length(word) - 1)) AS i FROM w)),
y AS (SELECT word, count(*) AS ways FROM c JOIN k a ON a.part = head JOIN k b ON b.part = tail GROUP BY word)
SELECT CASE WHEN n >= 3 THEN 'known' WHEN ways = 1 THEN 'unique' WHEN ways > 1 THEN 'ambiguous' ELSE 'none' END AS kind, count(*) AS types, CAST(sum(n) AS BIGINT) AS tokens FROM w LEFT JOIN y USING (word) GROUP BY 1""",
    "str08_folios": f"WITH {base.LOCI} SELECT nullif(regexp_extract(page_id, '^(f[0-9]+)[rv][0-9]*$', 1), '') AS folio, count(DISTINCT page_id) AS pages, count(*) AS loci FROM loc GROUP BY 1",
}
