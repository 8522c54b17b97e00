"""Scan of transcription files in the interlinear format (a header, page lines, numbered loci, inline tags).

The state that runs from line to line (the current page, the variables in force, the open paragraph, continuation lines)
is found with windows over the lines of a file, so files are read in parallel and nothing is guessed: what can't be read
goes to an error table, and ``strict`` raises if that isn't empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The locus types of the format.
LOCUS_TYPES = ("P0", "P1", "Pb", "Pc", "Pr", "Pt", "L0", "La", "Lc", "Lf", "Ln", "Lp", "Ls", "Lt", "Lx", "Lz", "Ca", "Cc", "Ri", "Ro")

#: The line patterns of the format (locus, short locus, page, header).
_LOCUS = r"^<([^.,>]+)\.([0-9]+),([@+*=&~/!])([A-Z][a-z0-9])(?:;(.))?>\s*(.*)$"
_SHORT = r"^<([A-Z]{2})([0-9]{3})(?:;(.))?>\s*(.*)$"
_PAGE = r"^<([^>.,]+)>(?:\s*<!\s*(.*?)\s*>)?\s*$"
_HEADER = r"^#=IVTFF (.{4}) (\S+) ([MDA])((?: \S+)*)$"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, raw) of all files at ``path``, decoded as Latin-1, in which every byte is a character."""
    files = spark.read.format("binaryFile").load(path)
    text = F.regexp_replace(F.decode("content", "ISO-8859-1"), r"\r\n|\r", "\n")
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), F.posexplode(F.split(F.regexp_replace(text, r"\n$", ""), "\n")).alias("line_no", "raw")).withColumn("line_no", F.col("line_no") + 1)


def logical_lines(lines: DataFrame) -> DataFrame:
    """(file, line_no, text, physical) with continuation lines (ending and beginning in /) joined, and bad_continuation."""
    order = Window.partitionBy("file").orderBy("line_no")
    is_comment = F.col("raw").startswith("#")
    open_before = F.coalesce(F.lag(F.col("raw").endswith("/") & ~is_comment).over(order), F.lit(False))
    marked = lines.withColumn("_open", open_before).withColumn("_cont", F.col("_open") & F.col("raw").startswith("/"))
    marked = marked.withColumn("_bad", F.col("_open") & ~F.col("raw").startswith("/")).withColumn("_ends", F.col("raw").endswith("/") & ~is_comment)
    rec = marked.withColumn("_rec", F.sum((~F.col("_cont")).cast("long")).over(order)).withColumn("_next_bad", F.coalesce(F.lead("_bad").over(order), F.col("_ends")))
    piece = F.when(F.col("_cont"), F.expr("substring(raw, 2)")).otherwise(F.col("raw"))
    rec = rec.withColumn("p", piece).withColumn("p", F.when(F.col("_ends"), F.expr("left(p, length(p) - 1)")).otherwise(F.col("p")))
    pieces = F.array_sort(F.collect_list(F.struct("line_no", "p", "raw")))
    return rec.groupBy("file", "_rec").agg(pieces.alias("_p"), F.max("_next_bad").alias("bad_continuation")).select("file", F.col("_p")[0]["line_no"].alias("line_no"), F.array_join(F.transform("_p", lambda x: x["p"]), "").alias("text"), F.transform("_p", lambda x: F.struct(x["line_no"].alias("number"), x["raw"].alias("raw"))).alias("physical"), "bad_continuation")


def _variables(c: Column) -> Column:
    names = F.regexp_extract_all(c, F.lit(r"\$([A-Z])=([^\s>]+)"), F.lit(1))
    values = F.regexp_extract_all(c, F.lit(r"\$([A-Z])=([^\s>]+)"), F.lit(2))
    return F.map_from_arrays(names, values)


def scan(lines: DataFrame, strict: bool = False, variables: tuple[str, ...] = ("I", "L", "H")) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages, loci, errors) of the lines (file, line_no, raw).

    pages: file, page_ord (line of the header), page_id, variables, comments. loci: file, line_no, page_id, number, locator,
    locus_type, transcriber, text, effective_<variable>, paragraph_index, paragraph_start, paragraph_end, physical. errors: file,
    line_no, reason. A text tag <@K=v> sets a variable for its locus and those behind it on the page, <@K=@> clears it; tags
    within comments are inert. Loci with the short identifiers are pages of their own code. An empty table gives empty ones.
    """
    order = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    t = F.col("text")
    l = logical_lines(lines)
    kind = F.when(t.rlike(r"^\s*$"), "blank").when(t.rlike("^#=IVTFF"), F.when(t.rlike(_HEADER) & (F.col("line_no") == 1), "header").otherwise("bad_header")).when(t.startswith("#"), "comment").when(t.rlike(_LOCUS), "locus").when(t.rlike(_SHORT), "short").when(t.rlike(_PAGE), "page").otherwise("bad_line")
    l = l.withColumn("kind", kind)
    part = lambda long, short: F.when(F.col("kind") == "locus", F.regexp_extract("text", _LOCUS, long)).when(F.col("kind") == "short", F.regexp_extract("text", _SHORT, short))
    l = l.withColumn("own_page", F.when(F.col("kind") == "page", F.regexp_extract("text", _PAGE, 1)).when(F.col("kind") == "short", F.regexp_extract("text", _SHORT, 1)))
    l = l.withColumn("page_id", F.last("own_page", ignorenulls=True).over(order)).withColumn("page_ord", F.last(F.when(F.col("own_page").isNotNull() & (F.col("kind") == "page"), F.col("line_no")), ignorenulls=True).over(order))
    l = l.withColumn("header", F.last(F.when(F.col("kind") == "page", F.regexp_extract("text", _PAGE, 2)), ignorenulls=True).over(order))
    heads = l.where("kind = 'page'").select("file", "page_ord", "page_id", _variables(F.col("header")).alias("variables"))
    comments = l.where("kind = 'comment' AND page_id IS NOT NULL").groupBy("file", "page_ord").agg(F.array_sort(F.collect_list(F.struct("line_no", F.regexp_replace("text", r"^#\s*", "").alias("c")))).alias("_c"))
    pages = heads.join(comments, ["file", "page_ord"], "left").withColumn("comments", F.coalesce(F.transform("_c", lambda x: x["c"]), F.array().cast("array<string>"))).drop("_c")

    loci = l.where("kind IN ('locus', 'short')").withColumn("number", part(2, 2).cast("int")).withColumn("locator", F.when(F.col("kind") == "locus", F.regexp_extract("text", _LOCUS, 3))).withColumn("locus_type", F.when(F.col("kind") == "locus", F.regexp_extract("text", _LOCUS, 4)))
    loci = loci.withColumn("transcriber", F.nullif(part(5, 3), F.lit(""))).withColumn("named_page", part(1, 1)).withColumn("body", part(6, 4))
    page = Window.partitionBy("file", "page_ord", "page_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    active = F.regexp_replace("body", "<![^>]*>", "")
    loci = loci.withColumn("_active", active)
    for v in variables:
        # The last tag of a line is the one in force behind it, and for the line itself.
        tag = F.try_element_at(F.regexp_extract_all("_active", F.lit(f"<@{v}=([^>]+)>"), F.lit(1)), F.lit(-1))
        from_page = F.try_element_at(_variables(F.col("header")), F.lit(v))
        set_ = F.last(tag, ignorenulls=True).over(page)
        loci = loci.withColumn(f"effective_{v.lower()}", F.when(set_.isNull(), from_page).when(set_ != "@", set_))
    starts, ends = (F.regexp_count("_active", F.lit(p)).cast("long") for p in ("<%>", r"<\$>"))
    loci = loci.withColumn("_s", starts).withColumn("_e", ends).withColumn("_started", F.sum("_s").over(page)).withColumn("_ended", F.sum("_e").over(page) - F.col("_e"))
    loci = loci.withColumn("paragraph_start", F.col("_s") > 0).withColumn("paragraph_end", F.col("_e") > 0).withColumn("paragraph_index", F.when(F.col("_started") > F.col("_ended"), F.col("_started").cast("int")))
    whole = Window.partitionBy("file", "page_ord", "page_id")
    before = F.lag("number").over(whole.orderBy("line_no"))
    same = F.count("*").over(Window.partitionBy("file", "page_id", "number", "transcriber"))
    alphabets = F.concat(F.when(F.col("_active").rlike(r"\[[^\]:]*\]"), "bad_alternative,").otherwise(""), F.when(F.regexp_replace("_active", r"@(12[89]|1[3-9][0-9]|2[0-4][0-9]|25[0-5]);", "").rlike("@[0-9]+;"), "bad_code,").otherwise(""), F.when(F.regexp_replace("_active", r"\{[^{}]*\}", "").rlike("[{}]"), "bad_ligature,").otherwise(""), F.when(F.regexp_replace("_active", "<[^<>]*>", "").rlike("[<>]"), "bad_tag,").otherwise(""))
    checked = loci.withColumn("_before", before).withColumn("_same", same).withColumn("_unbalanced", F.last("_started").over(whole) - F.last("_ended").over(whole) - F.last("_e").over(whole))
    reason = F.concat(alphabets, F.when((F.col("kind") == "locus") & ~F.coalesce(F.col("named_page") == F.col("page_id"), F.lit(False)), "wrong_page,").otherwise(""), F.when(F.col("number") < F.col("_before"), "number_decreases,").otherwise(""), F.when(F.col("_same") > 1, "duplicate,").otherwise(""), F.when((F.col("kind") == "locus") & ~F.col("locus_type").isin(*LOCUS_TYPES), "unknown_type,").otherwise(""), F.when((F.col("_started") - F.col("_ended") > 1) | (F.col("_started") - F.col("_ended") - F.col("_e") < 0), "paragraph_marks,").otherwise(""))
    page_end = loci.groupBy("file", "page_ord", "page_id").agg(F.sum("_s").alias("s"), F.sum("_e").alias("e"), F.max("line_no").alias("line_no")).where("s > e").select("file", "line_no", F.lit("unclosed_paragraph").alias("reason"))
    mixed = l.groupBy("file").agg(F.max((F.col("kind") == "short").cast("int")).alias("a"), F.max(F.col("kind").isin("page", "locus").cast("int")).alias("b"), F.min("line_no").alias("line_no")).where("a + b = 2").select("file", "line_no", F.lit("mixed_identifiers").alias("reason"))
    errors = l.where("kind IN ('bad_header', 'bad_line')").select("file", "line_no", F.col("kind").alias("reason")).unionAll(l.where("bad_continuation").select("file", "line_no", F.lit("bad_continuation"))).unionAll(checked.select("file", "line_no", F.explode(F.filter(F.split(reason, ","), lambda r: r != "")).alias("reason"))).unionAll(page_end).unionAll(mixed)
    out = loci.select("file", "line_no", "page_id", "number", "locator", "locus_type", "transcriber", F.col("body").alias("text"), *[f"effective_{v.lower()}" for v in variables], "paragraph_index", "paragraph_start", "paragraph_end", "physical")
    if strict and (first := errors.orderBy("file", "line_no").first()):
        raise ValueError(f"{first['file']}, line {first['line_no']}: {first['reason']}")
    return pages, out, errors


def emit(loci: DataFrame, pages: DataFrame) -> DataFrame:
    """(file, line_no, raw): standing loci and pages written in the format again, a header line for each page."""
    pairs = F.transform(F.array_sort(F.map_entries("variables")), lambda e: F.concat(F.lit("$"), e["key"], F.lit("="), e["value"]))
    head = pages.select("file", F.col("page_id").alias("k1"), F.lit(-1).alias("k2"), F.lit(0).alias("k3"), F.concat(F.lit("<"), "page_id", F.lit("> <! "), F.coalesce(F.array_join(pairs, " "), F.lit("")), F.lit(">")).alias("raw"))
    tag = F.concat(F.lit("<"), "page_id", F.lit("."), F.col("number").cast("string"), F.lit(","), "locator", "locus_type", F.when(F.col("transcriber").isNotNull(), F.concat(F.lit(";"), "transcriber")).otherwise(""), F.lit("> "))
    line = loci.select("file", F.col("page_id").alias("k1"), F.col("number").alias("k2"), F.posexplode("physical").alias("k3", "_p"), tag.alias("_tag"))
    body = line.select("file", "k1", "k2", "k3", F.when(F.col("k3") == 0, F.concat("_tag", "_p")).otherwise(F.col("_p")).alias("raw"))
    top = loci.select("file").distinct().select("file", F.lit("").alias("k1"), F.lit(-2).alias("k2"), F.lit(0).alias("k3"), F.lit("#=IVTFF Eva- 2.0 M").alias("raw"))
    order = Window.partitionBy("file").orderBy("k1", "k2", "k3")
    return top.unionAll(head).unionAll(body).select("file", F.row_number().over(order).alias("line_no"), "raw")
