"""What the query modules share: standing tables, and their text in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parchmill.operators import corpus
from parchmill.session import table


def loci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.standing_loci(table(spark, sf_dir, "loci"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.standing_lines(table(spark, sf_dir, "eligible_lines"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.standing_pages(table(spark, sf_dir, "local_order_pages"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.words(loci(spark, sf_dir))


_B = "' ' || chr(9)"

LOCI = """loc AS (SELECT locus_id, unnest(max(struct_pack(file := file, page_id := page_id, number := number, locator := locator, locus_type := locus_type,
  transcriber := transcriber, text := text, paragraph_index := paragraph_index, paragraph_start := paragraph_start, paragraph_end := paragraph_end,
  var_i := effective_variables['I'], var_l := effective_variables['L'], var_h := effective_variables['H']))) FROM loci GROUP BY locus_id)"""


def bare_sql(text: str = "text") -> str:
    out = text
    for pattern, by in ((r"\{[^}]*\}", ""), ("<->", " "), (r"<[^>]*>", ""), (r"\[([^:\]]*):[^\]]*\]", r"\1")):
        out = f"regexp_replace({out}, '{pattern}', '{by}', 'g')"
    return out


CLEAN = f"list_filter(string_split_regex({bare_sql()}, '[.,\\s]+'), lambda w: regexp_full_match(w, '[a-z]+'))"
#: One row per clean word; w.pos counts from 0.
WORDS = f"""{LOCI},
ws AS (SELECT *, {CLEAN} AS _ws FROM loc),
w AS (SELECT file, page_id, number, locus_id, locus_type, var_i, var_l, var_h, CAST(unnest(generate_series(0, len(_ws) - 1)) AS INTEGER) AS pos, unnest(_ws) AS word FROM ws)"""

_TERMS = f"list_filter(list_transform(coalesce(tokens, []), lambda x: lower(trim(x, {_B}))), lambda x: x IS NOT NULL AND x <> '')"
LINES = f"""li AS (SELECT line_id, unnest(max(struct_pack(page_id := lower(trim(page_id, {_B})), locus_number := locus_number, folio := lower(trim(physical_folio, {_B})), currier := currier,
  hand := hand, illustration := illustration, source_file := source_file, split := lower(trim(split, {_B})), words := {_TERMS}))) FROM eligible_lines GROUP BY line_id)"""
LINE_WORDS = f"{LINES}, lw AS (SELECT * EXCLUDE words, CAST(unnest(generate_series(0, len(words) - 1)) AS INTEGER) AS pos, unnest(words) AS word FROM li)"
PAGES = f"""pg AS (SELECT lop_id, unnest(max(struct_pack(corpus_id := corpus_id, page_ord := page_ord, page_id := page_id, words := {_TERMS}))) FROM local_order_pages GROUP BY lop_id)"""
PAGE_WORDS = f"{PAGES}, pw AS (SELECT * EXCLUDE words, CAST(unnest(generate_series(0, len(words) - 1)) AS INTEGER) AS pos, unnest(words) AS word FROM pg)"
