"""Queries on dirty deliveries: two systems' copies of a table, several values in one field."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmill.functions.text import folded, value_or_blank
from parchmill.operators.packed import unpack
from parchmill.operators.reconcile import differences
from parchmill.session import spread, table

COMPARED = ("zl_source", "gc_source", "zl_family", "gc_family")


def position_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = {"page_id": folded(F.col("page_id")), "locus_number": F.col("locus_number"), "ordinal": F.col("ordinal")}
    fields = {f: value_or_blank(F.col(f)) for f in COMPARED}
    return differences(table(spark, sf_dir, "zg_positions"), table(spark, sf_dir, "zg_positions_copy"), keys, fields, F.col("loaded_at"))


def difference_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences by kind, with the pages and positions they touch."""
    return position_differences(spark, sf_dir).groupBy("difference").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"))


def packed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unpack(spread(table(spark, sf_dir, "loci").select("locus_id", "text")), "locus_id", "text").select("locus_id", "pos", "value")


def packed_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each value was written (bare, quoted, bracketed, mixed), and whether it has a mark without partner."""
    return unpack(spread(table(spark, sf_dir, "loci").select("locus_id", "text")), "locus_id", "text").select("locus_id", "pos", "kind", "malformed")


def packed_value_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values were bare, quoted, bracketed or mixed, and how many had a mark without partner."""
    values = unpack(spread(table(spark, sf_dir, "loci").select("locus_id", "text")), "locus_id", "text")
    return values.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.col("malformed").cast("long")).alias("malformed"))


QUERIES = {
    "p1_found": position_differences,
    "p1_totals": difference_totals,
    "p4_found": packed_values,
    "p4_kinds": packed_value_kinds,
    "p4_marks": packed_marks,
}

_B = "' ' || chr(9)"


def _standing(t: str) -> str:
    values = ", ".join(f"{f} := coalesce(trim({f}, {_B}), '')" for f in COMPARED)
    return f"SELECT lower(trim(page_id, {_B})) AS page_id, locus_number, ordinal, max(struct_pack(t := loaded_at, {values})) AS r FROM {t} GROUP BY ALL"


_DIFFERENCES = f"""
WITH a AS ({_standing("zg_positions")}), b AS ({_standing("zg_positions_copy")}),
j AS (SELECT coalesce(a.page_id, b.page_id) AS page_id, coalesce(a.locus_number, b.locus_number) AS locus_number,
             coalesce(a.ordinal, b.ordinal) AS ordinal, a.r AS x, b.r AS y
      FROM a FULL JOIN b ON a.page_id IS NOT DISTINCT FROM b.page_id AND a.locus_number IS NOT DISTINCT FROM b.locus_number
                        AND a.ordinal IS NOT DISTINCT FROM b.ordinal)
SELECT page_id, locus_number, ordinal, 'only_first' AS difference FROM j WHERE y IS NULL
UNION ALL SELECT page_id, locus_number, ordinal, 'only_second' FROM j WHERE x IS NULL
""" + "".join(f"UNION ALL SELECT page_id, locus_number, ordinal, '{f}' FROM j WHERE x IS NOT NULL AND y IS NOT NULL AND x.{f} <> y.{f}\n" for f in COMPARED)

# RE2 has no possessive loops; the difference shows only where a doubled quotation mark follows one that doesn't close.
_SPACE = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_VALUE = rf'(?:"(?:""|[^"])*"|\[[^\]]*\]|\{{[^}}]*\}}|[^{_SPACE}.,/|·\-])+'
_VALUES = rf"""
WITH t AS (SELECT locus_id, max(text) AS text FROM loci GROUP BY locus_id),
v AS (SELECT locus_id, list_filter(list_transform(
        regexp_extract_all(regexp_replace(regexp_replace(text, '<[-~]>', '.', 'g'), '<[^>]*>', '', 'g'), '{_VALUE}'),
        lambda x: replace(regexp_replace(replace(x, '""', chr(57344)), '"([^"]*)"', '\1', 'g'), chr(57344), '"')), lambda x: x <> '') AS vs
      FROM t WHERE text IS NOT NULL)
SELECT locus_id, CAST(unnest(generate_series(1, len(vs))) AS INTEGER) AS pos, unnest(vs) AS value FROM v
"""

_MARKED = r'"(?:""|[^"])*"|\[[^\]]*\]|\{[^}]*\}'
_MARKS = rf"""
WITH t AS (SELECT locus_id, max(text) AS text FROM loci GROUP BY locus_id),
v AS (SELECT locus_id, list_filter(list_transform(
        regexp_extract_all(regexp_replace(regexp_replace(text, '<[-~]>', '.', 'g'), '<[^>]*>', '', 'g'), '{_VALUE}'),
        lambda x: struct_pack(v := replace(regexp_replace(replace(x, '""', chr(57344)), '"([^"]*)"', '\1', 'g'), chr(57344), '"'), x := x, r := regexp_replace(x, '{_MARKED}', '', 'g'))), lambda s: s.v <> '') AS vs
      FROM t WHERE text IS NOT NULL),
p AS (SELECT locus_id, CAST(unnest(generate_series(1, len(vs))) AS INTEGER) AS pos, unnest(vs) AS s FROM v)
SELECT locus_id, pos, CASE WHEN s.x = s.r THEN 'bare' WHEN regexp_full_match(s.x, '"(?:""|[^"])*"') THEN 'quoted' WHEN regexp_full_match(s.x, '\[[^\]]*\]|\{{[^}}]*\}}') THEN 'bracketed' ELSE 'mixed' END AS kind,
       regexp_matches(s.r, '["\[{{]') AS malformed FROM p
"""

SQL = {
    "p4_marks": _MARKS,
    "p4_kinds": f"SELECT kind, count(*) AS n, CAST(sum(CAST(malformed AS BIGINT)) AS BIGINT) AS malformed FROM ({_MARKS}) GROUP BY kind",
    "p1_found": _DIFFERENCES,
    "p1_totals": f"SELECT difference, count(*) AS n, count(DISTINCT page_id) AS pages FROM ({_DIFFERENCES}) GROUP BY 1",
    "p4_found": _VALUES,
}
