"""Base tables of a corpus: standing loci, certain words, and the ways of turning a transcribed line into tokens.

All functions are column expressions or DataFrame transformations that stay in the JVM. Rows are unordered, so every
table carries its ordinals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VARIABLES = ("I", "L", "H")


def standing_loci(loci: DataFrame) -> DataFrame:
    """One row per locus_id (deliveries repeat); page variables as columns."""
    row = F.struct("file", "page_id", "number", "locator", "locus_type", "transcriber", "text", "paragraph_index", "paragraph_start", "paragraph_end", *[F.try_element_at("effective_variables", F.lit(v)).alias(f"var_{v.lower()}") for v in VARIABLES])
    return loci.groupBy("locus_id").agg(F.max(row).alias("r")).select("locus_id", "r.*")


def standing_lines(lines: DataFrame) -> DataFrame:
    """One row per line_id of the admitted lines, spelling of ids and split folded, terms of the tokens."""
    from parchmill.functions.text import folded, terms

    row = F.struct(folded(F.col("page_id")).alias("page_id"), "locus_number", folded(F.col("physical_folio")).alias("folio"), "currier", "hand", "illustration", "source_file", folded(F.col("split")).alias("split"), terms(F.col("tokens")).alias("words"))
    return lines.groupBy("line_id").agg(F.max(row).alias("r")).select("line_id", "r.*")


def standing_pages(pages: DataFrame) -> DataFrame:
    """One row per lop_id of the ordered pages, with the terms of the tokens."""
    from parchmill.functions.text import terms

    row = F.struct("corpus_id", "page_ord", "page_id", terms(F.col("tokens")).alias("words"))
    return pages.groupBy("lop_id").agg(F.max(row).alias("r")).select("lop_id", "r.*")


def replaced(c: Column, *steps: tuple[str, str]) -> Column:
    for pattern, by in steps:
        c = F.regexp_replace(c, pattern, by)
    return c


def clean_words(text: Column, comma_split: bool = True) -> Column:
    """Certain lower-case words: braces go with their contents, the first alternative stands, doubtful tokens are dropped."""
    bare = replaced(text, (r"\{[^}]*\}", ""), ("<->", " "), (r"<[^>]*>", ""), (r"\[([^:\]]*):[^\]]*\]", "$1"))
    return F.filter(F.split(bare, r"[.,\s]+" if comma_split else r"[.\s]+"), lambda w: w.rlike("^[a-z]+$"))


def family_words(text: Column) -> Column:
    """The permissive reading: comments and braces go, marks and digits are deleted, alternatives stay unresolved."""
    return F.filter(F.split(replaced(text, (r"<![^>]*>", ""), (r"\{[^}]*\}", ""), (r"[@,;!?'\"<>0-9]", "")), r"[.\s]+"), lambda w: w != "")


#: What a doubtful space (comma) and an alternative become under each space policy.
POLICIES = {"join": ("", "$1"), "split": (".", "$1"), "strict": ("?", "?")}


def policy_parts(text: Column, policy: str) -> Column:
    """Components of a line under a space policy, blank ones dropped; those that aren't certain are kept as they are."""
    comma, alternative = POLICIES[policy]
    bare = replaced(text, ("<->", "."), (r"<[^>]*>", ""), (r"\[([^:\]]*):[^\]]*\]", alternative), (r"[{}]", ""), (",", comma.replace("$", r"\$")), (r"\s+", ""))
    return F.filter(F.split(bare, r"\."), lambda w: w != "")


def policy_words(text: Column, policy: str) -> Column:
    """The certain components: codes @128; to @255; and letters only, lower-cased."""
    kept = F.filter(policy_parts(text, policy), lambda w: w.rlike(r"^(@(12[89]|1[3-9][0-9]|2[0-4][0-9]|25[0-5]);|[A-Za-z'])+$"))
    return F.transform(kept, F.lower)


def view_text(text: Column, space: str = "boundary", first_alternative: bool = True, flatten: bool = True) -> Column:
    """A line with doubtful spaces as boundaries, joined or retained, and alternatives and ligatures resolved or kept."""
    c = replaced(text, (r"<[^>]*>", ""))
    if first_alternative:
        c = replaced(c, (r"\[([^:\]]*):[^\]]*\]", "$1"))
    if flatten:
        c = replaced(c, (r"\{([^{}]*)\}", "$1"))
    return {"boundary": replaced(c, (",", ".")), "join": replaced(c, (",", "")), "retain": c}[space]


#: Fixed values: (reason, pattern) in order of priority; the first that a component matches excludes it.
REASONS = (
    ("uncertain_word_space", ","),
    ("alternative_reading", r"[\[\]:]"),
    ("unreadable_glyph", r"\?"),
    ("extended_eva", "[@;]"),
    ("malformed_ligature", "[{}]"),
    ("joined_eva_form", "[A-Z]"),
    ("unsupported_symbol", "[^a-z']"),
)


def components(text: Column) -> Column:
    """Components between certain boundaries as structs (source, reason, token); token is null where a reason is given.

    Braces of ligatures are taken off from the inside out, as often as there are any; braces without partner stay.
    """
    bare = replaced(text, ("<[-~]>", "."), (r"<[^>]*>", ""))
    depth = F.length(bare) - F.length(F.replace(bare, F.lit("{"), F.lit("")))
    flat = F.aggregate(F.sequence(F.lit(0), depth), bare, lambda t, _: F.regexp_replace(t, r"\{([^{}]*)\}", "$1"))
    parts = F.filter(F.split(F.regexp_replace(flat, r"\s+", ""), r"\."), lambda w: w != "")

    def one(w: Column) -> Column:
        reason = F.coalesce(*[F.when(w.rlike(p), F.lit(name)) for name, p in REASONS])
        return F.struct(w.alias("source"), reason.alias("reason"), F.when(reason.isNull(), w).alias("token"))

    return F.transform(parts, one)


def code_family(source: Column) -> Column:
    """First signs of a word's two-sign codes; null if it isn't made of codes only."""
    return F.when(source.rlike("^([A-Z][0-9a-z])+$"), F.array_join(F.transform(F.regexp_extract_all(source, F.lit("[A-Z][0-9a-z]"), F.lit(0)), lambda x: F.substring(x, 1, 1)), ""))


#: Glyph units of several signs, longest first.
UNITS = ("cth", "ckh", "cph", "cfh", "iin", "ch", "sh", "ee", "in")


def glyph_units(word: Column) -> Column:
    """Longest-match segmentation into glyph units."""
    return F.regexp_extract_all(word, F.lit("|".join(UNITS) + "|."), F.lit(0))


#: The leading signs that are told apart, three-sign forms before one-sign ones.
GALLOWS = ("cth", "ckh", "cph", "cfh", "t", "p", "k", "f")


def gallows_prefix(word: Column) -> Column:
    return F.regexp_extract(word, f"^({'|'.join(GALLOWS)})?(.*)$", 1)


def latin_words(text: Column, least: int = 1) -> Column:
    """Runs of letters of any script, lower-cased, curly apostrophes folded."""
    found = F.regexp_extract_all(F.lower(F.regexp_replace(text, "’", "'")), F.lit(r"[\p{L}']+"), F.lit(0))
    return F.filter(F.transform(found, lambda w: F.regexp_replace(w, "'", "")), lambda w: F.length(w) >= least)


def words(loci: DataFrame) -> DataFrame:
    """(file, page_id, number, locus_id, locus_type, variables, pos, word) of the clean words of standing loci."""
    return loci.select("file", "page_id", "number", "locus_id", "locus_type", "var_i", "var_l", "var_h", F.posexplode(clean_words(F.col("text"))).alias("pos", "word"))


def hash_byte(c: Column, tag: str) -> Column:
    """First byte of SHA-256 of "tag:value"; the tag is the version of a split."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(tag + ":"), c), 256), 1, 2), 16, 10).cast("int")


def hash_order(*parts: Column | str) -> Column:
    """A key in whose order rows are shuffled, the same on every run and engine."""
    return F.sha2(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]), 256)
