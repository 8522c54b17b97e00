"""Queries on scans with state, record checks, event replay and dates (SRC-01..03, SNK, JSN, LED, WIN-06/07, DTM)."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parchmill.functions import plugins
from parchmill.operators.order import global_rank
from parchmill.plans import base
from parchmill.session import scratch_path, table
from parchmill.sources import files, sinks, transcription
from parchmill.streaming import replay


def _emitted(spark, sf_dir):
    physical = F.transform("physical_lines", lambda x: F.decode(x["raw"], "ISO-8859-1"))
    loci = table(spark, sf_dir, "loci").where("locator IS NOT NULL AND text IS NOT NULL").groupBy("locus_id").agg(F.max(F.struct("file", "page_id", "number", "locator", "locus_type", "transcriber", physical.alias("physical"))).alias("r")).select("r.*")
    variables = F.filter(F.map_entries("variables"), lambda e: e["key"].rlike("^[A-Z]$") & e["value"].rlike("^\\S+$"))
    pages = table(spark, sf_dir, "ivtff_pages").groupBy("file", "page_id").agg(F.max(F.array_sort(variables)).alias("v")).select("file", "page_id", F.map_from_entries(F.coalesce("v", F.array().cast("array<struct<key:string,value:string>>"))).alias("variables"))
    own = loci.select("file", "page_id").distinct().join(pages, ["file", "page_id"], "left").withColumn("variables", F.coalesce("variables", F.create_map().cast("map<string,string>")))
    return transcription.emit(loci, own)


def scanned_loci(spark, sf_dir):
    """SRC-01: the loci written in the transcription format and scanned again."""
    _, loci, _ = transcription.scan(_emitted(spark, sf_dir))
    return loci.select("file", "page_id", "number", "locator", "locus_type", "transcriber", "text", "paragraph_start", "paragraph_end", F.size("physical").cast("long").alias("lines"))


def scan_errors(spark, sf_dir):
    """SRC-01: what the scan doesn't read without guessing, by reason."""
    _, _, errors = transcription.scan(_emitted(spark, sf_dir))
    return errors.groupBy("reason").agg(F.count("*").alias("n"))


def baseline_rules(spark, sf_dir):
    """SRC-02: lines against the rules of the plain profile: ASCII only, length, one reading per place and transcriber."""
    l = base.loci(spark, sf_dir)
    twice = l.groupBy("page_id", "number", "transcriber").agg(F.count("*").alias("c"))
    return l.join(twice.withColumnsRenamed({"page_id": "_p", "number": "_n", "transcriber": "_t"}), F.col("page_id").eqNullSafe(F.col("_p")) & F.col("number").eqNullSafe(F.col("_n")) & F.col("transcriber").eqNullSafe(F.col("_t"))).groupBy("file").agg(F.count_if(~F.col("text").rlike("^[\\x{00}-\\x{7f}]*$")).alias("not_ascii"), F.count_if(F.length("text") > 80).alias("over_80"), F.count_if(F.col("c") > 1).alias("repeated_place"))


def lenient_scan(spark, sf_dir):
    """SRC-03: what a forgiving pattern reads of each line: flags, code of the locus, free comments."""
    l = base.loci(spark, sf_dir).where("page_id RLIKE '^f[0-9]+'")
    comments = F.size(F.regexp_extract_all("text", F.lit("<![^>]*>"), F.lit(0)))
    return l.groupBy("file", F.substring("locus_type", 1, 1).alias("kind"), F.substring("locus_type", 2, 1).alias("sub")).agg(F.count("*").alias("loci"), F.count_if(F.col("text").contains("<%>")).alias("starts"), F.count_if(F.col("text").contains("<$>")).alias("ends"), F.sum(comments.cast("long")).alias("comments"))


def row_digests(spark, sf_dir):
    """SNK-01, JSN-03: digest of a row as canonical JSON, and that of a part of its columns."""
    o = table(spark, sf_dir, "eligible_lines").select("line_id", "page_id", "locus_number", "source_file", "split")
    return o.select("line_id", sinks.digest(o).alias("whole"), sinks.digest(o, "page_id", "split").alias("part"))


def pruned_results(spark, sf_dir):
    """SNK-04: results without the named members, nested ones too, before they are reported."""
    e = sinks.pruned(table(spark, sf_dir, "entry_results"), "jaccard_distant", "page_unique_share", "computed_at")
    return e.groupBy("corpus_id").agg(F.max(F.to_json("results")).alias("results"), F.count("*").alias("rows"))


def json_lines(spark, sf_dir):
    """SNK-06, SRC-14: pages with their lines written as sorted JSON lines, read again as a collection, and the nested lines lifted; keys that repeat are counted."""
    l = table(spark, sf_dir, "eligible_lines").where("page_id IS NOT NULL").groupBy("line_id").agg(F.max(F.struct("page_id", "locus_number")).alias("r")).select("line_id", F.lower(F.trim("r.page_id")).alias("page_id"), "r.locus_number")
    path = scratch_path(spark, "collection")
    sinks.write_json(l.groupBy("page_id", F.col("locus_number").alias("part")).agg(F.array_sort(F.collect_list(F.struct("line_id"))).alias("lines")), path)
    back = files.records(spark, path, "page_id STRING, part INT, lines ARRAY<STRUCT<line_id: BIGINT>>", lines=True)
    lifted = files.lifted(back, "lines", "page_id")
    repeated = files.repeated_keys(back, "page_id").withColumnRenamed("n", "times")
    return lifted.groupBy("page_id").agg(F.count("*").alias("lines"), F.min("line_id").alias("first")).join(repeated, "page_id", "left").select("page_id", "lines", "first", F.coalesce("times", F.lit(1).cast("long")).alias("times"))


def decided_rows(spark, sf_dir):
    """UDF-02: documents that a caller's predicate lets through, which is asked once for each combination of language and source."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return plugins.decided(d, lambda lang, source: lang is not None and re.fullmatch("[a-z]{2}", lang) is not None and source is not None, "lang", "source").groupBy("lang", "source").agg(F.count("*").alias("documents"))


def absent_rows(spark, sf_dir):
    """SNK-05: keys of the copy that the first table lacks, each once."""
    from parchmill.functions.text import folded

    key = F.concat_ws("/", folded(F.col("page_id")), F.col("locus_number").cast("string"), F.col("ordinal").cast("string")).alias("key")
    old, new = (table(spark, sf_dir, t).select(key) for t in ("zg_positions", "zg_positions_copy"))
    return sinks.put_if_absent(new, old, "key")


def schema_issues(spark, sf_dir):
    """JSN-01: records against a schema: unknown values, values out of range, members that are missing, by path and code."""
    k = F.try_variant_get(F.parse_json("props"), "$.k", "bigint")
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value", k.alias("k"))
    issue = lambda cond, path, code: F.when(cond, F.struct(F.lit(path).alias("path"), F.lit(code).alias("code")))
    rules = F.array_compact(F.array(issue(~F.col("event_type").isin("click", "view", "purchase"), "event_type", "unknown_value"), issue(F.col("value") > 50, "value", "out_of_range"), issue(F.col("k").isNull(), "props.k", "missing"), issue(F.col("k") % 10 == 0, "props.k", "pattern")))
    return e.select(F.explode(rules).alias("i")).groupBy("i.path", "i.code").agg(F.count("*").alias("n"))


def structure_counts(spark, sf_dir):
    """JSN-04: structure of texts: tags, list items, links, lines and the longest line."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    lines = F.split("text", r"\r\n|\n|\r")
    return d.select("doc_id", F.regexp_count("text", F.lit("<[a-z]+>")).cast("long").alias("elements"), F.regexp_count("text", F.lit(r"(?m)^- ")).cast("long").alias("items"), F.size(lines).cast("long").alias("lines"), F.array_max(F.transform(lines, F.length)).cast("long").alias("longest"))


def same_records(spark, sf_dir):
    """JSN-06: repeated deliveries whose sorted contents agree."""
    c = F.to_json(F.array_sort(F.transform("tokens", lambda t: F.lower(F.trim(F.coalesce(t, F.lit("")))))))
    return table(spark, sf_dir, "eligible_lines").groupBy("line_id").agg(F.count("*").alias("n"), F.countDistinct(F.coalesce(c, F.lit("null"))).alias("d")).where("n > 1").groupBy((F.col("d") == 1).alias("agree")).agg(F.count("*").alias("lines"))


def high_water(spark, sf_dir):
    """WIN-07, AGG-27, LED-02: what each event adds over the highest value of its family before, and the sum."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("family"), F.col("event_id").alias("sequence"), F.round(F.col("value") * 100).cast("long").alias("value"))
    return replay.increments(e).groupBy("family").agg(F.sum("increment").alias("total"), F.max("value").alias("highest"), F.count_if(F.col("increment") > 0).alias("raises"))


def streamed_high_water(spark, sf_dir):
    """LED-02 as a stateful stream over the same events."""
    schema = table(spark, sf_dir, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(_folder(spark, sf_dir, "events"))
    e = source.select(F.col("user_id").cast("string").alias("family"), F.col("event_id").alias("sequence"), F.round(F.col("value") * 100).cast("long").alias("value"))
    out = replay.run_once(replay.stream_increments(e), "increments")
    return out.groupBy(F.col("family").cast("long").alias("family")).agg(F.sum("increment").alias("total"), F.max("value").alias("highest"), F.count_if(F.col("increment") > 0).alias("raises"))


def streamed_windows(spark, sf_dir):
    """Tumbling windows over a stream of events with a watermark."""
    schema = table(spark, sf_dir, "events").schema
    source = spark.readStream.schema(schema).parquet(_folder(spark, sf_dir, "events"))
    return replay.run_once(replay.stream_windows(source), "windows", "append")


def _folder(spark, sf_dir, name):
    """Streams read folders: a copy of the table in the shared folder."""
    import uuid

    from parchmill.session import _written, scratch_dir

    path = f"{scratch_dir(spark)}/parchmill-{uuid.uuid4().hex}"
    _written.append((spark, path))
    table(spark, sf_dir, name).write.parquet(path)
    return path


def _units(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "event_type", "ts", F.round(F.col("value") * 100).cast("long").alias("units"))


def leaderboard(spark, sf_dir):
    """LED-05, WIN-06: totals by category in columns, with competition ranks."""
    kinds = ["click", "error", "purchase", "signup", "view"]
    p = _units(spark, sf_dir).groupBy("user_id").pivot("event_type", kinds).agg(F.sum("units")).na.fill(0)
    t = p.withColumn("units", sum((F.col(k) for k in kinds), F.lit(0).cast("long")))
    return global_rank(t, "units")


def newcomers(spark, sf_dir):
    """DTM-04, LED-05: totals as of a date, users whose first event lies within the ten days before it marked."""
    asof = F.lit("2024-01-20").cast("timestamp")
    u = _units(spark, sf_dir).where(F.col("ts") < asof)
    return u.groupBy("user_id").agg(F.sum("units").alias("units"), (F.min("ts") >= asof - F.expr("INTERVAL 10 DAYS")).alias("newcomer"))


def periods(spark, sf_dir):
    """DTM-02: totals by ISO week and by month, half-open, in UTC."""
    u = _units(spark, sf_dir)
    both = [u.groupBy(F.lit(p).alias("period"), F.date_trunc(p, "ts").alias("start")).agg(F.sum("units").alias("units"), F.count("*").alias("n")) for p in ("week", "month")]
    return both[0].unionAll(both[1]).select("period", F.date_format("start", "yyyy-MM-dd").alias("start"), "units", "n")


def strict_times(spark, sf_dir):
    """DTM-01: times in the strict UTC form that read back to the same instant."""
    s = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    e = table(spark, sf_dir, "events").select("ts", s.alias("s"))
    return e.agg(F.count_if(F.col("s").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$")).alias("well_formed"), F.count_if(F.to_timestamp("s", "yyyy-MM-dd'T'HH:mm:ss'Z'") == F.date_trunc("second", "ts")).alias("same"))


def clock_slots(spark, sf_dir):
    """DTM-03: half-hour slots on a twelve-hour dial, halves rounded up."""
    m = F.pmod(F.hour("ts"), F.lit(12)) * 60 + F.minute("ts")
    return table(spark, sf_dir, "events").groupBy(F.pmod(F.floor(m / 30 + 0.5), F.lit(24)).cast("long").alias("slot")).agg(F.count("*").alias("n"))


def conservation(spark, sf_dir):
    """LED-03: units moved within each user and day against the day's total; what is lost must be nothing."""
    u = _units(spark, sf_dir)
    day = u.groupBy(F.to_date("ts").alias("day")).agg(F.sum("units").alias("total"))
    each = u.groupBy(F.to_date("ts").alias("day"), "user_id").agg(F.sum("units").alias("units")).groupBy("day").agg(F.sum("units").alias("parts"))
    return day.join(each, "day").groupBy((F.col("total") == F.col("parts")).alias("conserved")).agg(F.count("*").alias("days"))


def share_rules(spark, sf_dir):
    """JSN-02: shares of an order's items in basis points, largest remainder first, must make up the whole."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    whole = Window.partitionBy("l_orderkey")
    l = l.withColumn("total", F.sum("cents").over(whole)).where("total > 0").withColumn("floor", F.expr("cents * 10000 DIV total")).withColumn("rest", F.expr("cents * 10000 % total"))
    l = l.withColumn("missing", 10000 - F.sum("floor").over(whole)).withColumn("k", F.row_number().over(whole.orderBy(F.desc("rest"), "l_linenumber")))
    shares = l.withColumn("share", F.col("floor") + (F.col("k") <= F.col("missing")).cast("long"))
    o = shares.groupBy("l_orderkey").agg(F.sum("share").alias("sum"), F.count("*").alias("items"), F.max("share").alias("most"))
    return o.groupBy("items").agg(F.count("*").alias("orders"), F.count_if(F.col("sum") != 10000).alias("broken"), F.sum("most").alias("most"))


def unknown_references(spark, sf_dir):
    """JSN-05: references to records that aren't there, by kind."""
    t = {n: table(spark, sf_dir, n) for n in ("lineitem", "orders", "part", "supplier", "customer", "content_labels", "documents")}
    checks = [("item_order", "lineitem", "l_orderkey", "orders", "o_orderkey"), ("item_part", "lineitem", "l_partkey", "part", "p_partkey"), ("item_supplier", "lineitem", "l_suppkey", "supplier", "s_suppkey"), ("order_customer", "orders", "o_custkey", "customer", "c_custkey"), ("label_document", "content_labels", "doc_id", "documents", "doc_id")]
    one = lambda name, a, k, b, r: t[a].select(F.col(k).alias("k")).join(t[b].select(F.col(r).alias("k")), "k", "left_anti").agg(F.lit(name).alias("reference"), F.count("*").alias("unknown"))
    out = one(*checks[0])
    for c in checks[1:]:
        out = out.unionAll(one(*c))
    return out


def publication_delay(spark, sf_dir):
    """LED-01: texts by the days from writing to arrival, of sources that are known."""
    d = table(spark, sf_dir, "documents").where("source IS NOT NULL AND created_at IS NOT NULL AND received_at IS NOT NULL")
    return d.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("received_at") > F.col("created_at") + F.expr("INTERVAL 7 DAYS")).alias("late"), F.count_if(F.col("received_at") < F.col("created_at")).alias("before"))


def current_state(spark, sf_dir):
    """LED-04: of every user the last value of each kind, without those that are nothing."""
    e = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max_by(F.round(F.col("value") * 100).cast("long"), "event_id").alias("units"))
    return e.where("units <> 0").groupBy("event_type").agg(F.count("*").alias("users"), F.sum("units").alias("units"))


QUERIES = {
    "jsn02_share_rules": share_rules,
    "jsn05_unknown_references": unknown_references,
    "led01_publication_delay": publication_delay,
    "led04_current_state": current_state,
    "src01_scanned_loci": scanned_loci,
    "src01_scan_errors": scan_errors,
    "src02_baseline_rules": baseline_rules,
    "src03_lenient_scan": lenient_scan,
    "snk01_row_digests": row_digests,
    "snk04_pruned_results": pruned_results,
    "snk06_json_lines": json_lines,
    "udf02_decided_rows": decided_rows,
    "snk05_absent_rows": absent_rows,
    "jsn01_schema_issues": schema_issues,
    "jsn04_structure_counts": structure_counts,
    "jsn06_same_records": same_records,
    "win07_high_water": high_water,
    "led02_streamed_high_water": streamed_high_water,
    "led02_streamed_windows": streamed_windows,
    "led03_conservation": conservation,
    "led05_leaderboard": leaderboard,
    "dtm01_strict_times": strict_times,
    "dtm02_periods": periods,
    "dtm03_clock_slots": clock_slots,
    "dtm04_newcomers": newcomers,
}

_UNITS = "u AS (SELECT user_id, event_type, ts, CAST(round(value * 100) AS BIGINT) AS units FROM events)"
_HIGH = """WITH e AS (SELECT user_id AS family, event_id, CAST(round(value * 100) AS BIGINT) AS v FROM events),
i AS (SELECT family, v, greatest(0, v - coalesce(max(v) OVER (PARTITION BY family ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS i FROM e)
SELECT family, CAST(sum(i) AS BIGINT) AS total, max(v) AS highest, count(*) FILTER (WHERE i > 0) AS raises FROM i GROUP BY family"""

SQL = {
    "jsn02_share_rules": """WITH l AS (SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem), t AS (SELECT *, CAST(sum(cents) OVER (PARTITION BY l_orderkey) AS BIGINT) AS total FROM l),
f AS (SELECT *, cents * 10000 // total AS fl, cents * 10000 % total AS rest FROM t WHERE total > 0), m AS (SELECT *, 10000 - sum(fl) OVER (PARTITION BY l_orderkey) AS missing, row_number() OVER (PARTITION BY l_orderkey ORDER BY rest DESC, l_linenumber) AS k FROM f),
o AS (SELECT l_orderkey, sum(fl + CAST(k <= missing AS BIGINT)) AS s, count(*) AS items, max(fl + CAST(k <= missing AS BIGINT)) AS most FROM m GROUP BY l_orderkey)
SELECT items, count(*) AS orders, count(*) FILTER (WHERE s <> 10000) AS broken, CAST(sum(most) AS BIGINT) AS most FROM o GROUP BY items""",
    "jsn05_unknown_references": """SELECT 'item_order' AS reference, count(*) AS unknown FROM lineitem ANTI JOIN orders ON l_orderkey = o_orderkey UNION ALL SELECT 'item_part', count(*) FROM lineitem ANTI JOIN part ON l_partkey = p_partkey
UNION ALL SELECT 'item_supplier', count(*) FROM lineitem ANTI JOIN supplier ON l_suppkey = s_suppkey UNION ALL SELECT 'order_customer', count(*) FROM orders ANTI JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT 'label_document', count(*) FROM content_labels c ANTI JOIN documents d ON c.doc_id = d.doc_id""",
    "led01_publication_delay": "SELECT source, count(*) AS n, count(*) FILTER (WHERE received_at > created_at + INTERVAL 7 DAY) AS late, count(*) FILTER (WHERE received_at < created_at) AS before FROM documents WHERE source IS NOT NULL AND created_at IS NOT NULL AND received_at IS NOT NULL GROUP BY source",
    "led04_current_state": "WITH e AS (SELECT user_id, event_type, arg_max(CAST(round(value * 100) AS BIGINT), event_id) AS units FROM events GROUP BY ALL) SELECT event_type, count(*) AS users, CAST(sum(units) AS BIGINT) AS units FROM e WHERE units <> 0 GROUP BY event_type",
    "src01_scanned_loci": f"""WITH {base.LOCI}, p AS (SELECT locus_id, max(len(physical_lines)) AS k FROM loci GROUP BY locus_id)
SELECT file, page_id, number, locator, locus_type, transcriber, regexp_replace(text, '^[ \\t\\n\\r\\f\\v]+', '') AS text, contains(text, '<%>') AS paragraph_start, contains(text, '<$>') AS paragraph_end, k AS lines FROM loc JOIN p USING (locus_id) WHERE locator IS NOT NULL AND text IS NOT NULL""",
    "src02_baseline_rules": rf"""WITH {base.LOCI}, c AS (SELECT file, text, count(*) OVER (PARTITION BY page_id, number, transcriber) AS c FROM loc)
SELECT file, count(*) FILTER (WHERE NOT regexp_full_match(text, '[\x00-\x7f]*')) AS not_ascii, count(*) FILTER (WHERE length(text) > 80) AS over_80, count(*) FILTER (WHERE c > 1) AS repeated_place FROM c GROUP BY file""",
    "src03_lenient_scan": f"""WITH {base.LOCI} SELECT file, substr(locus_type, 1, 1) AS kind, substr(locus_type, 2, 1) AS sub, count(*) AS loci, count(*) FILTER (WHERE contains(text, '<%>')) AS starts, count(*) FILTER (WHERE contains(text, '<$>')) AS ends,
CAST(sum(len(regexp_extract_all(text, '<![^>]*>'))) AS BIGINT) AS comments FROM loc WHERE regexp_matches(page_id, '^f[0-9]+') GROUP BY ALL""",
    "snk01_row_digests": """SELECT line_id, sha256('{' || array_to_string(list_filter([CASE WHEN line_id IS NOT NULL THEN '"line_id":' || line_id END, CASE WHEN locus_number IS NOT NULL THEN '"locus_number":' || locus_number END, CASE WHEN page_id IS NOT NULL THEN '"page_id":"' || replace(replace(replace(page_id, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(9), chr(92) || 't') || '"' END, CASE WHEN source_file IS NOT NULL THEN '"source_file":"' || replace(replace(replace(source_file, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(9), chr(92) || 't') || '"' END, CASE WHEN split IS NOT NULL THEN '"split":"' || replace(replace(replace(split, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(9), chr(92) || 't') || '"' END], lambda x: x IS NOT NULL), ',') || '}') AS whole,
sha256('{' || array_to_string(list_filter([CASE WHEN page_id IS NOT NULL THEN '"page_id":"' || replace(replace(replace(page_id, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(9), chr(92) || 't') || '"' END, CASE WHEN split IS NOT NULL THEN '"split":"' || replace(replace(replace(split, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(9), chr(92) || 't') || '"' END], lambda x: x IS NOT NULL), ',') || '}') AS part FROM eligible_lines""",
    "snk04_pruned_results": """SELECT corpus_id, max('{"real":{' || array_to_string(list_filter([CASE WHEN results.real.pages IS NOT NULL THEN '"pages":' || results.real.pages END, CASE WHEN results.real.tokens IS NOT NULL THEN '"tokens":' || results.real.tokens END,
CASE WHEN results.real.types IS NOT NULL THEN '"types":' || results.real.types END, CASE WHEN results.real.jaccard_adjacent IS NOT NULL THEN '"jaccard_adjacent":' || results.real.jaccard_adjacent END], lambda x: x IS NOT NULL), ',') || '}}') AS results, count(*) AS rows FROM entry_results GROUP BY corpus_id""",
    "snk06_json_lines": f"""WITH l AS (SELECT line_id, max(struct_pack(p := page_id, n := locus_number)) AS r FROM eligible_lines WHERE page_id IS NOT NULL GROUP BY line_id)
SELECT lower(trim(r.p)) AS page_id, count(*) AS lines, min(line_id) AS first, count(DISTINCT coalesce(CAST(r.n AS VARCHAR), 'none')) AS times FROM l GROUP BY 1""",
    "udf02_decided_rows": "SELECT lang, source, count(*) AS documents FROM documents WHERE regexp_full_match(lang, '[a-z]{2}') AND source IS NOT NULL GROUP BY ALL",
    "snk05_absent_rows": "WITH k AS (SELECT 1 AS t, concat_ws('/', lower(trim(page_id, ' ' || chr(9))), locus_number, ordinal) AS key FROM zg_positions UNION ALL SELECT 2, concat_ws('/', lower(trim(page_id, ' ' || chr(9))), locus_number, ordinal) FROM zg_positions_copy) SELECT key FROM k GROUP BY key HAVING min(t) = 2",
    "jsn01_schema_issues": """WITH e AS (SELECT event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events), i AS (
SELECT 'event_type' AS path, 'unknown_value' AS code FROM e WHERE event_type NOT IN ('click', 'view', 'purchase') UNION ALL SELECT 'value', 'out_of_range' FROM e WHERE value > 50
UNION ALL SELECT 'props.k', 'missing' FROM e WHERE k IS NULL UNION ALL SELECT 'props.k', 'pattern' FROM e WHERE k % 10 = 0) SELECT path, code, count(*) AS n FROM i GROUP BY ALL""",
    "jsn04_structure_counts": r"""WITH d AS (SELECT doc_id, text, string_split_regex(text, '\r\n|\n|\r') AS ls FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(regexp_extract_all(text, '<[a-z]+>')) AS elements, len(regexp_extract_all(text, '(?m)^- ')) AS items, len(ls) AS lines, list_max(list_transform(ls, lambda l: length(l))) AS longest FROM d""",
    "jsn06_same_records": "WITH g AS (SELECT line_id, count(*) AS n, count(DISTINCT coalesce(CAST(list_sort(list_transform(tokens, lambda t: lower(trim(coalesce(t, ''))))) AS VARCHAR), 'null')) AS d FROM eligible_lines GROUP BY line_id HAVING count(*) > 1) SELECT d = 1 AS agree, count(*) AS lines FROM g GROUP BY 1",
    "win07_high_water": _HIGH,
    "led02_streamed_high_water": _HIGH,
    "led03_conservation": f"WITH {_UNITS}, d AS (SELECT CAST(ts AS DATE) AS day, sum(units) AS t FROM u GROUP BY 1), e AS (SELECT day, sum(x) AS p FROM (SELECT CAST(ts AS DATE) AS day, user_id, sum(units) AS x FROM u GROUP BY ALL) GROUP BY day) SELECT t = p AS conserved, count(*) AS days FROM d JOIN e USING (day) GROUP BY 1",
    "led05_leaderboard": f"WITH {_UNITS}, p AS (SELECT user_id, " + ", ".join(f"CAST(coalesce(sum(units) FILTER (WHERE event_type = '{k}'), 0) AS BIGINT) AS {k}" for k in ("click", "error", "purchase", "signup", "view")) + " FROM u GROUP BY user_id), t AS (SELECT *, click + error + purchase + signup + view AS units FROM p) SELECT *, rank() OVER (ORDER BY units DESC) AS rank FROM t",
    "dtm01_strict_times": "SELECT count(*) FILTER (WHERE regexp_full_match(strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), '\\d{4}-\\d\\d-\\d\\dT\\d\\d:\\d\\d:\\d\\dZ')) AS well_formed, count(*) FILTER (WHERE strptime(strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), '%Y-%m-%dT%H:%M:%SZ') = date_trunc('second', ts)) AS same FROM events",
    "dtm02_periods": f"WITH {_UNITS} SELECT 'week' AS period, strftime(date_trunc('week', ts), '%Y-%m-%d') AS start, CAST(sum(units) AS BIGINT) AS units, count(*) AS n FROM u GROUP BY 2 UNION ALL SELECT 'month', strftime(date_trunc('month', ts), '%Y-%m-%d'), CAST(sum(units) AS BIGINT), count(*) FROM u GROUP BY 2",
    "dtm03_clock_slots": "SELECT CAST(floor(((hour(ts) % 12) * 60 + minute(ts)) / 30 + 0.5) AS BIGINT) % 24 AS slot, count(*) AS n FROM events GROUP BY 1",
    "dtm04_newcomers": f"WITH {_UNITS} SELECT user_id, CAST(sum(units) AS BIGINT) AS units, min(ts) >= TIMESTAMP '2024-01-10' AS newcomer FROM u WHERE ts < TIMESTAMP '2024-01-20' GROUP BY user_id",
}
