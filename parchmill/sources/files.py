"""Other scans: pinned files, code tables in CSV, image manifests in JSON, nested record collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "items ARRAY<STRUCT<id: STRING, label: MAP<STRING, ARRAY<STRING>>, width: INT, height: INT, items: ARRAY<STRUCT<items: ARRAY<STRUCT<body: STRUCT<id: STRING, service: ARRAY<STRUCT<id: STRING, `@id`: STRING>>>>>>>>>"


def pinned(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """(file, sha256, bytes, status) of files against a manifest (file, sha256, bytes): ok, changed, missing or unlisted."""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))
    want = manifest.select("file", F.col("sha256").alias("_s"), F.col("bytes").cast("long").alias("_b"))
    status = F.when(F.col("_s").isNull(), "unlisted").when(F.col("sha256").isNull(), "missing").when((F.col("sha256") == F.col("_s")) & (F.col("bytes") == F.col("_b")), "ok").otherwise("changed")
    return files.join(want, "file", "full").select("file", "sha256", "bytes", status.alias("status"))


def code_table(spark: SparkSession, path: str) -> DataFrame:
    """(role, table, label, glyphs) of a CSV with the columns code and glyphs; of equal glyphs in a role the last row wins.

    A code is role_label_table. Raises if the header is another one.
    """
    raw = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("v"), F.monotonically_increasing_id().alias("n"))
    if (first := raw.orderBy("n").first()) is None or first["v"].strip() != "code,glyphs":
        raise ValueError("the header must be code,glyphs")
    rows = raw.where("n > 0 AND v <> ''").select("n", F.from_csv("v", "code STRING, glyphs STRING").alias("r")).select("n", "r.*")
    parts = F.split("code", "_")
    rows = rows.select("n", parts[0].alias("role"), F.element_at(parts, -2).alias("label"), F.element_at(parts, -1).alias("table"), "glyphs")
    return rows.groupBy("role", "glyphs").agg(F.max(F.struct("n", "table", "label")).alias("r")).select("role", "r.table", "r.label", "glyphs")


def canvases(manifest: DataFrame, column: str = "json") -> DataFrame:
    """(ordinal, label, canvas_id, image_id, image_service_id, width, height) of image manifests given as JSON text.

    The label is that without language, else the English one, else the first.
    """
    m = manifest.select(F.posexplode(F.from_json(column, MANIFEST)["items"]).alias("ordinal", "c"))
    labels = F.col("c.label")
    label = F.coalesce(F.try_element_at(labels, F.lit("none")), F.try_element_at(labels, F.lit("en")), F.try_element_at(F.map_values(labels), F.lit(1)))
    body = F.col("c.items")[0]["items"][0]["body"]
    service = F.coalesce(body["service"][0]["id"], body["service"][0]["@id"])
    return m.select("ordinal", F.try_element_at(label, F.lit(1)).alias("label"), F.col("c.id").alias("canvas_id"), body["id"].alias("image_id"), service.alias("image_service_id"), F.col("c.width").alias("width"), F.col("c.height").alias("height"))


def lifted(records: DataFrame, nested: str, *keys: str) -> DataFrame:
    """A row per member of a nested collection, with the keys of the record that holds it; records without members give none."""
    return records.select(*keys, F.explode(nested).alias("_m")).select(*keys, "_m.*")


def repeated_keys(records: DataFrame, key: str) -> DataFrame:
    """(key, n) of the keys that more than one record has; a collection is sound if there are none."""
    return records.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def records(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """Records of all JSON files below ``path``, single ones and arrays, or one a line, with the file they come from."""
    return spark.read.schema(schema).option("multiLine", not lines).option("recursiveFileLookup", True).json(path).withColumn("file", F.col("_metadata.file_name"))
