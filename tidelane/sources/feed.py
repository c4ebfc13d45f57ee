"""Tolerant reading of timetable feeds (folders of CSV text files, and an area file) into raw rows.

A feed is parsed once: rows are written by feed and file, and every table reads the files it is made of.
Every value stays text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.sources.records import decode, read_records
from tidelane.storage import Tables

#: The files of a feed; ``locations`` is a GeoJSON file, all others CSV.
FILES = ["agency", "stops", "routes", "trips", "calendar", "calendar_dates", "location_groups", "location_group_stops", "stop_times", "booking_rules", "translations", "feed_info", "locations"]


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for own in batches:
        found = [decode(bytes(c)) for c in own["content"]]
        yield pd.DataFrame({"path": own["path"], "text": [t for t, _ in found], "fell_back": [f for _, f in found]})


def _named(path: str = "path") -> list:
    parts = F.split(path, "/")
    return [F.url_decode(F.replace(F.element_at(parts, -2), F.lit("+"), F.lit("%2B"))).alias("feed_id"), F.regexp_replace(F.element_at(parts, -1), r"\.(txt|geojson)$", "").alias("file")]


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """(feed_id, file, row_no, cells, warning) of all ``*.txt`` and ``locations.geojson`` under feed folders, parsed once and kept by feed and file.

    Row 0 stands for the file itself: it is there if the file is, even an empty one, and carries
    ``encoding_fallback``.  Rows with too many or too few cells, or with quotes out of place, are kept
    and carry ``invalid_value``.  The GeoJSON text is the one cell ``geojson`` of its row 1.
    """
    rows, files, used = read_records(spark, path)
    none = F.lit(None).cast("string")
    nothing = F.create_map().cast("map<string,string>")
    folder = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    there = folder.option("pathGlobFilter", "{*.txt,locations.geojson}").load(path).select(F.col("_metadata.file_path").alias("path"))
    fell = files.where("NOT valid").select(*_named(), F.lit("encoding_fallback").alias("warning"))
    areas = folder.option("pathGlobFilter", "locations.geojson").load(path).select(F.col("_metadata.file_path").alias("path"), "content").mapInPandas(_texts, "path string, text string, fell_back boolean")
    areas = areas.select(*_named(), F.explode(F.array(F.struct(F.lit(1).cast("long").alias("row_no"), F.create_map(F.lit("geojson"), F.col("text")).alias("cells"), none.alias("warning")), F.struct(F.lit(0).cast("long").alias("row_no"), nothing.alias("cells"), F.when(F.col("fell_back"), "encoding_fallback").alias("warning")))).alias("x")).select("feed_id", "file", "x.*")
    marks = there.select(*_named()).where("file <> 'locations'").join(fell, ["feed_id", "file"], "left").select("feed_id", "file", F.lit(0).cast("long").alias("row_no"), nothing.alias("cells"), "warning")
    every = rows.select(*_named(), "row_no", "cells", F.when(F.col("flawed"), "invalid_value").alias("warning")).unionByName(marks).unionByName(areas)
    kept = Tables(spark).keep("raw", every.select("row_no", "cells", "warning", "feed_id", "file"), by=("feed_id", "file"))
    used.drop()
    return kept.select("feed_id", "file", "row_no", "cells", "warning")


def locations_of(raw: DataFrame) -> DataFrame:
    """(feed, text) of the ``locations.geojson`` among raw rows."""
    return raw.where("file = 'locations' AND row_no > 0").select(F.col("feed_id").alias("feed"), F.col("cells")["geojson"].alias("text"))


def read_credits(spark: SparkSession, path: str) -> DataFrame:
    """(generated_at, feed_id, provider, credit, license, license_url, source_url) of a JSON manifest of data sources."""
    entry = "struct<feedId: string, providerName: string, creditText: string, licenseId: string, licenseUrl: string, sourceUrl: string>"
    own = spark.read.schema(f"generatedAt string, entries array<{entry}>").json(path, multiLine=True)
    return own.select(F.col("generatedAt").alias("generated_at"), F.explode("entries").alias("e")).select("generated_at", F.col("e.feedId").alias("feed_id"), F.col("e.providerName").alias("provider"), F.col("e.creditText").alias("credit"), F.col("e.licenseId").alias("license"), F.col("e.licenseUrl").alias("license_url"), F.col("e.sourceUrl").alias("source_url"))


def missing_files(raw: DataFrame) -> DataFrame:
    """(feed_id, file) of known files that a feed lacks."""
    feeds = raw.where("row_no = 0").groupBy("feed_id").agg(F.collect_set("file").alias("there"))  # a row for each file of a feed
    lacking = F.array_except(F.array(*(F.lit(f) for f in FILES)), "there")
    return feeds.select("feed_id", F.explode(lacking).alias("file"))


def table_of(raw: DataFrame, file: str, columns: list[str]) -> DataFrame:
    """One file's rows with its columns as text; absent ones are null."""
    own = raw.where((F.col("file") == file) & (F.col("row_no") > 0))
    return own.select("feed_id", "row_no", *(F.col("cells")[c].alias(c) for c in columns))
