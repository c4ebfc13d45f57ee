"""Bounded, deterministic samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def crc_mod(key: str, n: int) -> Column:
    """crc32 of the key written as text, modulo n; a null key counts as the text ''."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % n


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, usable: Column | None = None) -> DataFrame:
    """At most ``bound`` documents with a 0/1 label: (doc_id, text, label, rank), ``rank`` from 1.

    The labels with the smallest hash of doc_id are taken, so the sample depends on ids
    alone, whatever their type.  A null doc_id or label is no label; of repeated labels the
    smallest holds, and of repeated documents the smallest text.  Only this bounded list of ids is
    broadcast to the scan of the texts.
    """
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    if usable is not None:
        ids = ids.where(usable)
    ids = ids.groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    ids = ids.withColumn("rank", F.row_number().over(Window.orderBy(F.xxhash64("doc_id"), "doc_id")).cast("long"))  # bounded rows
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return found.groupBy("doc_id", "label", "rank").agg(F.min("text").alias("text")).select("doc_id", "text", "label", "rank")


#: crc32 written out in SQL, for the queries' SQL: a CTE with the table of bytes, and the fold over the bytes of a text.
CRC_STEP = "step AS (SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY b) AS own FROM range(256) t(b))"


def crc_sql(text: str) -> str:
    """crc32 of a text's UTF-8 bytes, where ``step`` is joined."""
    byte = f"('0x' || hex(encode({text}))[2 * i + 1 : 2 * i + 2])::BIGINT"
    seen = f"list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode({text}))), lambda i: {byte}))"
    return f"xor(4294967295, list_reduce({seen}, lambda c, b: xor(step.own[(xor(c, b) & 255) + 1], c >> 8)))"
