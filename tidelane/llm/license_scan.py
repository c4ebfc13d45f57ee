"""License scans by diagonal voting.

All rolling word k-grams of all documents are joined by hash (and, to verify, word by word)
with the positions of the same k-grams in license templates: pairs of words for templates of
fewer than ``LONG`` words, ``GRAM`` words for the others.  A match at word ``pos`` of a
document and ``tpos`` of a template votes for the diagonal ``pos - tpos``; a phrase that
stands unbroken gets all its votes on one diagonal, and inserted or lost words shift the
rest to a neighbouring one.  A long template is found where the k-grams that voted on a
diagonal and the ``NEAR`` diagonals after it cover enough of it; runs never reach farther.
A short one has to stand unbroken, as one word more can name another license.

The templates are a short fixed list, so their positions are broadcast; documents are read
once and only votes are shuffled.  Rows are named by key and content, so a task that is run
again names them alike.

Defined cases: null and empty texts have no words, no labels and score 0.  Overlapping
occurrences count.  Repeated rows are scanned once each; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The phrases whose places are counted, and further notices of the method (label, words).
BASE = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]
NOTICES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc by", "licensed under cc by 4 0"),
    ("cc by nc", "licensed under cc by nc 4 0"),
    ("cc by sa", "licensed under cc by sa 4 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit", "released under the mit license"),
    ("mpl", "subject to the terms of the mozilla public license v 2 0"),
]

#: Words of a gram of templates with LONG words or more, diagonals that are merged, share of such a template that must be covered.
GRAM, LONG, NEAR, COVER = 4, 12, 2, 0.8

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def template_positions(spark, base: list, notices: list, k: int = GRAM, long: int = LONG) -> DataFrame:
    """One row per gram of every template: (template, label, base, strict, grams, tpos, t0..); a short template has pairs, and null beyond."""
    rows = []
    for i, (is_base, label, text) in enumerate([*((True, *x) for x in base), *((False, *x) for x in notices)]):
        words = text.split(" ")
        size = k if len(words) >= long else 2
        if len(words) < 2:
            raise ValueError(f"a template needs two words: {text!r}")
        grams = len(words) - size + 1
        rows.extend((i, label, is_base, size == 2, grams, p, *words[p : p + size], *[None] * (k - size)) for p in range(grams))
    return spark.createDataFrame(rows, "template int, label string, base boolean, strict boolean, grams int, tpos int, " + ", ".join(f"t{j} string" for j in range(k)))


def scan_votes(docs: DataFrame, templates: DataFrame, key: str = "doc_id", text: str = "text", k: int = GRAM) -> DataFrame:
    """Votes of each document (key, ``print``, n_words; ``copies`` rows of it), template and diagonal; one row without a template holds the copies."""
    plain = F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER)
    words = docs.select(F.col(key).alias("key"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("print"), F.filter(F.split(plain, SEPARATORS), lambda w: w != "").alias("w"))
    shifted = [F.col("w"), *(F.slice("w", j + 1, F.greatest(F.size("w") - j, F.lit(0))) for j in range(1, k))]
    # The first entry is no gram: it stands for the document itself.
    zipped = F.concat(F.array(F.lit(None).cast(f"struct<{', '.join(f'w{j}:string' for j in range(k))}>")), F.arrays_zip(*(c.alias(f"w{j}") for j, c in enumerate(shifted))))
    name = ["key", "print", "n_words"]
    grams = words.select("key", "print", F.size("w").cast("long").alias("n_words"), zipped.alias("z")).select(*name, F.posexplode("z").alias("at", "g"))
    grams = grams.select(*name, (F.col("at") - 1).alias("pos"), *(F.col("g").getField(f"w{j}").alias(f"w{j}") for j in range(k))).withColumn("h", F.xxhash64("w0", "w1"))
    same = (F.col("h") == F.col("th")) & (F.col("w0") == F.col("t0")) & (F.col("w1") == F.col("t1"))
    for j in range(2, k):
        same = same & (F.col(f"t{j}").isNull() | (F.col(f"w{j}") == F.col(f"t{j}")))
    hits = grams.join(F.broadcast(templates.withColumn("th", F.xxhash64("t0", "t1"))), same, "left").where("template IS NOT NULL OR pos < 0")
    diagonal = F.when(F.col("template").isNotNull(), F.col("pos") - F.col("tpos"))
    return hits.groupBy(*name, "template", "label", "base", "strict", "grams", diagonal.alias("diagonal")).agg(F.collect_set("tpos").alias("seen"), F.count(F.when(F.col("pos") < 0, 1)).alias("copies"))


def scan_licenses(docs: DataFrame, base: list = BASE, notices: list = NOTICES, key: str = "doc_id", text: str = "text", k: int = GRAM, near: int = NEAR, cover: float = COVER) -> DataFrame:
    """One row per document: n_words, n_base, first_word, last_word, base_labels, labels, score and ``spans``.

    ``spans``: (label, first_word, n_words, cover) of every template found, base phrases included.
    """
    name = ["key", "print", "n_words"]
    votes = scan_votes(docs, template_positions(docs.sparkSession, base, notices, k), key, text, k)
    along = Window.partitionBy(*name, "template").orderBy("diagonal")
    merged = F.array_distinct(F.flatten(F.collect_list("seen").over(along.rangeBetween(0, near))))
    votes = votes.withColumn("seen", F.when(F.col("template").isNull() | F.col("strict"), F.col("seen")).otherwise(merged))
    votes = votes.withColumn("cover", F.when(F.col("template").isNotNull(), F.size("seen") / F.col("grams")))
    votes = votes.withColumn("hit", F.coalesce(F.col("cover") >= F.when(F.col("strict"), 1.0).otherwise(cover), F.lit(False)))
    rank = F.struct("cover", -F.col("diagonal"))
    best = F.col("hit") & (F.col("strict") | (F.max(F.when(F.col("hit"), rank)).over(along.rangeBetween(-near, near)) == rank))
    found = votes.withColumn("best", best)
    place = F.col("base") & F.col("hit")
    start = F.col("diagonal").cast("long")
    span = F.struct("label", (start + F.array_min("seen")).alias("first_word"), (F.array_max("seen") - F.array_min("seen") + F.when(F.col("strict"), 2).otherwise(k)).cast("long").alias("n_words"), "cover")
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(F.when(c, F.col("label")))), ",")
    each = found.groupBy(*name).agg(
        F.count(F.when(place, 1)).alias("n_base"), F.min(F.when(place, start)).alias("first_word"), F.max(F.when(place, start)).alias("last_word"),
        joined(place).alias("base_labels"), joined(F.col("hit")).alias("labels"), F.coalesce(F.max("cover"), F.lit(0.0)).alias("score"),
        F.sort_array(F.collect_list(F.when(F.col("best"), span))).alias("spans"), F.sum("copies").alias("copies"),
    )
    rows = each.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows.select(F.col("key").alias(key), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


_TEMPLATES = ", ".join(f"({i}, '{label}', {b}, '{text}')" for i, (b, label, text) in enumerate([*(("true", *x) for x in BASE), *(("false", *x) for x in NOTICES)]))
OP2_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{SEPARATORS}'), lambda x: x <> '') AS w FROM documents),
t0(template, label, base, txt) AS (VALUES {_TEMPLATES}),
t1 AS (SELECT template, label, base, string_split(txt, ' ') AS w, CASE WHEN len(string_split(txt, ' ')) < {LONG} THEN 2 ELSE {GRAM} END AS k FROM t0),
t AS (SELECT template, label, base, k, len(w) - k + 1 AS grams, p - 1 AS tpos, w[p] AS a, w[p + 1] AS b, array_to_string(w[p:p + k - 1], ' ') AS gram FROM (SELECT *, unnest(generate_series(1, len(w) - k + 1)) AS p FROM t1)),
g AS (SELECT rid, p - 1 AS pos, w[p] AS a, w[p + 1] AS b, w[p:p + {GRAM - 1}] AS ws FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 1)) AS p FROM d WHERE len(w) > 1)),
v AS (SELECT rid, template, label, base, k, grams, pos - tpos AS diagonal, tpos FROM g JOIN t USING (a, b) WHERE array_to_string(ws[1:k], ' ') = gram),
n AS (SELECT DISTINCT rid, template, diagonal FROM v),
f AS (SELECT n.rid, n.diagonal, v.label, v.base, v.k, count(DISTINCT v.tpos) / v.grams AS cover
      FROM n JOIN v ON v.rid = n.rid AND v.template = n.template AND v.diagonal BETWEEN n.diagonal AND n.diagonal + CASE WHEN v.k = 2 THEN 0 ELSE {NEAR} END
      GROUP BY n.rid, n.template, n.diagonal, v.label, v.base, v.k, v.grams),
h AS (SELECT *, cover >= CASE WHEN k = 2 THEN 1 ELSE {COVER} END AS hit FROM f)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, count(*) FILTER (WHERE base AND hit) AS n_base,
       CAST(min(diagonal) FILTER (WHERE base AND hit) AS BIGINT) AS first_word, CAST(max(diagonal) FILTER (WHERE base AND hit) AS BIGINT) AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base AND hit), '') AS base_labels,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE hit), '') AS labels,
       CAST(coalesce(max(cover), 0) AS DOUBLE) AS score
FROM d LEFT JOIN h USING (rid) GROUP BY d.rid, d.doc_id, d.w
"""
