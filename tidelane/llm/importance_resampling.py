"""Resampling towards a target distribution by importance weights over hashed n-grams.

Two Arrow passes.  The first counts features: each partition turns its texts into one vector of
bucket counts (``np.bincount``), and ``treeReduce`` adds the vectors up, so the driver gets a few of
them whatever the number of partitions.  A bucket's gain is the logarithm of its share in the
target over its share in the corpus.  The second pass gathers the broadcast gains (as many
numbers as there are buckets) for each feature and sums them by document, again by
``np.bincount``, with weights.  Gumbel noise, a hash of the document's id, makes the best
scores a draw without replacement; ranks come from a range sort with the counts of the ranges.

Defined cases: null and empty texts have no features and weight 0; they, and texts of fewer
than ``least_words`` words, are never drawn.  Equal scores go to the smaller doc_id (null first),
equal ids to the row with more features, and rows equal in these are ranked one after the other,
in any order.  Repeated rows are drawn on their own each.  Without documents there are no rows;
without target texts every bucket's target count is 0.  A null doc_id is hashed as the text
``<seed>:``.  Other columns pass through, whatever their names; ``n_features``, ``weight``,
``score`` and ``rank`` replace columns of those names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelane.llm.bytetext import ALNUM_SEP, LOWER, Block, blocks, releasing, row_of, small_batches, split_words, utf8_block
from tidelane.llm.checkpoints import Tables
from tidelane.llm.sampling import CRC_STEP, crc_sql
from tidelane.scan import dense_numbers

#: Buckets of features, and the words a document needs to be drawn.
BUCKETS, LEAST_WORDS = 10_000, 20

#: Longest word, in bytes, whose checksum is taken side by side with others; longer ones are few and go one by one.
SHORT = 64


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The checksum's table of bytes, and ``skip[n, k, b]``: byte k of a state being b, carried over n zero bytes."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, np.uint32(0xEDB88320) ^ (step >> np.uint32(1)), step >> np.uint32(1))
    skip = np.zeros((SHORT + 1, 4, 256), np.uint32)
    for k in range(4):
        skip[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(SHORT):
        skip[n + 1] = step[skip[n] & np.uint32(255)] ^ (skip[n] >> np.uint32(8))
    return step, skip


def feature_checksums(data: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """crc32 of every word, and of every two words with a space between that ``first`` says to stand in one text (``first[i]``: word i + 1 has a word before it)."""
    step, skip = _tables()
    size = end - start
    order = np.argsort((SHORT + 1 - np.minimum(size, SHORT + 1)).astype(np.uint8), kind="stable")  # longest first
    state = np.full(len(size), 0xFFFFFFFF, np.uint32)
    many = np.cumsum(np.bincount(np.minimum(size, SHORT + 1), minlength=SHORT + 2)[::-1])[::-1]  # words of at least n bytes
    at, long = start[order], int(many[SHORT + 1])
    own = state.copy()
    for n in range(SHORT):
        upto = int(many[n + 1])
        if upto == long:
            break
        now = own[long:upto]
        own[long:upto] = step[(now ^ data[at[long:upto] + n]) & np.uint32(255)] ^ (now >> np.uint32(8))
    state[order] = own ^ np.uint32(0xFFFFFFFF)
    for i in order[:long]:
        state[i] = zlib.crc32(data[start[i] : end[i]])
    left = np.flatnonzero(first)
    # The checksum of a b is that of a carried over the bytes of b, with that of b added.
    spaced = state[left] ^ np.uint32(0xFFFFFFFF)
    spaced = step[(spaced ^ np.uint32(0x20)) & np.uint32(255)] ^ (spaced >> np.uint32(8)) ^ np.uint32(0xFFFFFFFF)
    width = np.minimum(size[left + 1], SHORT)
    both = state[left + 1].copy()
    for k in range(4):
        both ^= skip[width, k, (spaced >> np.uint32(8 * k)) & np.uint32(255)]
    for j in np.flatnonzero(size[left + 1] > SHORT):
        both[j] = zlib.crc32(data[start[left[j] + 1] : end[left[j] + 1]], int(spaced[j]))
    return state, both


def features(block: Block, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and row of every feature of a block, and the words of each row."""
    data = LOWER[block.data]
    words = split_words(Block(data, block.bounds), ALNUM_SEP)
    rows = row_of(words.bounds)
    follows = rows[1:] == rows[:-1]
    one, two = feature_checksums(data, words.start, words.end, follows)
    bucket = np.concatenate([one, two]) % np.uint32(buckets)
    return bucket.astype(np.int64), np.concatenate([rows, rows[1:][follows]]), words.counts


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, text: str = "text") -> np.ndarray:
    """Features of all texts by bucket."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in blocks(batches):
            total += np.bincount(features(utf8_block(batch.column(0)), buckets)[0], minlength=buckets)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    vectors = docs.select(F.col(text).alias("text")).mapInArrow(releasing(run), "counts binary").rdd
    none = np.zeros(buckets, np.int64)
    each = vectors.mapPartitions(lambda rows: iter([sum((np.frombuffer(r[0], np.int64) for r in rows), none)]))
    return each.treeReduce(np.add, depth=3) if each.getNumPartitions() else none


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of every bucket's smoothed share in the target over that in the corpus."""
    n = len(corpus)
    s_all, t_all = float(corpus.sum() + n), float(target.sum() + n)
    return np.array([floor(1000 * log((float(t) + 1) * s_all / ((float(s) + 1) * t_all))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, text: str = "text") -> DataFrame:
    """``docs`` (with columns packed by the caller) and ``n_words``, ``n_features``, ``weight``: the floored mean gain of the features."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # a number for each bucket
    at, schema = docs.columns.index(text), T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in blocks(batches, text):
            bucket, row, words = features(utf8_block(batch.column(at)), len(own))
            many = np.bincount(row, minlength=batch.num_rows)
            total = np.bincount(row, own[bucket].astype(np.float64), batch.num_rows).astype(np.int64)  # whole numbers, exact in doubles
            mean = np.floor_divide(total, np.maximum(many, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x.astype(np.int64)) for x in (words, many, mean))], schema.names)

    return docs.mapInArrow(releasing(run), schema)


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, seed: int = 7, key: str = "doc_id", text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (default: all) with ``n_features``, ``weight``, ``score`` and ``rank`` (1, 2, ... of the drawn rows, else null), all long.

    Drawn are the floor(``percent`` * N / 100) best scores of the N rows with ``least_words`` words.
    The texts are read twice; the range sort moves numbers and ``columns``.
    """
    small_batches(docs.sparkSession)
    tables = Tables(docs.sparkSession)
    gain = gains(bucket_counts(docs, buckets, text), bucket_counts(target, buckets, text))
    plain = lambda c: F.col("`" + c.replace("`", "``") + "`")
    keep = [c for c in columns or docs.columns if c not in ("n_features", "weight", "score", "rank")]
    packed = docs.select(plain(text).alias("text"), plain(key).alias("key"), F.struct(*map(plain, keep)).alias("own"))
    weighed = weigh(packed, gain).drop("text")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = weighed.withColumns({"score": (F.col("weight") + noise).cast("long"), "able": F.col("n_words") >= least_words})
    order = [F.col("able").desc(), F.col("score").desc(), F.col("key").asc_nulls_first(), F.col("n_features").desc()]
    placed = tables.keep("placed", dense_numbers(scored, order, "place", start=1, tables=tables))
    tables.drop("place_ranges")
    drawn = placed.where("able").count() * percent // 100
    rank = F.when(F.col("able") & (F.col("place") <= drawn), F.col("place"))
    own = [F.col("own").getField(c).alias(c) for c in keep]
    return placed.select(*own, "n_features", "weight", "score", rank.alias("rank"))


_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_CASE = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP12_SQL = f"""
WITH {CRC_STEP}, words AS MATERIALIZED (
  SELECT 0 AS kind, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_CASE}), '{_WORDS}') AS w FROM documents
  UNION ALL SELECT 1, NULL, regexp_extract_all(translate(coalesce(text, ''), {_CASE}), '{_WORDS}') FROM benchmark
), feature AS MATERIALIZED (
  SELECT kind, doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM words
), bucket AS MATERIALIZED (
  SELECT f, {crc_sql("f")} % 10000 AS b FROM (SELECT DISTINCT f FROM feature), step
), counts AS (
  SELECT k.b, count(*) FILTER (WHERE kind = 0) AS s, count(*) FILTER (WHERE kind = 1) AS t FROM feature JOIN bucket k USING (f) GROUP BY 1
), gain AS (
  SELECT b, floor(1000 * ln((t + 1.0::DOUBLE) * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1.0::DOUBLE) * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS g FROM counts
), weighed AS (
  SELECT doc_id, count(*) AS n, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM feature JOIN bucket USING (f) JOIN gain USING (b) WHERE kind = 0 GROUP BY 1
), scored AS (
  SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0) AS weight, len(w) >= 20 AS able,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM words LEFT JOIN weighed USING (doc_id) WHERE kind = 0
), ranked AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, count(*) FILTER (WHERE able) OVER () AS many FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 25 * many // 100 THEN place END AS rank FROM ranked
"""


def op12_importance_resampling(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = resample(docs, target, columns=["doc_id"])
    return found.select("doc_id", "n_features", "weight", "score", "rank")
