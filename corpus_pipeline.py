"""A corpus pipeline: quality, near-duplicates, repeated passages, benchmark passages, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``.  The near-duplicate and decontamination stages judge rows, not ids:
rows without a doc_id, or with the same one, are kept or dropped each by its own text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.llm import bpe, decontaminate, minhash, quality_classifier, suffix_dedup
from tidelane.llm.checkpoints import Tables, dropped_after
from tidelane.llm.sampling import crc_mod


#: Column that names the rows of a stage.
ROW = "__row"

#: Percent of the five-word shingles that near copies share at least.
NEAR_LIMIT = 80


def packed(docs: DataFrame) -> DataFrame:
    """doc_id and text, and all other columns in ``rest``, where no operator's names can clash with theirs."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*others or [F.lit(None).cast("int").alias("none")]).alias("rest"))


def unpacked(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs`` again, some of them ``changed``."""
    plain = lambda c: F.col(c) if c in ("doc_id", "text") else F.col("rest").getField(c)
    return rows.select(*(changed.get(c, plain(c)).alias(c) for c in docs.columns))


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a column ROW that names each row; written before use, so that it holds when tasks are rerun."""
    return Tables(docs.sparkSession).keep("rows", packed(docs).withColumn(ROW, F.monotonically_increasing_id()))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    model = quality_classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), usable=crc_mod("doc_id", 5) != 0)
    return unpacked(quality_classifier.score(packed(docs), model).where("predicted = 1"), docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the least doc_id."""
    rows = numbered(docs)
    judged = minhash.near_duplicates(rows, key=ROW, limit=NEAR_LIMIT).select(ROW, "component_id").join(rows.select(ROW, "doc_id"), ROW)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", ROW))
    kept = judged.groupBy("component_id").agg(first.alias("first")).select(F.col("first").getField(ROW).alias(ROW))
    return unpacked(rows.join(kept, ROW, "left_semi"), docs)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that stand earlier; a character that a passage cuts in two goes as well."""
    cut = suffix_dedup.suffix_dedup(packed(docs), whole_characters=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept").cast("string")).otherwise(F.col("text"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("n_removed") > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("rest.n_chars"))
    return unpacked(cut, docs, **changed)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    rows = numbered(docs)
    found = decontaminate.decontaminate(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key=ROW)
    return unpacked(rows.join(found.where("n_hit > 0").select(ROW), ROW, "left_anti"), docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their ``token_ids``, ``n_tokens`` and ``round_trip`` (decoding gives the text back); columns of these names are replaced."""
    out = bpe.encode_documents(packed(docs))
    same = F.col("decoded").eqNullSafe(F.coalesce("text", F.lit("")))
    added = {"token_ids": F.col("token_ids"), "n_tokens": F.size("token_ids").cast("long"), "round_trip": same}
    plain = {c: F.col(c) if c in ("doc_id", "text") else F.col("rest").getField(c) for c in docs.columns if c not in added}
    return out.select(*(value.alias(c) for c, value in (plain | added).items()))


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("suffix-array dedup", suffix_dedup_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("BPE encoding and decoding", bpe_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written as Parquet and read again; what a stage has used goes once its result is written."""
    docs, tables = spark.read.parquet(f"{sf_dir}/documents.parquet"), Tables(spark)
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with dropped_after():
            docs = tables.keep(str(k), stage(spark, docs, sf_dir))
        if k:
            tables.drop(str(k - 1))
    return STAGES[-1][1](spark, docs, sf_dir)
