"""The pipeline's stages judge rows, whatever their ids."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

rng = random.Random(11)
WORDS = ["".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 7))) for _ in range(400)]
say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
COPY, PASSAGE = say(60), say(30)
OWN = [say(60) for _ in range(4)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(1, PASSAGE)], "item_id int, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out)


def test_near_dedup_by_row(spark, folder):
    rows = [(None, COPY), (None, COPY), (None, OWN[0]), (7, COPY), (7, OWN[1]), (7, OWN[2]), (8, OWN[3]), (8, OWN[3]), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(r.text for r in corpus_pipeline.near_dedup_stage(spark, docs, folder).collect())
    assert got == sorted([COPY, *OWN, ""])
    assert corpus_pipeline.near_dedup_stage(spark, docs.where(F.col("text") == COPY), folder).first().doc_id == 7


def test_decontaminate_by_row(spark, folder):
    rows = [(None, say(5) + " " + PASSAGE), (None, OWN[0]), (7, PASSAGE), (7, OWN[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = corpus_pipeline.decontaminate_stage(spark, docs, folder)
    assert sorted(r.text for r in got.collect()) == sorted(OWN[:2]) and got.columns == docs.columns
    assert got.where(F.col("doc_id").isNull()).count() == 1


def test_near_dedup_from_four_fifths(spark, folder):
    """Copies that share 0.81 of their shingles are one document; at 0.74 they stay two."""
    base = [say(100).split(" ") for _ in range(2)]
    rows = []
    for i, (words, edits) in enumerate(zip(base, ((20, 60), (20, 50, 80)), strict=True)):
        other = [f"edit{k}" if k in edits else w for k, w in enumerate(words)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, folder).collect()) == [0, 2, 3]
