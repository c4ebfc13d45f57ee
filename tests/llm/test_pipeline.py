"""The five stages of the pipeline: nulls, repeated rows and ids, empty tables, clashing columns, long texts; each against brute force or a stated result."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidelane.llm import minhash

rng = random.Random(23)
WORDS = ["".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 7))) for _ in range(500)]
say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
GOOD = [say(60) for _ in range(40)]
BAD = [" ".join(w + "$$$" for w in say(60).split(" ")) for _ in range(40)]
PASSAGE, ITEM, LONG = say(70), say(30), say(420_000)
TEXTS = [*GOOD, GOOD[0], GOOD[1] + " tail", say(9) + " " + PASSAGE, say(12) + " " + PASSAGE + " ü" + say(3), say(5) + " " + ITEM + " " + say(5), None, "", LONG, "ñandú� " + say(30)]
#: Names that operators use within.
CLASHES = ["score", "predicted", "kept", "n_bytes", "n_removed", "n_spans", "component_id", "node", "doc", "starts", "stops", "__order", "__row", "rest", "hits", "place", "row", "key", "decoded", "label", "rank", "id"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, float(i), "own") for i, t in enumerate([*TEXTS, *BAD])]
    rows += [(3, "an other text of the same id " + say(30), 0.5, "own"), rows[5], (None, GOOD[7], 0.5, None), (None, say(40), None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, kept string").withColumn("n_chars", F.length("text"))
    docs.withColumns({c: F.lit("x") for c in CLASHES if c not in docs.columns}).repartition(3).write.parquet(f"{out}/documents.parquet")
    labels = [(i, int(i < len(TEXTS))) for i in range(len(TEXTS) + len(BAD)) if i not in (45, 46)]
    spark.createDataFrame([*labels, (None, 1), (2, None)], "doc_id long, quality int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (None, "")], "item_id int, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def ids(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in df.select("doc_id", "text").collect())


def unchanged(got, docs, texts_change=False):
    """Columns as before, and each row as it was."""
    assert got.columns == docs.columns
    own = [c for c in docs.columns if not (texts_change and c in ("text", "n_chars"))]
    assert got.select(own).exceptAll(docs.select(own)).count() == 0


def test_quality_stage(spark, docs, folder):
    got = corpus_pipeline.quality_stage(spark, docs, folder)
    unchanged(got, docs)
    left = {r.text for r in got.collect()}
    assert sum(t in left for t in GOOD) >= 38 and sum(t in left for t in BAD) <= 2


def test_near_dedup_stage(spark, docs, folder):
    got = corpus_pipeline.near_dedup_stage(spark, docs, folder)
    unchanged(got, docs)
    left = ids(got)
    assert len(left) == len(set(left))
    # GOOD[0] and GOOD[1] came twice, row 5 twice, GOOD[7] again without an id.
    assert len(left) == docs.count() - 4 and not any(i == 40 or i == 41 for _, i, _ in left)
    assert sum(i == 3 for _, i, _ in left) == 2 and sum(n for n, *_ in left) == 1


def test_suffix_dedup_stage(spark, docs, folder):
    rows = docs.where("doc_id < 49").dropDuplicates(["doc_id"])
    got = {r.doc_id: r for r in corpus_pipeline.suffix_dedup_stage(spark, rows, folder).collect()}
    unchanged(corpus_pipeline.suffix_dedup_stage(spark, rows, folder), rows, True)
    assert got[42].text == TEXTS[42] and PASSAGE not in got[43].text and len(got[43].text) < 100
    assert got[43].n_chars == len(got[43].text) and got[48].text == TEXTS[48] and got[47].text == LONG and got[45].text is None and got[40].text == ""


def test_suffix_dedup_stage_keeps_whole_characters(spark, folder):
    """The removed bytes begin within one character and end within another; what was no text before stays."""
    shared = "".join(rng.choice("abcdefghijk") for _ in range(120))
    rows = [(1, "é" + shared + "é" + "�"), (2, "�ã" + shared + "ê" + "end")]  # é, ã and ê share a first byte
    got = {r.doc_id: r.text for r in corpus_pipeline.suffix_dedup_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), folder).collect()}
    assert got[1] == rows[0][1] and got[2] == "�ãend"


def test_decontaminate_stage(spark, docs, folder):
    got = corpus_pipeline.decontaminate_stage(spark, docs, folder)
    unchanged(got, docs)
    assert ids(got) == [x for x in ids(docs) if ITEM not in x[2]]


def test_bpe_stage(spark, docs, folder):
    got = corpus_pipeline.bpe_stage(spark, docs, folder)
    assert got.where("NOT round_trip").count() == 0 and got.count() == docs.count()
    assert got.columns == [*docs.columns, "token_ids", "n_tokens", "round_trip"]


def test_run_and_empty_tables(spark, docs, folder, tmp_path):
    whole = corpus_pipeline.run(spark, folder)
    assert 30 < whole.count() < docs.count() and whole.where("NOT round_trip").count() == 0
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").where("false").coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_ties_and_hot_lists(spark):
    """Many equal texts, and a passage in all others: groups stay apart, and each is named by its least id."""
    rows = [(i, PASSAGE) for i in range(40)] + [(100 + i, PASSAGE + " " + say(60)) for i in range(60)]
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[i] == 0 for i in range(40)) and all(found[100 + i] == 100 + i for i in range(60))
