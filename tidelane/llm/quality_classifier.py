"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its hashed features: each word, the word's
byte 3- and 4-grams within word marks, each pair of neighbouring words, and one shared
feature for a word that equals the word before it.  A linear layer with softmax follows;
vectors and layer are trained together by stochastic gradient descent in numpy on a bounded
sample of labelled rows, by one task.  As the layer is linear, scoring folds it into one number per
feature, and per distinct word of a block into one sum, so a text costs a gather and a sum.

Defined cases: null and empty texts have no feature and get the softmax of the biases.
Repeated rows are scored once each; extra columns pass through, but for columns that are
named as the added ones.  With labels of one kind
only (or none) the score is the smoothed share of good labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelane.llm.bytetext import SPACE_SEP, Block, any_names, blocks, mix, releasing, row_of, small_batches, span_hashes, split_words, utf8_block
from tidelane.llm.sampling import crc_mod, labelled_sample

#: Feature vectors, their width, and the sizes of byte n-grams.
BUCKETS, WIDTH, GRAMS = 1 << 17, 10, (3, 4)

#: Labelled documents that the classifier is trained on, at most; epochs; rate of learning.
TRAIN_ROWS, EPOCHS, RATE = 3000, 8, 0.5

#: Distinct (document, feature) pairs that are trained on, at most: 8 bytes each.
TRAIN_ENTRIES = 16_000_000

#: A document is good from this score on.
GOOD_AT = 0.3

_REPEAT = 0  # the bucket of a word that equals its predecessor


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(40)).astype(np.int64) % (BUCKETS - 1) + 1


@dataclass
class Features:
    """Distinct words of a block: ``inverse`` maps words to them; word u has buckets ``bucket[bounds[u]:bounds[u + 1]]``; ``pair`` is the bucket of each word with its predecessor, -1 for a row's first."""

    rows: np.ndarray
    row_bounds: np.ndarray
    inverse: np.ndarray
    bucket: np.ndarray
    bounds: np.ndarray
    pair: np.ndarray


def features(block: Block) -> Features:
    words = split_words(block, SPACE_SEP)
    rows = row_of(words.bounds)
    hashes = span_hashes(block.data, words.start, words.end)
    distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    start, length = words.start[first], words.end[first] - words.start[first]
    # Distinct words side by side, each between two zero bytes as marks.
    bounds = np.concatenate([[0], np.cumsum(length + 2)]).astype(np.int64)
    data = np.zeros(bounds[-1], np.uint8)
    put = np.repeat(bounds[:-1] + 1 - start, length) + (within := np.repeat(start, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length))
    data[put] = block.data[within]
    owner, buckets = [np.arange(len(distinct))], [_bucket(distinct)]
    word_of = row_of(bounds)
    for n in GRAMS:
        at = np.flatnonzero(word_of[: len(word_of) - n + 1] == word_of[n - 1 :]) if len(data) >= n else np.zeros(0, np.int64)
        owner.append(word_of[at])
        buckets.append(_bucket(mix(span_hashes(data, at, at + n) + np.uint64(n))))
    owner, buckets = np.concatenate(owner), np.concatenate(buckets)
    order = np.argsort(owner, kind="stable")
    pair = np.full(len(hashes), -1, np.int64)
    if len(hashes) > 1:
        follows = rows[1:] == rows[:-1]
        joint = _bucket(mix(hashes[1:] * np.uint64(3) + hashes[:-1]))
        pair[1:] = np.where(follows, np.where(hashes[1:] == hashes[:-1], _REPEAT, joint), -1)
    return Features(rows, words.bounds, inverse, buckets[order], np.searchsorted(owner[order], np.arange(len(distinct) + 1)), pair)


@dataclass
class Classifier:
    """``gain[b]``: what feature b adds to the log odds of good quality before averaging; ``bias``: the log odds without features."""

    gain: np.ndarray
    bias: float

    def score(self, block: Block) -> np.ndarray:
        f = features(block)
        sums = np.concatenate([[0.0], np.cumsum(self.gain[f.bucket], dtype=np.float64)])
        per_word = sums[f.bounds[1:]] - sums[f.bounds[:-1]]
        many = np.diff(f.bounds)
        value = per_word[f.inverse] + np.where(f.pair >= 0, self.gain[np.maximum(f.pair, 0)], 0)
        count = many[f.inverse] + (f.pair >= 0)
        n = len(block)
        total = np.bincount(f.rows, value, n)
        odds = self.bias + total / np.maximum(np.bincount(f.rows, count, n), 1)
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


def train_frame(sample: DataFrame) -> DataFrame:
    """(rank, label, distinct buckets, their counts) of sampled texts."""
    schema = "rank long, label int, buckets array<int>, counts array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            f = features(utf8_block(batch.column(1)))
            many = np.diff(f.bounds)
            buckets, counts = [], []
            for a, b in zip(f.row_bounds[:-1], f.row_bounds[1:], strict=True):
                own = f.inverse[a:b]
                words, times = np.unique(own, return_counts=True)
                parts = [f.bucket[f.bounds[w] : f.bounds[w + 1]] for w in words]
                pairs = f.pair[a:b]
                each = np.concatenate([*parts, pairs[pairs >= 0], np.zeros(0, np.int64)])
                weight = np.concatenate([np.repeat(times, many[words]), np.ones((pairs >= 0).sum(), np.int64)])
                ids, back = np.unique(each, return_inverse=True)
                buckets.append(ids.astype(np.int32))
                counts.append(np.bincount(back, weight, len(ids)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(buckets, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], ["rank", "label", "buckets", "counts"])

    return sample.select("rank", "text", "label").mapInArrow(releasing(run), schema)


def fit(samples: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> Classifier:
    """Train vectors and layer on (buckets, counts, label) samples by plain SGD with a falling rate."""
    labels = np.array([y for *_, y in samples], np.float64)
    good = (labels.sum() + 1) / (len(labels) + 2)
    if len(set(labels.tolist())) < 2:
        return Classifier(np.zeros(BUCKETS, np.float32), float(np.log(good / (1 - good))))
    draw = np.random.default_rng(seed)
    vectors = draw.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    layer, bias = np.zeros((2, WIDTH), np.float32), np.array([np.log(1 - good), np.log(good)], np.float32)
    steps, done = epochs * len(samples), 0
    for _ in range(epochs):
        for i in draw.permutation(len(samples)):
            now = rate * (1 - done / steps)
            done += 1
            buckets, counts, y = samples[i]
            if not len(buckets):
                continue
            share = (counts / counts.sum()).astype(np.float32)
            hidden = share @ vectors[buckets]
            z = layer @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = p @ layer
            layer -= now * np.outer(p, hidden)
            bias -= now * 0.1 * p
            vectors[buckets] -= (now * len(buckets) ** 0.5) * share[:, None] * back
    return Classifier((vectors @ (layer[1] - layer[0])).astype(np.float32), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS, usable=None, entries: int = TRAIN_ENTRIES) -> Classifier:
    """Train on at most ``bound`` labelled documents, in the order of the sample, whose features have ``entries`` distinct buckets together at most.

    One task fits the model from these feature counts; only its ``BUCKETS`` gains and the bias reach the driver.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples, held = [], 0
        for batch in batches:
            for buckets, counts, label in zip(batch.column(2), batch.column(3), batch.column(1), strict=True):
                held += len(buckets)
                if held <= entries or not samples:
                    samples.append((buckets.values.to_numpy().copy(), counts.values.to_numpy().copy(), label.as_py()))
        model = fit(samples)
        yield pa.RecordBatch.from_arrays([pa.array([model.gain.tobytes()]), pa.array([model.bias])], ["gain", "bias"])

    rows = train_frame(labelled_sample(docs, labels, "quality", bound, usable)).repartition(1).sortWithinPartitions("rank")
    model = rows.mapInArrow(releasing(run), "gain binary, bias double").first()
    return Classifier(np.frombuffer(model["gain"], np.float32), model["bias"]) if model else fit([])


@any_names("score", "predicted")
def score(docs: DataFrame, model: Classifier, text: str = "text", good_at: float = GOOD_AT) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``; one pass, no shuffle."""
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    at = keep.index(text)
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, text):
            p = shared.value.score(utf8_block(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= good_at).astype(np.int32))], schema.names)

    return docs.select(*keep).mapInArrow(releasing(run), schema)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), usable=crc_mod("doc_id", 5) != 0)
    return score(docs, model).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
