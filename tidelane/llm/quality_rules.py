"""Quality rules: gradient-boosted trees over document statistics.

Statistics are computed by one vectorised pass over each block of texts.  Trees are grown
on histograms of a bounded labelled sample, by Newton steps on the logistic loss, with
monotonic constraints on chosen statistics (a split that breaks one is not taken, and
children inherit bounds on their values).  The forest is flattened into numpy node arrays,
so scoring moves all rows one level down at a time.

Defined cases: a null text counts as empty; a text without words fails the base rules.
Repeated rows are judged once each, extra columns pass through.  Without labels of both
kinds the forest is a constant and the base rules decide alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelane.llm.bytetext import SPACE_SEP, Block, any_names, blocks, gram_hashes, mix, releasing, row_of, small_batches, span_hashes, split_words, utf8_block
from tidelane.llm.sampling import labelled_sample

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: Statistics the trees see; the constraint is the sign in which quality may move with it.
FEATURES = {
    "log_words": 0, "word_length": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1, "punct_share": 0,
    "digit_share": 0, "distinct_share": 0, "same_as_previous_share": -1, "pipe_share": -1, "bang_share": -1, "words_per_line": 0, "high_byte_share": 0,
}

#: A document is kept where the forest's probability of good quality reaches this.
KEEP_AT = 0.3

#: Documents that the forest is fitted on, at most.
TRAIN_ROWS = 6000

WINDOW = 8

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def _per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Flags of the entries whose key stands more than once."""
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def statistics(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(rows x COUNTS) integers and (rows x FEATURES) doubles."""
    data, bounds, n = block.data, block.bounds, len(block)
    words = split_words(block, SPACE_SEP)
    n_words = words.counts
    rows = row_of(words.bounds)
    hashes = span_hashes(data, words.start, words.end)
    starts_char = (data & 0xC0) != 0x80
    word_chars = _per_row(starts_char & ~SPACE_SEP[data], bounds)
    n_symbols = _per_row(_SYMBOL[data], bounds)

    breaks = np.zeros(len(data) + 1, bool)
    breaks[bounds] = True
    newline = data == 10
    line_end = np.flatnonzero(newline | breaks[1:])
    line_start = np.concatenate([[0], line_end[:-1] + 1]) if len(line_end) else line_end
    line_stop = np.where(newline[line_end], line_end, line_end + 1)
    with_word = np.searchsorted(words.start, line_stop) > np.searchsorted(words.start, line_start)
    line_start, line_stop = line_start[with_word], line_stop[with_word]
    line_row = np.searchsorted(bounds, line_start, "right") - 1
    line_key = mix(span_hashes(data, line_start, line_stop) ^ mix(line_row.astype(np.uint64)))
    first = np.unique(line_key, return_index=True)[1]
    n_lines = np.bincount(line_row, minlength=n)
    n_dup_lines = n_lines - np.bincount(line_row[first], minlength=n)

    repeated = np.zeros(len(hashes) + 1, np.int64)
    if len(hashes) >= WINDOW:
        at = np.flatnonzero(rows[: len(rows) - WINDOW + 1] == rows[WINDOW - 1 :])
        again = at[_repeats(mix(gram_hashes(hashes, WINDOW)[at] ^ mix(rows[at].astype(np.uint64))))]
        np.add.at(repeated, again, 1)
        np.add.at(repeated, again + WINDOW, -1)
    n_repeat_words = _per_row(np.cumsum(repeated[:-1]) > 0, words.bounds)

    own = np.unique(mix(hashes ^ mix(rows.astype(np.uint64))), return_index=True)[1]
    n_distinct = np.bincount(rows[own], minlength=n)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    letters, n_bytes = _per_row(_LETTER[data], bounds), np.diff(bounds)
    share = lambda a, b: a / np.maximum(b, 1)
    counts = np.column_stack([n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words]).astype(np.int64)
    features = np.column_stack([
        np.log1p(n_words), share(word_chars, n_words), share(n_symbols, n_words), share(n_dup_lines, n_lines), share(n_repeat_words, n_words),
        share(_per_row(_UPPER[data], bounds), letters), share(n_bytes - letters - _per_row(SPACE_SEP[data] | _DIGIT[data], bounds), n_words),
        share(_per_row(_DIGIT[data], bounds), n_bytes), share(n_distinct, n_words), share(_per_row(same, words.bounds), n_words),
        share(_per_row(data == ord("|"), bounds), n_words), share(_per_row(data == ord("!"), bounds), n_words), share(n_words, n_lines), share(_per_row(data >= 128, bounds), n_bytes),
    ]).astype(np.float64)
    return counts, features


@dataclass
class Forest:
    """All trees' nodes side by side: node i splits on ``feature[i]`` (-1: leaf) at ``cut[i]``; its children are ``left[i]`` and ``left[i] + 1``."""

    base: float
    roots: list[int] = field(default_factory=list)
    feature: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    cut: np.ndarray = field(default_factory=lambda: np.zeros(0))
    left: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))
    depth: int = 0

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        each = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root, np.int32)
            for _ in range(self.depth):
                f = self.feature[node]
                node = np.where(f < 0, node, self.left[node] + (x[each, np.maximum(f, 0)] > self.cut[node]))
            out += self.value[node]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, constraints: list[int], trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: int = 8) -> Forest:
    """Newton boosting of the logistic loss with histogram splits and monotonic constraints."""
    y = np.asarray(y, np.float64)
    if not len(y) or y.min() == y.max():
        return Forest(base=float(np.clip(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)), -6, 6)) if len(y) else 0.0)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])
    nodes: list[list] = []  # feature, cut, left, value
    forest = Forest(base=float(np.log(y.mean() / (1 - y.mean()))), depth=depth)
    margin = np.full(len(y), forest.base)

    def grow(at: int, rows: np.ndarray, low: float, high: float, level: int) -> None:
        g, h = grad[rows], hess[rows]
        total_g, total_h = g.sum(), h.sum()
        nodes[at][3] = rate * float(np.clip(-total_g / (total_h + l2), low, high))
        best = (1e-6, None)
        if level < depth and len(rows) >= 2 * least:
            for j, e in enumerate(edges):
                b = binned[rows, j]
                gl = np.cumsum(np.bincount(b, g, len(e) + 1))[:-1]
                hl = np.cumsum(np.bincount(b, h, len(e) + 1))[:-1]
                nl = np.cumsum(np.bincount(b, minlength=len(e) + 1))[:-1]
                vl, vr = np.clip(-gl / (hl + l2), low, high), np.clip(-(total_g - gl) / (total_h - hl + l2), low, high)
                gain = lambda a, b, v: -(a * v + 0.5 * (b + l2) * v * v)
                won = gain(gl, hl, vl) + gain(total_g - gl, total_h - hl, vr) - gain(total_g, total_h, np.clip(-total_g / (total_h + l2), low, high))
                won[(nl < least) | (len(rows) - nl < least) | (constraints[j] * (vr - vl) < 0)] = -1
                if len(won) and won.max() > best[0]:
                    k = int(won.argmax())
                    best = (won[k], (j, k, vl[k], vr[k]))
        if best[1] is None:
            return
        j, k, vl, vr = best[1]
        child = len(nodes)
        nodes[at][:3] = [j, float(edges[j][k]), child]
        nodes.extend([[-1, 0.0, -1, 0.0], [-1, 0.0, -1, 0.0]])
        middle, goes_left = (vl + vr) / 2, binned[rows, j] <= k
        bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[constraints[j]]
        grow(child, rows[goes_left], *bounds[0], level + 1)
        grow(child + 1, rows[~goes_left], *bounds[1], level + 1)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        forest.roots.append(len(nodes))
        nodes.append([-1, 0.0, -1, 0.0])
        grow(forest.roots[-1], np.arange(len(y)), -np.inf, np.inf, 0)
        one = Forest(0.0, [forest.roots[-1]], *(np.array(c) for c in zip(*nodes, strict=True)), depth=depth)
        margin += one.margin(x)
    forest.feature, forest.cut, forest.left, forest.value = (np.array(c) for c in zip(*nodes, strict=True))
    return forest


def _stats_frame(docs: DataFrame, text: str, with_features: bool) -> DataFrame:
    extra = [T.StructField("features", T.ArrayType(T.DoubleType()))] if with_features else []
    keep = [c for c in docs.columns if c != text]
    at = docs.columns.index(text)
    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(c, T.LongType()) for c in COUNTS), *extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, text):
            counts, features = statistics(utf8_block(batch.column(at)))
            cols = [batch.column(i) for i in range(batch.num_columns) if i != at] + [pa.array(counts[:, j]) for j in range(counts.shape[1])]
            if with_features:
                ends = np.arange(0, features.size + 1, features.shape[1], dtype=np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(features.ravel())))
            yield pa.RecordBatch.from_arrays(cols, schema.names)

    return docs.mapInArrow(releasing(run), schema)


def train(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> Forest:
    """Fit the forest on at most ``bound`` labelled documents (their statistics alone reach the driver)."""
    small_batches(docs.sparkSession)
    sample = _stats_frame(labelled_sample(docs, labels, "quality", bound), "text", True)
    rows = sample.select("rank", "label", "features").toArrow()
    order = np.argsort(rows["rank"].to_numpy())
    x = np.array(rows["features"].to_pylist(), np.float64).reshape(rows.num_rows, len(FEATURES))[order]
    return fit(x, rows["label"].to_numpy()[order], list(FEATURES.values()))


@any_names(*COUNTS, "base_failed", "quality_score", "kept")
def judge(docs: DataFrame, forest: Forest, text: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``quality_score`` and ``kept``; one pass, no shuffle."""
    small_batches(docs.sparkSession)
    added = [*COUNTS, "base_failed", "quality_score", "kept"]
    keep = [c for c in docs.columns if c not in added]
    at = keep.index(text)
    schema = T.StructType([
        *(docs.schema[c] for c in keep), *(T.StructField(c, T.LongType()) for c in COUNTS),
        T.StructField("base_failed", T.BooleanType()), T.StructField("quality_score", T.DoubleType()), T.StructField("kept", T.BooleanType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, text):
            counts, features = statistics(utf8_block(batch.column(at)))
            failed = (counts[:, 0] < 20) | (100 * counts[:, 4] > 30 * counts[:, 0])
            score = forest.probability(features)
            cols = [*batch.columns, *(pa.array(counts[:, j]) for j in range(len(COUNTS))), pa.array(failed), pa.array(score), pa.array(~failed & (score >= keep_at))]
            yield pa.RecordBatch.from_arrays(cols, schema.names)

    return docs.select(*keep).mapInArrow(releasing(run), schema)


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    forest = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(docs, forest).select("doc_id", *COUNTS, "base_failed", "kept", "quality_score")
