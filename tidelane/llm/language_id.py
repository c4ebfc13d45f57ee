"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary, learned from
the pieces of a bounded sample of its texts.  A word's probability is the sum, over all ways
to cut it into pieces, of the products of their probabilities; a forward pass over the
word's bytes adds them up.  A text's score is the sum of the logs of its words, and the
languages' scores become a posterior.  All distinct words of a block are scored together:
a byte trie finds the pieces that start at each place, and places advance in lockstep.

Defined cases: a text that is null or has no letter is ``und`` with score 0, and so is every
text if no language was learned.  Words of any length are summed over all
their segmentations; those too long for products of probabilities are summed as logs.  Repeated rows are scored once each; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelane.llm.bytetext import LOWER, SPACE_SEP, Block, any_names, blocks, releasing, row_of, small_batches, span_hashes, split_words, utf8_block
from tidelane.llm.sampling import crc_mod

#: Texts of each language that are learned from, about.
TRAIN_ROWS = 2000

#: Longest word, in bytes, whose probabilities are multiplied as such; bytes of a longer word looked up at once. Neither changes a result.
DIRECT, STRETCH = 64, 1 << 16

#: Added to every piece's count.
SMOOTH = 0.05

_MARK = 0  # stands before every word, as the vocabulary's word mark


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def piece_bytes(path: str) -> list[bytes]:
    """The bytes of each vocabulary entry; b'' for those that never stand in a text."""
    sp = _processor(path)
    out = []
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            out.append(bytes([int(piece[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i):
            out.append(b"")
        else:
            own = piece.replace("▁", "\0").encode()
            out.append(bytes(LOWER[np.frombuffer(own, np.uint8)]))
    return out


@dataclass
class Trie:
    """``child[node, byte]`` is the next node or -1; ``piece[node]`` the piece that ends there or -1; ``longest`` piece in bytes."""

    child: np.ndarray
    piece: np.ndarray
    longest: int

    @staticmethod
    def of(pieces: list[bytes]) -> Trie:
        nodes: list[dict[int, int]] = [{}]
        ends = [-1]
        for i, own in enumerate(pieces):
            at = 0
            for b in own:
                if b not in nodes[at]:
                    nodes[at][b] = len(nodes)
                    nodes.append({})
                    ends.append(-1)
                at = nodes[at][b]
            if own:
                ends[at] = i
        child = np.full((len(nodes), 256), -1, np.int32)
        for i, own in enumerate(nodes):
            child[i, list(own)] = list(own.values())
        return Trie(child, np.array(ends, np.int32), max(map(len, pieces), default=0))


@dataclass
class Model:
    """``weight[piece, language]`` probabilities of the ``languages``."""

    languages: list[str]
    weight: np.ndarray
    trie: Trie

    @property
    def direct(self) -> int:
        """Bytes, mark included, up to which no product of probabilities leaves the range of a double."""
        least = self.weight[self.weight > 0].min(initial=0.1)
        return max(1, min(DIRECT, int(290 / -np.log10(min(least, 0.1)))))

    def words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """(spans x languages) log probabilities of byte spans, each summed over all its segmentations."""
        length = end - start + 1
        out = np.zeros((len(start), len(self.languages)))
        short = length <= self.direct
        for own, scored in ((np.flatnonzero(short), self._short), (np.flatnonzero(~short), self._long)):
            if len(own):
                out[own] = scored(data, start[own], length[own])
        return out

    def _bytes(self, data: np.ndarray, start: np.ndarray, first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes ``first`` to ``stop`` of every marked word one after the other, and their bounds."""
        bounds = np.concatenate([[0], np.cumsum(stop - first)]).astype(np.int64)
        flat = np.repeat(start - 1 + first - bounds[:-1], stop - first) + np.arange(bounds[-1])
        text = data[np.maximum(flat, 0)]
        text[bounds[:-1][first == 0]] = _MARK
        return text, bounds

    def _found(self, text: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pieces that stand within the spans: where they begin, their bytes and their numbers."""
        last = np.repeat(bounds[1:], np.diff(bounds))
        at, node = np.arange(bounds[-1]), np.zeros(bounds[-1], np.int32)
        found = []
        for n in range(self.trie.longest):
            node = self.trie.child[node, text[at + n]]
            ok = node >= 0
            at, node = at[ok], node[ok]
            piece = self.trie.piece[node]
            hit = piece >= 0
            found.append((at[hit], np.full(hit.sum(), n + 1, np.int64), piece[hit]))
            more = at + n + 1 < last[at]
            at, node = at[more], node[more]
            if not len(at):
                break
        begin, size, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        return begin, size, piece

    def _in_turn(self, rel: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order of pieces by place and size, and where each place and size starts and ends in it."""
        key = rel * (self.trie.longest + 1) + size
        if len(key) and key.max() < 1 << 15:
            key = key.astype(np.int16)  # sorted by counting
        order = np.argsort(key, kind="stable")
        key = key[order]
        return order, np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, np.int64)

    def _short(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Words of up to ``direct`` bytes: sums of probabilities."""
        text, bounds = self._bytes(data, start, np.zeros_like(length), length)
        begin, size, piece = self._found(text, bounds)
        word = row_of(bounds)
        order, cuts = self._in_turn(begin - bounds[word[begin]], size)
        begin, size, piece = begin[order], size[order], piece[order]
        # One slot per boundary: word w has slots bounds[w] + w ... bounds[w + 1] + w.
        total = np.zeros((bounds[-1] + len(start), len(self.languages)))
        total[bounds[:-1] + np.arange(len(start))] = 1
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):  # within a place and size all ends differ
            slot = begin[a:b] + word[begin[a:b]]
            total[slot + size[a]] += total[slot] * self.weight[piece[a:b]]
        return np.log(np.maximum(total[bounds[1:] + np.arange(len(start))], 1e-300))

    def _long(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Longer words, of any length: sums of logs, with the boundaries that a piece can still reach in a ring.

        Stretches bound what is looked up at once; the ring is carried from each to the next.
        """
        ring, last = self.trie.longest + 1, np.argsort(-length, kind="stable")
        start, length = start[last], length[last]  # the longest first, so words that go on are the first ones
        total = np.full((len(start), ring, len(self.languages)), -np.inf)
        total[:, 0] = 0
        with np.errstate(divide="ignore"):
            log_weight = np.log(self.weight)
        for low in range(0, int(length[0]), STRETCH):
            running = np.searchsorted(-length, -low)
            stop = np.minimum(length[:running], low + STRETCH + self.trie.longest)
            text, bounds = self._bytes(data, start[:running], np.full_like(stop, low), stop)
            begin, size, piece = self._found(text, bounds)
            word = row_of(bounds)[begin]
            place = begin - bounds[word]
            own = place < STRETCH  # later ones were looked at for their bytes only
            place, size, piece, word = place[own], size[own], piece[own], word[own]
            order, cuts = self._in_turn(place, size)
            place, size, piece, word = place[order], size[order], piece[order], word[order]
            many = min(STRETCH, int(length[0]) - low)
            of_place = np.searchsorted(place[cuts[:-1]], np.arange(many + 1))
            going = np.searchsorted(-length, -(low + np.arange(many)))
            for k in range(many):
                here = (low + k) % ring
                for j in range(of_place[k], of_place[k + 1]):
                    a, b = cuts[j], cuts[j + 1]
                    who, there = word[a:b], (low + k + size[a]) % ring
                    total[who, there] = np.logaddexp(total[who, there], total[who, here] + log_weight[piece[a:b]])
                total[: going[k], here] = -np.inf
        out = np.empty((len(start), len(self.languages)))
        out[last] = total[np.arange(len(start)), length % ring]
        return np.where(np.isneginf(out), np.log(1e-300), out)  # a word with a byte that no piece has says nothing of its language

    def posterior(self, block: Block) -> np.ndarray:
        """(rows x languages); rows without words get equal shares."""
        data = LOWER[block.data]
        words = split_words(Block(data, block.bounds), SPACE_SEP)
        total = np.zeros((len(block), len(self.languages)))
        if len(words.start):
            hashes = span_hashes(data, words.start, words.end)
            _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            own = self.words(data, words.start[first], words.end[first])
            rows = row_of(words.bounds)
            for j in range(total.shape[1]):
                total[:, j] = np.bincount(rows, own[inverse, j], len(block))
        total = np.exp(total - total.max(axis=1, keepdims=True))
        return total / total.sum(axis=1, keepdims=True)


def train(docs: DataFrame, bound: int = TRAIN_ROWS, vocabulary: str | None = None, usable: Column | None = None) -> Model:
    """Learn from about ``bound`` texts of each language, taken by the hash of doc_id.

    Only piece counts per language reach the driver: languages x vocabulary numbers.
    """
    small_batches(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    known = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if usable is not None:
        known = known.where(usable)
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    pieces = piece_bytes(path)
    trie = Trie.of(pieces)
    if not sizes:
        return Model([], np.zeros((len(pieces), 0)), trie)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    rate = F.coalesce(*(F.when(F.col("lang") == k, F.lit(min(1.0, bound / n))) for k, n in sizes.items()))
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("piece", T.IntegerType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = _processor(path)
        for batch in blocks(batches):
            langs = np.array(batch.column(0).to_pylist())
            for lang in np.unique(langs):
                texts = [bytes(LOWER[np.frombuffer(t.encode("utf-8", "replace"), np.uint8)]).decode() for t, own in zip(batch.column(1).to_pylist(), langs, strict=True) if own == lang]
                ids, n = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.array(x, np.int64) for x in sp.encode(texts, num_threads=1))]).astype(np.int32), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([str(lang)] * len(ids)), pa.array(ids), pa.array(n)], schema.names)

    counted = known.where(draw < rate * (1 << 30)).select("lang", "text").mapInArrow(releasing(run), schema).groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(sizes)
    counts = np.zeros((len(pieces), len(languages)))
    np.add.at(counts, (counted["piece"].to_numpy(), np.searchsorted(languages, counted["lang"].to_pylist())), counted["n"].to_numpy())
    # The vocabulary has some entries that differ by case only: the trie ends at the last of them, so it gets their sum.
    last = {own: i for i, own in enumerate(pieces) if own}
    merged = np.zeros_like(counts)
    np.add.at(merged, [last.get(own, 0) for own in pieces], counts * np.array([bool(own) for own in pieces])[:, None])
    used = np.zeros(len(pieces), bool)
    used[list(last.values())] = True
    weight = np.where(used[:, None], merged + SMOOTH, 0)
    return Model(languages, weight / weight.sum(axis=0), trie)


@any_names("lang_pred", "lang_score")
def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score``; one pass, no shuffle."""
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in ("lang_pred", "lang_score")]
    at = keep.index(text)
    fields = [docs.schema[c] for c in keep]
    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # vocabulary x languages, and the vocabulary's trie
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("__letters")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in blocks(batches, text):
            some = batch.column(len(keep)).to_numpy(zero_copy_only=False) & bool(own.languages)
            label, score = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows)
            if some.any():
                p = own.posterior(utf8_block(batch.column(at)))
                best = p.argmax(axis=1)
                label[some] = np.array(own.languages, object)[best[some]]
                score[some] = p.max(axis=1)[some]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(label, pa.string()), pa.array(score)], schema.names)

    return docs.select(*keep, letters).mapInArrow(releasing(run), schema)


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, usable=crc_mod("doc_id", 4) != 2)
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
